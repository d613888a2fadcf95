"""Removal of words in repeated 13-word windows: super-k-mers travel to the bucket of their minimiser."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from seacast.llm.blocks import NO_ID, POWERS, covered, mixed, pack, ragged, sliding_min, slices, unpack

#: Windows of one super-k-mer at most; a longer run goes on in the next one.
RUN = 64
#: Bytes of text that a task holds at once, buckets that a task sorts one after the other, and bytes of text for these.
SLICE, SUB, TASK = 3 << 20, 2, 128 << 20
#: Windows in distinct runs of one minimiser above which they go in blocks; one in so many documents is counted, longer texts always.
HOT, SAMPLE, LONG = 1 << 15, 8, 1 << 16
#: Words of a slice that are joined at once, and bits of a window's hash by which a bucket's windows are sorted in parts.
WORDS, PART_BITS = 1 << 18, 3
SPANS = "doc_id bigint, tag int, start int, size int"


def word_lists(texts: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All words, and for each text where its words begin, with the end."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").combine_chunks().cast(pa.string()))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not real.all():
        flat, offsets = flat.filter(pa.array(real)), np.concatenate([[0], np.cumsum(real)])[offsets]
    return flat, offsets.astype(np.int64)


def word_hashes(flat: pa.Array) -> np.ndarray:
    coded = flat.dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return table[coded.indices.to_numpy()] if len(table) else np.zeros(0, np.uint64)


class Hot:
    """Common keys and how many consecutive windows of each travel together."""

    def __init__(self, found: dict[int, int] | None = None):
        names = sorted(found or {})
        self.names, self.widths = np.array(names, np.uint64), np.array([found[k] for k in names], np.int64)

    def at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the names, whether it is there) of each key."""
        at = np.minimum(np.searchsorted(self.names, keys), len(self.names) - 1)
        return at, self.names[at] == keys

    def dealt(self, prefix: np.ndarray, window: int, grams: np.ndarray, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray, inner: np.ndarray | None = None, spot: np.ndarray | None = None):
        """(start, windows, key, inner, spot) of the runs, in the order of starts, those of common keys cut into blocks; ``spot``
        is where the key's gram lies in the run.

        A block has the windows whose key (the first place where its gram occurs in the window) lies in the same
        place, but for ``width`` steps. All of them hold the same core, and equal windows lie in blocks
        with equal cores, so a block goes by its key and the hash of its core. No window occurs twice in a block.
        """
        if not len(self.names) or not len(starts):
            return starts, sizes, keys, inner, spot
        at, hot = self.at(keys)
        if not hot.any():
            return starts, sizes, keys, inner, spot
        runs = np.flatnonzero(hot)
        begin, of = ragged(starts[runs], sizes[runs]).astype(np.int64), np.repeat(runs, sizes[runs])
        key, width = keys[of], self.widths[at[of]]
        places = np.flatnonzero(self.at(grams)[1])
        next_one = np.searchsorted(places, begin)
        while (wrong := grams[places[next_one]] != key).any():
            next_one[wrong] += 1
        place = places[next_one]
        block = (place - begin) // width
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(of) != 0) | (np.diff(place) != 0) | (np.diff(block) != 0)]))
        counts = np.diff(np.append(heads, len(begin)))
        core = place[heads] - block[heads] * width[heads]
        named = POWERS.ranges(prefix, core, core - width[heads] + 1 + window)
        named = mixed(key[heads] ^ mixed(named + block[heads].astype(np.uint64)))
        starts, sizes, keys = np.concatenate([starts[~hot], begin[heads]]), np.concatenate([sizes[~hot], counts]), np.concatenate([keys[~hot], named])
        order = np.argsort(starts, kind="stable")
        if inner is not None:
            inner = np.concatenate([inner[~hot], np.zeros(len(heads), bool)])[order]
            spot = np.concatenate([spot[~hot], (place - begin)[heads]])[order]
        return starts[order], sizes[order], keys[order], inner, spot


class KeySizes:
    """The map side of :func:`hot_keys`: (key, run, n) of the distinct runs of a slice."""

    def __init__(self, runs, limit: int):
        self.runs, self.limit = runs, limit

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, self.limit):
            row, keys, run, sizes = self.runs(table["text"])
            _, one = np.unique(keys ^ mixed(run), return_index=True)
            sizes = sizes[one] * table["share"].to_numpy()[row[one]]
            yield pa.RecordBatch.from_arrays([pa.array(keys[one].view(np.int64)), pa.array(run[one].view(np.int64)), pa.array(sizes, pa.int64())], ["key", "run", "n"])


def hot_keys(rows: DataFrame, runs, limit: int, most: int, widths: tuple[int, ...]) -> Hot:
    """The keys whose distinct runs have a size of more than ``most``, as estimated from one in ``SAMPLE`` documents and all long ones.

    They decide only where windows meet, never which are counted. Up to 64 times ``most`` a key's windows go in blocks
    of the first of ``widths``, up to 64 times more in blocks of the second and so on. There are at most (size of the
    table / ``most``) keys; callers let ``most`` grow with the size of the table per bucket, so that is a few a bucket.
    """
    long = F.coalesce(F.octet_length("text") > LONG, F.lit(False))
    sample = rows.where(long | (F.pmod(F.xxhash64("doc_id", "tag"), F.lit(SAMPLE)) == 0)).withColumn("share", F.when(long, 1).otherwise(SAMPLE).cast("long"))
    found = sample.mapInArrow(KeySizes(runs, limit), "key bigint, run bigint, n bigint").groupBy("key", "run").agg(F.min("n").alias("n"))
    sums = found.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    return Hot({r.key % (1 << 64): next((w for k, w in enumerate(widths) if r.n <= most * 64 ** (k + 1)), widths[-1]) for r in sums.collect()})


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


class SuperKmers:
    """The map side: a slice of documents to one packed value per bucket."""

    def __init__(self, window: int, minimiser: int, buckets: int, hot: Hot | None = None):
        self.window, self.minimiser, self.buckets, self.hot = window, minimiser, buckets, hot or Hot()

    def sizes(self, texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, minimiser, hash of the words, windows) of each run."""
        flat, offsets = word_lists(texts)
        hashes = word_hashes(flat)
        starts, sizes, lows, _ = self.runs(hashes, offsets)
        run = POWERS.ranges(POWERS.prefix(hashes), starts, starts + sizes + self.window - 1) if len(starts) else lows
        return np.searchsorted(offsets, starts, side="right") - 1, lows, run, sizes

    def runs(self, hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, windows, minimiser) of each run of windows of one document that share a minimiser, and the hashes of all grams."""
        w, m = self.window, self.minimiser
        n = len(hashes) - w + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        grams = mixed(sum(hashes[i : len(hashes) - m + 1 + i] * np.uint64(2 * i + 3) ** np.uint64(9) for i in range(m)))
        lows = sliding_min(grams, w - m + 1)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        valid = doc[:n] == doc[w - 1 :]
        fresh = valid.copy()
        fresh[1:] &= ~valid[:-1] | (lows[1:] != lows[:-1])
        place = np.arange(n) - np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        starts = np.flatnonzero(valid & (place % RUN == 0))
        sizes = np.add.reduceat(valid, starts, dtype=np.int64) if len(starts) else starts
        return starts, sizes, lows[starts], grams

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, SLICE):
            ids = pc.fill_null(table["doc_id"], NO_ID).to_numpy()
            order = np.argsort(ids, kind="stable")
            table, ids = table.take(order), ids[order]
            flat, offsets = word_lists(table["text"])
            hashes = word_hashes(flat)
            starts, sizes, lows, grams = self.runs(hashes, offsets)
            starts, sizes, lows, _, _ = self.hot.dealt(POWERS.prefix(hashes), self.window, grams, starts, sizes, lows)
            lengths = sizes + self.window - 1 if len(sizes) else sizes
            row = np.searchsorted(offsets, starts, side="right") - 1
            tags = table["tag"].to_numpy()
            sent, removed = self.collapse(hashes, starts, lengths, lows, ids[row])
            yield from self.packed(flat, offsets, ids, tags, row, starts, sizes, lengths, lows, sent, removed)

    def collapse(self, hashes, starts, lengths, lows, ids) -> tuple[np.ndarray, np.ndarray]:
        """(sent, removed): of equal runs of words in this slice the ones in the first document are sent; the
        others have a smaller document right here, so all of their words go."""
        if not len(starts):
            return np.zeros(0, bool), np.zeros(0, bool)
        prefix = POWERS.prefix(hashes)
        key = mixed(POWERS.ranges(prefix, starts, starts + lengths) ^ lows) + lengths.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        head = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        twin = np.empty(len(order), np.int64)
        twin[order] = first
        later = np.flatnonzero((twin != np.arange(len(twin))) & (ids > ids[twin]) & (lengths == lengths[twin]))
        equal = np.add.reduceat(
            hashes[ragged(starts[later], lengths[later])] != hashes[ragged(starts[twin[later]], lengths[later])],
            np.cumsum(lengths[later]) - lengths[later], dtype=np.int64,
        ) == 0 if len(later) else np.zeros(0, bool)
        removed = np.zeros(len(starts), bool)
        removed[later[equal]] = True
        return ~removed, removed

    def packed(self, flat, offsets, ids, tags, row, starts, sizes, lengths, lows, sent, removed) -> Iterator[pa.RecordBatch]:
        bucket = (mixed(lows) % np.uint64(self.buckets)).astype(np.int64)
        there = np.flatnonzero(sent)
        there = there[np.argsort(bucket[there], kind="stable")]
        gone = np.flatnonzero(removed)
        home = mixed(row[gone].astype(np.uint64)) % np.uint64(self.buckets) if len(gone) else np.zeros(0, np.uint64)
        gone, home = gone[np.argsort(home, kind="stable")], np.sort(home).astype(np.int64)
        names = np.union1d(bucket[there], home)
        a, b, c, d = (np.searchsorted(x, names, side=s) for x in (bucket[there], home) for s in ("left", "right"))
        edges = np.concatenate([[0], np.cumsum(lengths[there])])
        groups = np.flatnonzero(np.diff(edges[a] // WORDS, prepend=-1)) if len(names) else a
        values = []
        for first, last in zip(groups, np.append(groups[1:], len(names))):
            sent = there[a[first] : b[last - 1]]
            words = flat.take(pa.array(ragged(starts[sent], lengths[sent])))
            at = np.append(edges[a[first:last]], edges[b[last - 1]]) - edges[a[first]]
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), words), " ")
            for k in range(first, last):
                t, g = there[a[k] : b[k]], gone[c[k] : d[k]]
                values.append(pack(
                    np.diff(ids[row[t]], prepend=0), tags[row[t]], (starts[t] - offsets[row[t]]).astype(np.int32), sizes[t].astype(np.uint8),
                    joined[k - first].as_buffer().to_pybytes(),
                    np.diff(ids[row[g]], prepend=0), tags[row[g]], (starts[g] - offsets[row[g]]).astype(np.int32), lengths[g].astype(np.uint8),
                ))
        if values:
            yield pa.RecordBatch.from_arrays([pa.array((names // SUB).astype(np.int32)), pa.array(names), pa.array(values, pa.binary())], ["part", "bucket", "value"])


class Counted:
    """The bucket side: sorts the windows of a bucket and reports those that a smaller document has too."""

    def __init__(self, window: int):
        self.window = window

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []
        for batch in batches:
            for bucket, value in zip(batch.column("bucket").to_pylist(), batch.column("value")):
                if bucket != name and held:
                    yield from self.bucket(held)
                    held = []
                name = bucket
                held.append(unpack(value.as_buffer()))
        if held:
            yield from self.bucket(held)

    def bucket(self, parts: list[list[memoryview]]) -> Iterator[pa.RecordBatch]:
        def column(k: int, kind) -> np.ndarray:
            return np.concatenate([np.frombuffer(p[k], kind) for p in parts])

        def ids(k: int) -> np.ndarray:
            return np.concatenate([np.cumsum(np.frombuffer(p[k], np.int64)) for p in parts])

        gone = ids(5), column(6, np.int32), column(7, np.int32), column(8, np.uint8)
        yield spans(*gone)
        doc, tag, start, size = ids(0), column(1, np.int32), column(2, np.int32), column(3, np.uint8).astype(np.int64)
        if not len(doc):
            return
        texts = pa.array([str(p[4], "utf-8") for p in parts if len(p[4])], pa.large_string())
        codes = pc.split_pattern(texts, " ").flatten().dictionary_encode().indices.to_numpy()
        begin = np.cumsum(size + self.window - 1) - (size + self.window - 1)
        order = np.argsort(doc, kind="stable")
        owner = np.repeat(order, size[order])
        at = ragged(begin[order], size[order])
        flagged = np.flatnonzero(self.repeated(codes, at, doc[owner]))
        if not len(flagged):
            return
        place = at[flagged] - begin[owner[flagged]]
        fresh = np.concatenate([[True], (np.diff(owner[flagged]) != 0) | (np.diff(place) != 1)])
        firsts = np.flatnonzero(fresh)
        runs = np.diff(np.append(firsts, len(flagged)))
        of = owner[flagged[firsts]]
        yield spans(doc[of], tag[of], start[of] + place[firsts], runs + self.window - 1)

    def repeated(self, codes: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether the window at each place also starts in a smaller document; windows come in document order."""
        prefix = POWERS.prefix(mixed(codes.astype(np.uint64) + np.uint64(1)))
        key = POWERS.ranges(prefix, at, at + self.window)
        del prefix
        out, part = np.empty(len(at), bool), (mixed(key) >> np.uint64(64 - PART_BITS)).astype(np.uint8)
        for k in range(1 << PART_BITS):
            mine = np.flatnonzero(part == k)
            out[mine] = self.sorted_windows(codes, at[mine], doc[mine], key[mine])
        return out

    def sorted_windows(self, codes: np.ndarray, at: np.ndarray, doc: np.ndarray, key: np.ndarray) -> np.ndarray:
        """:meth:`repeated` for windows that have no equal one elsewhere."""
        order = np.argsort(key, kind="stable")
        tie = key[order][1:] == key[order][:-1]
        pair = np.flatnonzero(tie)
        for i in range(self.window):
            if (codes[at[order[pair]] + i] != codes[at[order[pair + 1]] + i]).any():  # two windows with one hash: sort by the words
                order = np.lexsort([codes[at + j] for j in reversed(range(self.window))])
                tie = np.logical_and.reduce([codes[at[order[1:]] + j] == codes[at[order[:-1]] + j] for j in range(self.window)])
                break
        head = np.maximum.accumulate(np.where(np.concatenate([[True], ~tie]), np.arange(len(order)), 0))
        out = np.empty(len(order), bool)
        out[order] = doc[order] > doc[order[head]]
        return out


def spans(doc, tag, start, size) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(tag, pa.int32()), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], ["doc_id", "tag", "start", "size"])


def without_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text without the words in its spans, the others joined by one space."""
    for table in slices(batches, SLICE):
        flat, offsets = word_lists(table["text"])
        lists = table["spans"].combine_chunks()
        first, inner = np.repeat(offsets[:-1], pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)), lists.flatten()
        keep = ~covered(len(flat), first + inner.field("start").to_numpy(), inner.field("size").to_numpy())
        kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), flat.filter(pa.array(keep))), " ")
        n = np.diff(offsets)
        yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array(n), pa.array(n - np.diff(kept)), text], ["doc_id", "n_words", "n_removed", "kept_text"])


def tagged(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tag): the tag tells rows of one doc_id apart, so that equal rows get equal results."""
    return docs.select(F.col("doc_id").cast("long"), "text", F.hash(F.col("doc_id").isNull(), "text").alias("tag"))


def gathered(found: DataFrame) -> DataFrame:
    """Spans by document; a document's own spans bound the list."""
    return found.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "size")).alias("spans"))


def joined(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Documents with their spans (null: none)."""
    by = gathered(found).withColumnsRenamed({"doc_id": "_id", "tag": "_tag"})
    return docs.join(by, (F.coalesce("doc_id", F.lit(int(NO_ID))) == F.col("_id")) & (F.col("tag") == F.col("_tag")), "left").select("doc_id", "text", "spans")


def window_spans(docs: DataFrame, window: int = 13, minimiser: int = 3, buckets: int | None = None) -> DataFrame:
    """(doc_id, tag, start, size): word ranges whose every window also starts in a document with a smaller doc_id."""
    total = text_bytes(docs)
    parts = buckets or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK))
    rows = tagged(docs)
    # A word takes some eight bytes; more than a quarter of a bucket's windows is too much for one key.
    hot = hot_keys(rows, SuperKmers(window, minimiser, parts).sizes, SLICE, max(HOT, total // (32 * parts * SUB)), (4, 1))
    sent = rows.mapInArrow(SuperKmers(window, minimiser, parts * SUB, hot), "part int, bucket bigint, value binary")
    return sent.repartitionById(parts, F.col("part")).sortWithinPartitions("bucket").mapInArrow(Counted(window), SPANS)


def substring_dedup(docs: DataFrame, window: int = 13, minimiser: int = 3, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): texts without the words covered by a window whose words also start in a
    document with a smaller doc_id. Windows are judged on the input.

    Consecutive windows with one minimiser (the least hash of ``minimiser`` words) travel as one packed
    string; a bucket sorts all windows of its minimisers and compares their words. The windows of a very
    common minimiser travel in blocks, dealt by a hash of the words that all of a block have. Equal strings of a
    slice travel once, from the slice's smallest document. A null text has no words; a null doc_id comes
    after all ids and rows with null ids do not count against each other; rows of one doc_id do not
    either. Only doc_id and text are read, so other columns cannot clash.
    """
    rows = tagged(docs)
    return joined(rows, window_spans(docs, window, minimiser, buckets)).mapInArrow(without_words, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")
