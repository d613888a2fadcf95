"""Removal of repeated 200-byte strings by suffix arrays sorted in two stages."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from seacast.llm.blocks import POWERS, covered, mixed, pack, ragged, sliding_min, slices, unpack
from seacast.llm.superkmer import SPANS, TASK, Hot, hot_keys, joined, spans, tagged, text_bytes

#: Bytes of an anchor; starts of one segment at most; bytes of text held at once; buckets that a task sorts one after the other.
GRAM, RUN, SLICE, SUB = 24, 1024, 2 << 20, 2
#: Bytes of distinct segments after which a suffix array takes no further anchor. An anchor with more bytes than that travels in blocks of windows.
BLOCK = 1 << 19
#: Segments whose bytes are hashed at once in a bucket.
PART = 2_048
#: A random value for each byte.
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` (bytes) in the order of the ``depth`` bytes from each; ties in any order.

    Two stages. Suffixes that are smaller than their successor are sorted directly. The others follow
    from one scan of the buckets of first bytes, in order: an entry i of a bucket puts i - 1, where that
    is larger than i, at the next free place of its own bucket, which is never an earlier one.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    change = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    end = np.repeat(change, np.diff(change, prepend=-1))
    small = (end < n - 1) & (text[end] < text[np.minimum(end + 1, n - 1)])
    direct = np.flatnonzero(small)
    raw = text.tobytes()
    keys = [raw[i : i + depth] for i in direct.tolist()]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)]
    del keys
    edges = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[-1]].append(np.array([n - 1]))
    out = []

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~small[before]]
        if len(before):
            firsts = text[before]
            order = np.argsort(firsts, kind="stable")
            before, firsts = before[order], firsts[order]
            cuts = np.flatnonzero(np.diff(firsts)) + 1
            for part in np.split(before, cuts):
                induced[text[part[0]]].append(part)

    for byte in range(256):
        while induced[byte]:  # again while runs of this byte are induced
            found = np.concatenate(induced[byte])
            induced[byte].clear()
            out.append(found)
            induce(found)
        own = direct[edges[byte] : edges[byte + 1]]
        out.append(own)
        induce(own)
    return np.concatenate(out)


def same_prefix(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether neighbours in ``order`` have ``depth`` bytes in common; positions too near to the end have not."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    words = sum(padded[i : i + len(text)] << np.uint64(56 - 8 * i) for i in range(8))
    alive = np.flatnonzero((order[1:] + depth <= len(text)) & (order[:-1] + depth <= len(text)))
    for at in [*range(0, depth - 7, 8), depth - 8]:
        alive = alive[words[order[alive] + at] == words[order[alive + 1] + at]]
    out = np.zeros(len(order) - 1, bool)
    out[alive] = True
    return out


class Segments:
    """The map side: consecutive windows whose least anchor is the same become one segment for the anchor's bucket."""

    def __init__(self, depth: int, buckets: int, hot: Hot | None = None):
        self.depth, self.buckets, self.hot = depth, buckets, hot or Hot()

    def sizes(self, texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, hash of the bytes, number of bytes) of each segment."""
        _, prefix, offsets = self.bytes(texts)
        starts, sizes, anchors, *_ = self.runs(prefix, offsets)
        lengths = sizes + self.depth - 1
        return np.searchsorted(offsets, starts, side="right") - 1, anchors, POWERS.ranges(prefix, starts, starts + lengths), lengths

    def bytes(self, texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, their prefix hashes, where each text begins, with the end)."""
        texts = pc.fill_null(texts, "").combine_chunks().cast(pa.large_binary())
        offsets = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())]).astype(np.int64)
        data = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
        return data, POWERS.prefix(_BYTES[data]), offsets

    def runs(self, prefix: np.ndarray, offsets: np.ndarray):
        """(start, windows, anchor, inner, spot) of each segment and the hashes of all grams; ``inner``: a window may occur in it
        twice; ``spot``: where the anchor lies in the segment, -1 if that is not the same place for all its windows."""
        size, width = len(prefix) - 1, self.depth - GRAM + 1
        n = size - self.depth + 1
        none = np.zeros(0, np.int64)
        if n <= 0:
            return none, none, np.zeros(0, np.uint64), np.zeros(0, bool), none, np.zeros(0, np.uint64)
        grams = mixed((prefix[GRAM:] - prefix[:-GRAM]) * POWERS.downs(size - GRAM + 1))
        lows = sliding_min(grams, width)
        valid = np.ones(n, bool)
        ends, lengths = offsets[1:], np.diff(offsets)
        valid_edges = np.maximum(ends - self.depth + 1, offsets[:-1])
        short = np.minimum(ends, n) - np.minimum(valid_edges, n)
        valid[ragged(np.minimum(valid_edges, n), short)] = False
        fresh = valid.copy()
        fresh[1:] &= ~valid[:-1] | (lows[1:] != lows[:-1])
        # Runs of windows with one anchor begin at a fresh one and end before the next or where windows reach into the next text.
        heads = np.flatnonzero(fresh)
        if not len(heads):
            return none, none, np.zeros(0, np.uint64), np.zeros(0, bool), none, grams
        runs = np.minimum(np.append(heads[1:], n), valid_edges[np.searchsorted(offsets, heads, side="right") - 1]) - heads
        cuts = -(-runs // RUN)
        starts = np.repeat(heads, cuts) + RUN * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
        sizes = np.minimum(np.repeat(heads + runs, cuts) - starts, RUN)
        # A window that occurs twice in a segment has its anchor both at a start and at an end of windows of the segment.
        first, last = np.full(len(starts), size), np.full(len(starts), -1)
        begins, ends = (np.flatnonzero((x == lows) & valid) for x in (grams[:n], grams[width - 1 :]))
        np.minimum.at(first, np.searchsorted(starts, begins, side="right") - 1, begins)
        np.maximum.at(last, np.searchsorted(starts, ends, side="right") - 1, ends + width - 1)
        spot = starts + sizes - 1
        spot = spot + np.concatenate([(grams[part[:, None] + np.arange(width)] == lows[part][:, None]).argmax(axis=1) for part in np.array_split(spot, len(spot) // 2048 + 1)])
        several = ((first < size) & (first != spot)) | ((last >= 0) & (last != spot))
        return starts, sizes, lows[starts], (first < size) & (last >= 0) & (first != last), np.where(several, -1, spot - starts), grams

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, SLICE):
            ids, tags = pc.fill_null(table["doc_id"], np.iinfo(np.int64).max).to_numpy(), table["tag"].to_numpy()
            data, prefix, offsets = self.bytes(table["text"])
            *runs, inner, spot, grams = self.runs(prefix, offsets)
            starts, sizes, anchors, inner, spot = self.hot.dealt(prefix, self.depth, grams, *runs, inner, spot)
            if not len(starts):
                continue
            lengths = sizes + self.depth - 1
            row = np.searchsorted(offsets, starts, side="right") - 1
            sent, counted, twins = self.collapse(data, prefix, starts, lengths, anchors)
            yield from self.packed(data, offsets, ids, tags, row, starts, sizes, lengths, anchors, inner, spot, sent, counted, twins)

    def collapse(self, data, prefix, starts, lengths, anchors):
        """(sent, copies, known): one of equal segments is sent with their number; all of them are known to occur again."""
        key = mixed(POWERS.ranges(prefix, starts, starts + lengths) ^ anchors) + lengths.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        head = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        twin = np.empty(len(order), np.int64)
        twin[order] = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        later = np.flatnonzero((twin != np.arange(len(twin))) & (lengths == lengths[twin]))
        sent, copies = np.ones(len(starts), bool), np.ones(len(starts), np.int32)
        if len(later):
            differ = data[ragged(starts[later], lengths[later])] != data[ragged(starts[twin[later]], lengths[later])]
            equal = later[np.add.reduceat(differ, np.cumsum(lengths[later]) - lengths[later], dtype=np.int64) == 0]
            sent[equal] = False
            np.add.at(copies, twin[equal], 1)
        return sent, copies, ~sent | (copies > 1)

    def packed(self, data, offsets, ids, tags, row, starts, sizes, lengths, anchors, inner, spot, sent, copies, known) -> Iterator[pa.RecordBatch]:
        bucket = (anchors % np.uint64(self.buckets)).astype(np.int64)
        there = np.flatnonzero(sent)
        there = there[np.argsort(bucket[there], kind="stable")]
        gone = np.flatnonzero(known)
        home = (mixed(row[gone].astype(np.uint64)) % np.uint64(self.buckets)).astype(np.int64)
        gone, home = gone[np.argsort(home, kind="stable")], np.sort(home)
        names = np.union1d(bucket[there], home)
        a, b, c, d = (np.searchsorted(x, names, side=s) for x in (bucket[there], home) for s in ("left", "right"))
        values = []
        for k in range(len(names)):
            t, g = there[a[k] : b[k]], gone[c[k] : d[k]]
            values.append(pack(
                np.diff(ids[row[t]], prepend=0), tags[row[t]], (starts[t] - offsets[row[t]]).astype(np.int32), sizes[t].astype(np.int32),
                (anchors[t] >> np.uint64(32)).astype(np.uint32), inner[t], copies[t], data[ragged(starts[t], lengths[t])],
                np.diff(ids[row[g]], prepend=0), tags[row[g]], (starts[g] - offsets[row[g]]).astype(np.int32), lengths[g].astype(np.int32),
                spot[t].astype(np.int32),
            ))
        yield pa.RecordBatch.from_arrays([pa.array((names // SUB).astype(np.int32)), pa.array(names), pa.array(values, pa.binary())], ["part", "bucket", "value"])


class Repeated:
    """The bucket side: suffix arrays over the distinct segments of anchors that occur more than once."""

    def __init__(self, depth: int):
        self.depth = depth

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

        yield spans(ids(8), column(9, np.int32), column(10, np.int32), column(11, np.int32))
        doc, tag, start, size = ids(0), column(1, np.int32), column(2, np.int32), column(3, np.int32).astype(np.int64)
        anchor, inner, copies, data = column(4, np.uint32), column(5, bool), column(6, np.int32), column(7, np.uint8)
        if not len(doc):
            return
        begin = np.cumsum(size + self.depth - 1) - (size + self.depth - 1)
        _, group, count = np.unique(anchor, return_inverse=True, return_counts=True)
        kept = np.flatnonzero(((count[group] > 1) & self.beside(data, begin, size, group, inner, column(12, np.int32))) | inner | (copies > 1))
        kept = kept[np.argsort(group[kept], kind="stable")]
        raw = data.tobytes()
        held: dict[bytes, list[tuple[int, int]]] = {}
        size_held = 0
        for one in np.split(kept, np.flatnonzero(np.diff(group[kept])) + 1):
            texts: dict[bytes, list[tuple[int, int]]] = {}
            for s in one.tolist():
                texts.setdefault(raw[begin[s] : begin[s] + size[s] + self.depth - 1], []).append((s, 0))
            total = sum(map(len, texts))
            if total > BLOCK:
                texts = self.trimmed(texts, copies)
                total = sum(map(len, texts))
            held |= texts  # texts of two anchors are never equal
            size_held += total
            if size_held >= BLOCK:
                yield from self.block(held, doc, tag, start, copies)
                held, size_held = {}, 0
        if held:
            yield from self.block(held, doc, tag, start, copies)

    def beside(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, group: np.ndarray, inner: np.ndarray, spot: np.ndarray) -> np.ndarray:
        """Whether a segment may have a window in common with another one of its anchor.

        A window reaches at least half of what it has besides the anchor to one side of it, so two segments with a
        common window have the same bytes there, before or behind the anchor. Where an anchor has a segment
        without a single place for it, all of its segments may.
        """
        reach = (self.depth - GRAM) // 2
        end, at = begin + size + self.depth - 1, begin + spot
        whole = np.bincount(group, (spot < 0) | inner, int(group.max()) + 1)[group] > 0
        out = whole.copy()
        for start, stop in ((at, at + GRAM + reach), (at - reach, at + GRAM)):
            there = ~whole & (start >= begin) & (stop <= end)
            key = np.zeros(len(begin), np.uint64)
            for first in range(0, len(begin), PART):  # prefix hashes of some segments at a time
                some = slice(first, first + PART)
                base = begin[first]
                mine = first + np.flatnonzero(there[some])
                prefix = POWERS.prefix(_BYTES[data[base : end[some][-1]]])
                key[mine] = mixed(POWERS.ranges(prefix, start[mine] - base, stop[mine] - base) ^ mixed(group[mine].astype(np.uint64)))
            there = np.flatnonzero(there)
            if len(there):
                _, of, times = np.unique(key[there], return_inverse=True, return_counts=True)
                out[there] |= times[of] > 1
        return out

    def trimmed(self, texts: dict[bytes, list[tuple[int, int]]], copies: np.ndarray) -> dict[bytes, list[tuple[int, int]]]:
        """The texts of a large group without the windows whose hash occurs once: these occur once for certain, the
        suffix array decides about the others. What documents have around a common passage falls away here."""
        text = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begin, windows = np.cumsum(lengths) - lengths, lengths - self.depth + 1
        at = ragged(begin, windows).astype(np.int64)
        of = np.repeat(np.arange(len(texts)), windows)
        key = POWERS.ranges(POWERS.prefix(_BYTES[text]), at, at + self.depth)
        weight = np.array([sum(int(copies[s]) for s, _ in m) for m in texts.values()], np.int64)
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
        again = np.empty(len(key), bool)
        again[order] = np.repeat(np.add.reduceat(weight[of[order]], heads) > 1, np.diff(np.append(heads, len(key))))
        kept = np.flatnonzero(again)
        if not len(kept):
            return {}
        firsts = np.flatnonzero(np.concatenate([[True], (np.diff(kept) != 1) | (np.diff(of[kept]) != 0)]))
        counts = np.diff(np.append(firsts, len(kept)))
        raw, members, out = text.tobytes(), list(texts.values()), {}
        for a, n in zip(kept[firsts].tolist(), counts.tolist()):
            i, place = int(of[a]), int(at[a])
            out.setdefault(raw[place : place + n + self.depth - 1], []).extend((s, skip + place - int(begin[i])) for s, skip in members[i])
        return out

    def block(self, texts: dict[bytes, list[tuple[int, int]]], doc, tag, start, copies) -> Iterator[pa.RecordBatch]:
        """Spans of the segments whose windows occur more than once, counting equal segments."""
        members = [np.array(m, np.int64) for m in texts.values()]
        text = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        weights = np.array([copies[m[:, 0]].sum() for m in members], np.int64)
        begin = np.cumsum(lengths) - lengths
        weight = np.zeros(len(text), np.int64)
        weight[ragged(begin, lengths - self.depth + 1)] = np.repeat(weights, lengths - self.depth + 1)
        order = suffix_array(text, self.depth)
        head = np.concatenate([[0], np.flatnonzero(~same_prefix(text, order, self.depth)) + 1])
        totals = np.add.reduceat(weight[order], head)
        again = np.zeros(len(text), bool)
        again[order] = np.repeat(totals > 1, np.diff(np.append(head, len(order))))
        at = np.flatnonzero(again & (weight > 0))
        if not len(at):
            return
        of = np.searchsorted(begin, at, side="right") - 1
        fresh = np.concatenate([[True], (np.diff(of) != 0) | (np.diff(at) != 1)])
        firsts = np.flatnonzero(fresh)
        runs = np.diff(np.append(firsts, len(at))) + self.depth - 1
        of, place = of[firsts], at[firsts] - begin[of[firsts]]
        many = np.array([len(members[i]) for i in of])
        who = np.concatenate([members[i] for i in of])
        yield spans(doc[who[:, 0]], tag[who[:, 0]], start[who[:, 0]] + who[:, 1] + np.repeat(place, many), np.repeat(runs, many))


def without_bytes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text without the bytes in its spans."""
    for table in slices(batches, SLICE):
        texts = pc.fill_null(table["text"], "").combine_chunks().cast(pa.large_binary())
        lengths = pc.binary_length(texts).to_numpy()
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        data = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
        lists = table["spans"].combine_chunks()
        first, inner = np.repeat(offsets[:-1], pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)), lists.flatten()
        gone = covered(len(data), first + inner.field("start").to_numpy(), inner.field("size").to_numpy())
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        begins[offsets[:-1][lengths > 0]] = gone[offsets[:-1][lengths > 0]]
        kept, removed, runs = data[~gone].tobytes(), *(np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]) for x in (gone, begins))
        ends = np.cumsum(lengths - removed)
        left = [kept[a:b] for a, b in zip((ends - (lengths - removed)).tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays(
            [table["doc_id"].combine_chunks(), pa.array(lengths.astype(np.int64)), pa.array(removed), pa.array(runs), pa.array(left, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes"],
        )


def repeated_spans(docs: DataFrame, depth: int = 200, buckets: int | None = None) -> DataFrame:
    """(doc_id, tag, start, size): byte ranges whose every ``depth``-byte string starts at another place too."""
    total = text_bytes(docs)
    parts = buckets or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK))
    rows = tagged(docs)
    hot = hot_keys(rows, Segments(depth, parts).sizes, SLICE, max(BLOCK, total // (4 * parts * SUB)), (32, 8, 1))
    sent = rows.mapInArrow(Segments(depth, parts * SUB, hot), "part int, bucket bigint, value binary")
    return sent.repartitionById(parts, F.col("part")).sortWithinPartitions("bucket").mapInArrow(Repeated(depth), SPANS)


def suffix_dedup(docs: DataFrame, depth: int = 200, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_bytes): texts without the bytes covered by a ``depth``-byte string that
    also starts anywhere else, in the same text or another; overlapping places count, texts never join.

    Equal strings have the same least anchor (hash of 24 bytes), so the windows of one anchor meet in one
    bucket, packed as segments of consecutive windows; those of a very common anchor travel in blocks, dealt by
    a hash of the bytes that all windows of a block have. Anchors that occur once need no sorting. Over the
    distinct segments of the others a suffix array is built in two stages, and neighbours with ``depth``
    bytes in common are repeats; equal segments count by their number. A null text is empty; rows of
    one doc_id (also null) are texts of their own; equal rows are copies of each other. Only doc_id and
    text are read, so other columns cannot clash.
    """
    rows = tagged(docs)
    return joined(rows, repeated_spans(docs, depth, buckets)).mapInArrow(without_bytes, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_bytes binary")
