"""Phrase collocations: fingerprints of n-grams meet in buckets, frequent ones alone are read from the text and verified."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from seacast.llm.blocks import POWERS, mixed, pack, ragged, slices, unpack
from seacast.session import stored

#: Bytes of text in one slice, and bytes of text whose n-grams one task sorts, in ``SUB`` buckets one after the other.
SLICE, TASK, SUB = 3 << 20, 256 << 20, 16
#: Bits of a fingerprint. Phrases that share one are told apart by their text, so it need not be longer.
BITS = 48
UNKNOWN = "und"

#: A random value for each byte; bytes that end a piece; bytes between words.
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) + np.uint64(1 << 20))
_PIECE, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_PIECE[list(b".,;:!?\n\v\f\r")] = True
_GAP[list(b" \t")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Slice:
    """Words of a slice of documents: lower-cased bytes with one space after each word, places, pieces and languages."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, langs: np.ndarray, names: list[str]):
        data = _LOWER[data]
        cut = _PIECE[data]
        word = ~(cut | _GAP[data])
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        first = (ends - np.diff(ends, prepend=0))[np.diff(ends, prepend=0) > 0]
        begins[first] = word[first]
        stops = word.copy()
        stops[:-1] &= ~word[1:]
        stops[ends[ends > 0] - 1] = word[ends[ends > 0] - 1]
        starts, lengths = np.flatnonzero(begins), np.flatnonzero(stops) + 1 - np.flatnonzero(begins)
        doc = np.searchsorted(ends, starts, side="right")
        self.piece = np.cumsum(cut)[starts] + doc  # grows at each piece and at each document
        self.lang, self.names = langs[doc], names
        stop = np.cumsum(lengths + 1)
        self.start, self.length = stop - lengths - 1, lengths
        self.bytes = np.full(int(stop[-1]) if len(stop) else 0, 32, np.uint8)
        for a, b in groups(lengths):
            here = slice(starts[a], starts[b - 1] + lengths[b - 1])
            self.bytes[ragged(self.start[a:b], lengths[a:b])] = data[here][word[here]]
        # Prefix sums where words begin and end, so that a phrase is named by its first and its last word.
        self.before = POWERS.prefix_at(_BYTES, self.bytes, self.start)
        self.after = POWERS.prefix_at(_BYTES, self.bytes, self.start + lengths)

    def grams(self, n: int) -> np.ndarray:
        """Words that begin an n-gram within a piece."""
        at = np.arange(max(len(self.start) - n + 1, 0))
        return at[self.piece[at] == self.piece[at + n - 1]]

    def size(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return self.start[at + n - 1] + self.length[at + n - 1] - self.start[at]

    def hashes(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """A hash of the bytes of each phrase of ``n`` words from ``at`` on."""
        return (self.after[at + n - 1] - self.before[at]) * POWERS.down(self.start[at])

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words ``a`` and ``b``, of one length each, have the same bytes."""
        out, sizes = np.ones(len(a), bool), self.length[a]
        for i, j in groups(sizes):
            differ = self.bytes[ragged(self.start[a[i:j]], sizes[i:j])] != self.bytes[ragged(self.start[b[i:j]], sizes[i:j])]
            out[i:j] = np.add.reduceat(differ, np.cumsum(sizes[i:j]) - sizes[i:j], dtype=np.int64) == 0
        return out

    def distinct(self, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, first word, words, occurrences) of the distinct n-grams of each language, in the order of fingerprints.

        Fingerprints are differences of prefix polynomials; those of one language and size that are equal are
        compared word by word, so an entry never stands for two phrases (a phrase may have two entries).
        """
        codes, kinds = np.zeros(0, np.int64), np.array([mixed(np.array([hash_name(x)], np.uint64))[0] for x in self.names], np.uint64)
        out = []
        for n in range(1, longest + 1):
            at = self.grams(n)
            key = mixed(self.hashes(at, n) ^ kinds[self.lang[at]] + np.uint64(n)) >> np.uint64(64 - BITS) if len(at) else np.zeros(0, np.uint64)
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            head = np.ones(len(at), bool)
            if n == 1:
                a, b = at[:-1], at[1:]
                near = np.flatnonzero((key[1:] == key[:-1]) & (self.length[a] == self.length[b]) & (self.lang[a] == self.lang[b]))
                head[1 + near[self.alike(a[near], b[near])]] = False
                codes = np.empty(len(self.start), np.int64)
                codes[at] = np.cumsum(head)
            else:
                same = key[1:] == key[:-1]
                for i in range(n):
                    same &= codes[at[1:] + i] == codes[at[:-1] + i]
                head[1:] = ~same
            heads = np.flatnonzero(head)
            out.append((key[heads], at[heads].astype(np.int32), np.full(len(heads), n, np.int8), np.diff(np.append(heads, len(at))).astype(np.int32)))
        key, at, n, count = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(key, kind="stable")
        return key[order], at[order], n[order], count[order]

    def phrases(self, at: np.ndarray, n: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The words of the n-grams joined by one space, one after the other, and their sizes."""
        sizes = self.size(at, n)
        return self.bytes[ragged(self.start[at], sizes)].tobytes(), sizes


def groups(sizes: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of the entries whose sizes add up to about ``limit``; one entry may be larger."""
    if len(sizes):
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1).tolist(), len(sizes)]
        yield from zip(cuts, cuts[1:])


def hash_name(name: str) -> int:
    out = 1469598103934665603
    for byte in name.encode():
        out = (out ^ byte) * 1099511628211 % (1 << 64)
    return out


def opened(value: bytes) -> Slice:
    data, sizes, langs, names = unpack(value)
    ends = np.cumsum(np.frombuffer(sizes, np.int64))
    return Slice(np.frombuffer(data, np.uint8), ends, np.frombuffer(langs, np.int32), json.loads(bytes(names)))


def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to slices: (slice, value), slices numbered within the partition."""
    part = TaskContext.get().partitionId()
    for number, table in enumerate(slices(batches, SLICE)):
        texts = pc.fill_null(table["text"], "").combine_chunks().cast(pa.large_binary())
        coded = table["lang"].combine_chunks().dictionary_encode()
        names = json.dumps(coded.dictionary.to_pylist())
        value = pack(b"".join(texts.to_pylist()), pc.binary_length(texts).to_numpy().astype(np.int64), coded.indices.to_numpy().astype(np.int32), names.encode())
        yield pa.RecordBatch.from_arrays([pa.array([part << 32 | number]), pa.array([value], pa.binary())], ["slice", "value"])


def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n): words of each language in a slice."""
    for batch in batches:
        for value in batch.column("value"):
            one = opened(value.as_buffer())
            counts = np.bincount(one.lang, minlength=len(one.names))
            yield pa.RecordBatch.from_arrays([pa.array(one.names, pa.string()), pa.array(counts.astype(np.int64))], ["lang", "n"])


class Fingerprints:
    """A slice to one packed value for each bucket, a range of fingerprints: they, occurrence pointers, sizes and numbers."""

    def __init__(self, longest: int, buckets: int):
        self.longest, self.buckets = longest, buckets

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value in zip(batch.column("slice").to_pylist(), batch.column("value")):
                key, at, n, count = opened(value.as_buffer()).distinct(self.longest)
                bucket = bucket_of(key, self.buckets)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = np.append(cuts[1:], len(key))
                values = [pack(planes(np.diff(key[a:b], prepend=np.uint64(0))), planes(at[a:b]), n[a:b], planes(count[a:b])) for a, b in zip(cuts, ends)]
                if values:
                    names = bucket[cuts]
                    yield pa.RecordBatch.from_arrays([pa.array((names // SUB).astype(np.int32)), pa.array(names), pa.array([name] * len(names)), pa.array(values, pa.binary())], ["part", "bucket", "slice", "value"])


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """The part of the range of fingerprints that a fingerprint lies in."""
    return ((key >> np.uint64(BITS - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    """Byte k of all numbers, for each k: what small numbers have in common stays together."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unplaned(data: memoryview, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def by_bucket(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[list[tuple]]:
    """The rows of one bucket after the other; batches are sorted by bucket."""
    name, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c) if c == "value" else batch.column(c).to_pylist() for c in ("bucket", *columns, "value"))):
            if row[0] != name and held:
                yield held
                held = []
            name = row[0]
            held.append((*row[1:-1], unpack(row[-1].as_buffer())))
    if held:
        yield held


class Frequent:
    """A bucket: for each slice the pointers, sizes and numbers of n-grams whose fingerprint occurs often enough in all."""

    def __init__(self, least: int):
        self.least = least

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_bucket(batches, "slice"):
            keys = np.concatenate([np.cumsum(unplaned(p[0], np.uint64), dtype=np.uint64) for _, p in held])
            counts = np.concatenate([unplaned(p[3], np.int32) for _, p in held])
            order = np.argsort(keys, kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
            often = np.empty(len(keys), bool)
            often[order] = np.repeat(np.add.reduceat(counts[order], heads, dtype=np.int64) >= self.least, np.diff(np.append(heads, len(keys))))
            names, values, done = [], [], 0
            for name, (_, at, n, count) in held:
                at, n, count = unplaned(at, np.int32), np.frombuffer(n, np.int8), unplaned(count, np.int32)
                mine = np.flatnonzero(often[done : done + len(at)])
                done += len(at)
                if len(mine):
                    mine = mine[np.argsort(at[mine], kind="stable")]
                    names.append(name)
                    values.append(pack(at[mine], n[mine], count[mine]))
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(values, pa.binary())], ["slice", "value"])


class Materialised:
    """A slice with its frequent pointers: their phrases, packed for the bucket of a hash of language and words."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, one, held = None, None, []
        for batch in batches:
            for key, first, value in zip(batch.column("slice").to_pylist(), batch.column("first").to_pylist(), batch.column("value")):
                if key != name and held:
                    yield from self.slice(one, held)
                    held = []
                name = key
                if first:
                    one = opened(value.as_buffer())
                else:
                    held.append(unpack(value.as_buffer()))
        if held:
            yield from self.slice(one, held)

    def slice(self, one: Slice, held: list) -> Iterator[pa.RecordBatch]:
        at, n, count = (np.concatenate([np.frombuffer(p[k], kind) for p in held]).astype(np.int64) for k, kind in enumerate((np.int32, np.int8, np.int32)))
        key = mixed(one.hashes(at, n)) >> np.uint64(64 - BITS)
        bucket = bucket_of(key, self.buckets)
        order = np.lexsort([key, bucket])
        at, n, count, bucket = at[order], n[order], count[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        values = []
        for a, b in zip(cuts, np.append(cuts[1:], len(at))):
            text, sizes = one.phrases(at[a:b], n[a:b])
            values.append(pack(text, planes(sizes.astype(np.int32)), planes(one.lang[at[a:b]].astype(np.int32)), n[a:b].astype(np.int8), planes(count[a:b]), json.dumps(one.names).encode()))
        yield pa.RecordBatch.from_arrays([pa.array((bucket[cuts] // SUB).astype(np.int32)), pa.array(bucket[cuts]), pa.array(values, pa.binary())], ["part", "bucket", "value"])


class Verified:
    """A bucket of phrases: exact numbers by language and words, whatever their fingerprints were."""

    def __init__(self, least: int):
        self.least = least

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_bucket(batches):
            tables = []
            for (text, sizes, langs, n, count, names) in (p for (p,) in held):
                ends = np.concatenate([[0], np.cumsum(unplaned(sizes, np.int32), dtype=np.int64)])
                phrases = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(text)])
                lang = pa.array(json.loads(bytes(names)), pa.large_string()).take(pa.array(unplaned(langs, np.int32)))
                tables.append(pa.table({"lang": lang, "phrase": phrases, "words": pa.array(np.frombuffer(n, np.int8).astype(np.int32)), "f": pa.array(unplaned(count, np.int64))}))
            sums = pa.concat_tables(tables).group_by(["lang", "phrase", "words"]).aggregate([("f", "sum")])
            sums = sums.filter(pc.greater_equal(sums["f_sum"], self.least)).select(["lang", "phrase", "words", "f_sum"]).rename_columns(["lang", "phrase", "words", "f"])
            yield from sums.cast(pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64())])).to_batches()


def frequent_phrases(docs: DataFrame, longest: int = 3, least: int = 10, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f), (lang, n)): phrases of one to ``longest`` words that occur at least ``least`` times in
    the documents of a language, and the number of words of each language.

    ASCII letters are lower-cased, texts split at ``.,;:!?`` and line ends into pieces and these at blanks and tabs into
    words; occurrences lie within a piece and may overlap. A null text is empty, a null language is ``und``; only text
    and lang are read, rows of one text count each.

    Slices of the documents are written once. The n-grams of a slice are told apart and counted there and their
    fingerprints go to buckets with a pointer to one occurrence; buckets return the pointers of fingerprints that occur
    often enough in all slices together, the slices read those phrases from their text, and a second exchange counts
    them by their words. Equal fingerprints of different phrases thus only make a phrase be read in vain. A very common
    phrase is one entry a slice; a very long text is a slice of its own. The number of buckets grows with the text.
    """
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))
    taken = stored(rows.mapInArrow(cut, "slice bigint, value binary"), "slices")
    found = stored(taken.select("value").mapInArrow(words, "lang string, n bigint"), "words").groupBy("lang").agg(F.sum("n").alias("n"))
    spark, total = docs.sparkSession, docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK))
    sent = taken.mapInArrow(Fingerprints(longest, parts * SUB), "part int, bucket bigint, slice bigint, value binary")
    often = sent.repartitionById(parts, F.col("part")).sortWithinPartitions("bucket").mapInArrow(Frequent(least), "slice bigint, value binary")
    both = taken.withColumn("first", F.lit(True)).unionByName(often.withColumn("first", F.lit(False))).repartition(parts, "slice").sortWithinPartitions("slice", F.col("first").desc())
    read = both.mapInArrow(Materialised(parts * SUB), "part int, bucket bigint, value binary")
    kept = read.repartitionById(parts, F.col("part")).sortWithinPartitions("bucket").mapInArrow(Verified(least), "lang string, phrase string, words int, f bigint")
    return stored(kept, "phrases"), found


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, buckets: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two or three words of each language.

    a is how often a phrase occurs, l and r its two parts at the cut with the lowest score
    floor(1000000 * a * a / (l * r)) (ties: after fewer words), n the words of its language. Phrases whose words lie
    inside a longer candidate that occurs ``share`` percent as often or more are dropped. Ranks go by score, a (both
    descending) and the phrase's bytes. Products are decimals of 38 digits, so they are exact below 10 ** 15 occurrences.
    Texts are split and counted as in :func:`frequent_phrases`; every part of a candidate occurs at least as often as it.
    """
    found, totals = frequent_phrases(docs, 3, least, buckets)
    word = F.split("phrase", " ")
    two = found.where("words = 2").select("lang", "phrase", F.col("f").alias("a"), word[0].alias("x"), word[1].alias("y"))
    three = found.where("words = 3").select(
        "lang", "phrase", F.col("f").alias("a"), word[0].alias("x"), F.concat_ws(" ", word[1], word[2]).alias("yz"), F.concat_ws(" ", word[0], word[1]).alias("xy"), word[2].alias("z"),
    )

    def counted(df: DataFrame, part: str, name: str) -> DataFrame:
        return df.join(found.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])

    def score(left: str, right: str) -> F.Column:
        return F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) div (CAST({left} AS DECIMAL(19,0)) * CAST({right} AS DECIMAL(19,0)))")

    longer = three.select("lang", F.explode(F.array("xy", "yz")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("inside"))
    pairs = counted(counted(two, "x", "l"), "y", "r").select("lang", "phrase", "a", "l", "r", score("l", "r").alias("score"))
    pairs = pairs.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("inside") < share * F.col("a"), F.lit(True))).drop("inside")
    triples = counted(counted(counted(counted(three, "x", "l1"), "yz", "r1"), "xy", "l2"), "z", "r2")
    triples = triples.withColumns({"s1": score("l1", "r1"), "s2": score("l2", "r2")})
    first = F.col("s1") <= F.col("s2")
    triples = triples.select("lang", "phrase", "a", *(F.when(first, a).otherwise(F.col(b)).alias(c) for a, b, c in ((F.col("l1"), "l2", "l"), (F.col("r1"), "r2", "r"), (F.col("s1"), "s2", "score"))))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = pairs.unionByName(triples).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
