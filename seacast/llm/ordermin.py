"""Near duplicates by order MinHash: ordered pairs of minimum shingles as sketches, banded alignment as the judge."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from seacast.llm.blocks import mixed, ragged, slices
from seacast.llm.common import without
from seacast.llm.superkmer import word_hashes, word_lists
from seacast.session import stored

#: Words of a shingle, sketches of a text, least similarity.
SHINGLE, SKETCHES, SIMILARITY = 5, 14, 0.8
#: Sketches of the first round, neighbours that a text of a bucket meets in the second, texts of a bucket that one task takes.
FIRST, REACH, WHOLE = 5, 2, 1000
#: Texts, and shingles, of one slice of a bucket that is finished exactly.
ROWS, MANY = 512, 1 << 19
SLICE = 2 << 20
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``size`` words of one text, where the shingles of each text begin, with the end)."""
    n = len(hashes) - size + 1
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    ends = np.concatenate([[0], np.cumsum(counts)])
    if n <= 0:
        return np.zeros(0, np.uint64), ends
    grams = sum(hashes[i : n + i] * np.uint64(2 * i + 3) ** np.uint64(11) for i in range(size))
    return mixed(grams[ragged(offsets[:-1], counts)]), ends


class Profiles:
    """Each document's text_id (128 bits of its words), number of shingles and sketches."""

    def __init__(self, size: int, sketches: int):
        self.size, self.sketches = size, sketches

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, SLICE):
            flat, offsets = word_lists(table["text"])
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat), " ")
            names = [xxhash.xxh3_128_hexdigest(t.as_buffer()) for t in joined]
            found, ends = shingles(word_hashes(flat), offsets, self.size)
            counts = np.diff(ends)
            there = np.flatnonzero(counts)
            keys = self.keys(found, ends[:-1][there], counts[there]) if len(there) else []
            columns = []
            for key in keys or [np.zeros(0, np.uint64)] * self.sketches:
                full, none = np.zeros(len(counts), np.int64), np.ones(len(counts), bool)
                full[there], none[there] = key.view(np.int64), False
                columns.append(pa.array(full, mask=none))
            yield pa.RecordBatch.from_arrays(
                [table["doc_id"].combine_chunks(), table["tag"].combine_chunks(), pa.array(names), pa.array(counts), *columns],
                ["doc_id", "tag", "text_id", "n_shingles", *[f"s{i}" for i in range(self.sketches)]],
            )

    def keys(self, found: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """One key per text and sketch: its two least shingles, told apart by occurrence, in text order."""
        row = np.repeat(np.arange(len(starts)), counts)
        same = found ^ mixed(row.astype(np.uint64) + np.uint64(1))
        order = np.argsort(same, kind="stable")
        head = np.concatenate([[True], same[order][1:] != same[order][:-1]])
        nth = np.empty(len(found), np.uint64)
        nth[order] = np.arange(len(found)) - np.maximum.accumulate(np.where(head, np.arange(len(found)), 0))
        labels = found + nth * np.uint64(0xD6E8FEB86659FD93)

        def least(x: np.ndarray) -> np.ndarray:
            hits = np.flatnonzero(x == np.repeat(np.minimum.reduceat(x, starts), counts))
            return hits[np.searchsorted(hits, starts)]

        out = []
        for i in range(self.sketches):
            x = mixed(labels ^ mixed(np.full(1, 1000 + i, np.uint64)))
            first = least(x)
            x[first] = _TOP
            second = np.where(counts > 1, least(x), first)
            early, late = labels[np.minimum(first, second)], labels[np.maximum(first, second)]
            out.append(mixed(early * np.uint64(3) + mixed(late)))
        return out


class Sequences:
    """Each text's shingles in order, 32 bits each."""

    def __init__(self, size: int):
        self.size = size

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, SLICE):
            flat, offsets = word_lists(table["text"])
            found, ends = shingles(word_hashes(flat), offsets, self.size)
            raw = memoryview((found >> np.uint64(32)).astype(np.uint32).tobytes())
            values = [bytes(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([table["text_id"].combine_chunks(), pa.array(values, pa.binary())], ["text_id", "shingles"])


def aligned(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the best alignment of two shingle sequences has common / (all - common) of ``similarity`` or more.

    That allows a number of unmatched shingles, which bounds how far the alignment can leave the
    diagonal; only matches in that band count. The longest increasing chain of matches is the
    alignment; texts that repeat themselves a lot take the band row by row instead.
    """
    both = len(a) + len(b)
    need = int(np.ceil(both * similarity / (1 + similarity) - 1e-9))
    band = both - 2 * need
    if abs(len(a) - len(b)) > band:
        return False
    order = np.argsort(b, kind="stable")
    lows, highs = (np.searchsorted(b[order], a, side=s) for s in ("left", "right"))
    counts = highs - lows
    if np.count_nonzero(counts) < need:
        return False
    if counts.sum() > 20 * both:
        return banded(a, b, band) >= need
    i, j = np.repeat(np.arange(len(a)), counts), order[ragged(lows, counts)]
    near = abs(i - j) <= band
    i, j = i[near], j[near]
    tails: list[int] = []
    for x in j[np.lexsort((-j, i))].tolist():
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
    return len(tails) >= need


def banded(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence within ``band`` of the diagonal, a row at a time."""
    row = np.zeros(len(b) + 1, np.int64)
    for i, x in enumerate(a):
        lo, hi = max(0, i - band), min(len(b), i + band + 1)
        if lo >= hi:
            continue
        reach = np.maximum(row[lo + 1 : hi + 1], row[lo:hi] + (b[lo:hi] == x))
        reach[0] = max(reach[0], row[lo])
        row[lo + 1 : hi + 1] = np.maximum.accumulate(reach)
        row[hi + 1 :] = np.maximum(row[hi + 1 :], row[hi])
    return int(row[-1])


class Judge:
    """Of candidate pairs with their shingles, the pairs that are similar."""

    def __init__(self, similarity: float):
        self.similarity = similarity

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[np.frombuffer(v.as_buffer(), np.uint32) for v in batch.column(c)] for c in ("left", "right")]
            good = [aligned(x, y, self.similarity) for x, y in zip(*sides)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))


class Neighbours:
    """Pairs of rows at most ``reach`` apart in a sorted partition that share a bucket, are not linked and near in size."""

    def __init__(self, reach: int, similarity: float):
        self.reach, self.similarity = reach, similarity

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            old = len(rows) - batch.num_rows
            for step in range(1, self.reach + 1):
                begin = max(old - step, 0)
                here, there = rows.slice(begin, max(len(rows) - step - begin, 0)), rows.slice(begin + step)
                near = pc.and_(pc.equal(here["r"], there["r"]), pc.and_(pc.equal(here["key"], there["key"]), pc.not_equal(here["comp"], there["comp"])))
                least, most = pc.min_element_wise(here["n"], there["n"]), pc.max_element_wise(here["n"], there["n"])
                near = pc.and_(near, pc.greater_equal(pc.cast(least, pa.float64()), pc.multiply(pc.cast(most, pa.float64()), self.similarity)))
                yield from pa.table({"a": here["text_id"], "b": there["text_id"]}).filter(near).combine_chunks().to_batches()
            held = rows.slice(max(len(rows) - self.reach, 0)).combine_chunks()


def overlaps(rows: np.ndarray, found: np.ndarray, left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """Shingles that each text of ``left`` has in common with each other text of ``right``, repeats counted, in any order.

    A shingle that one text alone has is left out, so the cell of a text and itself lacks those; nothing asks for it.
    ``found`` are the shingles of ``size`` texts, ``rows`` says whose. Shingles that the same texts have are one weighted column.
    """
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order].astype(np.uint64)
    head = np.concatenate([[True], (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])])
    nth = np.arange(len(found)) - np.maximum.accumulate(np.where(head, np.arange(len(found)), 0))
    label = found | nth.astype(np.uint64) << np.uint64(32)
    order = np.argsort(label, kind="stable")
    rows, label = rows[order], label[order]
    starts = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
    counts = np.diff(np.append(starts, len(label)))
    pattern = np.add.reduceat(mixed(rows.astype(np.uint64) + np.uint64(1)), starts)
    starts, counts, pattern = (x[counts > 1] for x in (starts, counts, pattern))
    _, one, weight = np.unique(pattern, return_index=True, return_counts=True)
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(one), 4096):
        part = one[at : at + 4096]
        has = np.zeros((size, len(part)), np.float32)
        has[rows[ragged(starts[part], counts[part])], np.repeat(np.arange(len(part)), counts[part])] = 1
        out += (has[left] * weight[at : at + 4096].astype(np.float32)) @ has[right].T
    return out


class Finish:
    """Links of blocks (two slices of a bucket): every pair of texts of different components is judged, or ruled out by a bound.

    A pair belongs to the first sketch that it shares. Its common shingles in any order bound the alignment; the
    pairs above that bound are aligned, unless links of this block already join them.
    """

    def __init__(self, similarity: float):
        self.similarity = similarity

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("r", "key", "lo", "hi")], axis=1)
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if held and tuple(ids[a]) != name:
                    yield self.block(pa.Table.from_batches(held), name)
                    held = []
                name = tuple(ids[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield self.block(pa.Table.from_batches(held), name)

    def block(self, rows: pa.Table, name: tuple[int, ...]) -> pa.RecordBatch:
        r, _, lo, hi = name
        texts, salt, n = rows["text_id"].combine_chunks(), rows["salt"].to_numpy(), rows["n"].to_numpy()
        comp = rows["comp"].combine_chunks().dictionary_encode().indices.to_numpy()
        left, right = (np.flatnonzero(salt == s) for s in (lo, hi))
        made: list[tuple[int, int]] = []
        if len(left) and len(right) and len(np.unique(comp)) > 1:
            sequences = [np.frombuffer(v.as_buffer(), np.uint32) for v in rows["shingles"].combine_chunks()]
            both = overlaps(np.repeat(np.arange(len(sequences)), [len(x) for x in sequences]), np.concatenate(sequences), left, right, len(sequences))
            need = np.ceil((n[left][:, None] + n[right]) * self.similarity / (1 + self.similarity) - 1e-9)
            good = (both >= need) & (comp[left][:, None] != comp[right])
            if lo == hi:
                good = np.triu(good, 1)
            x, y = np.nonzero(good)
            best = np.argsort(-both[x, y] / need[x, y], kind="stable")
            x, y = left[x[best]], right[y[best]]
            if r:
                after = rows["after"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1)[:, -r:]
                mine = ~np.concatenate([(after[x[k : k + 65536]] == after[y[k : k + 65536]]).any(axis=1) for k in range(0, max(len(x), 1), 65536)])
                x, y = x[mine], y[mine]
            root = list(range(int(comp.max()) + 1))

            def find(c: int) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            of = comp.tolist()
            for i, j in zip(x.tolist(), y.tolist()):
                a, b = find(of[i]), find(of[j])
                if a != b and aligned(sequences[i], sequences[j], self.similarity):
                    root[a] = b
                    made.append((i, j))
        a, b = (texts.take(pa.array([p[k] for p in made], pa.int64())) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pc.min_element_wise(a, b), pc.max_element_wise(a, b)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (a, b) is linked to, by alternating stars.

    Each step hangs a node's larger neighbours, then its smaller ones, below the least of them; a step is
    a written table, so nothing gathers at one node and a lost executor re-reads files. Ends when each node hangs directly below a root.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u")
        hung = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(root.select("u", F.col("m").alias("v")))
        edges = stored(hung.where("u <> v").distinct(), "small")
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def joined_roots(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) with more links: these join the roots known so far, and what hangs below follows."""
    if roots is None:
        return components(links)
    of = {c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"}
    between = links.join(of["a"], "a", "left").join(of["b"], "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    more = components(between)
    step = more.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    moved = roots.join(step, F.col("root") == F.col("_node"), "left").select("node", F.coalesce("_root", "root").alias("root"))
    return stored(moved.unionByName(more), "roots")


def buckets(nodes: DataFrame, sketches: int) -> DataFrame:
    """(r, key, text_id, n, after, texts) of the texts that share sketch ``r`` with others: ``after`` has the text's other
    sketches in turn, from r + 1 on, ``texts`` the number of texts in the bucket."""
    every = F.array(*[F.col(f"s{i}") for i in range(sketches)])
    rows = nodes.where("n_shingles > 0").select("text_id", F.col("n_shingles").alias("n"), every.alias("all"), F.posexplode(every).alias("r", "key"))
    more = rows.groupBy("r", "key").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    after = F.concat(F.slice("all", F.col("r") + 2, sketches), F.slice("all", F.lit(1), F.col("r")))
    return stored(rows.join(more, ["r", "key"]).select("r", "key", "text_id", "n", after.alias("after"), "texts"), "buckets")


def sequences(shared: DataFrame, docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(text_id, shingles) of the texts in buckets; one document of each is read again."""
    wanted = nodes.join(shared.select("text_id").distinct(), "text_id", "left_semi")
    where = wanted.select("text_id", F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"))
    texts = docs.join(where, (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.col("tag") == F.col("_tag"))).select("text_id", "text").dropDuplicates(["text_id"])
    return stored(texts.mapInArrow(Sequences(size), "text_id string, shingles binary"), "sequences")


def with_components(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``rows`` with comp, the root of each text."""
    if roots is None:
        return rows.withColumn("comp", F.col("text_id"))
    return rows.join(roots, rows.text_id == roots.node, "left").withColumn("comp", F.coalesce("root", "text_id")).drop("node", "root")


def candidates(shared: DataFrame, roots: DataFrame | None, turn: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts that share a sketch and are not linked yet, a bounded number of each text.

    The first round takes few sketches; in each bucket every text meets the bucket's first text, found
    by a map-side minimum, and the next one in a random order, which settles most. The second gives all
    pairs of the buckets of up to ``REACH + 1`` texts; :func:`finished` takes the larger ones. In the first
    round a bucket of more than ``WHOLE`` texts is dealt over several tasks; that a text does not meet the
    next one across their borders costs nothing, because those buckets are finished.
    """
    wanted = F.col("r") < FIRST if turn == 0 else F.col("texts") <= REACH + 1
    place = F.array(F.xxhash64("text_id", "r"))
    rows = with_components(shared.where(wanted).select("r", "key", "text_id", "n", "texts", place.alias("turn")), roots)
    first = rows.groupBy("r", "key").agg(F.min(F.struct("turn", "text_id", "n", "comp")).alias("f"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    # Buckets of one component have nothing left to link and go out here.
    open_ = rows.join(first.where("x <> y").select("r", "key", "f"), ["r", "key"])
    part = F.when(F.col("texts") > WHOLE, F.col("turn")).otherwise(F.array().cast("array<bigint>")).alias("part")
    ordered = open_.select("r", "key", part, "turn", "text_id", "n", "comp").repartitionByRange("r", "key", "part").sortWithinPartitions("r", "key", "turn", "text_id")
    pairs = ordered.select("r", "key", "text_id", "n", "comp").mapInArrow(Neighbours(REACH if turn == 1 else 1, similarity), "a string, b string")
    if turn == 0:
        near = F.least("n", "f.n") >= similarity * F.greatest("n", "f.n")
        pairs = pairs.unionByName(open_.where((F.col("comp") != F.col("f.comp")) & near).select(F.col("f.text_id").alias("a"), F.col("text_id").alias("b")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def finished(shared: DataFrame, found: DataFrame, roots: DataFrame | None, similarity: float) -> DataFrame:
    """Links (a, b) that join all similar texts that share a bucket of more than ``REACH + 1`` texts.

    A bucket with several components is dealt in slices of about ``ROWS`` texts and ``MANY`` shingles;
    each two slices (and each slice with itself) are a block of their own, so that no task holds a bucket.
    """
    rows = with_components(shared.where(F.col("texts") > REACH + 1), roots)
    sums = rows.groupBy("r", "key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("count"), F.sum("n").alias("sum"))
    parts = F.greatest(F.ceil(F.col("count") / ROWS), F.ceil(F.col("sum") / MANY)).cast("int")
    open_ = rows.join(sums.where("x <> y").select("r", "key", parts.alias("parts")), ["r", "key"])
    dealt = open_.withColumn("salt", F.pmod(F.xxhash64("text_id"), F.col("parts")).cast("int"))
    dealt = dealt.join(found, "text_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = dealt.select("r", "key", F.least("salt", "other").alias("lo"), F.greatest("salt", "other").alias("hi"), "salt", "text_id", "n", "comp", "after", "shingles")
    blocks = blocks.repartition("r", "key", "lo", "hi").sortWithinPartitions("r", "key", "lo", "hi")
    return stored(blocks.mapInArrow(Finish(similarity), "a string, b string").distinct(), "links")


def judged(pairs: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """The similar ones of the pairs."""
    left, right = (found.select(F.col("text_id").alias(c), F.col("shingles").alias(n)) for c, n in (("a", "left"), ("b", "right")))
    return stored(pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(Judge(similarity), "a string, b string"), "links")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, tag, text_id, class_id, class_size, kept): classes of documents linked by similar texts.

    Texts are their words, as they are; two are similar when an alignment of their sequences of
    ``size``-word shingles has common / (all - common) of ``similarity`` or more. Equal texts are one
    node. Each sketch of a text is the pair of its two least shingles (repeats told apart by their
    number) in text order; texts that share a sketch are candidates. A pair at the threshold shares a
    sketch with probability 0.64 or more, so it has none of 14 in common once in a million. All pairs
    that share a sketch are judged, unless links already join the two or their common shingles, in any
    order, are too few.

    class_id is the least doc_id of the class; the row with it is kept (of several, one). Null and empty
    texts are equal to each other; texts of fewer than ``size`` words are similar only to equal ones. A
    null doc_id comes after all ids. Only doc_id and text are read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.hash(F.col("doc_id").isNull(), "text").alias("tag"))
    sketches = [f"s{i}" for i in range(SKETCHES)]
    kinds = "doc_id bigint, tag int, text_id string, n_shingles bigint, " + ", ".join(f"{s} bigint" for s in sketches)
    profiles = stored(rows.mapInArrow(Profiles(size, SKETCHES), kinds), "profiles")
    nodes = stored(profiles.groupBy("text_id").agg(
        F.min("n_shingles").alias("n_shingles"), *[F.min(s).alias(s) for s in sketches],
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tag")).alias("first"), F.count(F.lit(1)).alias("n_docs"),
    ).select("*", "first.doc_id", "first.tag").drop("first"), "nodes")
    shared = buckets(nodes, SKETCHES)
    found = sequences(shared, rows, nodes, size)
    roots, tried = None, None
    for turn in range(2):
        pairs = candidates(shared, roots, turn, similarity)
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs
        links = None if pairs.isEmpty() else judged(pairs, found, similarity)
        roots = joined_roots(roots, links) if links is not None and not links.isEmpty() else roots
    links = finished(shared, found, roots, similarity)
    roots = roots if links.isEmpty() else joined_roots(roots, links)
    comp = nodes.select("text_id", F.col("text_id").alias("root"), "doc_id", "n_docs") if roots is None else (
        nodes.join(roots, nodes.text_id == roots.node, "left").select("text_id", F.coalesce("root", "text_id").alias("root"), "doc_id", "n_docs")
    )
    classes = comp.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("n_docs").alias("class_size"))
    members = stored(comp.select("text_id", "root").join(classes, "root"), "members")
    labelled = profiles.select("doc_id", "tag", "text_id").join(members, "text_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
    meet = F.when(F.col("kept"), F.lit(0)).otherwise(F.xxhash64("doc_id"))
    one = Window.partitionBy("root", meet).orderBy("tag", "text_id")
    return labelled.withColumn("kept", F.col("kept") & (F.row_number().over(one) == 1)).select("doc_id", "tag", "text_id", "class_id", "class_size", "kept")


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class. Rows equal in doc_id and text share a verdict and one stays."""
    keep = near_duplicates(docs, **options).where("kept").select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag2"))
    tag = F.hash(F.col("doc_id").isNull(), F.col("text"))
    joined = docs.withColumn("_tag", tag).join(keep, (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.col("_tag") == F.col("_tag2")))
    one = Window.partitionBy("_id", "_tag").orderBy(F.lit(1))
    return joined.withColumn("_n", F.row_number().over(one)).where("_n = 1").select(without(docs))
