"""Vector codes by Lloyd rounds over partition-local cover trees: whole subtrees go to an entry by the triangle inequality."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seacast.llm.blocks import pack, ragged, unpack
from seacast.session import stored

#: Vectors of one tree at most; points below which a node is not split; largest integer component that squares may hold.
BLOCK, LEAF, LARGEST = 4096, 8, 1 << 26
#: Share of a distance that rounding of square roots may take away from a bound.
SLACK = 1e-9


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``a`` to the rows of ``b`` beside them."""
    gap = a.astype(np.int64) - b
    return np.einsum("...i,...i->...", gap, gap)


class CoverTree:
    """Distinct points with their numbers, in an order where each node is a range of points.

    A node covers its points within its radius; its children have centres more than half the cover
    radius of their level apart and split its points. ``sums`` are cumulative, so a node's sum and
    number of vectors are two differences.
    """

    def __init__(self, points: np.ndarray, weights: np.ndarray, nodes: np.ndarray):
        self.points, self.weights = points, weights
        self.centre, self.start, self.end, self.reach, self.child, self.children = nodes
        self.sums = np.zeros((len(points) + 1, points.shape[1] + 1), np.int64)
        np.cumsum(np.column_stack([points * weights[:, None], weights]), axis=0, out=self.sums[1:])

    @classmethod
    def build(cls, vectors: np.ndarray) -> tuple[CoverTree, np.ndarray]:
        """(tree, place): ``place`` has for each vector the place of its point in the tree."""
        points, inverse, weights = np.unique(vectors, axis=0, return_inverse=True, return_counts=True)
        order, nodes = cls.split(points)
        place = np.empty(len(points), np.int64)
        place[order] = np.arange(len(points))
        nodes[0] = place[nodes[0]]
        return cls(points[order], weights[order], nodes), place[inverse.reshape(-1)]

    @staticmethod
    def split(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, nodes): nodes (centre, start, end, squared radius, first child, children) level by level."""
        order, levels = np.arange(len(points)), []
        centre, start, end = np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([len(points)])
        done = 1
        cover = None
        while len(centre):
            sizes = end - start
            of = np.repeat(np.arange(len(centre)), sizes)
            at = ragged(start, sizes).astype(np.int64)
            far = squared(points[order[at]], points[centre[of]])
            reach = np.maximum.reduceat(far, np.cumsum(sizes) - sizes)
            cover = int(reach.max()) if cover is None else cover // 4
            wide = np.flatnonzero(sizes > LEAF)
            child, children = np.zeros(len(centre), np.int64), np.zeros(len(centre), np.int64)
            levels.append((centre, start, end, reach, child, children))
            if not len(wide):
                break
            centre, sizes = centre[wide], sizes[wide]
            inside = ragged(start[wide], sizes).astype(np.int64)
            parent, members = np.repeat(np.arange(len(wide)), sizes), order[inside]
            group, net = np.empty(len(members), np.int64), []
            left = np.arange(len(members))
            first, bound = centre, cover // 4
            owner = np.arange(len(wide))
            while len(left):  # one further centre for every node that still has points outside its net
                number = np.full(len(wide), -1)
                number[owner] = sum(len(n[0]) for n in net) + np.arange(len(owner))
                net.append((first, owner))
                mine = np.full(len(wide), 0)
                mine[owner] = first
                near = squared(points[members[left]], points[mine[parent[left]]]) <= bound
                group[left[near]] = number[parent[left[near]]]
                left = left[~near]
                heads = np.flatnonzero(np.diff(parent[left], prepend=-1))
                owner, first = parent[left[heads]], members[left[heads]]
            centres, owners = np.concatenate([n[0] for n in net]), np.concatenate([n[1] for n in net])
            sort = np.argsort(owners, kind="stable")
            rank = np.empty(len(sort), np.int64)
            rank[sort] = np.arange(len(sort))
            group = rank[group]
            order[inside] = members[np.argsort(group, kind="stable")]
            counts = np.bincount(group, minlength=len(centres))
            many = np.bincount(owners, minlength=len(wide))
            child[wide], children[wide] = done + np.cumsum(many) - many, many
            done += len(centres)
            inner = np.cumsum(counts) - counts
            shift = np.repeat(start[wide] - (np.cumsum(sizes) - sizes), many)
            centre, start = centres[sort], inner + shift
            end = start + counts
        return order, np.concatenate([np.stack(level) for level in levels], axis=1)

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry of each point, exact comparisons): the nearest entry, ties to the lower index."""
        fresh = np.array([not (entries[:k] == e).all(axis=1).any() for k, e in enumerate(entries)])
        out, front, exact = np.zeros(len(self.points), np.int64), np.zeros(1, np.int64), 0
        while len(front):
            far = np.sqrt(squared(self.points[self.centre[front], None], entries[None]).astype(np.float64))
            far[:, ~fresh] = np.inf
            best = far.argmin(axis=1)
            low = far[np.arange(len(front)), best]
            far[np.arange(len(front)), best] = np.inf
            radius = np.sqrt(self.reach[front].astype(np.float64))
            sure = far.min(axis=1, initial=np.inf) * (1 - SLACK) > (low + 2 * radius) * (1 + SLACK)
            sizes = self.end[front] - self.start[front]
            out[ragged(self.start[front[sure]], sizes[sure])] = np.repeat(best[sure], sizes[sure])
            front = front[~sure]
            leaf = self.children[front] == 0
            at = ragged(self.start[front[leaf]], sizes[~sure][leaf])
            if len(at):  # argmin takes the first of equal distances
                out[at] = squared(self.points[at, None], entries[None]).argmin(axis=1)
                exact += len(at)
            front = ragged(self.child[front[~leaf]], self.children[front[~leaf]]).astype(np.int64)
        return out, exact

    def totals(self, entries: np.ndarray) -> np.ndarray:
        """For each entry the sums of the components of its vectors and their number, by runs of equally assigned points."""
        codes, _ = self.assign(entries)
        heads = np.flatnonzero(np.diff(codes, prepend=-1))
        ends = np.append(heads[1:], len(codes))
        out = np.zeros((len(entries), self.sums.shape[1]), np.int64)
        np.add.at(out, codes[heads], self.sums[ends] - self.sums[heads])
        return out

    def parts(self) -> list[np.ndarray]:
        return [self.points.astype(np.int32), self.weights.astype(np.int32), np.stack([self.centre, self.start, self.end, self.reach, self.child, self.children])]


def trees(value: bytes, width: int) -> list[CoverTree]:
    raw = unpack(value)
    return [
        CoverTree(np.frombuffer(raw[k], np.int32).reshape(-1, width).astype(np.int64), np.frombuffer(raw[k + 1], np.int32).astype(np.int64), np.frombuffer(raw[k + 2], np.int64).reshape(6, -1))
        for k in range(0, len(raw), 3)
    ]


class Plant:
    """Batches of vectors to one row a block: ids, labels, a tree for each part position, the places of the vectors in them."""

    def __init__(self, parts: int, scale: int):
        self.parts, self.scale = parts, scale

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(at, BLOCK)
                whole = whole_numbers(rows.column("vector").flatten().to_numpy(zero_copy_only=False), self.scale).reshape(rows.num_rows, -1)
                made = [CoverTree.build(part) for part in np.split(whole, self.parts, axis=1)]
                one = [pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(c)) for c in ("id", "label")]
                packed = [pack(*(x for tree, _ in made for x in tree.parts())), pack(*(place.astype(np.int32) for _, place in made))]
                yield pa.RecordBatch.from_arrays([*one, pa.array(packed[:1], pa.binary()), pa.array(packed[1:], pa.binary())], ["id", "label", "trees", "places"])


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    scaled = np.floor(values.astype(np.float64) * scale)
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a component times {scale} is beyond {LARGEST}; squared distances would not be exact")
    return scaled.astype(np.int64)


class Totals:
    """One round: what all trees of a task give each entry, one row for each part position and entry."""

    def __init__(self, books: np.ndarray):
        self.books = books

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((*self.books.shape[:2], self.books.shape[2] + 1), np.int64)
        for batch in batches:
            for value in batch.column("trees"):
                for k, tree in enumerate(trees(value.as_buffer(), self.books.shape[2])):
                    out[k] += tree.totals(self.books[k])
        part, entry = np.nonzero(out[:, :, -1])
        rows = out[part, entry]
        lists = pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), rows.shape[1]).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), lists], ["part", "entry", "sums"])


class Codes:
    """The last assignment: id, label, code and error of every vector."""

    def __init__(self, books: np.ndarray):
        self.books = books

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (value, places) in enumerate(zip(batch.column("trees"), batch.column("places"))):
                grown, codes, error = trees(value.as_buffer(), self.books.shape[2]), [], 0
                for tree, book, place in zip(grown, self.books, unpack(places.as_buffer())):
                    found, _ = tree.assign(book)
                    at = np.frombuffer(place, np.int32)
                    error = error + squared(tree.points, book[found])[at]
                    codes.append(found[at].astype(np.uint8))
                text = np.stack(codes, axis=1).tobytes().hex()
                n = 2 * len(codes)
                lists = [batch.column(c).slice(k, 1).flatten() for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([text[i : i + n] for i in range(0, len(text), n)], pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])


def finite(vector: str) -> F.Column:
    """Whether a vector is there and holds no null, NaN or infinite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


def compress(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error), codebooks): product codes of ``parts`` bytes for every vector.

    Components become floor(scale * x). A codebook starts as the parts of the ``entries`` smallest ids (null
    ids last, equal ids by vector); each of ``rounds`` rounds assigns every part to its nearest entry (ties to
    the lower index) and moves entries to floor(sum / count) of their parts; entries without parts stay.

    Blocks of 4,096 vectors get a cover tree for each part position once, in a written table. A round reads the
    trees only: a node whose nearest entry beats the second by more than twice its radius goes there whole, by
    its cumulative sums; only the others descend, and points of leaves are compared exactly. What leaves a task
    is one sum for each position and entry, so rows of one label or many equal vectors do not matter.

    Rows whose vector is null or holds a null or non-finite component are left out; equal rows count each; an
    empty table gives no rows and empty codebooks, fewer rows than entries a smaller codebook. Vectors of
    different or indivisible lengths and components beyond 2 ** 26 / scale are refused. Other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256: a code has two hex digits")
    rows = df.where(finite(f"`{vector}`")).select(F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    size = rows.agg(F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
    out = "id {}, label {}, code string, error bigint".format(*(rows.schema[c].dataType.simpleString() for c in ("id", "label")))
    if size.low is None:
        return df.sparkSession.createDataFrame([], out), np.zeros((parts, 0, 0), np.int64)
    if size.low != size.high or size.low % parts or not size.low:
        raise ValueError(f"vectors have {size.low} to {size.high} components; one length that {parts} divides is needed")
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    seeds = whole_numbers(np.array([r.vector for r in first]), scale)
    books = np.stack(np.split(seeds, parts, axis=1))
    kinds = ", ".join(f"{c} array<{rows.schema[c].dataType.simpleString()}>" for c in ("id", "label"))
    grown = stored(rows.mapInArrow(Plant(parts, scale), f"{kinds}, trees binary, places binary"), "trees")
    for _ in range(rounds):
        sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(books.shape[2] + 1)]
        for r in grown.select("trees").mapInArrow(Totals(books), "part int, entry int, sums array<bigint>").groupBy("part", "entry").agg(*sums).collect():
            books[r.part, r.entry] = [s // r[-1] for s in r[2:-1]]
    return grown.mapInArrow(Codes(books), out), books


def digest(books: np.ndarray) -> str:
    """sha256 of all components as decimal integers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_group_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: the error summed over rows of the same label, null being one of them.

    The sums are aggregated before they are joined back, so a label with a third of the rows is one row of that side.
    """
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
