"""Exact k-nearest-neighbour vote by balls around pivots."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from seacast.operators.quantiles import clean_double
from seacast.session import stored

#: Pivots at most: tasks hold them all, and the driver one row of statistics for each.
PIVOTS = 2_000
#: What rounding may add to a bound.
SLACK = 1e-9


def gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and y, feature by feature."""
    out = np.zeros((len(x), len(y)))
    for f in range(x.shape[1]):
        gap = x[:, f, None] - y[None, :, f]
        out += gap * gap
    return out


class Balls:
    """Pivots with the number of training rows that are nearest to each and the radius around it that holds them."""

    def __init__(self, points: np.ndarray, names: Sequence[str]):
        self.points, self.names = points, list(names)
        self.rows, self.radius = np.zeros(len(points), np.int64), np.zeros(len(points))

    def chunks(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        for frame in frames:
            for at in range(0, len(frame), size := max(1, 2_000_000 // len(self.points))):
                part = frame.iloc[at : at + size]
                yield part, np.sqrt(gaps(part[self.names].to_numpy(), self.points))

    def nearest(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows with ``c``, their nearest pivot, and ``d``, the distance to it."""
        for part, far in self.chunks(frames):
            yield part.assign(c=far.argmin(axis=1).astype("int32"), d=far.min(axis=1))

    def bounded(self, k: int) -> Callable:
        def bound(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Rows with ``c``, ``d`` and ``r``: balls taken in the order of their far sides hold k rows within r."""
            for part, far in self.chunks(frames):
                ends = np.where(self.rows > 0, far + self.radius, np.inf)
                order = np.argsort(ends, axis=1)
                enough = (np.cumsum(self.rows[order], axis=1) >= k).argmax(axis=1)
                reach = np.take_along_axis(ends, np.take_along_axis(order, enough[:, None], axis=1), axis=1)[:, 0]
                reach = np.where(self.rows.sum() >= k, reach, np.inf)
                near = np.where(self.rows > 0, far, np.inf)
                yield part.assign(c=near.argmin(axis=1).astype("int32"), d=near.min(axis=1), r=reach * (1 + SLACK))

        return bound

    def beside(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows (with ``own`` and ``r``) once for each other ball that may hold a row within r: its near side is within r, and
        so is the plane half-way between its pivot and the own one, beyond which all its rows lie."""
        between = np.sqrt(gaps(self.points, self.points))
        for part, far in self.chunks(frames):
            own, reach = part["own"].to_numpy(), part["r"].to_numpy()[:, None] * (1 + SLACK)
            mine = far[np.arange(len(part)), own][:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (far * far - mine * mine) / (2 * between[own])
            plane = np.where(np.isfinite(plane), plane * (1 - SLACK), 0.0) - SLACK * far
            some = (self.rows > 0) & (far - self.radius <= reach) & (plane <= reach)
            some[np.arange(len(part)), own] = False
            row, ball = np.nonzero(some)
            yield part.iloc[row].drop(columns="own").assign(c=ball.astype("int32"), d=far[row, ball])


def knn_pairs(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, key: str, k: int = 5, block_rows: int = 20_000, pivots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((key, train_key, label, dist), (compared)): the k nearest training rows of each test row, and with how many
    training rows the test rows were compared in all.

    Pivots are training rows in the order of a hash, one for about ``block_rows`` rows (``PIVOTS`` at most). A training
    row belongs to its nearest pivot; a test row first meets the rows of its own pivot, then those of each other
    ball that the triangle inequality leaves: neither the ball's near side nor the plane between both pivots may be
    farther than the k-th neighbour so far, which before any comparison is bounded by the balls' far sides. Within a
    ball only rows whose distance to the pivot differs by no more than that are compared. A ball or a group of test
    rows larger than a block is split by key. Equal distances go to the smaller training key. A null or NaN
    feature has no distance and is an error: impute first.
    """
    names = [f"f{i}" for i in range(len(features))]
    values = [clean_double(f).alias(n) for f, n in zip(features, names)]
    holes = F.count_if(F.array_contains(F.transform(F.array(*names), lambda v: v.isNull()), True))
    trains = train.select(F.col(key).alias("train_key"), F.col(label).cast("int").alias("label"), *values)
    tests = test.select(F.col(key).alias("key"), *values)
    (n, lost), (_, open_) = (d.agg(F.count(F.lit(1)), holes).first() for d in (trains, tests))
    if lost or open_:
        raise ValueError(f"{lost} training and {open_} test rows lack a feature")
    if not n:
        raise ValueError("no training row")
    count = min(PIVOTS, pivots or -(-n // block_rows))
    first = trains.orderBy(F.xxhash64(F.col("train_key").cast("string")), "train_key", *names).select(*names).limit(count).collect()
    balls = Balls(np.array([tuple(r) for r in first], dtype=float).reshape(-1, len(names)), names)
    kind, train_kind = test.schema[key].dataType.simpleString(), train.schema[key].dataType.simpleString()
    numbers = ", ".join(f"{f} double" for f in names)
    in_balls = stored(trains.mapInPandas(balls.nearest, f"train_key {train_kind}, label int, {numbers}, c int, d double"), "balls")
    for r in in_balls.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("r")).collect():
        balls.rows[r["c"]], balls.radius[r["c"]] = r["n"], r["r"] * (1 + SLACK)

    def blocks(df: DataFrame):
        """Blocks of the row's ball ``c``."""
        sizes = {r[0]: r[1] for r in df.groupBy("c").count().collect()}
        return F.array(*[F.lit(-(-max(sizes.get(c, 1), 1) // block_rows)) for c in range(len(balls.points))])[F.col("c")]

    def part(name: str, of):
        return F.pmod(F.xxhash64(F.col(name).cast("string")), of).cast("int")

    train_blocks = blocks(in_balls)

    def nearest(tests: pd.DataFrame, trains: pd.DataFrame) -> pd.DataFrame:
        tests, trains = tests.sort_values("d"), trains.sort_values(["d", "train_key"])
        x, y, at_d = tests[names].to_numpy(), trains[names].to_numpy(), trains["d"].to_numpy()
        d, reach, found = tests["d"].to_numpy(), tests["r"].to_numpy(), []
        chunk = max(1, 4_000_000 // max(1, len(trains)))
        for start in range(0, len(tests), chunk):
            rows = slice(start, start + chunk)
            low, high = (d[rows] - reach[rows]) * (1 - SLACK) - SLACK, (d[rows] + reach[rows]) * (1 + SLACK) + SLACK
            a, b = np.searchsorted(at_d, low.min(), "left"), np.searchsorted(at_d, high.max(), "right")
            if a == b:
                continue
            names_of = trains["train_key"].to_numpy()[a:b]
            by_key = np.argsort(names_of, kind="stable")
            dist = gaps(x[rows], y[a:b][by_key])
            take = min(k, b - a)
            limit = np.partition(dist, take - 1, axis=1)[:, take - 1]
            row, at = np.nonzero(dist <= limit[:, None])
            order = np.lexsort((at, dist[row, at], row))
            row, at = row[order], at[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, at, place = row[place < take], at[place < take], place[place < take]
            found.append(pd.DataFrame({
                "key": tests["key"].to_numpy()[start + row], "train_key": names_of[by_key][at], "label": trains["label"].to_numpy()[a:b][by_key][at],
                "dist": dist[row, at], "seen": np.where(place == 0, b - a, 0),
            }))
        none = pd.DataFrame({"key": tests["key"].iloc[:0], "train_key": trains["train_key"].iloc[:0].set_axis([]), "label": [], "dist": [], "seen": []})
        return pd.concat(found) if found else none

    def met(rows: DataFrame) -> DataFrame:
        """The k best training rows of each test row from each block of the balls ``c`` that it is given."""
        test_blocks = blocks(rows)
        left = rows.withColumn("b", part("key", test_blocks)).withColumn("a", F.explode(F.sequence(F.lit(0), train_blocks - 1)))
        right = in_balls.withColumn("a", part("train_key", train_blocks)).withColumn("b", F.explode(F.sequence(F.lit(0), test_blocks - 1)))
        both = left.groupBy("c", "a", "b").cogroup(right.groupBy("c", "a", "b"))
        return stored(both.applyInPandas(nearest, f"key {kind}, train_key {train_kind}, label int, dist double, seen bigint"), "met")

    def best(pairs: DataFrame) -> DataFrame:
        nearest_first = Window.partitionBy("key").orderBy("dist", "train_key")
        return pairs.withColumn("_place", F.row_number().over(nearest_first)).where(F.col("_place") <= k).drop("_place")

    at_home = stored(tests.mapInPandas(balls.bounded(k), f"key {kind}, {numbers}, c int, d double, r double"), "tests")
    own = met(at_home)
    reach = best(own).groupBy("key").agg(F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("dist"))).alias("_r"))
    placed = at_home.join(reach, "key", "left").withColumn("r", F.least("r", F.coalesce("_r", "r"))).withColumnRenamed("c", "own").drop("_r", "d")
    others = stored(placed.mapInPandas(balls.beside, f"key {kind}, {numbers}, r double, c int, d double"), "others")
    beside = met(others)
    every = own.unionByName(beside)
    return best(every).drop("seen"), every.agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("compared"))


def knn_vote(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, key: str, k: int = 5, block_rows: int = 20_000, pivots: int | None = None) -> DataFrame:
    """(key, prediction): exact majority vote of the k nearest training rows (Euclidean), see :func:`knn_pairs`; equal votes
    go to the smaller label."""
    return voted(knn_pairs(train, test, features, label, key, k, block_rows, pivots)[0], key)


def voted(pairs: DataFrame, key: str) -> DataFrame:
    votes = pairs.groupBy("key", "label").agg(F.count(F.lit(1)).alias("votes"))
    return (
        votes.groupBy("key")
        .agg(F.min(F.struct(-F.col("votes"), F.col("label"))).alias("best"))
        .select(F.col("key").alias(key), F.col("best.label").alias("prediction"))
    )
