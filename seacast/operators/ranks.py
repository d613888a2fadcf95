"""Rank correlations over range-partitioned orders: average ranks of all pairs from one order, and inversion counts.

No row meets another by its value: equal values that lie in several ranges are settled by what the ranges
report, so a value that a third of the rows have is dealt like any other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from seacast.operators.quantiles import clean_double
from seacast.session import stored


#: Entries of a range, or of a part of rows that are put together; their number grows with the table, not their size.
RANGE_ROWS = 250_000


def parts_of(n: int) -> int:
    return max(-(-n // RANGE_ROWS), 4)


class Within:
    """A sorted range to its rows with the number of the range and, for each flag, the average rank of the value among the rows of
    its key in the range for which the flag is 1 (``_mid_<flag>``)."""

    def __init__(self, key: str, value: str, flags: Sequence[str]):
        self.key, self.value, self.flags = key, value, list(flags)

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        key, value = table[self.key].to_numpy(), table[self.value].to_numpy()
        other = np.diff(key) != 0
        keys = np.concatenate([[True], other])
        first = np.flatnonzero(np.concatenate([[True], other | (np.diff(value) != 0)]))
        sizes = np.diff(np.append(first, len(key)))
        begin = np.maximum.accumulate(np.where(keys, np.arange(len(key)), 0))[first]
        for f in self.flags:
            upto = np.concatenate([[0], np.cumsum(table[f].to_numpy(), dtype=np.int64)])
            equal, less = upto[first + sizes] - upto[first], upto[first] - upto[begin]
            table = table.append_column(f"_mid_{f}", pa.array(np.repeat(less + (equal + 1) / 2.0, sizes)))
        yield from table.append_column("_range", pa.array(np.full(len(key), TaskContext.get().partitionId(), np.int32))).to_batches()


def tied_ranks(rows: DataFrame, key: str, value: str, tie: str, flags: Sequence[str]) -> DataFrame:
    """``rows`` (key, value, tie, flags) with the average rank of the value within its key, for each flag as ``<flag>_rank``:
    among the rows of the key for which the flag is 1. Keys and flags are whole numbers, values are neither null nor NaN.

    The rows are dealt once by ranges of (key, value, tie), as many as their number asks for, and ranked within them. A range reports its
    totals and, for its least and greatest value, how many rows have it; running totals of these give every range how many rows come
    before it and how many equal ones lie in the ranges beside it. Tasks hold these reports, a few rows for each range.
    """
    dealt = rows.repartitionByRange(parts_of(rows.count()), key, value, tie).sortWithinPartitions(key, value)
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), *(f"`_mid_{f}` double" for f in flags), "_range int"])
    parts = stored(dealt.mapInArrow(Within(key, value, flags), kinds), "ranks")
    report = parts.groupBy(key, "_range").agg(F.min(value).alias("_low"), F.max(value).alias("_high"), *(F.sum(f).alias(f"_t_{f}") for f in flags))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    report = stored(report.select(key, "_range", "_low", "_high", *(F.coalesce(F.sum(f"_t_{f}").over(before), F.lit(0)).alias(f"_b_{f}") for f in flags)), "ranges")
    edges = parts.join(F.broadcast(report.select(key, "_range", "_low", "_high")), [key, "_range"]).where((F.col(value) == F.col("_low")) | (F.col(value) == F.col("_high")))
    counts = edges.groupBy(key, value, "_range").agg(*(F.sum(f).alias(f) for f in flags))
    sides = [Window.partitionBy(key, value).orderBy(order).rowsBetween(Window.unboundedPreceding, -1) for order in (F.col("_range"), F.col("_range").desc())]
    left, right = ({f: F.coalesce(F.sum(f).over(w), F.lit(0)) for f in flags} for w in sides)
    beside = counts.select(F.col(key).alias("_k"), F.col("_range").alias("_r"), F.col(value).alias("_edge"), *((right[f] - left[f]).alias(f"_beside_{f}") for f in flags))
    kept = stored(beside.where(" OR ".join(f"_beside_{f} <> 0" for f in flags)), "edges")
    told = parts.join(F.broadcast(report.drop("_low", "_high")), [key, "_range"])
    told = told.join(F.broadcast(kept), (F.col(key) == F.col("_k")) & (F.col("_range") == F.col("_r")) & (F.col(value) == F.col("_edge")), "left")
    # Of the rows before the range, the equal ones to the left count by half, and so do those to the right.
    return told.select(*rows.columns, *((F.col(f"_b_{f}") + F.col(f"_mid_{f}") + F.coalesce(f"_beside_{f}", F.lit(0)) / 2.0).alias(f"{f}_rank") for f in flags))


def pair_ranks(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str], list[int], list[int], list[tuple[str, str]]]:
    """(rows, names, left, right, pairs): columns of ranks such that those at left[i] and right[i] are the ranks of pair i
    among the rows that know both of its columns.

    All columns share one order. Besides its rank among all known values, a value has one among the rows
    that know column b, for each b with holes; these come from running totals over the same order.
    """
    data = stored(df.select(*[clean_double(c).alias(f"c{i}") for i, c in enumerate(cols)]).withColumn("_row", F.monotonically_increasing_id()), "numbers")
    holes = data.agg(*[F.count_if(F.col(f"c{i}").isNull()).alias(f"h{i}") for i in range(len(cols))]).first()
    flagged = [i for i in range(len(cols)) if holes[i]]
    flags = ["k", *(f"k{i}" for i in flagged)]
    known = [F.lit(1).alias("k"), *(F.col(f"c{i}").isNotNull().cast("int").alias(f"k{i}") for i in flagged)]
    slots = F.array(*[F.struct(F.lit(i).alias("variable"), F.col(f"c{i}").alias("value")) for i in range(len(cols))])
    entries = data.select("_row", *known, F.inline(slots)).where("value IS NOT NULL")
    ranked = tied_ranks(entries.select("variable", "value", "_row", *flags), "variable", "value", "_row", flags)
    names = [f"r{i}_{f}" for i in range(len(cols)) for f in flags]
    wide = ranked.repartition(parts_of(entries.count()), "_row").groupBy("_row").agg(*[F.max(F.when(F.col("variable") == i, F.col(f"{f}_rank"))).alias(f"r{i}_{f}") for i in range(len(cols)) for f in flags])

    def place(of: int, beside: int) -> int:
        return names.index(f"r{of}_{f'k{beside}' if beside in flagged else 'k'}")

    both = list(combinations(range(len(cols)), 2))
    return stored(wide.select(*names), "wide-ranks"), names, [place(a, b) for a, b in both], [place(b, a) for a, b in both], [(cols[a], cols[b]) for a, b in both]


# --- inversions -------------------------------------------------------------


def inversions(rank: np.ndarray, weight: np.ndarray) -> float:
    """Weight of the pairs whose first member has the larger rank, by splitting the ranks bit by bit."""
    order, group, total = np.arange(len(rank)), np.zeros(len(rank), np.int64), 0.0
    for bit in reversed(range(int(rank.max()).bit_length() if len(rank) else 0)):
        high = (rank[order] >> bit) & 1
        w = weight[order].astype(np.float64)
        ones = np.cumsum(w * high) - w * high
        first = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
        ones -= np.repeat(ones[first], np.diff(np.append(first, len(group))))
        total += float((w * (1 - high) * ones).sum())
        group = 2 * group + high
        stable = np.argsort(group, kind="stable")
        order, group = order[stable], group[stable]
    return total


class Crossed:
    """Sorted ranges of weighted points to the same points with the number of the range, as column ``out``. The first point of a
    pair in a range carries the inversions among its points there: those of (y, x) in the order that they come in."""

    def __init__(self, out: str):
        self.out = out

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pair, held = TaskContext.get().partitionId(), None, []
        for batch in batches:
            pairs = batch.column("pair").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(pairs) != 0])) if len(pairs) else []
            for a, b in zip(cuts, np.append(cuts[1:], len(pairs)) if len(cuts) else []):
                if held and pairs[a] != pair:
                    yield from self.segment(held, part)
                    held = []
                pair = pairs[a]
                held.append(batch.slice(int(a), int(b - a)))
        if held:
            yield from self.segment(held, part)

    def segment(self, held: list[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        x, y, w = (table[c].to_numpy() for c in ("x", "y", "w"))
        rank = np.empty(len(x), np.int64)
        rank[np.lexsort((x, y))] = np.arange(len(x))
        at = pa.array(np.full(len(x), part, np.int32))
        found = np.zeros(len(x))
        found[0] = inversions(rank, w)
        old = ["a"] if "a" in table.column_names else []
        columns = [*(table[c] for c in ("pair", "x", "y", "w", *old)), at, pa.array(found)]
        yield from pa.table(columns, names=["pair", "x", "y", "w", *old, self.out, f"inside_{self.out}"]).to_batches()


def apart(cells: pd.DataFrame) -> pd.DataFrame:
    """Inversions between points of different x ranges and different y ranges, from the weights of all cells of a pair."""
    a, q = (np.unique(cells[c].to_numpy(), return_inverse=True)[1] for c in ("a", "q"))
    grid = np.zeros((a.max() + 1, q.max() + 1))
    np.add.at(grid, (a, q), cells["w"].to_numpy())
    above = grid[:, ::-1].cumsum(axis=1)[:, ::-1] - grid  # in the same x range, greater y ranges
    earlier = above.cumsum(axis=0) - above
    return pd.DataFrame({"pair": cells["pair"].iloc[:1], "d": [float((grid * earlier).sum())]})


def kendall_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``var_a, var_b, corr``: Kendall's tau-b of every column pair, over the rows that know both.

    Equal points of a pair are one weighted point. Points are dealt by ranges of (pair, x, y): a range counts the
    inversions inside itself. They are dealt again by ranges of (pair, y, x), in the order of x: a range counts the
    inversions between its points of different x ranges. What is left, points that differ in both ranges, follows
    from the weights of the cells (x range, y range), as many as the square of the ranges. Equal y are told apart by x, so they are
    no inversions and a value with most rows is dealt over many ranges. Ties are grouped counts. A column
    without two different values gives null. Weights add up as doubles, exact below 2 ** 53 pairs.
    """
    cols = list(cols)
    both = list(combinations(range(len(cols)), 2))
    values = [clean_double(c) for c in cols]
    slots = F.array(*[F.struct(F.lit(i).alias("pair"), values[a].alias("x"), values[b].alias("y")) for i, (a, b) in enumerate(both)])
    known = df.select(F.inline(slots)).where("x IS NOT NULL AND y IS NOT NULL")
    points = stored(known.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("w")), "points")
    kind = "pair int, x double, y double, w bigint, {}"
    by_x = points.repartitionByRange("pair", "x", "y").sortWithinPartitions("pair", "x", "y").mapInArrow(Crossed("a"), kind.format("a int, inside_a double"))
    by_x = stored(by_x, "by-x")
    by_y = by_x.drop("inside_a").repartitionByRange("pair", "y", "x").sortWithinPartitions("pair", "a", "y", "x")
    by_y = stored(by_y.mapInArrow(Crossed("q"), kind.format("a int, q int, inside_q double")), "by-y")
    cells = by_y.groupBy("pair", "a", "q").agg(F.sum("w").cast("double").alias("w"))
    crossed = (
        by_x.groupBy("pair").agg(F.sum("inside_a").alias("d"))
        .unionByName(by_y.groupBy("pair").agg(F.sum("inside_q").alias("d")))
        .unionByName(cells.groupBy("pair").applyInPandas(apart, "pair int, d double"))
        .groupBy("pair").agg(F.sum("d").alias("d"))
    )

    def ties(*keys: str) -> DataFrame:
        w = F.col("w").cast("double")
        same = points.groupBy("pair", *keys).agg(F.sum("w").alias("w"))
        return same.groupBy("pair").agg(F.sum(w * (w - 1) / 2).alias("_".join(["t", *keys])))

    all_ = ties().join(ties("x"), "pair").join(ties("y"), "pair").join(ties("x", "y"), "pair").join(crossed, "pair")
    top = F.col("t") - F.col("t_x") - F.col("t_y") + F.col("t_x_y") - 2 * F.col("d")
    wide = F.sqrt(F.col("t") - F.col("t_x")) * F.sqrt(F.col("t") - F.col("t_y"))
    names = [F.get(F.array(*[F.lit(cols[p[k]]) for p in both]), F.col("pair")) for k in (0, 1)]
    pairs = df.sparkSession.range(len(both)).select(F.col("id").cast("int").alias("pair"))
    return pairs.join(all_, "pair", "left").select(names[0].alias("var_a"), names[1].alias("var_b"), F.try_divide(top, wide).alias("corr"))
