"""Operators over one global row order, without a single-task window.

The rows are range-partitioned on the order key, each range is summarised to one row,
the summaries (as many as ranges) carry their result to the next range, and the exact
work happens inside each range. A reliable checkpoint pins the range of every row, so
a lost executor cannot move a row to another range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from seacast.session import checkpointed

PART = "_range"


def ranged(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` cut into ordered ranges: a row of a lower ``_range`` sorts first."""
    return checkpointed(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))


def running_totals(
    df: DataFrame, order: Sequence[Column], totals: dict[str, Column], keys: Sequence[str] = ()
) -> DataFrame:
    """Adds running sums over the order (inclusive), one series per ``keys`` group.

    The order must be unique within a group.
    """
    keys = list(keys)
    names = list(totals)
    parts = ranged(df.withColumns({f"_v_{n}": c for n, c in totals.items()}), [F.col(k) for k in keys] + list(order))
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy(*keys, PART)
        .agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
        .select(*keys, PART, *[F.sum(f"_s_{n}").over(before).alias(f"_o_{n}") for n in names])
    )
    inside = Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = parts.join(F.broadcast(offsets) if not keys else offsets, [*keys, PART])
    return joined.withColumns(
        {n: F.sum(f"_v_{n}").over(inside) + F.coalesce(F.col(f"_o_{n}"), F.lit(0)) for n in names}
    ).drop(PART, *[f"_v_{n}" for n in names], *[f"_o_{n}" for n in names])


def fill_both_ways(
    df: DataFrame, order: Sequence[str], cols: Sequence[str], partition_cols: Sequence[str] = ()
) -> DataFrame:
    """Forward fill, then backward fill, of ``cols`` along the unique ``order``.

    Per range only the first and last known value of each column travel on. A row with no
    known value before it takes the first one of its own range, else of a later range, so
    every window only looks back and runs in linear time.
    """
    keys = list(partition_cols)
    rank = F.struct(*order)
    parts = ranged(df, [F.col(c) for c in [*keys, *order]])
    known = parts.groupBy(*keys, PART).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(f"_last_{c}") for c in cols],
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(f"_first_{c}") for c in cols],
    )
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    own_and_later = Window.partitionBy(*keys).orderBy(F.desc(PART)).rowsBetween(Window.unboundedPreceding, 0)
    carried = known.select(
        *keys,
        PART,
        *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_down_{c}") for c in cols],
        *[F.last(f"_first_{c}", ignorenulls=True).over(own_and_later).alias(f"_up_{c}") for c in cols],
    )
    back = Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = parts.join(F.broadcast(carried) if not keys else carried, [*keys, PART])
    filled = {
        c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.col(f"_down_{c}"), F.col(f"_up_{c}")) for c in cols
    }
    return joined.withColumns(filled).select(*df.columns)
