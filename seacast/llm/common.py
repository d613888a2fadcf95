"""Shared pieces: the word pattern, column hygiene, staged tables and distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seacast.session import stored

#: ASCII white space; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]"


def words(text: str | Column = "text") -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; a null text has none."""
    col = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(col, F.lit("")), SPACE + "+"), lambda w: w != "")


def without(df: DataFrame, *names: str) -> list[Column]:
    """The columns of ``df`` that ``names`` would not hide (names compare without case)."""
    taken = {n.lower() for n in names}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]


def prefix_sums(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of its group that come before it in ``order``.

    Rows are dealt by ranges of (group, order), so a hot group spans many ranges. The ranges are
    pinned in a written table; one total per range and group gives each range its start. ``group``
    columns must not be null; rows that tie in ``order`` are ordered arbitrarily among themselves.
    """
    staged = stored(df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        staged.groupBy("_range", *group).agg(F.sum(value).alias("_total"))
        .withColumn("_start", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
    )
    inside = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        staged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, ["_range", *group])
        .withColumn(out, (F.col("_start") + F.col("_inside")).cast("long"))
        .drop("_range", "_start", "_inside")
    )
