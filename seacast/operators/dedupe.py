"""Duplicate handling with an explicit row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key in ``order``.

    ``min_by`` pre-aggregates on the map side: a key that holds a third of the rows reaches
    the shuffle as one row per input partition.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*keys, "_row.*").select(*df.columns)


def duplicate_rows(
    df: DataFrame, order: Sequence[str], subset: Sequence[str] | None = None, keep: str | bool = "first"
) -> DataFrame:
    """The duplicate rows of ``df``: all but the first, all but the last, or all (``False``).

    Two rows are duplicates when ``subset`` (default: every column but ``order``) is equal,
    nulls being equal to each other. Only keys seen more than once join back, null-safe; a
    hot key is split by the adaptive skew join.
    """
    keys = list(subset) if subset is not None else [c for c in df.columns if c not in order]
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    kept = {"first": F.min(rank), "last": F.max(rank), False: F.lit(None)}
    if keep not in kept:
        raise ValueError(f"keep must be 'first', 'last' or False, got {keep!r}")
    groups = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), kept[keep].alias("_kept"))
        .where(F.col("_n") > 1)
        .withColumnsRenamed({k: f"_k_{k}" for k in keys})
    )
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = df.join(groups, match, "inner")
    if keep is not False:
        joined = joined.where(rank != F.col("_kept"))
    return joined.select(*df.columns)


def count_duplicates(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Number of rows beyond the first of each group, from pre-aggregated counts."""
    keys = list(subset) if subset is not None else df.columns
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"))


def consolidate(df: DataFrame, order: Sequence[str], date: str = "date") -> DataFrame:
    """Keep-first per raw date text, then a typed date."""
    return keep_first(df, [date], order).withColumn(date, F.col(date).try_cast("date"))
