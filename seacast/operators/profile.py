"""Column profiling: every check of a table from one aggregate row."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from seacast.operators.quantiles import clean_double, exact_quantiles

# Texts that stand for a missing value.
MISSING_TEXTS = ["", "na", "NA", "null", "NULL"]


def numeric_columns(df: DataFrame, with_bool: bool = False) -> list[str]:
    """Numeric columns; booleans count only on request."""
    kinds = (T.NumericType, T.BooleanType) if with_bool else (T.NumericType,)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def column_types(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric columns and all others."""
    numeric = numeric_columns(df)
    return numeric, [c for c in df.columns if c not in numeric]


def _long(row: DataFrame, cols: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One struct column per profiled column to one row each."""
    items = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"s{i}")[f].alias(f) for f in fields])
        for i, c in enumerate(cols)
    ]
    return row.select(F.inline(F.array(*items)))


def fill_rates(df: DataFrame) -> DataFrame:
    """Rows, nulls, completion and missing percentage of each column, from one pass."""
    total = F.count(F.lit(1))
    row = df.agg(*[F.struct(total.alias("n"), F.count(F.col(c)).alias("n_filled")).alias(f"s{i}") for i, c in enumerate(df.columns)])
    share = F.try_divide(F.col("n_filled") * 100.0, F.col("n"))
    return _long(row, df.columns, ["n", "n_filled"]).select(
        "column",
        (F.col("n") - F.col("n_filled")).alias("n_null"),
        share.alias("fill_pct"),
        (F.lit(100.0) - share).alias("missing_pct"),
    )


def missing_top(df: DataFrame, n: int | None = None) -> DataFrame:
    """Columns by missing share, highest first."""
    ranked = fill_rates(df).select("column", "missing_pct").orderBy(F.desc("missing_pct"), "column")
    return ranked.limit(n) if n is not None else ranked


def _is_boolean_like(df: DataFrame, col: str) -> Column:
    kind = df.schema[col].dataType
    if isinstance(kind, T.BooleanType):
        return F.lit(True)
    if isinstance(kind, T.NumericType):
        return F.coalesce(F.bool_and(F.col(col).isin(0, 1)), F.lit(True))
    return F.count(F.col(col)) == 0


def profile_columns(df: DataFrame, na_threshold: float = 0.5, max_modalities: int = 20) -> DataFrame:
    """Per column: empty, constant, boolean-like, high-missing, high-cardinality, missing-like.

    Everything but the distinct counts of text columns is a plain aggregate of one pass.
    The distinct counts are two-phase: pre-aggregated per partition, then per value.
    """
    text = set(string_columns(df))
    stats = []
    for i, c in enumerate(df.columns):
        value = F.col(c)
        filled = F.count(value)
        rows = F.count(F.lit(1))
        single = F.coalesce(F.min(value) == F.max(value), F.lit(True))
        missing_like = F.max(value.isNull() | (value.isin(*MISSING_TEXTS) if c in text else F.lit(False)))
        stats.append(
            F.struct(
                (rows - filled).alias("n_null"),
                (filled == 0).alias("is_empty"),
                (single & ((filled == 0) | (filled == rows))).alias("is_constant"),
                _is_boolean_like(df, c).alias("is_boolean"),
                (F.try_divide((rows - filled).cast("double"), rows) > na_threshold).alias("is_high_na"),
                F.coalesce(missing_like, F.lit(False)).alias("is_missing_like"),
            ).alias(f"s{i}")
        )
    fields = ["n_null", "is_empty", "is_constant", "is_boolean", "is_high_na", "is_missing_like"]
    base = _long(df.agg(*stats), df.columns, fields)
    modal = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in text]) if text else None
    if modal is None:
        return base.withColumns({"n_distinct": F.lit(None).cast("long"), "is_high_cardinality": F.lit(False)})
    counts = modal.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_distinct")) for c in sorted(text)]))
    )
    return base.join(counts, "column", "left").withColumn(
        "is_high_cardinality", F.coalesce(F.col("n_distinct") > max_modalities, F.lit(False))
    )


def capped_modalities(df: DataFrame, cols: Sequence[str], most: int) -> DataFrame:
    """``column, n_seen``: the number of different values of each text column (null not counted), where more than ``most``
    count as ``most + 1``.

    A task keeps at most ``most + 1`` values of a column, so what is shuffled depends on the number of
    tasks, not on the number of different values.
    """
    names = list(cols)

    def few(batches):
        held: list[set] = [set() for _ in names]
        for batch in batches:
            for values, column in zip(held, batch.columns):
                if len(values) <= most:
                    seen = pc.unique(column).drop_null()
                    values.update(seen.slice(0, 2 * most + 2).to_pylist())  # of these, at least most + 1 are new or there are no others
        rows = [(i, v) for i, values in enumerate(held) for v in sorted(values)[: most + 1]]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.string())], ["i", "v"])

    found = df.select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(names)]).mapInArrow(few, "i int, v string").distinct()
    counts = found.groupBy("i").agg(F.least(F.count(F.lit(1)), F.lit(most + 1)).alias("n"))
    every = df.sparkSession.range(len(names)).select(F.col("id").cast("int").alias("i"))
    name = F.get(F.array(*[F.lit(c) for c in names]), F.col("i"))
    return every.join(counts, "i", "left").select(name.alias("column"), F.coalesce("n", F.lit(0)).cast("long").alias("n_seen"))


def high_cardinality(df: DataFrame, max_modalities: int = 20) -> DataFrame:
    """``column, n_seen, is_high_cardinality`` of the text columns, without counting beyond ``max_modalities``."""
    text = [c for c in string_columns(df)]
    if not text:
        return df.sparkSession.createDataFrame([], "column string, n_seen bigint, is_high_cardinality boolean")
    return capped_modalities(df, text, max_modalities).withColumn("is_high_cardinality", F.col("n_seen") > max_modalities)


def flagged(df: DataFrame, check: str, **options) -> list[str]:
    """Names of the columns with a profile flag, e.g. ``flagged(df, 'is_empty')``."""
    if check == "is_high_cardinality":  # needs no exact numbers
        found = high_cardinality(df, **{k: v for k, v in options.items() if k == "max_modalities"})
    else:
        found = profile_columns(df, **options)
    names = {r["column"] for r in found.where(F.col(check)).select("column").collect()}
    return [c for c in df.columns if c in names]


def value_counts(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    """Counts of each value (null kept), largest first, ties by value."""
    counts = df.groupBy(F.col(col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.orderBy(F.desc("n"), F.asc_nulls_last("value"))
    return ranked.limit(n) if n is not None else ranked


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def distinct_counts(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values of each column, exact or by sketch."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(F.col(c)).alias(c) for c in cols])


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, standard deviation, minimum, quartiles and maximum per numeric column; NaN counts as null."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    row = df.agg(
        *[
            F.struct(
                F.count(clean_double(c)).alias("n"),
                F.avg(clean_double(c)).alias("mean"),
                F.stddev_samp(clean_double(c)).alias("std"),
                F.min(clean_double(c)).alias("min"),
                F.max(clean_double(c)).alias("max"),
            ).alias(f"s{i}")
            for i, c in enumerate(cols)
        ]
    )
    quartiles = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    schema = "column string, q25 double, q50 double, q75 double"
    points = df.sparkSession.createDataFrame(
        [(c, *[quartiles[c][p] for p in (0.25, 0.5, 0.75)]) for c in cols], schema
    )
    return _long(row, cols, ["n", "mean", "std", "min", "max"]).join(points, "column")


def date_span(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).alias("first"), F.max(col).alias("last"))


def inspect(df: DataFrame, date: str, target: str) -> DataFrame:
    """Shape, date span, distinct target values and null cells in one row."""
    nulls = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in df.columns), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.min(date).alias("first"),
        F.max(date).alias("last"),
        F.count_distinct(F.col(target)).alias("n_target_values"),
        F.sum(nulls).alias("n_null_cells"),
    )


def majority_value(df: DataFrame, col: str, order: Sequence[str]) -> DataFrame:
    """The most frequent non-null value; a tie goes to the value seen first. No value, no row."""
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    counts = (
        df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"), F.min(rank).alias("_first"))
    )
    best = counts.agg(F.min(F.struct(-F.col("_n"), F.col("_first"), F.col(col).alias("value"))).alias("_best"))
    return best.where(F.col("_best").isNotNull()).select("_best.value")


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mode of each column as text (ties: smallest value), from one pre-aggregated pass."""
    slots = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(cols)])
    numeric = set(numeric_columns(df))
    counts = (
        df.select(F.inline(slots)).where(F.col("v").isNotNull()).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    )
    number = F.when(F.col("i").isin(*[i for i, c in enumerate(cols) if c in numeric]), F.col("v").try_cast("double"))
    best = counts.groupBy("i").agg(F.min(F.struct(-F.col("n"), number.alias("x"), F.col("v"))).alias("b"))
    names = F.array(*[F.lit(c) for c in cols])
    return best.select(F.get(names, F.col("i")).alias("column"), F.col("b.v").alias("mode"), (-F.col("b.col1")).alias("n"))


def histograms(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 40) -> DataFrame:
    """Equal-width histogram per numeric column, last bin closed; empty bins are left out. NaN counts as null.

    One pass finds the ranges, a second one counts all columns' bins in a hash aggregate.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    values = {c: clean_double(c) for c in cols}
    row = df.agg(*[F.struct(F.min(v).alias("low"), F.max(v).alias("high")).alias(f"s{i}") for i, v in enumerate(values.values())]).first()
    items = []
    for i, (c, v) in enumerate(values.items()):
        low, high = row[i]["low"], row[i]["high"]
        if low is None:
            continue
        if low == high:
            low, high = low - 0.5, high + 0.5
        width = (high - low) / bins
        bin_no = F.least(F.floor((v - low) / F.lit(high - low) * bins), F.lit(bins - 1)).cast("int")
        items.append(
            F.when(
                v.isNotNull(),
                F.struct(F.lit(c).alias("column"), bin_no.alias("bin"), F.lit(low).alias("low"), F.lit(width).alias("width")),
            )
        )
    return (
        df.select(F.explode(F.array(*items)).alias("h"))
        .where(F.col("h").isNotNull())
        .groupBy("h.column", "h.bin", "h.low", "h.width")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "column",
            "bin",
            (F.col("low") + F.col("bin") * F.col("width")).alias("bin_low"),
            (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("bin_high"),
            "n",
        )
    )
