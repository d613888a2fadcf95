"""Readers and writers of the landed, derived and exported tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from seacast.operators.lines import EXTRACT_GROUPS, LINE_GROUPS, fan_out_lines
from seacast.schemas import CLEAN_CROSSINGS, RAW_CROSSINGS, SOURCE_NAMES, WEATHER_LANDED
from seacast.session import stored
from seacast.sources.landing import CORRUPT, ORDER, file_report, read_landed, rejected

# The texts a sheet or CSV reader takes as missing.
NA_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

INDEX = "_index"


def na_to_null(df: DataFrame) -> DataFrame:
    """Missing-value texts to null in every text column."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(c).isin(*NA_TEXTS), F.col(c)) for c in text})


def landed_crossings(spark: SparkSession, path: str, skip: Sequence[int] = ()) -> DataFrame:
    """All records of the landed crossing log, for :func:`read_raw_crossings` and :func:`rejected_crossings` of the same log."""
    return read_landed(spark, path, RAW_CROSSINGS, RAW_CROSSINGS.names[0], skip=skip)


def read_raw_crossings(spark: SparkSession, path: str, skip: Sequence[int] = (), landed: DataFrame | None = None) -> DataFrame:
    """The landed crossing log (CSV with header, columns found by name), canonical names, missing texts as null.

    Fields may hold line breaks. Records that are not whole are left out; :func:`rejected_crossings` gives them.
    ``skip`` are record numbers to leave out of each file (a log exported from the sheet has one below its header: 1).
    ``landed`` is what :func:`landed_crossings` gave for this log, where both functions are called.
    """
    df = landed_crossings(spark, path, skip) if landed is None else landed
    return na_to_null(df.where(F.col(CORRUPT).isNull()).drop(CORRUPT, *ORDER)).withColumnsRenamed(SOURCE_NAMES)


def rejected_crossings(spark: SparkSession, path: str, skip: Sequence[int] = (), landed: DataFrame | None = None) -> DataFrame:
    """File, place and text of the records that :func:`read_raw_crossings` leaves out."""
    return rejected(landed_crossings(spark, path, skip) if landed is None else landed)


def read_indexed_csv(spark: SparkSession, path: str, schema: T.StructType = CLEAN_CROSSINGS) -> DataFrame:
    """A CSV with a saved row index, which no column of ``schema`` names; columns are found by the header's names.

    Records that are not whole keep what could be read and are otherwise null, as :func:`read_landed` has them."""
    return read_landed(spark, path, schema, schema.names[0]).drop(CORRUPT, *ORDER)


#: Names of monthly files: landed by a collector, or written by :func:`write_monthly`.
MONTHLY_FILES = "{meteo_,part-}*.csv"


def read_monthly(spark: SparkSession, root: str, schema: T.StructType = WEATHER_LANDED, key: str = "date") -> DataFrame:
    """All monthly CSV files below ``root`` with the columns that give their row order.

    Columns are found by the names in each file's own header, whatever their order; missing ones are
    null. Unreadable files are skipped; a malformed row, and every row of a file without a header
    that names ``key``, keeps its text in ``_corrupt_record`` (:func:`skipped_files` tells of both).
    Sorting by ``_file, _block, _row`` gives file-then-line order. No file with a header is an error.
    """
    return read_landed(spark, root, schema, key, MONTHLY_FILES)


def skipped_files(spark: SparkSession, root: str, schema: T.StructType = WEATHER_LANDED, key: str = "date") -> DataFrame:
    """``file, lines, has_header, unknown, missing`` of the files that :func:`read_monthly` cannot take whole.

    ``unknown`` and ``missing`` are the columns that the file has beyond the schema and lacks of it.
    """
    return file_report(spark, root, schema, key, MONTHLY_FILES)


MONTHLY_ORDER = ORDER


def union_files(frames: Sequence[DataFrame]) -> DataFrame:
    """Row union with the outer union of the columns."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def monthly_rows(df: DataFrame, date: str = "date") -> DataFrame:
    """Rows with a readable date (as ``yyyy-MM-dd`` text) and their year and month."""
    if date not in df.columns:
        raise ValueError(f"column {date!r} is required for the monthly sink")
    parsed = df.withColumn("_day", F.col(date).cast("string").try_cast("date")).where(F.col("_day").isNotNull())
    return parsed.withColumns(
        {date: F.date_format("_day", "yyyy-MM-dd"), "year": F.year("_day"), "month": F.month("_day")}
    ).drop("_day")


def monthly_manifest(rows: DataFrame, date: str = "date") -> DataFrame:
    """First date, last date and rows of each month."""
    day = F.col(date).cast("date")
    return rows.groupBy("year", "month").agg(
        F.date_format(F.min(day), "yyyy-MM-dd").alias("first_date"),
        F.date_format(F.max(day), "yyyy-MM-dd").alias("last_date"),
        F.count(F.lit(1)).alias("n"),
    )


def write_monthly(df: DataFrame, root: str, date: str = "date", save_json: bool = False) -> DataFrame:
    """Date-sorted CSV (and JSON) per calendar month below ``root``; returns the manifest.

    The months of ``df`` are replaced, all others stay; the same call again gives the same files. The
    input is evaluated once, into a written stage. The rows are range-partitioned by date, so a month
    with very many rows is written by several tasks as several files.
    """
    rows = monthly_rows(df, date)
    ordered = stored(rows.repartitionByRange("year", "month", date).sortWithinPartitions("year", "month", date), "monthly")
    for kind in ("csv", "json") if save_json else ("csv",):
        months = ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month")
        months.format(kind).option("header", True).save(f"{root}/{kind}")
    return monthly_manifest(ordered, date)


def write_consolidated(df: DataFrame, path: str, run_date: str, date: str = "date") -> DataFrame:
    """Appends one consolidation run, partitioned by run and year; returns its date range.

    The input is evaluated once, into a written stage."""
    rows = stored(df.withColumn("year", F.year(date)), "consolidated")
    rows.withColumn("run_date", F.lit(run_date)).repartitionByRange("year", date).write.mode("append").partitionBy("run_date", "year").parquet(path)
    return rows.agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count(F.lit(1)).alias("n"))


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest consolidation run; only its partition is read.

    The newest run is an aggregate of the partition column, which reads no data column.
    """
    table = spark.read.parquet(path)
    newest = table.agg(F.max(F.col("run_date").cast("string"))).first()[0] if "run_date" in table.columns else None
    if newest is None:
        raise FileNotFoundError(f"no consolidated run below {path}")
    return table.where(F.col("run_date").cast("string") == newest).drop("run_date", "year")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_line_extracts(
    df: DataFrame, root: str, names: Sequence[str] = tuple(EXTRACT_GROUPS), groups: Mapping[str, Sequence[str]] = LINE_GROUPS
) -> DataFrame:
    """All line-group extracts as CSV in one pass, one folder per group; returns rows per group.

    A name without a group is left out and does not stop the others.
    """
    known = [n for n in names if n in groups]
    rows = stored(fan_out_lines(df, known, groups), "extracts")
    rows.write.mode("overwrite").partitionBy("line_group").csv(root, header=True)
    return rows.groupBy("line_group").agg(F.count(F.lit(1)).alias("n"))


def corrupt_rows(landed: DataFrame) -> DataFrame:
    """File, place and text of the malformed rows of :func:`read_monthly`."""
    return rejected(landed)


def export_train_test(
    df: DataFrame, root: str, features: Sequence[str], target: str, target_name: str = "log_buy_price",
    log_target: bool = False, drop_cols: Sequence[str] = (), split: str = "split",
) -> None:
    """X and y of the train and test rows as Parquet; ``drop_cols`` leave the train features only."""
    y = F.log1p(F.col(target)) if log_target else F.col(target)
    for part in ("train", "test"):
        rows = df.where(F.col(split) == part)
        kept = [c for c in features if part == "test" or c not in drop_cols]
        rows.select(*kept, y.alias(target_name)).write.mode("overwrite").parquet(f"{root}/{part}")


def write_predictions(scored: DataFrame, root: str, stem: str) -> DataFrame:
    """Scored rows as CSV below ``predictions_<stem>``; returns path and row count."""
    path = f"{root}/predictions_{stem}"
    rows = stored(scored, "predictions")
    write_csv(rows, path)
    return rows.agg(F.lit(path).alias("output"), F.count(F.lit(1)).alias("n_predictions"))


def preprocessing_metadata(processed: DataFrame, numeric: DataFrame, reduced: DataFrame, source: str, target: str = "annulation") -> DataFrame:
    """One row: input rows and the column lists of the three model tables."""

    def names(cols):
        return F.array(*[F.lit(c) for c in cols]) if cols else F.array().cast("array<string>")

    return processed.agg(
        F.lit(source).alias("source"),
        F.count(F.lit(1)).alias("input_rows"),
        names(processed.columns).alias("input_columns"),
        names(numeric.columns).alias("numeric_columns"),
        names(reduced.columns).alias("reduced_columns"),
        F.lit(target if target in processed.columns else None).cast("string").alias("target_column"),
    )
