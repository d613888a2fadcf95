"""Time parsing, calendar parts and range predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NOTE_TIME = "d/M/yyyy H:mm"


def parse_crossing_time(text: Column) -> Column:
    """``dd/MM/yyyy HH:mm`` (padded or not); junk becomes null."""
    return F.try_to_timestamp(text, F.lit(NOTE_TIME)).cast("timestamp_ntz")


def parse_iso(text: Column) -> Column:
    """ISO date or time text; junk becomes null."""
    return text.try_cast("timestamp_ntz")


def date_part(ts: Column) -> Column:
    return ts.cast("date")


def time_part(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def hour_floor(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def month_start(ts: Column) -> Column:
    return F.date_trunc("month", ts).cast("date")


def calendar_columns(df: DataFrame) -> dict[str, Column]:
    """Month and hour numbers from the optional ``date`` and ``heure`` columns."""
    out = {}
    if "date" in df.columns:
        out["mois"] = F.month(F.col("date").try_cast("date"))
    if "heure" in df.columns:
        text = F.concat(F.lit("2000-01-01 "), F.col("heure").cast("string"))
        out["heure_num"] = F.hour(text.try_cast("timestamp_ntz"))
    return out


def in_range(column: Column, start: str, end: str, grain: str = "date") -> Column:
    """Inclusive range predicate that reaches the scan.

    ``grain='date'`` keeps the whole last day, also of a timestamp column: the bounds
    stay literals and the column stays bare, so Parquet statistics can prune.
    ``grain='timestamp'`` compares with midnight of ``end`` and so loses that day.
    """
    lower, upper = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    if grain == "timestamp":
        return (column >= lower) & (column <= upper)
    if grain == "date":
        return (column >= lower) & (column < upper + F.expr("INTERVAL 1 DAY"))
    raise ValueError(f"grain must be 'date' or 'timestamp', got {grain!r}")


def period_windows(df: DataFrame, start: str, end: str, days: int = 30) -> DataFrame:
    """Closed windows of ``days`` days from column ``start`` to column ``end`` of each row."""
    step = F.expr(f"INTERVAL {int(days)} DAY")
    opened = df.select(
        "*",
        F.posexplode(F.sequence(F.col(start), F.col(end), step)).alias("period_no", "period_start"),
    ).where(F.col("period_start") <= F.col(end))
    return opened.withColumn(
        "period_end", F.least(F.date_add(F.col("period_start"), days - 1), F.col(end))
    )
