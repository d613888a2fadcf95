"""Paired marine / weather JSON payloads to daily rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seacast.schemas import MARINE_MEASURES, WEATHER_MEASURES, WEATHER_PAYLOAD


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed payload files, one JSON object per period and line."""
    return spark.read.schema(WEATHER_PAYLOAD).json(path)


def flatten_payloads(payloads: DataFrame) -> DataFrame:
    """One row per marine day of each payload, with the weather of the same date.

    The two halves sit in one row, so the date lookup is an array search inside the row and
    nothing is shuffled. A measure array shorter than ``time`` gives null, a date without
    weather keeps its marine values, a repeated weather date uses its first position, and a
    payload without marine data gives no rows.
    """
    marine = F.col("marine_data.daily")
    weather = F.col("weather_data.daily")
    days = payloads.select(marine.alias("m"), weather.alias("w"), F.posexplode("marine_data.daily.time").alias("at", "date"))
    spot = F.array_position(F.col("w.time"), F.col("date"))
    found = days.withColumn("spot", F.when(spot > 0, (spot - 1).cast("int")))
    return found.select(
        "date",
        *[F.get(F.col(f"m.{source}"), F.col("at")).alias(name) for source, name in MARINE_MEASURES.items()],
        *[F.get(F.col(f"w.{source}"), F.col("spot")).alias(name) for source, name in WEATHER_MEASURES.items()],
    )
