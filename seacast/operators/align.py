"""Joins of crossings with weather."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def daily_weather_merge(daily: DataFrame, weather: DataFrame, day: str = "jour") -> DataFrame:
    """Inner join of the daily roll-up with daily weather.

    The roll-up's own temperature columns get the prefix ``crossing_``: their names would
    differ from the weather ones only by letter case. Both sides hold one row per day; the
    join strategy is left to the measured sizes.
    """
    renamed = daily.withColumnsRenamed(
        {"temperature_min": "crossing_temperature_min", "temperature_max": "crossing_temperature_max"}
    )
    return renamed.join(weather, day, "inner")


def align(crossings: DataFrame, weather: DataFrame, grain: str = "day", ts: str = "horaire", day: str = "jour"):
    """Crossing-grain inner join with daily weather.

    ``grain='hour'`` compares the hour of the crossing with the weather date at midnight,
    so only crossings between 00:00 and 00:59 match; ``'day'`` compares the calendar days.
    The crossing side is the big one: with weather below the broadcast threshold it is not
    shuffled; above it, adaptive skew splitting handles a day that holds many crossings.
    """
    if grain == "hour":
        key = F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz")
        right = F.col("_day").cast("timestamp_ntz")
    elif grain == "day":
        key, right = F.col(ts).cast("date"), F.col("_day")
    else:
        raise ValueError(f"grain must be 'hour' or 'day', got {grain!r}")
    left = crossings.drop(day) if day in crossings.columns else crossings
    return left.join(weather.withColumnRenamed(day, "_day"), key == right, "inner").drop("_day")


def attach_label(weather: DataFrame, labels: DataFrame, day: str = "jour", target: str = "annulation") -> DataFrame:
    """Weather rows with the day's target."""
    return weather.join(labels.select(day, target), day, "inner")
