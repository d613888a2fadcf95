"""Sunrise and sunset per calendar day, and minutes of night per crossing.

The day table follows the public NOAA solar equations (Julian century, equation of
time, declination, hour angle at zenith 90.833 degrees), evaluated twice: once at
midnight, once at the event itself. Every step is a plain column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# Position and time zone of the home harbour.
LATITUDE = 43.2965
LONGITUDE = 5.3698
TIME_ZONE = "Europe/Paris"
ZENITH = 90.833


def _sin(deg: Column) -> Column:
    return F.sin(F.radians(deg))


def _cos(deg: Column) -> Column:
    return F.cos(F.radians(deg))


def _event(df: DataFrame, century: Column, side: int, lat: float, lon: float, zenith: float, out: str):
    """Adds ``out``: minutes after 00:00 UTC of sunrise (side 1) or sunset (side -1)."""
    jc = F.col("_jc")
    df = df.withColumn("_jc", century).withColumns(
        {
            "_l0": F.pmod(F.lit(280.46646) + jc * (F.lit(36000.76983) + jc * 0.0003032), F.lit(360.0)),
            "_m": F.lit(357.52911) + jc * (F.lit(35999.05029) - jc * 0.0001537),
            "_e": F.lit(0.016708634) - jc * (F.lit(0.000042037) + jc * 0.0000001267),
            "_node": F.lit(125.04) - jc * 1934.136,
        }
    )
    m, e, l0, node = F.col("_m"), F.col("_e"), F.col("_l0"), F.col("_node")
    center = (
        _sin(m) * (F.lit(1.914602) - jc * (F.lit(0.004817) + jc * 0.000014))
        + _sin(m * 2) * (F.lit(0.019993) - jc * 0.000101)
        + _sin(m * 3) * 0.000289
    )
    seconds = F.lit(21.448) - jc * (F.lit(46.815) + jc * (F.lit(0.00059) - jc * 0.001813))
    df = df.withColumns(
        {
            "_lambda": l0 + center - 0.00569 - _sin(node) * 0.00478,
            "_eps": F.lit(23.0) + (F.lit(26.0) + seconds / 60) / 60 + _cos(node) * 0.00256,
        }
    )
    df = df.withColumns(
        {
            "_decl": F.degrees(F.asin(_sin(F.col("_eps")) * _sin(F.col("_lambda")))),
            "_y": F.pow(F.tan(F.radians(F.col("_eps") / 2)), F.lit(2.0)),
        }
    )
    y, decl = F.col("_y"), F.col("_decl")
    equation_of_time = F.degrees(
        y * _sin(l0 * 2)
        - e * 2 * _sin(m)
        + e * y * 4 * _sin(m) * _cos(l0 * 2)
        - y * y * 0.5 * _sin(l0 * 4)
        - e * e * 1.25 * _sin(m * 2)
    ) * 4
    hour_angle = F.degrees(
        F.acos(
            F.lit(math.cos(math.radians(zenith))) / (F.lit(math.cos(math.radians(lat))) * _cos(decl))
            - F.lit(math.tan(math.radians(lat))) * F.tan(F.radians(decl))
        )
    )
    df = df.withColumn(out, F.lit(720.0 - 4 * lon) - equation_of_time - hour_angle * (4 * side))
    return df.drop("_jc", "_l0", "_m", "_e", "_node", "_lambda", "_eps", "_decl", "_y")


def solar_day(
    days: DataFrame, date: str = "jour", lat: float = LATITUDE, lon: float = LONGITUDE, zenith: float = ZENITH
) -> DataFrame:
    """``sunrise_min`` and ``sunset_min`` (minutes after 00:00 UTC) for each date row."""
    epoch_days = F.datediff(F.col(date), F.lit("2000-01-01").cast("date")).cast("double")
    midnight = (epoch_days - 0.5) / 36525
    out = days
    for name, side in (("sunrise_min", 1), ("sunset_min", -1)):
        out = _event(out, midnight, side, lat, lon, zenith, "_first")
        at_event = (epoch_days - 0.5 + F.col("_first") / 1440) / 36525
        out = _event(out, at_event, side, lat, lon, zenith, name).drop("_first")
    return out


def calendar(df: DataFrame, date: Column) -> tuple[DataFrame, int]:
    """One row per day between the first and the last date of ``df``, and the day count."""
    first, last = df.agg(F.min(date), F.max(date)).first()
    spark = df.sparkSession
    if first is None:
        return spark.range(0).select(F.lit(None).cast("date").alias("jour")), 0
    count = (last - first).days + 1
    days = spark.range(count).select(
        F.date_add(F.lit(first), F.col("id").cast("int")).alias("jour")
    )
    return days, count


def day_night_minutes(
    df: DataFrame, ts: str = "horaire", out: str = "jour_nuit", time_zone: str = TIME_ZONE, **place
) -> DataFrame:
    """Minutes before sunrise (negative) or after sunset (positive); 0 by day, null without time.

    ``ts`` is naive local time; an hour that occurs twice in autumn is read as winter time.
    The sun is computed once per day of the table's date span and joined, not once per row.
    """
    local_day = F.col(ts).cast("date")
    days, _ = calendar(df, local_day)
    sun = solar_day(days, "jour", **place).withColumnRenamed("jour", "_day")
    local = F.col(ts).cast("timestamp")
    summer = F.to_utc_timestamp(local, time_zone)
    winter = summer + F.expr("INTERVAL 1 HOUR")
    utc = F.when(F.from_utc_timestamp(winter, time_zone) == local, winter).otherwise(summer)
    minutes = (
        F.unix_micros(utc) - F.unix_micros(F.col("_day").cast("timestamp"))
    ) / F.lit(60_000_000.0)
    value = (
        F.when(F.col("_minutes") < F.col("sunrise_min"), F.col("_minutes") - F.col("sunrise_min"))
        .when(F.col("_minutes") > F.col("sunset_min"), F.col("_minutes") - F.col("sunset_min"))
        .when(F.col("_minutes").isNotNull(), F.lit(0.0))
    )
    return (
        df.withColumn("_local_day", local_day)
        .join(sun, F.col("_local_day") == F.col("_day"), "left")
        .withColumn("_minutes", minutes)
        .withColumn(out, F.bround(value).cast("int"))
        .drop("_local_day", "_day", "_minutes", "sunrise_min", "sunset_min")
    )
