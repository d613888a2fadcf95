import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from seacast.functions.direction import COMPASS, compass_degrees, direction_parts, mistral, sea_ordinal
from seacast.functions.solar import LATITUDE, LONGITUDE, calendar, day_night_minutes, solar_day
from seacast.functions.timefeat import calendar_columns, in_range, parse_crossing_time, period_windows


def test_time_parsing(spark):
    df = spark.createDataFrame([("05/03/2024 07:05",), ("5/3/2024 7:05",), ("05-03-2024",), (None,)], "t string")
    got = [r[0] for r in df.select(parse_crossing_time(F.col("t"))).collect()]
    assert got == [dt.datetime(2024, 3, 5, 7, 5)] * 2 + [None, None]


def test_last_instant_of_range(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 9, 23, 59, 59),), (dt.datetime(2024, 1, 10),), (dt.datetime(2024, 1, 9),)], "t timestamp_ntz")
    assert df.where(in_range(F.col("t"), "2024-01-01", "2024-01-09")).count() == 2
    assert df.where(in_range(F.col("t"), "2024-01-01", "2024-01-09", "timestamp")).count() == 1
    with pytest.raises(ValueError):
        in_range(F.col("t"), "2024-01-01", "2024-01-09", "week")


def test_range_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where(in_range(F.col("o_orderdate"), "1996-01-01", "1996-02-01"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_calendar_columns(spark):
    df = spark.createDataFrame([("2024-03-05", "07:05:00"), ("x", None)], "date string, heure string")
    rows = df.withColumns(calendar_columns(df)).collect()
    assert [(r["mois"], r["heure_num"]) for r in rows] == [(3, 7), (None, None)]


def test_period_windows(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 3, 1)), (dt.date(2024, 1, 1), dt.date(2024, 1, 30))], "a date, b date")
    rows = period_windows(df, "a", "b").collect()
    assert [(str(r["period_start"]), str(r["period_end"])) for r in rows] == [
        ("2024-01-01", "2024-01-30"), ("2024-01-31", "2024-02-29"), ("2024-03-01", "2024-03-01"), ("2024-01-01", "2024-01-30"),
    ]


def test_mistral_every_half_degree(spark):
    angles = [i / 2 for i in range(721)] + [None, 630.0, 359.9, 720.0]
    rows = spark.createDataFrame([(a,) for a in angles], "a double").select("a", mistral(F.col("a")).alias("m")).collect()
    for r in rows:
        a = r["a"]
        want = 0 if a is None else int(270 <= a % 360 or a % 360 == 0)
        assert r["m"] == want, a


def test_compass(spark):
    points = [*COMPASS, "NNNE", None]
    rows = spark.createDataFrame([(p,) for p in points], "p string").select("p", compass_degrees(F.col("p")).alias("d")).collect()
    assert [r["d"] for r in rows] == [i * 22.5 for i in range(16)] + [None, None]
    parts = spark.createDataFrame([(90.0,)], "d double").select(*[v.alias(k) for k, v in direction_parts(F.col("d")).items()]).first()
    assert parts["y"] == pytest.approx(1.0) and abs(parts["x"]) < 1e-12 and parts["rad"] == pytest.approx(math.pi / 2)


def test_sea_ordinal(spark):
    states = ["ridée", "belle", "peu agitée", "agitée", "forte", "belle ", None]
    rows = spark.createDataFrame([(s,) for s in states], "s string").select(sea_ordinal(F.col("s"))).collect()
    assert [r[0] for r in rows] == [0, 1, 2, 3, 4, -1, -1]


def altitude(day: dt.date, minutes: float) -> float:
    """Solar altitude in degrees over the harbour by the Almanac's low-precision series."""
    n = (day - dt.date(2000, 1, 1)).days - 0.5 + minutes / 1440
    mean_long, anomaly = 280.460 + 0.9856474 * n, math.radians(357.528 + 0.9856003 * n)
    ecliptic = math.radians(mean_long + 1.915 * math.sin(anomaly) + 0.020 * math.sin(2 * anomaly))
    tilt = math.radians(23.439 - 0.0000004 * n)
    ascension = math.degrees(math.atan2(math.cos(tilt) * math.sin(ecliptic), math.cos(ecliptic)))
    declination = math.asin(math.sin(tilt) * math.sin(ecliptic))
    sidereal = 15 * ((18.697374558 + 24.06570982441908 * n) % 24)
    hour_angle = math.radians(sidereal + LONGITUDE - ascension)
    lat = math.radians(LATITUDE)
    up = math.sin(lat) * math.sin(declination) + math.cos(lat) * math.cos(declination) * math.cos(hour_angle)
    return math.degrees(math.asin(up))


def test_sun_stands_at_the_horizon(spark):
    start = dt.date(2023, 1, 1)
    days = spark.createDataFrame([(start + dt.timedelta(days=i),) for i in range(0, 1100, 9)], "jour date")
    for r in solar_day(days).collect():
        assert r["sunrise_min"] < r["sunset_min"]
        for at in ("sunrise_min", "sunset_min"):
            assert altitude(r["jour"], r[at]) == pytest.approx(-0.833, abs=0.05)


def test_day_night_signs_and_nulls(spark):
    times = [dt.datetime(2024, 6, 21, 4, 0), dt.datetime(2024, 6, 21, 12, 0), dt.datetime(2024, 6, 21, 23, 0), None]
    rows = day_night_minutes(spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id int, horaire timestamp_ntz")).orderBy("id").collect()
    before, noon, after, missing = [r["jour_nuit"] for r in rows]
    assert -121 <= before <= -115 and noon == 0 and 95 <= after <= 101 and missing is None


def test_clock_changes_read_as_winter_time(spark):
    # 02:30 does not exist on 2024-03-31 and exists twice on 2024-10-27: both are 01:30 UTC.
    times = [dt.datetime(2024, 3, 31, 2, 30), dt.datetime(2024, 10, 27, 2, 30)]
    df = spark.createDataFrame([(t,) for t in times], "horaire timestamp_ntz")
    days = solar_day(df.select(F.col("horaire").cast("date").alias("jour")))
    sunrise = {r["jour"]: r["sunrise_min"] for r in days.collect()}
    for r in day_night_minutes(df).collect():
        assert r["jour_nuit"] == round(90 - sunrise[r["horaire"].date()])


def test_empty_calendar(spark):
    days, n = calendar(spark.createDataFrame([], "jour date"), F.col("jour"))
    assert n == 0 and days.count() == 0
