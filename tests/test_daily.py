import datetime as dt

import pytest
from pyspark.sql import functions as F

from seacast.operators.align import align, daily_weather_merge
from seacast.operators.daily import binarise, crosstab_share, daily_rollup, period_compare, rate_by_group_flag
from seacast.operators.lines import fan_out_lines, select_lines
from seacast.plans.adapters import adapted

DAY = dt.date(2024, 1, 1)
SCHEMA = (
    "crossing_id long, horaire timestamp_ntz, jour date, annulation int, ligne string, vent string, vent_noeud double, "
    "houle_dominante double, houle_max double, houle double, houle_periode double, mer string, temperature double, ciel string"
)


def crossings(spark):
    at = dt.datetime(2024, 1, 1, 8)
    rows = [
        (3, at, DAY, 1, "L3", "N", 5.0, 2.0, 3.0, 10.0, None, "forte", 8.0, None),
        (1, at, DAY, 0, "L1", "S", 9.0, 1.0, 1.0, 20.0, 4.0, "ridée", None, None),
        (2, at + dt.timedelta(hours=1), DAY, None, "L2", "N", None, 2.0, None, None, 6.0, "belle ", 12.0, None),
        (4, at + dt.timedelta(hours=2), DAY, 0, "L2", "S", 1.0, 1.0, 2.0, 30.0, None, None, 9.0, None),
        (5, at + dt.timedelta(days=1), DAY + dt.timedelta(days=1), 1, "L9", None, None, None, None, None, None, None, None, "Clair"),
        (6, None, None, 1, "L9", "N", 1.0, 1.0, 1.0, 1.0, 1.0, "belle", 1.0, "Clair"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_ties_nulls_and_first_line(spark):
    first, second = daily_rollup(crossings(spark)).orderBy("jour").collect()
    assert (first["n_traversees"], first["n_annulations"]) == (3, 1)
    assert first["annulation_pct"] == pytest.approx(1 / 3)
    assert first["ligne"] == "L1"  # same time as L3, smaller id
    assert first["vent"] == "N" and first["houle_dominante"] == 1.0  # tie: smallest
    assert first["mer"] == "ridée" and first["ciel"] is None
    assert first["houle"] == 20.0 and first["houle_periode"] == 5.0
    assert (first["temperature_min"], first["temperature_max"]) == (8.0, 12.0)
    assert second["vent"] is None and second["ciel"] == "Clair" and second["houle"] is None


def test_ordinal_sea_and_bad_option(spark):
    rows = daily_rollup(crossings(spark), sea="ordinal").orderBy("jour").collect()
    assert [r["mer"] for r in rows] == ["forte", None]
    with pytest.raises(ValueError):
        daily_rollup(crossings(spark), sea="other")


def test_map_side_aggregate_is_hashed(spark):
    plan = daily_rollup(crossings(spark))._jdf.queryExecution().sparkPlan().toString()
    below_first_shuffle = plan[plan.rindex("HashAggregate") :]
    assert "partial_count" in below_first_shuffle and "SortAggregate" not in below_first_shuffle


def test_same_rows_for_any_partitioning(spark):
    source = adapted(spark, "/root/testdata/sf0.001", "crossings")
    results = []
    try:
        for n in (1, 7, 200):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            rows = daily_rollup(source.repartition(n)).collect()
            results.append(sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] == results[2]


def test_binarise_threshold(spark):
    df = spark.createDataFrame([(0.166,), (0.1659,), (None,)], "annulation_pct double")
    assert [r[1] for r in binarise(df).collect()] == [1, 0, 0]


def test_merge_keeps_both_temperatures(spark):
    weather = spark.createDataFrame([(DAY, 30.0, 1.0)], "jour date, temperature_max double, temperature_min double")
    row = daily_weather_merge(daily_rollup(crossings(spark)), weather).first()
    assert row["crossing_temperature_max"] == 12.0 and row["temperature_max"] == 30.0


def test_hour_grain_only_matches_the_first_hour(spark):
    rows = [(i, dt.datetime(2024, 1, 1, h, 59)) for i, h in enumerate((0, 1, 12))]
    df = spark.createDataFrame(rows, "crossing_id int, horaire timestamp_ntz")
    weather = spark.createDataFrame([(DAY, 1.0)], "jour date, x double")
    assert [r["crossing_id"] for r in align(df, weather, "hour").collect()] == [0]
    assert align(df, weather, "day").count() == 3
    with pytest.raises(ValueError):
        align(df, weather, "month")


def test_period_compare_splits_a_day(spark):
    df = crossings(spark)
    rows = {r["period"]: r for r in period_compare(df, F.col("horaire") <= F.lit(dt.datetime(2024, 1, 1, 8))).collect()}
    assert rows["all"]["n_days"] == 2 and rows["all"]["n_traversees"] == 4
    assert rows["range"]["n_days"] == 1 and rows["range"]["n_traversees"] == 2 and rows["range"]["n_days_hit"] == 1


def test_missing_cells_count_as_zero(spark):
    df = spark.createDataFrame([("A", 1, 1), ("A", 1, 0)], "ligne string, f int, annulation int")
    got = {(r["name"], r["value"]): r["rate"] for r in rate_by_group_flag(df, "ligne", ["A", "B"], ["f"]).collect()}
    assert got == {("A", 0): 0.0, ("A", 1): 0.5, ("B", 0): 0.0, ("B", 1): 0.0}


def test_crosstab_rows_sum_to_one(spark):
    df = spark.createDataFrame([(0, 1), (0, 0), (0, 0), (1, 1), (None, 1)], "f int, y int")
    got = {r["f"]: (r["y_0"], r["y_1"]) for r in crosstab_share(df, "f", "y", [0, 1]).collect()}
    assert got == {0: (pytest.approx(2 / 3), pytest.approx(1 / 3)), 1: (0.0, 1.0)}


def test_line_groups(spark):
    df = spark.createDataFrame([("Frioul-IF",), ("Vieux Port-IF",), ("other",), (None,)], "ligne string")
    assert select_lines(df, "Frioul_if").count() == 1
    assert select_lines(df, "Departs").count() == 1
    with pytest.raises(ValueError):
        select_lines(df, "nope")
    got = sorted((r["ligne"], r["line_group"]) for r in fan_out_lines(df).collect())
    assert got == [("Frioul-IF", "Frioul_if"), ("Frioul-IF", "VP_frioul_if"), ("Vieux Port-IF", "VP_frioul_if"), ("Vieux Port-IF", "VP_if")]
    with pytest.raises(ValueError):
        fan_out_lines(df, ["nope"])
