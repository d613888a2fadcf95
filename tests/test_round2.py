"""Heavy tails, NaN, null keys, wide vocabularies, unlisted values: no switch, no cap, no endless pass."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seacast.operators import corr, daily, encode, impute, profile, quantiles, split


def jobs(spark, run):
    tracker, group = spark.sparkContext.statusTracker(), f"g{random.random()}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(tracker.getJobIdsForGroup(group))


@pytest.mark.parametrize("values", [
    [math.exp(x) for x in range(-300, 300)], [-1.7e308, 1.7e308, 0.0, 5.0], [7.0] * 900 + [1.0] * 3, [-0.0, 0.0, 1e-320, 2e-320],
])
@pytest.mark.parametrize("small", [20_000, 5])
def test_quantiles_end_in_few_passes(spark, monkeypatch, values, small):
    monkeypatch.setattr(quantiles, "SMALL", small)
    monkeypatch.setattr(quantiles, "ACCURACY", 20 if small == 5 else 10_000)
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    got, n = jobs(spark, lambda: quantiles.exact_quantiles(df, ["x"], [0.0, 0.5, 1.0])["x"])
    ordered = sorted(values)
    mid = (ordered[(len(values) - 1) // 2], ordered[len(values) // 2])
    assert got[0.0] == ordered[0] and got[1.0] == ordered[-1] and got[0.5] == pytest.approx(mid[0] / 2 + mid[1] / 2)
    assert n <= (7 if small > 5 else 40)


def test_time_split_refuses_null_keys(spark):
    df = spark.createDataFrame([(i if i % 2 else None,) for i in range(40)], "k int").select((F.lit("2024-01-01").cast("date") + F.col("k")).alias("d"))
    with pytest.raises(ValueError, match="no d"):
        split.split_exact(df, ["d"], mode="time")


def test_null_parts_of_a_key_keep_their_place(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    assert len({r[0] for r in df.select(split.hash_text(["x", "y", "z"])).collect()}) == 2


def test_cuts_among_equal_first_bits(spark, monkeypatch):
    monkeypatch.setattr(split, "hash_text", lambda keys, seed=42: F.concat(F.lit("0" * 32), F.lpad(F.col(keys[0]).cast("string"), 4, "0")))
    df = spark.range(100)
    sizes = {r[0]: r[1] for r in split.split_exact(df, ["id"]).groupBy("split").count().collect()}
    assert sizes == {"train": 70, "val": 15, "test": 15}
    assert split.sample_exact(df, ["id"], 13).count() == 13


def test_nan_counts_as_null_everywhere(spark):
    rows = [(float(i), float("nan") if i % 10 == 0 else float(i * i), float(-i)) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    clean = df.withColumn("b", F.when(~F.isnan("b"), F.col("b")))
    for f in (lambda d: profile.describe(d), lambda d: profile.histograms(d), lambda d: corr.corr_matrix(d), lambda d: corr.target_corr(d, "b")):
        assert sorted(map(str, f(df).collect())) == sorted(map(str, f(clean).collect()))
    for how in ("mean", "median", "zero"):
        assert impute.impute_numeric(df, strategy=how).collect() == impute.impute_numeric(clean, strategy=how).collect()


def test_one_correlation_whatever_the_number_of_columns(spark):
    rng = random.Random(3)
    rows = [tuple(float("nan") if rng.random() < 0.01 else rng.gauss(0, 1) + i for i in range(12)) for _ in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"x{i} double" for i in range(12)))
    two = corr.corr_pairs(df, ["x0", "x1"]).first()["corr"]
    all_ = {(r.var_a, r.var_b): r["corr"] for r in corr.corr_pairs(df).collect()}
    assert two == pytest.approx(all_["x0", "x1"], abs=1e-12)
    assert corr.corr_pairs(df.withColumn("x1", F.lit(3.1)), ["x0", "x1"]).first()["corr"] is None


def test_more_labels_than_columns(spark):
    df = spark.range(6000).select(F.format_string("v%05d", "id").alias("v")).union(spark.createDataFrame([(None,)], "v string"))
    got = encode.label_encode(df, "v", "code")
    assert got.where("v IS NULL AND code IS NULL").count() == 1
    assert got.where("CAST(substring(v, 2) AS INT) <> code").count() == 0
    codes = encode.category_codes(df, "v")
    vectors = {r.v: r.x for r in encode.one_hot_sparse(df, "v", codes, "x").where("v IS NULL OR v IN ('v00000', 'v00001', 'v05999')").collect()}
    assert {v: (x.size, x.indices.tolist()) for v, x in vectors.items()} == {None: (5999, []), "v00000": (5999, []), "v00001": (5999, [0]), "v05999": (5999, [5998])}
    with pytest.raises(ValueError, match="one_hot_sparse"):
        encode.fit_vocabulary(df, ["v"])


def test_names_with_dots(spark):
    df = spark.createDataFrame([("a.b", 1), ("c`d", 0), (None, 1)], "ciel string, annulation int")
    got = encode.model_matrix(encode.one_hot(df, encode.fit_vocabulary(df, ["ciel"])))
    assert got.columns == ["ciel_c`d", "ciel_nan", "annulation"]


def test_crosstab_covers_all_values(spark):
    df = spark.createDataFrame([("x", 0), ("x", 1), ("x", 2), ("y", 2)], "f string, y int")
    got = {(r.f, r.y): r.share for r in daily.crosstab_cells(df, "f", "y").collect()}
    assert got == {("x", 0): 1 / 3, ("x", 1): 1 / 3, ("x", 2): 1 / 3, ("y", 2): 1.0}
    with pytest.raises(Exception, match="not listed"):
        daily.crosstab_share(df, "f", "y", [0, 1]).collect()


def test_apply_neither_learns_nor_edits(spark):
    config = {"numeric_median_cols": ["a", "b"], "drop_na_threshold": 0.5}
    _, stats = impute.clean_data(spark.createDataFrame([(1.0,), (3.0,)], "a double"), config)
    before = repr(stats)
    test = spark.createDataFrame([(None, 5.0), (9.0, None)], "a double, b double")
    got, after = impute.clean_data(test, config, stats)
    assert repr(stats) == before == repr(after)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(2.0, 5.0), (9.0, None)], key=repr)


def test_column_without_values_stays(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert encode.apply_preprocess(df, encode.fit_preprocess(df)).columns == ["a", "b"]


def test_balanced_weights_by_join(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] + [(None,)], "y string")
    got = {(r.y, r.weight) for r in split.balanced_weights(df, "y").collect()}
    assert got == {("a", 4 / 6), ("b", 2.0), (None, None)}


def payloads(spark, days, **extra):
    import json

    from seacast.schemas import MARINE_MEASURES, WEATHER_MEASURES
    from tests.test_sources import text_file

    def half(names, base):
        return {"daily": {"time": [d for d, _ in days], **{n: [v + base for _, v in days] for n in names}}}

    row = {"period_start": "a", "period_end": "b", "marine_data": half(MARINE_MEASURES, 0), "weather_data": half(WEATHER_MEASURES, 100)}
    return text_file(spark, "payloads", [json.dumps(row)])


def test_weather_lifecycle_from_payloads_to_one_table(spark):
    from seacast.plans import lifecycles
    from seacast.session import scratch_path
    from seacast.sources import tables

    root = scratch_path(spark, "raw")
    lifecycles.collect_weather(spark, payloads(spark, [("2024-01-30", 1.0), ("2024-01-31", 2.0)]), root)
    lifecycles.collect_weather(spark, payloads(spark, [("2024-02-01", 3.0)]), root)
    lifecycles.collect_weather(spark, payloads(spark, [("2024-02-01", 4.0)]), root)  # the month again
    got = lifecycles.consolidate_weather(spark, root)
    assert sorted((str(r.date), r.wave_height_max, r.temperature_max) for r in got.collect()) == [("2024-01-30", 1.0, 101.0), ("2024-01-31", 2.0, 102.0), ("2024-02-01", 4.0, 104.0)]
    assert tables.skipped_files(spark, root).count() == 0


def test_columns_are_found_by_name(spark, tmp_path):
    from seacast.sources import tables

    (tmp_path / "meteo_a.csv").write_text("date,wave_height_max,temperature_max\n2024-01-01,1.5,20\n")
    (tmp_path / "meteo_b.csv").write_text('temperature_max,extra,date,"wave_height_max"\n21,x,2024-01-02,2.5\nbad,y,2024-01-03,3.5\n')
    (tmp_path / "meteo_c.csv").write_text("2024-01-04,9,9\n")
    rows = {r.date: (r.wave_height_max, r.temperature_max, r.temperature_min, r._corrupt_record) for r in tables.read_monthly(spark, str(tmp_path)).collect()}
    assert rows["2024-01-01"] == (1.5, 20.0, None, None) and rows["2024-01-02"] == (2.5, 21.0, None, None)
    assert rows["2024-01-03"][3] == "bad,y,2024-01-03,3.5" and rows[None][3] == "2024-01-04,9,9"
    odd = {r.file.rsplit("/", 1)[1]: (r.has_header, r.unknown) for r in tables.skipped_files(spark, str(tmp_path)).collect()}
    assert odd["meteo_c.csv"] == (False, None) and odd["meteo_b.csv"] == (True, ["extra"])


def test_crossing_log_columns_by_name(spark):
    from seacast.sources import tables
    from tests.test_sources import text_file

    log = text_file(spark, "log", ["Ligne,Horaire,Bateau", "L1,01/02/2024 08:30,B1", "L2,NA,"])
    got = sorted((r.ligne, r.horaire, r.bateau, r.annulation) for r in tables.read_raw_crossings(spark, log).collect())
    assert got == [("L1", "01/02/2024 08:30", "B1", None), ("L2", None, None, None)]


def test_stream_takes_two_texts_of_a_date_as_one(spark):
    from seacast.session import scratch_path
    from seacast.streaming.jobs import consolidate_stream

    source, out = scratch_path(spark, "landing"), scratch_path(spark, "daily")
    spark.createDataFrame([("2024-01-01", 1.0, 1), ("2024-1-1", 2.0, 2)], "date string, x double, at int").coalesce(1).write.parquet(source)
    consolidate_stream(spark.readStream.schema("date string, x double, at int").parquet(source), out, scratch_path(spark, "checkpoint"), ["at"]).awaitTermination()
    assert [r.x for r in spark.read.parquet(out).collect()] == [1.0]


def test_empty_sinks(spark):
    from seacast.session import scratch_path
    from seacast.sources import tables

    none = spark.createDataFrame([], "ligne string, x int")
    assert tables.write_predictions(none, scratch_path(spark, "sink"), "a").first()["n_predictions"] == 0
    assert tables.write_line_extracts(none, scratch_path(spark, "lines")).count() == 0


def test_knn_refuses_missing_features_and_meets_few_cells(spark):
    from seacast.models import train

    rng = random.Random(8)
    rows = [(i, rng.choice([0.0, rng.gauss(0, 3)]), rng.gauss(0, 1), rng.randrange(3)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int")
    old, new = df.where("id < 300"), df.where("id >= 300")
    votes = {}
    for i, a, b, _ in rows[300:]:
        near = sorted(((a - c) ** 2 + (b - d) ** 2, j, y) for j, c, d, y in rows[:300])[:5]
        count = {y: sum(1 for x in near if x[2] == y) for _, _, y in near}
        votes[i] = min(count, key=lambda y: (-count[y], y))
    for block in (7, 60, 1000):
        assert {r.id: r.prediction for r in train.knn_vote(old, new, ["a", "b"], "y", "id", 5, block).collect()} == votes
    with pytest.raises(ValueError, match="lack a feature"):
        train.knn_vote(old, new.withColumn("a", F.when(F.col("id") > 350, F.col("a"))), ["a", "b"], "y", "id")


def test_stages_can_be_dropped(spark):
    import os

    from seacast import session

    path = session.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    kept, session._given[:] = session._given[:-1], session._given[-1:]
    assert session.drop_stages() == 1 and not os.path.exists(path)
    session._given[:] = kept
