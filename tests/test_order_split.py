import datetime as dt
import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from seacast.operators.dedupe import consolidate, count_duplicates, duplicate_rows, keep_first
from seacast.operators.ordered import fill_both_ways, running_totals
from seacast.operators.quantiles import exact_quantiles
from seacast.operators.split import (
    balanced_weights, sample_exact, split_exact, split_stratified, stratified_folds,
)

LAX = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@given(
    st.lists(
        st.one_of(st.none(), st.floats(-1e6, 1e6), st.sampled_from([0.0, -0.0, 1.5, 1e-300, 1e300, -1e300])), min_size=1, max_size=40
    )
)
@LAX
def test_quantiles_equal_numpy(spark, values):
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(spark.createDataFrame([(v,) for v in values], "x double"), ["x"], probs)["x"]
    known = [v for v in values if v is not None]
    for p in probs:
        if not known:
            assert got[p] is None
        else:
            assert got[p] == pytest.approx(float(np.quantile(known, p)), rel=1e-9, abs=1e-9)


def test_quantiles_of_a_hot_value_and_nan(spark):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 1000 == 1, float("nan")).otherwise(F.col("id").cast("double")).alias("x")
    )
    want = df.toPandas()["x"].dropna()
    got = exact_quantiles(df, ["x"], [0.05, 0.5, 0.99])["x"]
    for p, v in got.items():
        assert v == pytest.approx(want.quantile(p))


def test_infinite_values_are_refused(spark):
    with pytest.raises(ValueError):
        exact_quantiles(spark.createDataFrame([(1.0,), (float("inf"),)], "x double"), ["x"], [0.5])


def many_rows(spark, n=5000, hole=0.7, seed=3):
    rng = random.Random(seed)
    rows = [(i, f"k{i % 3 if i % 2 else 0}", None if rng.random() < hole else float(i % 97), None) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id int, k string, x double, y double").repartition(6)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_fill_equals_pandas(spark, keys):
    df = many_rows(spark)
    got = fill_both_ways(df, ["id"], ["x", "y"], keys).toPandas().sort_values("id").reset_index(drop=True)
    want = df.toPandas().sort_values("id").reset_index(drop=True)
    filled = want.groupby(keys)["x"].transform(lambda s: s.ffill().bfill()) if keys else want["x"].ffill().bfill()
    pd.testing.assert_series_equal(got["x"], filled, check_names=False)
    assert got["y"].isna().all() and list(got.columns) == ["id", "k", "x", "y"]


def test_fill_carries_across_empty_ranges(spark):
    rows = [(i, 1.0 if i == 10 else (2.0 if i == 4990 else None)) for i in range(5000)]
    df = spark.createDataFrame(rows, "id int, x double").repartition(8)
    got = [r["x"] for r in fill_both_ways(df, ["id"], ["x"]).orderBy("id").collect()]
    assert got == [1.0] * 4990 + [2.0] * 10


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_totals_equal_pandas(spark, keys):
    df = many_rows(spark, hole=0.0)
    got = running_totals(df, [F.desc("id")], {"total": F.col("x")}, keys).toPandas().sort_values("id", ascending=False)
    want = df.toPandas().sort_values("id", ascending=False)
    sums = want.groupby(keys)["x"].cumsum() if keys else want["x"].cumsum()
    assert got["total"].tolist() == sums.tolist()


def test_fill_has_no_single_task_window(spark):
    plan = fill_both_ways(many_rows(spark), ["id"], ["x"])._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window" in line and "_last_x" not in line and "_first_x" not in line:
            assert "_range" in line


def test_keep_first_and_raw_date_text(spark):
    rows = [("f1", 0, "2024-01-01", 1.0), ("f1", 1, "2024-1-1", 2.0), ("f2", 0, "2024-01-01", 3.0), ("f2", 1, "bad", 4.0)]
    df = spark.createDataFrame(rows, "_file string, _row int, date string, x double")
    got = sorted((str(r["date"]), r["x"]) for r in consolidate(df, ["_file", "_row"]).collect())
    assert got == [("2024-01-01", 1.0), ("2024-01-01", 2.0), ("None", 4.0)]
    assert keep_first(df, ["date"], ["_file", "_row"]).columns == df.columns


@pytest.mark.parametrize("keep", ["first", "last", False])
def test_duplicates_equal_pandas(spark, keep):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([1, None])) for i in range(60)] + [(99, "only", 5)]
    df = spark.createDataFrame(rows, "id int, a string, b int").repartition(5)
    pdf = pd.DataFrame(rows, columns=["id", "a", "b"])
    want = pdf[pdf.duplicated(["a", "b"], keep=keep)]["id"].tolist()
    assert sorted(r["id"] for r in duplicate_rows(df, ["id"], ["a", "b"], keep).collect()) == sorted(want)
    assert count_duplicates(df, ["a", "b"]).first()[0] == int(pdf.duplicated(["a", "b"]).sum())


def test_duplicates_option(spark):
    with pytest.raises(ValueError):
        duplicate_rows(spark.range(2).toDF("id"), ["id"], ["id"], "middle")


@pytest.mark.parametrize("n, sizes", [(719, (503, 107, 109)), (10, (7, 1, 2)), (1, (0, 0, 1)), (0, (0, 0, 0))])
def test_exact_split_sizes(spark, n, sizes):
    out = split_exact(spark.range(n).toDF("id"), ["id"]).groupBy("split").count().collect()
    got = {r["split"]: r["count"] for r in out}
    assert tuple(got.get(s, 0) for s in ("train", "val", "test")) == sizes


def test_split_does_not_depend_on_partitioning(spark):
    a = split_exact(spark.range(500).toDF("id"), ["id"]).collect()
    b = split_exact(spark.range(500).toDF("id").repartition(7), ["id"]).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    c = split_exact(spark.range(500).toDF("id"), ["id"], seed=7).collect()
    assert sorted(map(tuple, a)) != sorted(map(tuple, c))


def test_split_needs_no_shuffle(spark):
    plan = split_exact(spark.range(100).toDF("id"), ["id"])._jdf.queryExecution().sparkPlan().toString()
    assert "Exchange" not in plan


def test_time_split_is_chronological(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=i),) for i in range(20)], "jour date")
    rows = {r["jour"]: r["split"] for r in split_exact(df, ["jour"], mode="time").collect()}
    order = [rows[d] for d in sorted(rows)]
    assert order == ["train"] * 14 + ["val"] * 3 + ["test"] * 3
    with pytest.raises(ValueError):
        split_exact(df, ["jour"], mode="other")


@pytest.mark.parametrize("n, test", [(719, 144), (79_285, 15_857)])
def test_stratified_sizes(spark, n, test):
    df = spark.range(n).select("id", (F.col("id") % 6 == 0).cast("int").alias("y"))
    counts = {(r["y"], r["split"]): r["count"] for r in split_stratified(df, "y", ["id"]).groupBy("y", "split").count().collect()}
    assert counts[(0, "test")] + counts[(1, "test")] == test
    share = counts[(1, "test")] / (counts[(1, "test")] + counts[(1, "train")])
    assert abs(share - 0.2) < 0.01


def test_stratified_refuses_null_labels(spark):
    with pytest.raises(ValueError):
        split_stratified(spark.createDataFrame([(1, None), (2, 1)], "id int, y int"), "y", ["id"])


@pytest.mark.parametrize(("sizes", "test", "want"), [((5, 5), 0.3, (2, 1)), ((661, 131), 0.2, (133, 26)), ((1, 1, 1), 0.5, (1, 1, 0))])
def test_largest_remainder(spark, sizes, test, want):
    df = spark.createDataFrame([(f"{c}-{i}", str(c)) for c, n in enumerate(sizes) for i in range(n)], "id string, c string")
    got = {r["c"]: r["n"] for r in split_stratified(df, "c", ["id"], test).where("split = 'test'").groupBy("c").agg(F.count("*").alias("n")).collect()}
    assert tuple(got.get(str(c), 0) for c in range(len(sizes))) == want


def test_cuts_of_many_classes_and_repeated_keys(spark, monkeypatch):
    from seacast.operators import split

    monkeypatch.setattr(split, "SMALL", 3)  # several passes over the bits of the place
    rng = random.Random(3)
    rows = [(rng.randrange(400) if i % 3 else 7, rng.randrange(60)) for i in range(2500)]  # a third of the rows have one key
    df = spark.createDataFrame(rows, "id int, c int").repartition(5)
    ids = {}
    for i, c in rows:
        ids.setdefault(str(c), []).append(i)
    texts = {c: sorted(hashlib.md5(f"{i}|42".encode()).hexdigest() + f"{i}|42" for i in group) for c, group in ids.items()}
    k = 4
    for r in stratified_folds(df, "c", ["id"], k).collect():
        text = hashlib.md5(f"{r.id}|42".encode()).hexdigest() + f"{r.id}|42"
        ends = [len(texts[str(r.c)]) * i // k - 1 for i in range(1, k)]
        assert r.fold == sum(e < 0 or text > texts[str(r.c)][e] for e in ends)


def test_folds_are_disjoint_and_even(spark):
    df = spark.range(103).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    rows = stratified_folds(df, "y", ["id"], 5).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in rows if r["y"] == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_sample_size(spark):
    df = spark.range(300).toDF("id")
    assert sample_exact(df, ["id"], 37).count() == 37
    assert sample_exact(df, ["id"], 1000).count() == 300


def test_balanced_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "y int")
    assert sorted({(r["y"], round(r["weight"], 6)) for r in balanced_weights(df, "y").collect()}) == [(0, 0.666667), (1, 2.0)]
