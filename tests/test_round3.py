"""Runs with atomic promotion, state that survives restarts, kernels, balls, and scoring after a written result."""

import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from seacast.models import kernel, metrics, neighbours, runs, train
from seacast.session import scratch_path
from seacast.sources import tables
from seacast.streaming.jobs import consolidate_by_state


def record(spark, version):
    rows = spark.createDataFrame([(1, 1), (0, 1), (0, 0)], "y_true int, y_pred int")
    return runs.run_record(metrics.binary_metrics(rows), version, "weather", 3, 1)


def test_run_log_commits_are_atomic(spark):
    path = scratch_path(spark, "runs")
    a, b = runs.RunLog(spark, path), runs.RunLog(spark, path)
    assert a.table().count() == 0
    first, second = a.append(record(spark, "v1")), b.append(record(spark, "v2"))
    seen = len(a.entries())
    b.promote(second, seen)
    with pytest.raises(runs.Conflict):
        a.promote(first, seen)
    record(spark, "lost").write.parquet(f"{path}/runs/lost")  # its writer died before the commit
    assert {(r.version, r.active) for r in a.table().collect()} == {("v1", False), ("v2", True)}
    a.promote(first)
    assert {r.version for r in b.table().where("active").collect()} == {"v1"}
    with pytest.raises(ValueError, match="no run"):
        a.promote("lost")
    assert not runs.create_if_absent(spark, f"{path}/log/{0:012d}.json", "x") and a.entries()[0] == {"add": first}


def landed(spark, rows, path):
    spark.createDataFrame(rows, "date string, x double, at int").coalesce(1).write.mode("append").parquet(path)


def test_state_keeps_first_rows_over_restarts(spark):
    source, out, checkpoint = (scratch_path(spark, n) for n in ("landing", "daily", "checkpoint"))

    def run(ttl="400 days"):
        stream = spark.readStream.schema("date string, x double, at int").option("maxFilesPerTrigger", 1).parquet(source)
        return consolidate_by_state(stream, out, checkpoint, ["at"], ttl=ttl)

    landed(spark, [("2024-01-01", 2.0, 2), ("2024-1-1", 1.0, 1), ("bad", 3.0, 3), (None, 3.0, 3)] + [("2024-01-05", float(i), i) for i in range(50)], source)
    run().awaitTermination()
    landed(spark, [("2024-01-01", 9.0, 0), ("2024-02-01", 5.0, 5)], source)
    killed = run()
    killed.stop()  # wherever it is
    run().awaitTermination()
    run().awaitTermination()  # nothing new
    landed(spark, [("2026-01-01", 7.0, 6), ("2024-02-01", 8.0, 1)], source)
    run().awaitTermination()
    landed(spark, [("2024-01-01", 4.0, 1), ("2020-01-01", 4.0, 1), ("2025-12-01", 3.0, 1), ("2026-01-01", 1.0, 1)], source)  # two are beyond the state's time
    run().awaitTermination()
    got = sorted((str(r["date"]), r["x"]) for r in spark.read.parquet(out).collect())
    assert got == [("2024-01-01", 1.0), ("2024-01-05", 0.0), ("2024-02-01", 5.0), ("2025-12-01", 3.0), ("2026-01-01", 7.0)]


def days(spark, n=120):
    rng = random.Random(2)
    rows = [(i, *(rng.gauss(0, 1) for _ in range(2))) for i in range(n)]
    return spark.createDataFrame([(i, a, b, int(a * a + b * b > 1.2)) for i, a, b in rows], "id int, a double, b double, y int")


def test_forests_score_after_predictions_were_written(spark):
    df = days(spark)
    first = train.fit_model(df, ["a", "b"], train.forest("y", trees=3, depth=3))
    written = tables.write_predictions(train.score(first, df), scratch_path(spark, "sink"), "a").first()
    assert written["n_predictions"] == 120
    again = train.fit_model(df, ["a", "b"], train.forest("y", trees=3, depth=3))
    assert train.score(again, df).select("annulation_predicted").collect() == train.score(first, df).select("annulation_predicted").collect()


def test_fourier_features_give_the_kernel(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    z = np.array([r.z for r in df.select("id", kernel.fourier(F.col("v"), 0.1, 2000, 3).alias("z")).orderBy("id").collect()])
    exact = np.exp(-0.1 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - exact).max() < 5 / np.sqrt(2 * 2000)
    both = df.crossJoin(df.select(F.col("v").alias("w"))).where("id = 3").select(kernel.kernel(F.col("v"), F.col("w"), 0.1).alias("k")).collect()
    assert sorted(r.k for r in both) == pytest.approx(sorted(exact[3]))
    assert df.limit(0).select(kernel.fourier(F.col("v"), 0.1, 8, 3)).count() == 0


def test_rbf_machine_separates_a_ring_and_can_be_stored(spark):
    df = days(spark, 400)
    scores = {}
    for name, estimator in (("rbf", train.rbf_svm("y", width=2)), ("linear", train.LinearSVC(labelCol="y"))):
        model = train.fit_model(df, ["a", "b"], estimator)
        scores[name] = model.transform(df).where("prediction = y").count() / 400
    assert scores["rbf"] > 0.9 > scores["linear"]
    path = scratch_path(spark, "model")
    model = train.fit_model(df, ["a", "b"], train.rbf_svm("y", width=2, size=32))
    model.write().save(path)
    vector = df.select("id", "a", "b")
    assert PipelineModel.load(path).transform(vector).select("prediction").collect() == model.transform(vector).select("prediction").collect()
    assert array_to_vector is not None


def test_balls_compare_few_rows_and_find_all(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 13)) * 50
    x = np.concatenate([c + rng.normal(size=(60, 13)) for c in centres] + [np.zeros((200, 13))])  # many equal rows
    q = np.concatenate([c + rng.normal(size=(4, 13)) for c in centres] + [np.zeros((2, 13)), np.full((1, 13), 500.0)])
    names = [f"x{i}" for i in range(13)]
    kind = "id int, y int, " + ", ".join(f"{n} double" for n in names)
    old = spark.createDataFrame([(i, i % 3, *map(float, v)) for i, v in enumerate(x)], kind)
    new = spark.createDataFrame([(i, 0, *map(float, v)) for i, v in enumerate(q)], kind)
    dist = np.zeros((len(q), len(x)))
    for f in range(13):
        dist += (q[:, f, None] - x[None, :, f]) ** 2
    want = {(i, int(j)) for i in range(len(q)) for j in np.lexsort((np.arange(len(x)), dist[i]))[:5]}
    for block, pivots in ((40, None), (1000, 30)):
        pairs, compared = neighbours.knn_pairs(old, new, names, "y", "id", 5, block, pivots)
        assert {(r["key"], r["train_key"]) for r in pairs.collect()} == want
        assert compared.first()["compared"] < len(q) * len(x) / 4
    few = neighbours.knn_pairs(old.limit(3), new, names, "y", "id", 5)[0]
    assert few.count() == 3 * len(q)
    assert neighbours.knn_vote(old, new.limit(0), names, "y", "id").count() == 0


def test_searches_weigh_classes_by_fold(spark):
    df = days(spark, 150)
    grid = {"regParam": [0.0, 10.0], "class_weight": [None, "balanced"]}
    found = train.search(df, ["a", "b"], train.LogisticRegression(labelCol="y"), grid, "y", ["id"], "recall", folds=2)
    scores = {r.params: r.score for r in train.search_scores(spark, found).collect()}
    assert len(scores) == 4 and scores["class_weight=balanced; regParam=0.0"] < scores["class_weight=None; regParam=0.0"]  # class 1 is the larger one
    assert found.bestModel.transform(train.assembler(["a", "b"]).transform(df)).count() == 150
    forests = train.search_forests(df, ["a", "b"], "y", ["id"], {"trees": [3], "depth": [None, 2], "min_split": [2], "min_leaf": [1], "class_weight": [None]}, None, 2)
    assert {m["maxDepth"] for m in ({p.name: v for p, v in s.items()} for s in forests.getEstimatorParamMaps())} == {30, 2}
    assert len(train.combinations_of(train.FOREST_GRID, train.FOREST_DRAWS)) == 20
