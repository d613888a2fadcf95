import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from seacast.models import metrics, runs, train
from seacast.schemas import MEASURES
from seacast.session import scratch_path
from seacast.streaming.jobs import read_requests, score_stream

# Published confusion matrices (rows true, columns predicted) and their scores.
PUBLISHED = [
    ([[13092, 137], [807, 1821]], (0.940468, 0.930031, 0.692922, 0.794156)),
    ([[51, 17], [11, 65]], (0.805556, 0.792683, 0.855263, 0.822785)),
    ([[5, 0], [3, 0]], (0.625, 0.0, 0.0, 0.0)),
]


def from_matrix(spark, matrix):
    cells = [(t, p, matrix[t][p]) for t in (0, 1) for p in (0, 1)]
    df = spark.createDataFrame(cells, "y_true int, y_pred int, n int")
    return df.select("y_true", "y_pred", F.explode(F.array_repeat(F.lit(1), F.col("n")))).drop("col")


@pytest.mark.parametrize("matrix, scores", PUBLISHED)
def test_published_matrices(spark, matrix, scores):
    row = metrics.binary_metrics(from_matrix(spark, matrix)).first()
    assert [row[s] for s in metrics.SCORES] == pytest.approx(scores, abs=1e-6)
    report = {r["class"]: r for r in metrics.class_report(from_matrix(spark, matrix)).collect()}
    assert report["1"]["f1"] == pytest.approx(scores[3], abs=1e-6)
    assert report["accuracy"]["f1"] == pytest.approx(scores[0], abs=1e-6)
    assert report["weighted avg"]["support"] == sum(map(sum, matrix))


def test_roc_against_rank_statistic(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400) * 0.7 + y * 0.3, 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y_true int, score double").repartition(5)
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    assert metrics.roc_auc(df).first()["auc"] == pytest.approx(want)
    points = metrics.roc_points(df).orderBy("fpr", "tpr").collect()
    assert points[0]["threshold"] == float("inf") and points[-1]["tpr"] == points[-1]["fpr"] == 1.0
    assert np.trapezoid([p["tpr"] for p in points], [p["fpr"] for p in points]) == pytest.approx(want)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0), (None, 1.0)], "y double, p double")
    row = metrics.regression_metrics(df, "y", "p").first()
    assert (row["n"], row["r2"], row["mae"]) == (3, pytest.approx(0.75), pytest.approx(2 / 3))


def run_rows(spark, f1s):
    return spark.createDataFrame(
        [(v, 0.9, 0.8, 0.7, f) for v, f in f1s.items()], "version string, accuracy double, precision double, recall double, f1 double"
    )


def test_tie_rules(spark):
    table = run_rows(spark, {"a": 0.5, "b": 0.5})
    assert runs.compare_two(table, "a", "b", "first").first()["winner"] == "a"
    assert runs.compare_two(table, "a", "b", "second").first()["winner"] == "b"
    assert runs.compare_two(run_rows(spark, {"a": 0.5, "b": 0.25}), "a", "b", "second").first()["winner"] == "a"
    texts = {r["metric"]: r["delta_text"] for r in runs.compare_two(run_rows(spark, {"a": 0.5, "b": 0.25}), "a", "b").collect()}
    assert texts["f1"] == "-0.2500" and texts["accuracy"] == "+0.0000"
    with pytest.raises(ValueError):
        runs.compare_two(table, "a", "b", "none")


def test_pivot_and_board(spark):
    table = run_rows(spark, {"a": 0.5, "b": 0.25, "c": 0.75})
    wide = {r["metric"]: r for r in runs.compare_many(table, ["a", "b", "c"]).collect()}
    assert (wide["f1"]["a"], wide["f1"]["b"], wide["f1"]["c"]) == (0.5, 0.25, 0.75)
    assert [r["version"] for r in runs.leader_board(table, "f1").collect()] == ["c", "a", "b"]


def test_or_vote(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "k int, annulation_predicted int")
    b = spark.createDataFrame([(1, 1), (2, 0)], "k int, annulation_predicted int")
    assert [r[1] for r in runs.or_vote(a, b, ["k"]).collect()] == [1, 1]


def weather_rows(spark, n=240):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(n):
        values = [float(round(v, 3)) for v in rng.random(len(MEASURES)) * 10]
        rows.append((i, int(values[0] > 5), *values))
    return spark.createDataFrame(rows, "id int, annulation_binary int, " + ", ".join(f"{m} double" for m in MEASURES))


@pytest.fixture(scope="module")
def model(spark):
    df = train.with_ratios(weather_rows(spark))
    fitted, row = train.train_weather_model(df, ["id"], estimator=train.forest("annulation_binary", trees=10))
    assert row.first()["n"] == 48 and row.first()["accuracy"] > 0.85
    return fitted


def test_scoring_fills_and_derives(spark, model):
    df = weather_rows(spark).drop("annulation_binary").withColumn("wave_height_max", F.when(F.col("id") > 0, F.col("wave_height_max")))
    out = train.score(model, df)
    assert out.columns == [*df.columns, "annulation_predicted", "annulation_probability", "confidence"]
    rows = out.collect()
    assert len(rows) == 240
    for r in rows:
        p = r["annulation_probability"]
        assert r["confidence"] == pytest.approx(max(p, 1 - p)) and r["annulation_predicted"] == int(p > 0.5)
    assert next(r for r in rows if r["id"] == 0)["wave_height_max"] is None


def test_missing_feature_fails_early(spark, model):
    with pytest.raises(ValueError, match="missing features"):
        train.score(model, weather_rows(spark).drop("wind_gusts_max"))


def test_training_is_repeatable_and_saved(spark, model):
    df = train.with_ratios(weather_rows(spark))
    again, _ = train.train_weather_model(df, ["id"], estimator=train.forest("annulation_binary", trees=10))
    path = scratch_path(spark, "model")
    again.write().save(path)
    loaded = PipelineModel.load(path)
    a = train.score(model, weather_rows(spark)).select("id", "annulation_probability").collect()
    b = train.score(loaded, weather_rows(spark)).select("id", "annulation_probability").collect()
    assert sorted(a) == sorted(b)


def test_stream_equals_batch(spark, model):
    landing, out = scratch_path(spark, "requests"), scratch_path(spark, "scored")
    checkpoint = scratch_path(spark, "checkpoint")
    rows = weather_rows(spark).select(*MEASURES)
    rows.limit(100).repartition(3).write.json(landing)
    score_stream(model, read_requests(spark, landing, max_files=1), out, checkpoint).awaitTermination()
    rows.subtract(rows.limit(100)).write.mode("append").json(landing)
    score_stream(model, read_requests(spark, landing, max_files=1), out, checkpoint).awaitTermination()
    streamed = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert streamed == sorted(map(tuple, train.score(model, rows).collect()))


def test_search_scores_every_set(spark):
    df = weather_rows(spark)
    estimator = LogisticRegression(labelCol="annulation_binary", maxIter=5)
    found = train.search(df, MEASURES, estimator, {"regParam": [0.0, 10.0]}, "annulation_binary", ["id"], "accuracy", folds=2)
    scores = train.search_scores(spark, found).collect()
    assert len(scores) == 2 and scores[0]["params"] == "regParam=0.0" and scores[0]["score"] > scores[1]["score"]


def test_random_search_draws(spark):
    estimator = LogisticRegression()
    grid = {"regParam": [0.0, 0.1, 0.2], "elasticNetParam": [0.0, 1.0]}
    assert len(train.param_maps(estimator, grid)) == 6
    a, b = train.param_maps(estimator, grid, draws=4), train.param_maps(estimator, grid, draws=4)
    assert len(a) == 4 and [sorted(m.values()) for m in a] == [sorted(m.values()) for m in b]
    assert train.logistic_params(10.0, "l1", 100) == {"regParam": 0.001, "elasticNetParam": 1.0, "standardization": False}


def test_eval_without_and_with_grid(spark):
    df = weather_rows(spark)
    parts = train.split_stratified(df, "annulation_binary", ["id"])
    tr, te = parts.where("split = 'train'").drop("split"), parts.where("split = 'test'")
    estimator = LogisticRegression(labelCol="annulation_binary", maxIter=5)
    plain = train.eval_classification(tr, te, MEASURES, estimator, "annulation_binary", ["id"], cv=2)
    assert plain["cv_results"].count() == 2 and plain["accuracy"] > 0.8
    found = train.eval_classification(tr, te, MEASURES, estimator, "annulation_binary", ["id"], {"regParam": [0.0, 5.0]}, "random", cv=2, draws=1)
    assert found["cv_results"].count() == 1
    with pytest.raises(ValueError):
        train.eval_classification(tr, te, MEASURES, estimator, "annulation_binary", ["id"], search_type="other")


def test_regression_without_grid_returns_metrics(spark):
    df = weather_rows(spark).withColumn("y", F.col("wave_height_max") * 2 + 1)
    parts = train.split_stratified(df, "annulation_binary", ["id"])
    tr, te = parts.where("split = 'train'"), parts.where("split = 'test'")
    out = train.evaluate_regression(tr, te, MEASURES, LinearRegression(labelCol="y"), "y", ["id"])
    assert out["r2"] == pytest.approx(1.0) and out["rmse"] < 1e-6


@pytest.mark.parametrize("block_rows", [15, 10_000])
def test_knn_equals_brute_force(spark, block_rows):
    rng = np.random.default_rng(6)
    x, y, q = rng.integers(0, 6, (80, 2)), rng.integers(0, 3, 80), rng.integers(0, 6, (40, 2))
    tr = spark.createDataFrame([(i, int(y[i]), float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, y int, a double, b double")
    te = spark.createDataFrame([(1000 + i, float(a), float(b)) for i, (a, b) in enumerate(q)], "id int, a double, b double")
    got = {r["id"]: r["prediction"] for r in train.knn_vote(tr, te, ["a", "b"], "y", "id", 5, block_rows).collect()}
    for i, row in enumerate(q):
        dist = ((x - row) ** 2).sum(axis=1)
        near = sorted(range(80), key=lambda j: (dist[j], j))[:5]
        labels = [int(y[j]) for j in near]
        want = min(set(labels), key=lambda v: (-labels.count(v), v))
        assert got[1000 + i] == want


def test_run_record(spark):
    row = runs.run_record(metrics.binary_metrics(from_matrix(spark, PUBLISHED[1][0])), "v2", "weather", 719, 13).first()
    assert (row["version"], row["n_samples"], row["n_features"], row["active"]) == ("v2", 719, 13, False)
    assert row["target_rate"] == pytest.approx(76 / 144)


def test_run_table_and_promotion(spark):
    path = scratch_path(spark, "model-runs")
    for version in ("v1", "v2"):
        table = runs.append_run(runs.run_record(metrics.binary_metrics(from_matrix(spark, PUBLISHED[1][0])), version, "weather", 719, 13), path)
    active = {r["version"]: r["active"] for r in runs.promote(table, "v2").collect()}
    assert active == {"v1": False, "v2": True}
    with pytest.raises(ValueError):
        runs.promote(table, "v9")


def test_text_labels_are_coded(spark):
    df = weather_rows(spark).withColumn("state", F.when(F.col("annulation_binary") == 1, "stop").otherwise("go"))
    parts = train.split_stratified(df, "state", ["id"])
    tr, te = parts.where("split = 'train'").drop("split"), parts.where("split = 'test'")
    out = train.eval_classification(tr, te, MEASURES, LogisticRegression(labelCol="state", maxIter=5), "state", ["id"], cv=2)
    assert {r["class"] for r in out["classification_report"].collect()} == {"go", "stop", "accuracy", "macro avg", "weighted avg"}


def test_crossing_grain_fusion(spark):
    from seacast.plans.lifecycles import train_crossings

    df = weather_rows(spark).select("id", F.col("annulation_binary").alias("annulation"), "wave_height_max", F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("ligne"))
    model, row = train_crossings(df, ["id"], trees=5, depth=5)
    assert train.model_features(model) == ["wave_height_max", "ligne_B"]
    assert row.first()["accuracy"] > 0.9


def test_model_comparison_is_sorted(spark):
    board = train.compare_models(weather_rows(spark), MEASURES, "annulation_binary", ["id"], ["logistic", "tree"]).collect()
    assert sorted(r["model"] for r in board) == ["logistic", "tree"]
    assert board[0]["accuracy"] >= board[1]["accuracy"]


def test_grid_search_scores_every_parameter_set(spark):
    from seacast.plans.queries_model import grid_search

    rows = grid_search(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len({r.params for r in rows}) == 5 * 2 * 2
    assert all(0 <= r.score <= 1 for r in rows)


# --- forests over many rows ---


def test_forest_rows_are_dealt_by_their_number(spark, monkeypatch):
    rows = spark.range(0, 1000, 1, 1).selectExpr("id AS k", "id % 7 AS a", "CAST(id % 3 = 0 AS INT) AS y")
    monkeypatch.setattr(train, "FOREST_ROWS", 300)
    dealt = train.spread(rows, ["a", "y", "a"])
    assert dealt.columns == ["a", "y"] and dealt.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, dealt.collect())) == sorted((i % 7, int(i % 3 == 0)) for i in range(1000))
    assert dealt.rdd.glom().map(lambda p: p == sorted(p)).collect() == [True] * 4
    assert max(dealt.rdd.glom().map(len).collect()) == 250
    monkeypatch.setattr(train, "FOREST_ROWS", 1000)
    assert train.spread(rows, ["a", "y"]).rdd.getNumPartitions() == 1


def test_forests_are_fitted_to_dealt_rows(spark, monkeypatch):
    seen = []
    deal = train.spread
    monkeypatch.setattr(train, "spread", lambda rows, cols: seen.append(list(cols)) or deal(rows, cols))
    rows = spark.range(60).selectExpr("CAST(id % 5 AS DOUBLE) AS a", "CAST(id % 2 AS INT) AS y", "1.0 AS weight")
    train.fit_model(rows, ["a"], train.forest("y", trees=2, depth=2, weight="weight"))
    train.fit_model(rows, ["a"], train.forest("y", trees=2, depth=2))
    train.fit_model(rows, ["a"], LogisticRegression(labelCol="y", maxIter=2))
    assert seen == [["a", "y", "weight"], ["a", "y"]]
