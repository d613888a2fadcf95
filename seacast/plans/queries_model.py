"""Queries that train, score, search and compare models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression

from seacast.models import metrics, runs, train
from seacast.operators import corr
from seacast.operators.encode import model_matrix, preprocess_crossings
from seacast.plans import lifecycles
from seacast.plans.adapters import adapted, table, with_views
from seacast.plans.queries import query, r6
from seacast.schemas import MEASURES
from seacast.session import scratch_path
from seacast.sources.tables import export_train_test, preprocessing_metadata, write_predictions
from seacast.streaming.jobs import score_stream

# --- metrics ----------------------------------------------------------------

_COUNTS = """SELECT count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
  count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp FROM preds"""
_SCORES = """coalesce(round((tp + tn) / nullif(tn + fp + fn + tp, 0), 6), 0.0) AS accuracy, coalesce(round(tp / nullif(tp + fp, 0), 6), 0.0) AS precision,
  coalesce(round(tp / nullif(tp + fn, 0), 6), 0.0) AS recall, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 6), 0.0) AS f1"""


@query(with_views(["preds"], f", c AS ({_COUNTS}) SELECT tn, fp, fn, tp, tn + fp + fn + tp AS n, {_SCORES}, round((tp + fn) / (tn + fp + fn + tp), 6) AS target_rate FROM c"))
def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return r6(metrics.binary_metrics(adapted(spark, sf, "preds")))


@query(with_views(["preds"], "SELECT y_true AS label, y_pred AS prediction, count(*) AS n FROM preds GROUP BY 1, 2"))
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(adapted(spark, sf, "preds"))


@query(
    with_views(
        ["preds"],
        """, k AS (SELECT unnest([0, 1]) AS c),
p AS (SELECT c, count(*) FILTER (y_true = c AND y_pred = c) AS tp, count(*) FILTER (y_true = c) AS support, count(*) FILTER (y_pred = c) AS predicted FROM k, preds GROUP BY c),
s AS (SELECT CAST(c AS VARCHAR) AS class, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
  coalesce(2 * tp / nullif(predicted + support, 0), 0) AS f1, support, tp FROM p)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM s
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM s
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM s
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM s""",
    )
)
def class_report(spark: SparkSession, sf: str) -> DataFrame:
    return r6(metrics.class_report(adapted(spark, sf, "preds")))


_ROC = """, g AS (SELECT score AS threshold, count(*) FILTER (y_true = 1) AS p, count(*) FILTER (y_true = 0) AS n FROM preds GROUP BY 1),
c AS (SELECT threshold, p, n, CAST(sum(p) OVER (ORDER BY threshold DESC) AS BIGINT) AS tps, CAST(sum(n) OVER (ORDER BY threshold DESC) AS BIGINT) AS fps FROM g)"""


@query(
    with_views(
        ["preds"],
        _ROC
        + """SELECT threshold, tps, fps, round(tps / (SELECT sum(p) FROM g), 6) AS tpr, round(fps / (SELECT sum(n) FROM g), 6) AS fpr FROM c
UNION ALL SELECT 9999.0::DOUBLE, 0, 0, 0.0::DOUBLE, 0.0::DOUBLE""",
    )
)
def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    points = metrics.roc_points(adapted(spark, sf, "preds"))
    finite = F.when(F.col("threshold") == float("inf"), F.lit(9999.0)).otherwise(F.col("threshold"))
    return r6(points.withColumn("threshold", finite), "tpr", "fpr")


@query(with_views(["preds"], _ROC + "SELECT round(CAST(sum(n * (tps - p / 2)) AS DOUBLE) / CAST(sum(p) * sum(n) AS DOUBLE), 6) AS auc FROM c"))
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return r6(metrics.roc_auc(adapted(spark, sf, "preds")))


@query(
    """WITH f AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)
SELECT count(*) AS n, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) AS r2, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae FROM f"""
)
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    out = metrics.regression_metrics(df, "y", "p")
    return r6(out, "r2").withColumns({c: F.round(c, 4) for c in ("rmse", "mae")})


# --- runs -------------------------------------------------------------------

_VERSIONS = {"v1": "y_pred", "v2": "CASE WHEN score >= 0.5 THEN 1 ELSE 0 END", "v3": "1"}


def run_table(spark: SparkSession, sf: str) -> DataFrame:
    """One run per rule that turns a prediction row into a class."""
    out = None
    preds = adapted(spark, sf, "preds")
    for version, rule in _VERSIONS.items():
        scored = preds.select("y_true", F.expr(rule).alias("y_pred"))
        row = runs.run_record(r6(metrics.binary_metrics(scored)), version, "labels", 0, 1)
        out = row if out is None else out.unionByName(row)
    return out


_RUNS = ", " + ", ".join(
    f"{v} AS (SELECT '{v}' AS version, {_SCORES} FROM (SELECT count(*) FILTER (y_true = 0 AND q = 0) AS tn, count(*) FILTER (y_true = 0 AND q = 1) AS fp, "
    f"count(*) FILTER (y_true = 1 AND q = 0) AS fn, count(*) FILTER (y_true = 1 AND q = 1) AS tp FROM (SELECT y_true, {rule} AS q FROM preds)))"
    for v, rule in _VERSIONS.items()
) + ", r AS (SELECT * FROM v1 UNION ALL SELECT * FROM v2 UNION ALL SELECT * FROM v3)"
_LONG = "SELECT version, unnest(['accuracy', 'precision', 'recall', 'f1']) AS metric, unnest([accuracy, precision, recall, f1]) AS value FROM r"


@query(with_views(["preds"], _RUNS + "SELECT version, accuracy, precision, recall, f1 FROM r"))
def leader_board(spark: SparkSession, sf: str) -> DataFrame:
    return runs.leader_board(run_table(spark, sf)).select("version", "accuracy", "precision", "recall", "f1")


@query(
    with_views(
        ["preds"],
        _RUNS
        + f""", l AS ({_LONG}) SELECT a.metric, a.value AS first_value, b.value AS second_value, round(b.value - a.value, 6) AS delta,
  format('{{:+.4f}}', b.value - a.value) AS delta_text, CASE WHEN (SELECT f1 FROM v2) > (SELECT f1 FROM v1) THEN 'v2' ELSE 'v1' END AS winner
FROM l a JOIN l b ON a.metric = b.metric WHERE a.version = 'v1' AND b.version = 'v2'""",
    )
)
def compare_runs(spark: SparkSession, sf: str) -> DataFrame:
    return r6(runs.compare_two(run_table(spark, sf), "v1", "v2"), "delta")


@query(with_views(["preds"], _RUNS + f", l AS ({_LONG}) SELECT metric, max(value) FILTER (version = 'v1') AS v1, max(value) FILTER (version = 'v2') AS v2, max(value) FILTER (version = 'v3') AS v3 FROM l GROUP BY metric"))
def compare_three(spark: SparkSession, sf: str) -> DataFrame:
    return runs.compare_many(run_table(spark, sf), ["v1", "v2", "v3"])


@query(with_views(["preds"], "SELECT doc_id, greatest(y_pred, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) AS annulation_predicted FROM preds"))
def or_vote(spark: SparkSession, sf: str) -> DataFrame:
    preds = adapted(spark, sf, "preds")
    first = preds.select("doc_id", F.col("y_pred").alias("annulation_predicted"))
    second = preds.select("doc_id", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("annulation_predicted"))
    return runs.or_vote(first, second, ["doc_id"])


# --- training ---------------------------------------------------------------


def training_days(spark: SparkSession, sf: str) -> DataFrame:
    days = lifecycles.training_days(adapted(spark, sf, "crossings"), adapted(spark, sf, "weather"))
    return days.select("jour", "annulation_binary", *MEASURES)


@query()
def rf_score_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Day-grain forest trained on the merged days, then every weather day scored."""
    model, _ = lifecycles.train_days(training_days(spark, sf))
    return train.score(model, adapted(spark, sf, "weather"))


@query()
def rf_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Test metrics of the day-grain forest as a run record."""
    days = training_days(spark, sf)
    _, row = lifecycles.train_days(days)
    return runs.run_record(row, "v2", "weather", days.count(), len(train.WEATHER_FEATURES)).drop("run_at")


@query()
def rf_crossings(spark: SparkSession, sf: str) -> DataFrame:
    """Crossing-grain forest on the encoded matrix (balanced weights), test metrics."""
    df = adapted(spark, sf, "crossings").drop("horaire", "jour")
    matrix = model_matrix(preprocess_crossings(df), keys=["crossing_id"]).fillna(0)
    weighted = train.balanced_weights(matrix, "annulation")
    features = [c for c in matrix.columns if c not in ("crossing_id", "annulation")]
    estimator = train.forest("annulation", weight="weight")
    _, row = train.train_weather_model(weighted, ["crossing_id"], "annulation", features, estimator)
    return row


@query()
def logistic_before_after(spark: SparkSession, sf: str) -> DataFrame:
    """Logistic baseline with and without the wide column families."""
    return lifecycles.logistic_before_after(adapted(spark, sf, "crossings").drop("horaire", "jour"), ["crossing_id"])


@query()
def model_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    days = lifecycles.weather_features(training_days(spark, sf))
    return train.compare_models(days, train.WEATHER_FEATURES, "annulation_binary", ["jour"])


@query()
def grid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-validated logistic regression: every C, penalty and class weight of the grid, recall of class 1.

    Class weights are those of each fold's training rows."""
    days = lifecycles.weather_features(training_days(spark, sf))
    folds = 5
    n = days.count() * (folds - 1) / folds
    estimator = LogisticRegression(labelCol="annulation_binary", maxIter=1000, standardization=False)
    grid = {
        "regParam": [train.logistic_params(c, "l2", n)["regParam"] for c in (0.01, 0.1, 1, 10, 100)],
        "elasticNetParam": [train.logistic_params(1, p, n)["elasticNetParam"] for p in ("l1", "l2")], "class_weight": [None, "balanced"],
    }
    found = train.search(days, train.WEATHER_FEATURES, estimator, grid, "annulation_binary", ["jour"], "recall", folds=folds)
    return train.search_scores(spark, found)


@query()
def fold_scores(spark: SparkSession, sf: str) -> DataFrame:
    days = lifecycles.weather_features(training_days(spark, sf))
    estimator = LogisticRegression(labelCol="annulation_binary", maxIter=1000)
    return train.cross_val_scores(days, train.WEATHER_FEATURES, estimator, "annulation_binary", ["jour"], folds=5)


@query()
def eval_regression(spark: SparkSession, sf: str) -> DataFrame:
    """Linear regression of price on quantity, discount and tax; metrics on the test rows."""
    df = table(spark, sf, "lineitem").withColumn("key", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")).withColumn("one", F.lit(1))
    parts = train.split_stratified(df, "one", ["key"])
    features = ["l_quantity", "l_discount", "l_tax"]
    out = train.evaluate_regression(
        parts.where("split = 'train'"), parts.where("split = 'test'"), features, LinearRegression(labelCol="l_extendedprice"), "l_extendedprice", ["key"]
    )
    return spark.createDataFrame([(out["r2"], out["rmse"], out["mae"])], "r2 double, rmse double, mae double")


_KNN = ["temperature_max", "wave_direction_dominant", "wind_gusts_max"]
_DIST = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in _KNN)


@query(
    with_views(
        ["crossings", "weather"],
        f""", y AS (SELECT jour, CASE WHEN avg(annulation) >= 0.166 THEN 1 ELSE 0 END AS label FROM crossings GROUP BY jour),
d AS (SELECT w.jour, label, {", ".join(_KNN)} FROM weather w JOIN y ON y.jour = w.jour),
n AS (SELECT a.jour, b.label, row_number() OVER (PARTITION BY a.jour ORDER BY {_DIST}, b.jour) AS r
  FROM d a JOIN d b ON a.jour >= DATE '2000-06-01' AND b.jour < DATE '2000-06-01'),
v AS (SELECT jour, label, count(*) AS c FROM n WHERE r <= 5 GROUP BY jour, label)
SELECT jour, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY jour ORDER BY c DESC, label) AS p FROM v) WHERE p = 1""",
    )
)
def knn_vote(spark: SparkSession, sf: str) -> DataFrame:
    days = training_days(spark, sf)
    old, new = days.where("jour < DATE '2000-06-01'"), days.where("jour >= DATE '2000-06-01'")
    return train.knn_vote(old, new, _KNN, "annulation_binary", "jour", block_rows=700)


@query()
def pca_scree(spark: SparkSession, sf: str) -> DataFrame:
    return corr.pca_scree(adapted(spark, sf, "weather"), MEASURES)


@query()
def pca_loadings(spark: SparkSession, sf: str) -> DataFrame:
    return corr.pca_loadings(adapted(spark, sf, "weather"), MEASURES)


# --- sinks and streaming ----------------------------------------------------


@query()
def stream_score(spark: SparkSession, sf: str) -> DataFrame:
    """Weather requests land as JSON files and are scored as a stream."""
    model, _ = lifecycles.train_days(training_days(spark, sf))
    landing = scratch_path(spark, "requests")
    adapted(spark, sf, "weather").select(*MEASURES).write.json(landing)
    from seacast.streaming.jobs import read_requests

    out = scratch_path(spark, "scored")
    score_stream(model, read_requests(spark, landing), out, scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out)


@query(with_views(["preds"], "SELECT count(*) AS n_predictions FROM preds"))
def prediction_sink(spark: SparkSession, sf: str) -> DataFrame:
    scored = adapted(spark, sf, "preds")
    return write_predictions(scored, scratch_path(spark, "sink"), "labels").select("n_predictions")


@query(
    """WITH s AS (SELECT o_orderkey, o_totalprice, o_custkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42')) AS r, count(*) OVER () AS n FROM orders)
SELECT CASE WHEN r <= ceil(n * 0.25) THEN 'test' ELSE 'train' END AS part, CASE WHEN r <= ceil(n * 0.25) THEN o_custkey END AS o_custkey, o_orderkey,
  round(ln(1 + o_totalprice), 6) AS log_buy_price FROM s"""
)
def export_parts(spark: SparkSession, sf: str) -> DataFrame:
    """X and y of both parts written and read back; the train part lacks the dropped column."""
    df = table(spark, sf, "orders").withColumn("one", F.lit(1))
    parts = train.split_stratified(df, "one", ["o_orderkey"], test=0.25)
    root = scratch_path(spark, "export")
    export_train_test(parts, root, ["o_orderkey", "o_custkey"], "o_totalprice", log_target=True, drop_cols=["o_custkey"])
    both = spark.read.parquet(f"{root}/train").withColumn("part", F.lit("train")).unionByName(
        spark.read.parquet(f"{root}/test").withColumn("part", F.lit("test")), allowMissingColumns=True
    )
    return r6(both)


@query(
    with_views(
        ["crossings"],
        # Ten columns that are no categories; the first line and the first sky have no column, a missing sky has one.
        """SELECT 'orders' AS source, count(*) AS input_rows, 10 + count(DISTINCT ligne) - 1 + count(DISTINCT ciel) - 1 + max(CAST(ciel IS NULL AS INTEGER)) AS n_input,
  10 + count(DISTINCT ligne) - 1 + count(DISTINCT ciel) - 1 + max(CAST(ciel IS NULL AS INTEGER)) AS n_numeric,
  10 + count(DISTINCT ligne) - 1 AS n_reduced, 'annulation' AS target_column FROM crossings""",
    )
)
def preprocessing_run(spark: SparkSession, sf: str) -> DataFrame:
    """Run metadata of the three model tables."""
    from seacast.operators.encode import model_tables

    tables = model_tables(adapted(spark, sf, "crossings").drop("horaire", "jour"))
    meta = preprocessing_metadata(tables["processed"], tables["numeric"], tables["reduced"], "orders")
    sizes = {f"n_{c}": F.size(f"{c}_columns") for c in ("input", "numeric", "reduced")}
    return meta.select("source", "input_rows", *[v.alias(k) for k, v in sizes.items()], "target_column")
