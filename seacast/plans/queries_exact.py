"""The parts of trained models that SQL can state exactly: sizes, folds, identities and closed forms."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, functions as F

from seacast.models import train
from seacast.operators import corr, daily
from seacast.operators.split import split_stratified, stratified_folds
from seacast.plans.adapters import adapted, table, with_views
from seacast.plans.queries import query, r6
from seacast.plans.queries_model import training_days
from seacast.schemas import MEASURES
from seacast.session import scratch_path, stored
from seacast.streaming.jobs import read_requests, score_stream


@query(
    with_views(
        ["weather"],
        """, m AS (SELECT var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b
  FROM (SELECT temperature_max AS x, wave_height_max AS y FROM weather) WHERE x IS NOT NULL AND y IS NOT NULL),
e AS (SELECT ((a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b)) / (a + c) AS s FROM m)
SELECT 1 AS component, round(s, 6) AS explained, round(s, 6) AS cumulative FROM e
UNION ALL SELECT 2, round(1 - s, 6), 1.0::DOUBLE FROM e""",
    )
)
def pca_two_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Explained variance of two measures, whose components have a closed form."""
    return r6(corr.pca_scree(adapted(spark, sf, "weather"), ["temperature_max", "wave_height_max"]))


_ORDER = "row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42') || CAST(o_orderkey AS VARCHAR) || '|42')"


@query(
    f"""WITH s AS (SELECT o_totalprice AS y, o_custkey AS x, {_ORDER} <= ceil(count(*) OVER () * 0.2) AS test FROM orders),
m AS (SELECT regr_slope(y, x) AS k, regr_intercept(y, x) AS d FROM s WHERE NOT test),
p AS (SELECT y, d + k * x AS p FROM s, m WHERE test)
SELECT round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) AS r2, round(sqrt(avg((y - p) * (y - p))), 3) AS rmse, round(avg(abs(y - p)), 3) AS mae FROM p"""
)
def regression_one_feature(spark: SparkSession, sf: str) -> DataFrame:
    """Least squares of one feature, scored on the held-out fifth."""
    df = table(spark, sf, "orders").withColumn("one", F.lit(1)).withColumn("o_totalprice", F.col("o_totalprice").cast("double"))
    parts = split_stratified(df, "one", ["o_orderkey"])
    out = train.evaluate_regression(
        parts.where("split = 'train'"), parts.where("split = 'test'"), ["o_custkey"],
        LinearRegression(labelCol="o_totalprice", solver="normal"), "o_totalprice", ["o_orderkey"],
    )
    return spark.createDataFrame([(round(out["r2"], 6), round(out["rmse"], 3), round(out["mae"], 3))], "r2 double, rmse double, mae double")


@query(
    with_views(
        ["crossings"],
        """, r AS (SELECT crossing_id, annulation, count(*) OVER (PARTITION BY annulation) AS n,
    row_number() OVER (PARTITION BY annulation ORDER BY md5(CAST(crossing_id AS VARCHAR) || '|42')) AS r FROM crossings)
SELECT crossing_id, annulation, CAST(r > n // 5 AS INT) + CAST(r > n * 2 // 5 AS INT) + CAST(r > n * 3 // 5 AS INT) + CAST(r > n * 4 // 5 AS INT) AS fold FROM r""",
    )
)
def fold_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """The fold of every crossing in a stratified five-fold validation."""
    rows = adapted(spark, sf, "crossings").select("crossing_id", "annulation")
    return stratified_folds(rows, "annulation", ["crossing_id"], 5)


_DAYS = """, y AS (SELECT jour, CASE WHEN avg(annulation) >= 0.166 THEN 1 ELSE 0 END AS label FROM crossings GROUP BY jour),
d AS (SELECT w.jour, label FROM weather w JOIN y ON y.jour = w.jour)"""


@query(with_views(["crossings", "weather"], _DAYS + " SELECT CAST(ceil(count(*) * 0.2) AS BIGINT) AS n_test FROM d"))
def forest_test_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The confusion matrix of a forest holds every test row once."""
    days = training_days(spark, sf).fillna(0)
    _, row = train.train_weather_model(days, ["jour"], features=MEASURES, estimator=train.forest("annulation_binary"))
    return row.select(sum((F.col(c) for c in ("tn", "fp", "fn", "tp")), F.lit(0)).cast("long").alias("n_test"))


def _forest(spark: SparkSession, sf: str):
    return train.fit_model(stored(training_days(spark, sf).fillna(0), "training"), MEASURES, train.forest("annulation_binary"))


@query(with_views(["weather"], "SELECT jour, true AS class_follows, true AS confidence_follows FROM weather"))
def score_identities(spark: SparkSession, sf: str) -> DataFrame:
    """Every scored day: its class is that of a probability above one half, its confidence the larger probability."""
    p = F.col("annulation_probability")
    scored = train.score(_forest(spark, sf), adapted(spark, sf, "weather"))
    return scored.select(
        "jour", ((p > 0.5).cast("int") == F.col("annulation_predicted")).alias("class_follows"),
        (F.abs(F.greatest(p, 1 - p) - F.col("confidence")) < 1e-12).alias("confidence_follows"),
    )


@query(with_views(["weather"], "SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_different FROM weather"))
def stream_equals_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Requests scored as a stream and as a batch: how many rows, and how many that only one of them has."""
    model, landing, out = _forest(spark, sf), scratch_path(spark, "requests"), scratch_path(spark, "scored")
    adapted(spark, sf, "weather").select(*MEASURES).write.json(landing)
    score_stream(model, read_requests(spark, landing), out, scratch_path(spark, "checkpoint")).awaitTermination()
    streamed = spark.read.parquet(out)
    batch = train.score(model, spark.read.schema(read_requests(spark, landing).schema).json(landing)).select(streamed.columns)
    signed = streamed.withColumn("_s", F.lit(1)).unionByName(batch.withColumn("_s", F.lit(-1)))
    groups = signed.groupBy(streamed.columns).agg(F.sum("_s").alias("d"), F.count_if(F.col("_s") == 1).alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.abs("d")), F.lit(0)).alias("n_different"))


@query(
    with_views(
        ["crossings"],
        """, k AS (SELECT vent, ligne, count(*) AS c FROM crossings WHERE vent IS NOT NULL AND ligne IS NOT NULL GROUP BY 1, 2)
SELECT vent, ligne, round(c / sum(c) OVER (PARTITION BY vent), 6) AS share FROM k""",
    )
)
def crosstab_all_values(spark: SparkSession, sf: str) -> DataFrame:
    """Shares over every line that occurs, not a list of them."""
    return r6(daily.crosstab_cells(adapted(spark, sf, "crossings"), "vent", "ligne"))
