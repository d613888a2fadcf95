"""Queries of whole width: all measures, all features, every landed record, every category."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import DataFrame, SparkSession, functions as F

from seacast.functions.direction import weather_ratios
from seacast.models import kernel, neighbours, runs, train
from seacast.models.sparsetree import SparseTree
from seacast.operators import corr, profile
from seacast.operators.encode import crossing_features, sparse_layout
from seacast.operators.ordered import running_totals
from seacast.operators.split import split_stratified
from seacast.plans.adapters import adapted, table, with_views
from seacast.plans.queries import query, r6
from seacast.plans.queries_crossing import night_sql
from seacast.plans.queries_model import run_table, training_days
from seacast.schemas import MEASURES
from seacast.session import scratch_path, stored
from seacast.sources.tables import landed_crossings, read_raw_crossings, rejected_crossings
from seacast.streaming.jobs import consolidate_by_state

# --- correlations of all measures, with their holes ---------------------------


def _pairwise(body: str) -> str:
    parts = [body.format(a=a, b=b) for a, b in combinations(MEASURES, 2)]
    return with_views(["weather"], " UNION ALL ".join(parts))


def _known(df: DataFrame) -> DataFrame:
    return r6(df).withColumn("corr", F.col("corr") + F.lit(0.0))


@query(_pairwise("SELECT '{a}' AS var_a, '{b}' AS var_b, round(corr({a}, {b}), 6) + 0.0 AS corr FROM weather"))
def corr_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Pearson of all measures, each pair over the days that know both."""
    return _known(corr.corr_pairs(adapted(spark, sf, "weather"), MEASURES))


@query(
    _pairwise(
        """SELECT '{a}' AS var_a, '{b}' AS var_b, round(corr(x, y), 6) + 0.0 AS corr FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS x,
  rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS y FROM weather WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
    )
)
def corr_spearman_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Spearman of all measures; the ranks of a pair are those among the days that know both."""
    return _known(corr.corr_pairs(adapted(spark, sf, "weather"), MEASURES, "spearman"))


@query(
    _pairwise(
        """SELECT '{a}' AS var_a, '{b}' AS var_b, round(sum(sign((p.{a} - q.{a}) * (p.{b} - q.{b}))) / (sqrt(count_if(p.{a} <> q.{a})) * sqrt(count_if(p.{b} <> q.{b}))), 6) + 0.0 AS corr
FROM weather p JOIN weather q ON p.jour < q.jour WHERE p.{a} IS NOT NULL AND p.{b} IS NOT NULL AND q.{a} IS NOT NULL AND q.{b} IS NOT NULL"""
    )
)
def corr_kendall(spark: SparkSession, sf: str) -> DataFrame:
    """Kendall's tau-b of all measures, against counting every pair of days."""
    return _known(corr.corr_pairs(adapted(spark, sf, "weather"), MEASURES, "kendall"))


@query(
    with_views(
        ["weather"],
        """, m AS (SELECT var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b
  FROM (SELECT temperature_max AS x, wave_height_max AS y FROM weather) WHERE x IS NOT NULL AND y IS NOT NULL),
e AS (SELECT a, b, (a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l FROM m), v AS (SELECT b / sqrt(b * b + (l - a) * (l - a)) AS x, (l - a) / sqrt(b * b + (l - a) * (l - a)) AS y FROM e)
SELECT 'temperature_max' AS variable, round(abs(x), 6) AS strength_x, round(abs(y), 6) AS strength_y FROM v
UNION ALL SELECT 'wave_height_max', round(abs(y), 6), round(abs(x), 6) FROM v""",
    )
)
def pca_loadings_two_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Loadings of two measures, whose components have a closed form up to their sign."""
    out = corr.pca_loadings(adapted(spark, sf, "weather"), ["temperature_max", "wave_height_max"])
    return r6(out.select("variable", F.abs("loading_x").alias("strength_x"), F.abs("loading_y").alias("strength_y")))


@query(
    with_views(
        ["crossings"],
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", least(count(DISTINCT {c}), 4) AS n_seen, count(DISTINCT {c}) > 3 AS is_high_cardinality FROM crossings" for c in ("ligne", "vent", "mer", "ciel")
        ),
    )
)
def high_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    """Text columns with more than three values, counted no further than that."""
    return profile.high_cardinality(adapted(spark, sf, "crossings"), 3)


# --- landed records -------------------------------------------------------------


#: Records of the landed log for each pair of its files.
LOG_ROWS = 500_000


def _land_log(spark: SparkSession, sf: str, root: str) -> None:
    """The notes as records in two layouts: some notes hold a line break and quotes, every seventh line lacks cells.

    Files hold half of LOG_ROWS records or so, in five files a layout at least, so writing and reading take as many tasks as the table asks for."""
    log = spark.sql("SELECT l_orderkey, l_linenumber, annulation, meteo FROM {raw_notes}", raw_notes=adapted(spark, sf, "raw_notes"))
    files = max(5, -(-log.count() // LOG_ROWS))
    line = F.concat_ws("-", "l_orderkey", "l_linenumber")
    note = F.concat(F.lit('"'), F.replace(F.coalesce("meteo", F.lit("NA")), F.lit(" Mer"), F.lit('\n""Mer""')), F.lit('"'))
    broken = F.concat(F.lit("cut off "), line)
    first = F.when(F.col("l_linenumber") == 7, broken).otherwise(F.concat_ws(",", note, line, F.lit("01/02/2024 08:30"), F.coalesce("annulation", F.lit(""))))
    second = F.when(F.col("l_linenumber") == 7, broken).otherwise(F.concat_ws(",", F.lit("x"), line, F.coalesce("annulation", F.lit("")), note, F.lit("01/02/2024 08:30")))
    for folder, header, record, rest in (("a", "Météo,Ligne,Horaire,Annulation", first, 0), ("b", "more,Ligne,Annulation,Météo,Horaire", second, 1)):
        # A file's header comes with one of its rows, the first to arrive at its task.
        file = F.pmod(F.xxhash64("l_orderkey"), F.lit(files)).cast("int").alias("file")
        rows = log.where(F.col("l_orderkey") % 2 == rest).select(file, record.alias("value"))
        heads = spark.range(files).select(F.col("id").cast("int").alias("file"), F.lit(None).cast("string").alias("value"))
        dealt = rows.unionByName(heads).repartitionById(files, "file").select("value", F.monotonically_increasing_id().alias("at"))
        begin = F.when(F.shiftleft("at", 31) == 0, F.lit(header + "\n")).otherwise(F.lit(""))
        dealt.where((F.shiftleft("at", 31) == 0) | F.col("value").isNotNull()).select(F.concat(begin, F.coalesce("value", F.lit(""))).alias("value")).write.text(f"{root}/{folder}")


@query(
    with_views(
        ["raw_notes"],
        """, l AS (SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS ligne, * FROM raw_notes)
SELECT ligne, annulation, replace(meteo, ' Mer', chr(10) || '"Mer"') AS meteo, CAST(NULL AS VARCHAR) AS rejected FROM l WHERE l_linenumber <> 7
UNION ALL SELECT NULL, NULL, NULL, 'cut off ' || ligne FROM l WHERE l_linenumber = 7""",
    )
)
def landed_records(spark: SparkSession, sf: str) -> DataFrame:
    """Logs in two layouts whose notes hold line breaks and quotes: the good records, and the text of the rejected ones."""
    root = scratch_path(spark, "log")
    _land_log(spark, sf, root)
    log = landed_crossings(spark, root)
    good = read_raw_crossings(spark, root, landed=log).select("ligne", "annulation", "meteo", F.lit(None).cast("string").alias("rejected"))
    none = F.lit(None).cast("string")
    bad = rejected_crossings(spark, root, landed=log).select(none.alias("ligne"), none.alias("annulation"), none.alias("meteo"), F.col("_corrupt_record").alias("rejected"))
    return good.unionByName(bad)


# --- the whole crossing matrix --------------------------------------------------

_MOVED = """, moved AS (SELECT * REPLACE (horaire + INTERVAL 1 MINUTE * CAST(crossing_id % 1440 AS INTEGER) AS horaire) FROM crossings),
night AS ({night}),
f AS (SELECT m.crossing_id, m.annulation, month(horaire) AS mois, hour(horaire) AS heure_num, jour_nuit, vent_noeud, houle_dominante, houle_max, houle_periode, temperature,
  CASE mer WHEN 'ridée' THEN 0 WHEN 'belle' THEN 1 WHEN 'peu agitée' THEN 2 WHEN 'agitée' THEN 3 WHEN 'forte' THEN 4 ELSE -1 END AS mer,
  CASE WHEN vent IN ('W', 'WNW', 'NW', 'NNW', 'N') THEN 1 ELSE 0 END AS vent_mistral, CASE WHEN houle >= 270 OR houle = 0 THEN 1 ELSE 0 END AS houle_mistral,
  ligne, ciel, CASE WHEN m.crossing_id % 41 <> 0 THEN 'B' || CAST(m.crossing_id % 40 AS VARCHAR) END AS bateau, 'Cap_' || CAST(m.crossing_id AS VARCHAR) AS capitaine
  FROM moved m JOIN night n ON n.crossing_id = m.crossing_id)
"""
_NUMBERS = ["vent_noeud", "houle_dominante", "houle_max", "houle_periode", "mer", "temperature", "mois", "heure_num", "jour_nuit", "vent_mistral", "houle_mistral"]
_CELLS = [f"SELECT crossing_id, '{c}' AS name, CAST({c} AS DOUBLE) AS value FROM f WHERE coalesce({c}, 0) <> 0" for c in _NUMBERS] + [
    f"SELECT crossing_id, '{c}_' || coalesce({c}, 'nan'), 1.0::DOUBLE FROM (SELECT crossing_id, {c}, dense_rank() OVER (ORDER BY {c} NULLS LAST) AS r FROM f) WHERE r > 1"
    for c in ("ligne", "bateau", "ciel", "capitaine")
]


def whole_crossings(spark: SparkSession, sf: str) -> DataFrame:
    """Crossings with times of the whole day, ships, and a captain for each crossing."""
    key = F.col("crossing_id")
    moved = adapted(spark, sf, "crossings").drop("jour").withColumn("horaire", F.col("horaire") + F.make_dt_interval(mins=(key % 1440).cast("int")))
    return moved.withColumns({
        "date": F.col("horaire").cast("date"), "heure": F.date_format("horaire", "HH:mm:ss"),
        "bateau": F.when(key % 41 != 0, F.concat(F.lit("B"), (key % 40).cast("string"))), "capitaine": F.concat(F.lit("Cap_"), key.cast("string")),
    })


@query(with_views(["crossings"], _MOVED.format(night=night_sql("moved")) + " UNION ALL ".join(_CELLS)))
def sparse_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Every non-zero cell of the crossing matrix with calendar, day/night, sea, mistral, line, ship, sky and captain columns."""
    rows = crossing_features(whole_crossings(spark, sf))
    layout = sparse_layout(rows, drop=["crossing_id", "annulation"])
    cells = layout.entries(rows).select("crossing_id", F.inline("entries"))
    return cells.join(layout.names(), "place").select("crossing_id", "name", "value")


@query(
    with_views(
        ["crossings"],
        """, d AS (SELECT count(DISTINCT ligne) - 1 + count(DISTINCT ciel) + count(DISTINCT bateau) + count(*) - 1 AS hot, count(*) AS n FROM (
  SELECT ligne, ciel, CASE WHEN crossing_id % 41 <> 0 THEN 'B' || CAST(crossing_id % 40 AS VARCHAR) END AS bateau FROM crossings))
SELECT n AS n_rows, 11 + hot AS width, CAST(ceil(n * 0.2) AS BIGINT) AS n_test FROM d""",
    )
)
def sparse_model(spark: SparkSession, sf: str) -> DataFrame:
    """A tree trained on the whole sparse matrix: rows, width of the vectors, and test rows in its confusion matrix."""
    rows = crossing_features(whole_crossings(spark, sf))
    layout = sparse_layout(rows, drop=["crossing_id", "annulation"])
    vectors = layout.vectors(rows).select("crossing_id", "annulation", "features")
    parts = split_stratified(stored(vectors, "vectors"), "annulation", ["crossing_id"])
    model = SparseTree("annulation", len(layout.numeric), depth=5).fit(parts.where("split = 'train'"))
    scored = model.transform(parts.where("split = 'test'"))
    n_test = train.binary_metrics(scored, "annulation", "prediction").select(sum((F.col(c) for c in ("tn", "fp", "fn", "tp")), F.lit(0)).cast("long").alias("n_test"))
    return n_test.select(F.lit(rows.count()).cast("long").alias("n_rows"), F.lit(model.numFeatures).cast("long").alias("width"), "n_test")


# --- models ---------------------------------------------------------------------

_FILLED = """, y AS (SELECT jour, CASE WHEN avg(annulation) >= 0.166 THEN 1 ELSE 0 END AS label FROM crossings GROUP BY jour),
w AS (SELECT jour, {measures} FROM weather),
d AS (SELECT w.*, label, wave_height_max / (swell_wave_height_max + 1e-5) AS wave_to_swell_ratio, wave_height_max + swell_wave_height_max AS total_wave_energy,
  wind_speed_max / (wave_height_max + 1e-5) AS wind_to_wave_ratio, temperature_max - temperature_min AS temp_range FROM w JOIN y ON y.jour = w.jour)
""".format(measures=", ".join(f"coalesce({m}, 0) AS {m}" for m in MEASURES))
_DISTANCE = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in train.WEATHER_FEATURES)


def feature_days(spark: SparkSession, sf: str) -> DataFrame:
    """Days with all 13 features; a missing measure is 0."""
    return training_days(spark, sf).fillna(0, MEASURES).withColumns(weather_ratios())


@query(
    with_views(
        ["crossings", "weather"],
        _FILLED
        + f""", n AS (SELECT a.jour, b.label, row_number() OVER (PARTITION BY a.jour ORDER BY {_DISTANCE}, b.jour) AS r
  FROM d a JOIN d b ON a.jour >= DATE '2000-06-01' AND b.jour < DATE '2000-06-01'),
v AS (SELECT jour, label, count(*) AS c FROM n WHERE r <= 5 GROUP BY jour, label)
SELECT jour, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY jour ORDER BY c DESC, label) AS p FROM v) WHERE p = 1""",
    )
)
def knn_all_features(spark: SparkSession, sf: str) -> DataFrame:
    """The vote of the five nearest days over all 13 features, by balls around 24 pivots."""
    days = feature_days(spark, sf)
    old, new = days.where("jour < DATE '2000-06-01'"), days.where("jour >= DATE '2000-06-01'")
    return neighbours.knn_vote(old, new, train.WEATHER_FEATURES, "annulation_binary", "jour", pivots=24)


_GAMMA = 0.0005


@query(
    with_views(
        ["crossings", "weather"],
        _FILLED
        + f""", p AS (SELECT *, lead(jour) OVER (ORDER BY jour) AS following FROM d)
SELECT a.jour, round(exp(-{_GAMMA} * ({_DISTANCE})), 6) AS kernel, true AS close FROM p a JOIN d b ON b.jour = a.following""",
    )
)
def kernel_features(spark: SparkSession, sf: str) -> DataFrame:
    """The kernel of each day and the next one, and whether random Fourier features give it within four standard errors."""
    size = 1024
    vector = F.array(*[F.col(c).cast("double") for c in train.WEATHER_FEATURES])
    days = feature_days(spark, sf).select("jour", vector.alias("v"), kernel.fourier(vector, _GAMMA, size, 42).alias("z"))
    dates = days.select("jour")
    following = running_totals(dates, [F.col("jour")], {"place": F.lit(1)})
    following = following.join(following.select(F.col("jour").alias("following"), (F.col("place") - 1).alias("place")), "place").drop("place")
    pairs = following.join(days, "jour").join(days.select(F.col("jour").alias("following"), F.col("v").alias("w"), F.col("z").alias("y")), "following")
    exact = kernel.kernel(F.col("v"), F.col("w"), _GAMMA)
    product = F.aggregate(F.zip_with("z", "y", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return pairs.select("jour", F.round(exact, 6).alias("kernel"), (F.abs(exact - product) < 4 / (2 * size) ** 0.5).alias("close"))


@query(
    with_views(
        ["crossings", "weather"],
        _FILLED
        + """, r AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(jour AS VARCHAR) || '|42')) AS r, count(*) OVER () AS n, count(*) OVER (PARTITION BY label) AS c FROM d),
b AS (SELECT DISTINCT label, CAST(ceil(n * 0.2) AS BIGINT) AS total, ceil(n * 0.2) * c / n AS x FROM r),
o AS (SELECT *, floor(x) AS lo, row_number() OVER (ORDER BY x - floor(x) DESC, label) AS o, sum(floor(x)) OVER () AS used FROM b),
q AS (SELECT label, CAST(lo + CASE WHEN o <= total - used THEN 1 ELSE 0 END AS BIGINT) AS support FROM o)
SELECT CAST(label AS VARCHAR) AS class, support FROM q UNION ALL SELECT c, CAST((SELECT sum(support) FROM q) AS BIGINT) FROM (SELECT unnest(['accuracy', 'macro avg', 'weighted avg']) AS c)""",
    )
)
def eval_report(spark: SparkSession, sf: str) -> DataFrame:
    """The classes of the report of an evaluated search (four trees, five folds) and how many test rows each has."""
    parts = split_stratified(feature_days(spark, sf), "annulation_binary", ["jour"])
    estimator = DecisionTreeClassifier(labelCol="annulation_binary", seed=42)
    out = train.eval_classification(
        parts.where("split = 'train'"), parts.where("split = 'test'"), train.WEATHER_FEATURES, estimator, "annulation_binary", ["jour"],
        grid={"maxDepth": [5, 10], "minInstancesPerNode": [1, 2]}, scoring="recall",
    )
    return out["classification_report"].select("class", "support")


@query(
    """WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42')) AS r, count(*) OVER () AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders),
b AS (SELECT DISTINCT o_custkey, CAST(ceil(n * 0.25) AS BIGINT) AS total, CAST(ceil(n * 0.25) AS BIGINT) * c AS up, n FROM r),
f AS (SELECT o_custkey, total, up // n AS lo, row_number() OVER (ORDER BY up % n DESC, CAST(o_custkey AS VARCHAR)) AS o, sum(up // n) OVER () AS used FROM b)
SELECT o_orderkey, CASE WHEN r.r <= lo + CASE WHEN o <= total - used THEN 1 ELSE 0 END THEN 'test' ELSE 'train' END AS split FROM r JOIN f ON f.o_custkey = r.o_custkey"""
)
def split_many_classes(spark: SparkSession, sf: str) -> DataFrame:
    """A quarter of the orders, shared out over as many classes as there are customers."""
    return split_stratified(table(spark, sf, "orders"), "o_custkey", ["o_orderkey"], test=0.25).select("o_orderkey", "split")


# --- runs and state -------------------------------------------------------------


@query(
    with_views(
        ["preds"],
        " UNION ALL ".join(
            f"""SELECT '{v}' AS version, coalesce(round(count_if(y_true = q) / nullif(count(*), 0), 6), 0.0) AS accuracy, {str(v == "v2").lower()} AS active, true AS second_writer_lost
FROM (SELECT y_true, {rule} AS q FROM preds)"""
            for v, rule in {"v1": "y_pred", "v2": "CASE WHEN score >= 0.5 THEN 1 ELSE 0 END", "v3": "1"}.items()
        ),
    )
)
def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs appended to a run log and one promoted; a second writer that saw the same state loses."""
    path, records = scratch_path(spark, "runs"), run_table(spark, sf)
    first, second = runs.RunLog(spark, path), runs.RunLog(spark, path)
    ids = {v: first.append(records.where(F.col("version") == v)) for v in ("v1", "v2", "v3")}
    seen = len(second.entries())
    first.promote(ids["v2"], seen)
    try:
        second.promote(ids["v1"], seen)
        lost = False
    except runs.Conflict:
        lost = True
    return runs.RunLog(spark, path).table().select("version", "accuracy", "active", F.lit(lost).alias("second_writer_lost"))


@query(with_views(["weather"], f"SELECT jour AS date, {', '.join(MEASURES)} FROM weather"))
def stream_first_by_state(spark: SparkSession, sf: str) -> DataFrame:
    """Landed days, each three times, as a stream of one file a batch that is stopped and started again; a day's state lets its first row pass."""
    source, out, checkpoint = (scratch_path(spark, n) for n in ("landing", "daily", "checkpoint"))
    days = adapted(spark, sf, "weather").select(F.date_format("jour", "yyyy-MM-dd").alias("date"), *MEASURES)
    schema = days.withColumn("at", F.lit(0)).schema
    for at in range(3):
        # The first landing holds every second day twice; its later rows differ and must lose.
        rows = days if at else days.where(F.dayofmonth("date") % 2 == 0)
        both = rows.withColumn("at", F.lit(2 * at)).unionByName(rows.withColumns({m: F.col(m) + 1 for m in MEASURES}).withColumn("at", F.lit(2 * at + 1)))
        late = both if at < 2 else both.withColumns({m: F.lit(-1.0) for m in MEASURES})
        late.coalesce(1).write.mode("append").parquet(source)
        landed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        consolidate_by_state(landed, out, checkpoint, ["at"], ttl="5000 days").awaitTermination()
    return spark.read.parquet(out)
