"""Queries that profile, correlate, impute, encode and split tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seacast.functions import text
from seacast.operators import corr, encode, impute, profile, split
from seacast.plans.adapters import adapted, table, with_views
from seacast.plans.queries import query, r6
from seacast.schemas import MEASURES

# --- profiling --------------------------------------------------------------

_PROFILE_EXTRA = "*, 'x' AS constant_text, CAST(NULL AS DOUBLE) AS empty_number, crossing_id % 2 AS flag, CASE WHEN crossing_id % 3 = 0 THEN 'NA' ELSE 'ok' END AS holes, CASE WHEN crossing_id % 5 > 1 THEN NULL ELSE vent_noeud END AS sparse"
_PROFILE_COLS = {
    "crossing_id": "n", "horaire": "o", "jour": "o", "annulation": "n", "ligne": "s", "vent": "s", "vent_noeud": "n", "houle_dominante": "n",
    "houle_max": "n", "houle": "n", "houle_periode": "n", "mer": "s", "temperature": "n", "ciel": "s", "constant_text": "s",
    "empty_number": "n", "flag": "n", "holes": "s", "sparse": "n",
}


def _profile_sql(col: str, kind: str) -> str:
    boolean = {"n": f"coalesce(bool_and({col} IN (0, 1)), true)", "s": f"count({col}) = 0", "o": f"count({col}) = 0"}[kind]
    missing = f"coalesce(bool_or({col} IS NULL OR {col} IN ('', 'na', 'NA', 'null', 'NULL')), false)" if kind == "s" else f"bool_or({col} IS NULL)"
    distinct = f"count(DISTINCT {col})" if kind == "s" else "CAST(NULL AS BIGINT)"
    high = f"count(DISTINCT {col}) > 4" if kind == "s" else "false"
    return f"""SELECT '{col}' AS "column", count(*) - count({col}) AS n_null, count({col}) = 0 AS is_empty,
  count(DISTINCT {col}) + max(CASE WHEN {col} IS NULL THEN 1 ELSE 0 END) <= 1 AS is_constant, {boolean} AS is_boolean,
  (count(*) - count({col})) / count(*) > 0.5 AS is_high_na, {missing} AS is_missing_like, {distinct} AS n_distinct, {high} AS is_high_cardinality FROM wide"""


@query(
    with_views(["crossings"], f", wide AS (SELECT {_PROFILE_EXTRA} FROM crossings) " + " UNION ALL ".join(_profile_sql(c, k) for c, k in _PROFILE_COLS.items()))
)
def profile_columns(spark: SparkSession, sf: str) -> DataFrame:
    wide = adapted(spark, sf, "crossings").selectExpr(*_split_exprs(_PROFILE_EXTRA))
    return profile.profile_columns(wide, max_modalities=4)


def _split_exprs(exprs: str) -> list[str]:
    """Top-level comma split of a select list."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(exprs):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(exprs[start:i].strip())
            start = i + 1
    return [*out, exprs[start:].strip()]


_WCOLS = ["jour", *MEASURES]


@query(
    with_views(
        ["weather"],
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) - count({c}) AS n_null, round(count({c}) * 100.0 / count(*), 6) AS fill_pct,
  round(100.0 - count({c}) * 100.0 / count(*), 6) AS missing_pct FROM weather"""
            for c in _WCOLS
        ),
    )
)
def fill_rates(spark: SparkSession, sf: str) -> DataFrame:
    return r6(profile.fill_rates(adapted(spark, sf, "weather")))


_LNUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min,
  CAST(max({c}) AS DOUBLE) AS max, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75 FROM lineitem"""
        for c in _LNUM
    )
)
def describe_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return r6(profile.describe(table(spark, sf, "lineitem")))


@query("SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def value_counts_top(spark: SparkSession, sf: str) -> DataFrame:
    return profile.value_counts(table(spark, sf, "part"), "p_type", 5)


@query(with_views(["crossings"], "SELECT vent AS value, count(*) AS n FROM crossings GROUP BY 1"))
def value_counts_with_null(spark: SparkSession, sf: str) -> DataFrame:
    return profile.value_counts(adapted(spark, sf, "crossings"), "vent")


@query(with_views(["crossings"], "SELECT DISTINCT ciel FROM crossings"))
def distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    return profile.distinct_values(adapted(spark, sf, "crossings"), "ciel")


@query("SELECT count(DISTINCT l_orderkey) AS l_orderkey, count(DISTINCT l_partkey) AS l_partkey, count(DISTINCT l_shipdate) AS l_shipdate FROM lineitem")
def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.distinct_counts(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_shipdate"])


@query(
    with_views(
        ["crossings"],
        """SELECT count(*) AS n_rows, 12 AS n_columns, min(jour) AS first, max(jour) AS last, count(DISTINCT annulation) AS n_target_values,
  CAST(sum((vent IS NULL)::INT + (houle_periode IS NULL)::INT + (mer IS NULL)::INT + (temperature IS NULL)::INT + (ciel IS NULL)::INT) AS BIGINT) AS n_null_cells FROM crossings""",
    )
)
def inspect_table(spark: SparkSession, sf: str) -> DataFrame:
    df = adapted(spark, sf, "crossings").drop("crossing_id", "horaire")
    return profile.inspect(df, "jour", "annulation")


def _bins_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", bin, lo + bin * w AS bin_low, lo + (bin + 1) * w AS bin_high, n FROM
  (SELECT CAST(least(floor((v - lo) / (hi - lo) * 40), 39) AS INTEGER) AS bin, min(lo) AS lo, min((hi - lo) / 40) AS w, count(*) AS n
   FROM (SELECT CAST({c} AS DOUBLE) AS v, min(CAST({c} AS DOUBLE)) OVER () AS lo, max(CAST({c} AS DOUBLE)) OVER () AS hi FROM lineitem) GROUP BY 1)"""


@query(
    "SELECT \"column\", bin, round(bin_low, 6) AS bin_low, round(bin_high, 6) AS bin_high, n FROM ("
    + " UNION ALL ".join(_bins_sql(c) for c in _LNUM)
    + ")"
)
def histogram40(spark: SparkSession, sf: str) -> DataFrame:
    return r6(profile.histograms(table(spark, sf, "lineitem")))


@query(
    with_views(
        ["crossings"],
        "SELECT vent AS value FROM (SELECT vent, count(*) AS n, min(struct_pack(a := horaire, b := crossing_id)) AS f FROM crossings WHERE vent IS NOT NULL GROUP BY vent) ORDER BY n DESC, f LIMIT 1",
    )
)
def majority_value(spark: SparkSession, sf: str) -> DataFrame:
    return profile.majority_value(adapted(spark, sf, "crossings"), "vent", ["horaire", "crossing_id"])


def _mode_sql(c: str, shown: str) -> str:
    return f"SELECT * FROM (SELECT '{c}' AS \"column\", {shown} AS mode, count(*) AS n FROM crossings WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1)"


@query(
    with_views(["crossings"], " UNION ALL ".join([_mode_sql("vent", "vent"), _mode_sql("mer", "mer"), _mode_sql("ciel", "ciel"), _mode_sql("annulation", "CAST(annulation AS VARCHAR)"), _mode_sql("houle_max", "CAST(houle_max AS VARCHAR)")]))
)
def column_modes(spark: SparkSession, sf: str) -> DataFrame:
    return profile.modes(adapted(spark, sf, "crossings"), ["vent", "mer", "ciel", "annulation", "houle_max"])


# --- correlation ------------------------------------------------------------


def _corr_sql(a: str, b: str) -> str:
    return f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END"


def _pairs_sql(cols: list[str], view: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS var_a, '{b}' AS var_b, {_corr_sql(a, b)} AS corr FROM {view}" for a, b in combinations(cols, 2))


_W6 = ["wave_height_max", "wave_period_max", "swell_wave_height_max", "temperature_max", "wind_speed_max", "wind_direction_dominant"]


@query(
    with_views(
        ["weather"],
        f""", p AS ({_pairs_sql(_W6, "weather")})
SELECT var_a, var_b, round(corr, 6) + 0.0 AS corr FROM p UNION ALL SELECT var_b, var_a, round(corr, 6) + 0.0 FROM p
UNION ALL """
        + " UNION ALL ".join(f"SELECT '{c}', '{c}', CASE WHEN stddev_pop({c}) > 0 THEN 1.0::DOUBLE END FROM weather" for c in _W6),
    )
)
def corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return r6(corr.corr_matrix(adapted(spark, sf, "weather"), _W6)).withColumn("corr", F.col("corr") + F.lit(0.0))


_FEATURES = """SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_quantity * 2 + l_linenumber AS q_twice, l_quantity + l_tax * 200 AS q_tax,
  CAST(l_linenumber AS DOUBLE) AS line, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned FROM {lineitem}"""
_FCOLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "q_twice", "q_tax", "line"]
_FVIEW = f"WITH f AS ({_FEATURES.format(lineitem='lineitem')}), p AS ({_pairs_sql(_FCOLS, 'f')})"
_TVIEW = _FVIEW + ", t AS (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, {_corr_sql(c, 'returned')} AS corr FROM f" for c in _FCOLS) + ")"


def feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_FEATURES, lineitem=table(spark, sf, "lineitem"))


@query(_FVIEW + " SELECT var_a, var_b, round(abs(corr), 6) AS corr FROM p WHERE abs(corr) > 0.5")
def collinear_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return r6(corr.collinear_pairs(feature_rows(spark, sf), _FCOLS, 0.5))


@query(_TVIEW + " SELECT variable, round(corr, 6) + 0.0 AS corr FROM t")
def target_corr(spark: SparkSession, sf: str) -> DataFrame:
    return r6(corr.target_corr(feature_rows(spark, sf), "returned")).withColumn("corr", F.col("corr") + F.lit(0.0))


@query(_TVIEW + " SELECT variable, round(abs(corr), 6) AS corr FROM t ORDER BY abs(corr) DESC, variable LIMIT 3")
def target_corr_top(spark: SparkSession, sf: str) -> DataFrame:
    return r6(corr.target_corr_top(feature_rows(spark, sf), "returned", n=3))


@query(
    _TVIEW
    + """, top AS (SELECT variable FROM t ORDER BY abs(corr) DESC, variable LIMIT 3), names AS (SELECT variable FROM top UNION ALL SELECT 'returned'),
every AS (SELECT var_a, var_b, corr FROM p UNION ALL SELECT var_b, var_a, corr FROM p UNION ALL SELECT variable, 'returned', corr FROM t
  UNION ALL SELECT 'returned', variable, corr FROM t UNION ALL SELECT variable, variable, 1.0::DOUBLE FROM names)
SELECT var_a, var_b, round(corr, 6) + 0.0 AS corr FROM every WHERE var_a IN (SELECT variable FROM names) AND var_b IN (SELECT variable FROM names)"""
)
def top_sub_matrix(spark: SparkSession, sf: str) -> DataFrame:
    out = corr.top_sub_matrix(feature_rows(spark, sf), "returned", _FCOLS, 3)
    return r6(out).withColumn("corr", F.col("corr") + F.lit(0.0))


@query(
    _TVIEW
    + """, j AS (SELECT CASE WHEN abs(a.corr) > abs(b.corr) THEN p.var_b ELSE p.var_a END AS variable
  FROM p JOIN t a ON a.variable = p.var_a JOIN t b ON b.variable = p.var_b WHERE abs(p.corr) > 0.9)
SELECT variable, round(abs(corr), 6) AS strength, variable IN (SELECT variable FROM j) AS dropped FROM t"""
)
def feature_prune(spark: SparkSession, sf: str) -> DataFrame:
    return r6(corr.prune_plan(feature_rows(spark, sf), "returned", 0.9))


_RANKS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "WITH f AS (SELECT "
    + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _RANKS)
    + f" FROM lineitem), p AS ({_pairs_sql(_RANKS, 'f')}) SELECT var_a, var_b, round(corr, 6) + 0.0 AS corr FROM p"
)
def corr_spearman(spark: SparkSession, sf: str) -> DataFrame:
    out = corr.corr_pairs(table(spark, sf, "lineitem"), _RANKS, "spearman")
    return r6(out).withColumn("corr", F.col("corr") + F.lit(0.0))


@query(
    with_views(
        ["crossings"],
        """, m AS (SELECT DISTINCT ciel AS modality FROM crossings)
SELECT modality, round(corr(CASE WHEN ciel IS NOT DISTINCT FROM modality THEN 1 ELSE 0 END, annulation), 6) + 0.0 AS corr FROM m, crossings GROUP BY modality""",
    )
)
def modality_corr(spark: SparkSession, sf: str) -> DataFrame:
    out = corr.modality_corr(adapted(spark, sf, "crossings"), "ciel", "annulation")
    return r6(out).withColumn("corr", F.col("corr") + F.lit(0.0))


@query(
    with_views(
        ["weather"],
        """SELECT 'swell_wave_height_max' AS variable, swell_wave_height_max AS x, round(ln(1 + wave_height_max), 6) AS y FROM weather WHERE swell_wave_height_max IS NOT NULL
UNION ALL SELECT 'wind_speed_max', wind_speed_max, round(ln(1 + wave_height_max), 6) FROM weather WHERE wind_speed_max IS NOT NULL""",
    )
)
def scatter_points(spark: SparkSession, sf: str) -> DataFrame:
    out = corr.scatter_points(adapted(spark, sf, "weather"), "wave_height_max", ["swell_wave_height_max", "wind_speed_max"], True)
    return r6(out, "y")


# --- imputation and text ----------------------------------------------------


@query(
    with_views(
        ["crossings"],
        """SELECT crossing_id, coalesce(temperature, (SELECT quantile_cont(temperature, 0.5) FROM crossings)) AS temperature,
  coalesce(houle_periode, (SELECT quantile_cont(houle_periode, 0.5) FROM crossings)) AS houle_periode FROM crossings""",
    )
)
def impute_median(spark: SparkSession, sf: str) -> DataFrame:
    df = adapted(spark, sf, "crossings").select("crossing_id", "temperature", "houle_periode")
    return impute.impute_numeric(df, ["temperature", "houle_periode"])


@query(
    with_views(
        ["crossings"],
        """SELECT crossing_id, round(coalesce(temperature, (SELECT avg(temperature) FROM crossings)), 6) AS temperature,
  coalesce(houle_periode, 0.0) AS houle_periode, coalesce(mer, 'missing') AS mer FROM crossings""",
    )
)
def impute_mean_zero_text(spark: SparkSession, sf: str) -> DataFrame:
    df = adapted(spark, sf, "crossings").select("crossing_id", "temperature", "houle_periode", "mer")
    df = impute.impute_numeric(impute.impute_numeric(df, ["temperature"], "mean"), ["houle_periode"], "zero")
    return r6(impute.impute_categorical(df, ["mer"]), "temperature")


@query(
    with_views(
        ["crossings"],
        """SELECT crossing_id, coalesce(ciel, (SELECT ciel FROM crossings WHERE ciel IS NOT NULL GROUP BY ciel ORDER BY count(*) DESC, ciel LIMIT 1)) AS ciel FROM crossings""",
    )
)
def impute_mode(spark: SparkSession, sf: str) -> DataFrame:
    return impute.impute_mode(adapted(spark, sf, "crossings").select("crossing_id", "ciel"), ["ciel"])


_CLEAN_CONFIG = {
    "drop_na_threshold": 0.40, "binary_cols": ["flag"], "floor_col": "floor", "floor_replace": {"bajo": 0},
    "numeric_median_cols": ["temperature"], "rent_col": "rent", "rent_invalid_below": 5,
}
_HOUSES = """SELECT crossing_id, jour, CASE WHEN crossing_id % 5 > 1 THEN NULL ELSE 1 END AS hollow, CASE WHEN crossing_id % 7 = 0 THEN NULL ELSE annulation END AS flag,
  CASE crossing_id % 6 WHEN 0 THEN 'bajo' WHEN 1 THEN 'x' WHEN 2 THEN NULL ELSE CAST(crossing_id % 9 AS STRING) END AS floor, temperature, vent_noeud AS rent FROM {crossings}"""


@query(
    with_views(
        ["crossings"],
        f""", h AS ({_HOUSES.format(crossings="crossings")}), c AS (SELECT crossing_id, jour, flag, TRY_CAST(CASE WHEN floor = 'bajo' THEN '0' ELSE floor END AS DOUBLE) AS floor,
  temperature, CASE WHEN rent >= 5 THEN rent END AS rent FROM h), tr AS (SELECT * FROM c WHERE jour < DATE '1999-01-01')
SELECT crossing_id, coalesce(flag, (SELECT flag FROM tr WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) AS flag,
  coalesce(floor, (SELECT quantile_cont(floor, 0.5) FROM tr)) AS floor, coalesce(temperature, (SELECT quantile_cont(temperature, 0.5) FROM tr)) AS temperature,
  coalesce(rent, (SELECT quantile_cont(rent, 0.5) FROM tr)) AS rent FROM c""",
    )
)
def clean_fit_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics learned on the years before 1999, applied to every row."""
    rows = spark.sql(_HOUSES, crossings=adapted(spark, sf, "crossings"))
    _, stats = impute.clean_data(rows.where("jour < DATE '1999-01-01'"), _CLEAN_CONFIG)
    return impute.clean_data(rows, _CLEAN_CONFIG, stats)[0].drop("jour")


@query("SELECT doc_id, CASE WHEN lower(text) IN ('true', 'false') THEN text ELSE strip_accents(lower(text)) END AS text FROM documents")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return text.normalize_text_columns(table(spark, sf, "documents").select("doc_id", "text"))


@query("SELECT doc_id, CASE WHEN lower(text) IN ('true', 'false') THEN text ELSE strip_accents(lower(text)) END AS text FROM documents")
def normalize_text_full(spark: SparkSession, sf: str) -> DataFrame:
    return text.normalize_text_columns(table(spark, sf, "documents").select("doc_id", "text"), full=True)


_MIXED = """SELECT CASE l_linenumber WHEN 1 THEN '1d' WHEN 2 THEN '1_0' WHEN 3 THEN CAST(l_orderkey AS STRING) WHEN 4 THEN ' 12.5 ' WHEN 5 THEN '-1e3'
  WHEN 6 THEN NULL ELSE l_returnflag END AS value FROM {lineitem}"""


@query(f"SELECT value FROM ({_MIXED.format(lineitem='lineitem')}) WHERE value IN ('1d', '1_0') OR value IN (SELECT l_returnflag FROM lineitem)")
def non_numeric_rows(spark: SparkSession, sf: str) -> DataFrame:
    return text.non_numeric_rows(spark.sql(_MIXED, lineitem=table(spark, sf, "lineitem")), "value")


@query(
    """SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'ring') THEN 'metal' WHEN regexp_matches(p_name, 'small') THEN 'petit' WHEN regexp_matches(p_name, 'b') THEN 'b' END AS type FROM part"""
)
def keyword_type(spark: SparkSession, sf: str) -> DataFrame:
    out = text.keyword_type(table(spark, sf, "part"), "p_name", {"ring": "metal", "small": "petit", "b": "b"})
    return out.select("p_partkey", "type")


@query("SELECT doc_id, CAST(quality AS TINYINT) AS quality, lower(lang) AS lang FROM (SELECT l.doc_id, quality, lang FROM labels l JOIN documents d ON d.doc_id = l.doc_id)")
def lower_and_byte(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    out = text.lower_columns(text.bool_to_byte(df, ["quality"]), ["lang", "absent", "doc_id"])
    return out.select("doc_id", "quality", "lang")


# --- encoders and scalers ---------------------------------------------------

_CIEL = ["Brume", "Clair", "Couvert", "Ensoleillé"]
_LIGNE = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _onehot_sql(col: str, values: list[str]) -> str:
    return ", ".join(f"CASE WHEN {col} = '{v}' THEN 1 ELSE 0 END AS \"{col}_{v}\"" for v in values)


@query(
    with_views(
        ["crossings"],
        f"SELECT crossing_id, {_onehot_sql('ligne', _LIGNE[1:])}, {_onehot_sql('ciel', _CIEL[1:])}, CASE WHEN ciel IS NULL THEN 1 ELSE 0 END AS ciel_nan FROM crossings",
    )
)
def one_hot_drop_first(spark: SparkSession, sf: str) -> DataFrame:
    df = adapted(spark, sf, "crossings").select("crossing_id", "ligne", "ciel")
    return encode.one_hot(df, encode.fit_vocabulary(df, ["ligne", "ciel"]))


@query(with_views(["crossings"], f"SELECT crossing_id, {_onehot_sql('ligne', _LIGNE[1:])}, {_onehot_sql('ciel', _CIEL[1:])} FROM crossings"))
def dummies_drop_first(spark: SparkSession, sf: str) -> DataFrame:
    return encode.dummies(adapted(spark, sf, "crossings").select("crossing_id", "ligne", "ciel"))


_SCALED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _scaled_sql(center: str, width: str) -> str:
    cols = ", ".join(f"round((l.{c} - s.{c}_c) / s.{c}_w, 6) + 0.0 AS {c}" for c in _SCALED)
    stats = ", ".join(f"{center.format(c=c)} AS {c}_c, {width.format(c=c)} AS {c}_w" for c in _SCALED)
    return f"WITH s AS (SELECT {stats} FROM lineitem) SELECT l_orderkey, l_linenumber, {cols} FROM lineitem l, s"


def _scaled(df: DataFrame) -> DataFrame:
    return r6(df, *_SCALED).withColumns({c: F.col(c) + F.lit(0.0) for c in _SCALED})


@query(_scaled_sql("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def robust_scale(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_SCALED)
    return _scaled(encode.scale(df, encode.fit_robust(df, _SCALED)))


@query(_scaled_sql("avg({c})", "stddev_pop({c})"))
def standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_SCALED)
    return _scaled(encode.scale(df, encode.fit_standard(df, _SCALED)))


@query(
    f"""WITH s AS (SELECT quantile_cont(l_quantity, 0.5) AS c, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS w FROM lineitem)
SELECT round((l_quantity - c) / w, 6) + 0.0 AS l_quantity, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS "l_returnflag_N",
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS "l_returnflag_R" FROM lineitem, s"""
)
def column_transformer(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select("l_quantity", "l_returnflag")
    return r6(encode.apply_preprocess(df, encode.fit_preprocess(df)), "l_quantity").withColumn("l_quantity", F.col("l_quantity") + F.lit(0.0))


@query(
    """SELECT o_orderkey, CAST(r - 1 AS INTEGER) AS code FROM orders JOIN (SELECT o_orderpriority AS p, dense_rank() OVER (ORDER BY o_orderpriority) AS r
FROM orders GROUP BY 1) ON p = o_orderpriority"""
)
def label_encode(spark: SparkSession, sf: str) -> DataFrame:
    return encode.label_encode(table(spark, sf, "orders"), "o_orderpriority", "code").select("o_orderkey", "code")


_MATRIX = f"""SELECT crossing_id, annulation, vent_noeud, houle_dominante, houle_max, houle_periode,
  CAST(CASE mer WHEN 'ridée' THEN 0 WHEN 'belle' THEN 1 WHEN 'peu agitée' THEN 2 WHEN 'agitée' THEN 3 WHEN 'forte' THEN 4 ELSE -1 END AS TINYINT) AS mer,
  temperature, CASE WHEN vent IN ('W', 'WNW', 'NW', 'NNW', 'N') THEN 1 ELSE 0 END AS vent_mistral,
  CASE WHEN houle >= 270 OR houle = 0 THEN 1 ELSE 0 END AS houle_mistral, {_onehot_sql('ligne', _LIGNE[1:])}"""


@query(with_views(["crossings"], f"{_MATRIX}, {_onehot_sql('ciel', _CIEL[1:])}, CASE WHEN ciel IS NULL THEN 1 ELSE 0 END AS ciel_nan FROM crossings"))
def model_matrix(spark: SparkSession, sf: str) -> DataFrame:
    df = adapted(spark, sf, "crossings").drop("horaire", "jour")
    return encode.model_matrix(encode.preprocess_crossings(df), keys=["crossing_id"])


@query(with_views(["crossings"], f"{_MATRIX} FROM crossings"))
def model_matrix_reduced(spark: SparkSession, sf: str) -> DataFrame:
    return encode.model_tables(adapted(spark, sf, "crossings").drop("horaire", "jour"))["reduced"]


# --- splits and samples -----------------------------------------------------


def _hash_sql(key: str) -> str:
    return f"md5(CAST({key} AS VARCHAR) || '|42')"


@query(
    f"""SELECT o_orderkey, CASE WHEN r <= CAST(floor(n * 0.7) AS BIGINT) THEN 'train' WHEN r <= CAST(floor(n * 0.7) AS BIGINT) + CAST(floor(n * 0.15) AS BIGINT) THEN 'val' ELSE 'test' END AS split
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {_hash_sql("o_orderkey")}) AS r, count(*) OVER () AS n FROM orders)"""
)
def split_exact(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_exact(table(spark, sf, "orders"), ["o_orderkey"]).select("o_orderkey", "split")


@query(
    with_views(
        ["weather"],
        """SELECT jour, CASE WHEN r <= CAST(floor(n * 0.7) AS BIGINT) THEN 'train' WHEN r <= CAST(floor(n * 0.7) AS BIGINT) + CAST(floor(n * 0.15) AS BIGINT) THEN 'val' ELSE 'test' END AS split
FROM (SELECT jour, row_number() OVER (ORDER BY jour) AS r, count(*) OVER () AS n FROM weather)""",
    )
)
def split_time(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_exact(adapted(spark, sf, "weather").select("jour"), ["jour"], mode="time")


_STRATA = f""", r AS (SELECT crossing_id, annulation, row_number() OVER (PARTITION BY annulation ORDER BY {_hash_sql("crossing_id")}) AS r FROM crossings),
k AS (SELECT annulation, count(*) AS c, sum(count(*)) OVER () AS n FROM crossings GROUP BY annulation)"""


@query(
    with_views(
        ["crossings"],
        _STRATA
        + """, b AS (SELECT annulation, CAST(ceil(n * 0.2) AS BIGINT) AS total, ceil(n * 0.2) * c / n AS x FROM k),
f AS (SELECT *, floor(x) AS lo, row_number() OVER (ORDER BY x - floor(x) DESC, annulation) AS o, sum(floor(x)) OVER () AS used FROM b),
q AS (SELECT annulation, lo + CASE WHEN o <= total - used THEN 1 ELSE 0 END AS share FROM f)
SELECT crossing_id, r.annulation, CASE WHEN r.r <= share THEN 'test' ELSE 'train' END AS split FROM r JOIN q ON q.annulation = r.annulation""",
    )
)
def split_stratified(spark: SparkSession, sf: str) -> DataFrame:
    out = split.split_stratified(adapted(spark, sf, "crossings"), "annulation", ["crossing_id"])
    return out.select("crossing_id", "annulation", "split")


@query(
    with_views(
        ["crossings"],
        _STRATA
        + """SELECT crossing_id, CASE WHEN r.r <= c * 1 // 5 THEN 0 WHEN r.r <= c * 2 // 5 THEN 1 WHEN r.r <= c * 3 // 5 THEN 2 WHEN r.r <= c * 4 // 5 THEN 3 ELSE 4 END AS fold
FROM r JOIN k ON k.annulation = r.annulation""",
    )
)
def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    out = split.stratified_folds(adapted(spark, sf, "crossings"), "annulation", ["crossing_id"], 5)
    return out.select("crossing_id", "fold")


@query(f"SELECT o_orderkey FROM orders ORDER BY {_hash_sql('o_orderkey')} LIMIT 10000")
def sample_exact(spark: SparkSession, sf: str) -> DataFrame:
    return split.sample_exact(table(spark, sf, "orders"), ["o_orderkey"], 10_000).select("o_orderkey")


@query(
    with_views(
        ["crossings"],
        """SELECT crossing_id, round(n / (2.0 * c), 6) AS weight FROM (SELECT crossing_id, count(*) OVER () AS n, count(*) OVER (PARTITION BY annulation) AS c FROM crossings)""",
    )
)
def balanced_weights(spark: SparkSession, sf: str) -> DataFrame:
    return r6(split.balanced_weights(adapted(spark, sf, "crossings"), "annulation").select("crossing_id", "weight"))
