import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seacast.functions import text
from seacast.operators import corr, encode, impute, profile
from seacast.operators.select import downcast, downcast_plan, drop_columns


def constants(spark):
    rows = [(1, 0, None, "NA", True, "é"), (2, 1, None, "x", None, "É"), (3, 0, None, "null", False, None), (4, 1, None, "", True, "True")]
    return spark.createDataFrame(rows, "id int, flag int, hollow double, holes string, b boolean, t string").withColumn("same", F.lit("k"))


def test_profile_flags(spark):
    df = constants(spark)
    rows = {r["column"]: r for r in profile.profile_columns(df, max_modalities=3).collect()}
    flags = {f: sorted(c for c, r in rows.items() if r[f]) for f in ("is_empty", "is_constant", "is_boolean", "is_high_na", "is_missing_like", "is_high_cardinality")}
    assert flags == {
        "is_empty": ["hollow"],
        "is_constant": ["hollow", "same"],
        "is_boolean": ["b", "flag", "hollow"],
        "is_high_na": ["hollow"],
        "is_missing_like": ["b", "holes", "hollow", "t"],
        "is_high_cardinality": ["holes"],
    }
    assert profile.flagged(df, "is_constant") == ["hollow", "same"]


def test_column_with_value_and_null_is_not_constant(spark):
    df = spark.createDataFrame([("a",), (None,)], "c string")
    assert not profile.profile_columns(df).first()["is_constant"]


def test_column_kinds(spark):
    df = constants(spark)
    assert profile.numeric_columns(df) == ["id", "flag", "hollow"]
    assert profile.numeric_columns(df, with_bool=True) == ["id", "flag", "hollow", "b"]
    assert profile.column_types(df)[1] == ["holes", "b", "t", "same"]
    assert profile.string_columns(df) == ["holes", "t", "same"]


def test_fill_rates_of_empty_table(spark):
    rows = profile.fill_rates(spark.createDataFrame([], "a int")).collect()
    assert rows[0]["fill_pct"] is None and rows[0]["n_null"] == 0


def test_missing_top(spark):
    assert [r["column"] for r in profile.missing_top(constants(spark), 2).collect()] == ["hollow", "b"]


def test_describe_equals_pandas(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 2), (3.0, 3), (10.0, None)], "x double, y int")
    got = {r["column"]: r for r in profile.describe(df).collect()}
    want = df.toPandas().describe()
    for c in ("x", "y"):
        assert [got[c][f] for f in ("n", "mean", "std", "min", "q25", "q50", "q75", "max")] == pytest.approx(want[c].tolist())


def test_histogram_equals_numpy(spark):
    values = np.random.default_rng(1).normal(size=500).tolist()
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    got = {r["bin"]: r["n"] for r in profile.histograms(df, bins=40).collect()}
    want, _ = np.histogram(values, bins=40)
    assert [got.get(i, 0) for i in range(40)] == want.tolist()


def test_histogram_of_constant_column(spark):
    row = profile.histograms(spark.createDataFrame([(2.0,), (2.0,)], "x double")).first()
    assert (row["bin_low"] <= 2.0 <= row["bin_high"]) and row["n"] == 2


def test_majority_first_seen_wins(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b"), (5, None)], "i int, v string").repartition(3)
    assert profile.majority_value(df, "v", ["i"]).first()["value"] == "b"
    assert profile.majority_value(df.where("v is null"), "v", ["i"]).count() == 0


def test_modes_smallest_wins(spark):
    df = spark.createDataFrame([("b", 10.0), ("a", 9.0), ("a", 9.0), ("b", 10.0), (None, None)], "s string, x double")
    got = {r["column"]: r["mode"] for r in profile.modes(df, ["s", "x"]).collect()}
    assert got == {"s": "a", "x": "9.0"}


def test_value_counts_and_inspect(spark):
    df = spark.createDataFrame([("a", 1), (None, 0), ("a", 1)], "v string, y int")
    assert [tuple(r) for r in profile.value_counts(df, "v").collect()] == [("a", 2), (None, 1)]
    row = profile.inspect(df, "v", "y").first()
    assert (row["n_rows"], row["n_columns"], row["n_null_cells"], row["n_target_values"]) == (3, 2, 1, 2)
    assert profile.distinct_counts(df, ["v"], approximate=True).first()[0] == 1


# --- correlation ------------------------------------------------------------


def wide(spark, n=400, k=9):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(n, k))
    data[:, 1] = data[:, 0] * 3 + rng.normal(size=n) * 0.01
    data[:, 2] = 5.0
    frame = pd.DataFrame(data, columns=[f"c{i}" for i in range(k)])
    frame.loc[rng.random(n) < 0.2, "c3"] = np.nan
    frame.loc[rng.random(n) < 0.3, "c4"] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in frame.to_numpy()]
    return frame, spark.createDataFrame(rows, ", ".join(f"{c} double" for c in frame.columns)).repartition(3)


@pytest.mark.parametrize("cols", [["c0", "c1", "c2", "c3", "c4"], None])
def test_pearson_equals_pandas(spark, cols):
    frame, df = wide(spark)
    want = frame[cols or list(frame.columns)].corr()
    for r in corr.corr_matrix(df, cols).collect():
        expected = want.loc[r["var_a"], r["var_b"]]
        if np.isnan(expected):
            assert r["corr"] is None
        else:
            assert r["corr"] == pytest.approx(expected, abs=1e-9)


def test_spearman_with_nulls_equals_pandas(spark):
    frame, df = wide(spark, n=120)
    frame["c5"] = frame["c5"].round(0)
    df = df.withColumn("c5", F.round("c5", 0))
    cols = ["c0", "c3", "c4", "c5"]
    want = frame[cols].corr(method="spearman")
    for r in corr.corr_pairs(df, cols, "spearman").collect():
        assert r["corr"] == pytest.approx(want.loc[r["var_a"], r["var_b"]], abs=1e-9)
    with pytest.raises(ValueError):
        corr.corr_pairs(df, cols, "other")


def plain_kendall(frame):
    """tau-b by counting all pairs of rows that know both columns."""
    out = pd.DataFrame(1.0, frame.columns, frame.columns)
    for a in frame.columns:
        for b in frame.columns:
            x, y = frame[[a, b]].dropna().to_numpy().T
            p, q = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
            wide = np.sqrt((p * p).sum()) * np.sqrt((q * q).sum())
            out.loc[a, b] = (p * q).sum() / wide if wide else np.nan
    return out


def test_kendall_with_nulls_equals_counting(spark):
    rng = np.random.default_rng(6)
    n = 260
    frame = pd.DataFrame({"a": rng.normal(size=n).round(1), "b": rng.integers(0, 4, n).astype(float), "c": np.where(rng.random(n) < 0.4, 0.0, rng.normal(size=n)), "d": 1.0})
    frame["a"] = frame["a"].where(rng.random(n) > 0.1)
    frame["b"] += frame["c"].round(0)
    df = spark.createDataFrame(frame.replace({np.nan: None})).repartition(7)
    want = plain_kendall(frame)
    for r in corr.corr_pairs(df, list("abcd"), "kendall").collect():
        expected = want.loc[r["var_a"], r["var_b"]]
        assert r["corr"] is None if np.isnan(expected) else r["corr"] == pytest.approx(expected, abs=1e-9)
    # more ranges than points of a value: equal values lie in several ranges
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for method in ("kendall", "spearman"):
            want = plain_kendall(frame) if method == "kendall" else frame.corr(method=method)
            for r in corr.corr_pairs(df, list("abc"), method).collect():
                assert r["corr"] == pytest.approx(want.loc[r["var_a"], r["var_b"]], abs=1e-9)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    none = corr.corr_pairs(df.limit(0), ["a", "b"], "kendall").collect()
    assert [(r.var_a, r.var_b, r["corr"]) for r in none] == [("a", "b", None)]


def test_spearman_does_not_join_on_values(spark):
    _, df = wide(spark, n=60)
    plan = corr.corr_pairs(df, ["c0", "c3", "c4"], "spearman")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "_range" not in line and "_row" not in line]


def test_high_cardinality_counts_no_further(spark):
    df = spark.range(5000).select(F.concat(F.lit("v"), F.col("id") % 400).alias("many"), (F.col("id") % 3).cast("string").alias("few"), F.lit(None).cast("string").alias("none"), "id")
    got = {r["column"]: (r.n_seen, r.is_high_cardinality) for r in profile.high_cardinality(df.repartition(6), 20).collect()}
    assert got == {"many": (21, True), "few": (3, False), "none": (0, False)}
    assert profile.flagged(df, "is_high_cardinality") == ["many"] and profile.flagged(df, "is_high_cardinality", max_modalities=2) == ["many", "few"]
    assert profile.high_cardinality(df.select("id")).count() == 0


def test_nan_target_counts_as_null(spark):
    rows = [("a", 1.0), ("a", 0.0), ("b", 1.0), ("b", 1.0), ("c", 0.0)]
    want = {r.modality: r["corr"] for r in corr.modality_corr(spark.createDataFrame(rows, "m string, y double"), "m", "y").collect()}
    got = {r.modality: r["corr"] for r in corr.modality_corr(spark.createDataFrame([*rows, ("a", float("nan"))], "m string, y double"), "m", "y").collect()}
    assert got == pytest.approx(want) and None not in want.values()


def test_sparse_rows_equal_dense_ones(spark):
    rows = [(i, float(i % 5), None if i % 7 == 0 else float(i), f"c{i % 11}" if i % 4 else None, f"k{i}", "same") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, b double, ligne string, capitaine string, ciel string").repartition(3)
    layout = encode.sparse_layout(df, drop=["id"])
    names = {r.place: r["name"] for r in layout.names().collect()}
    assert layout.width == 2 + 11 + 59 + 0 and sorted(names) == list(range(layout.width))
    dense = encode.one_hot(df, encode.fit_vocabulary(df, ["ligne", "ciel", "capitaine"])).drop("id").columns
    assert sorted(names.values()) == sorted(dense)
    unknown = spark.createDataFrame([(99, 0.0, float("nan"), "new", None, "same")], df.schema)
    table = df.unionByName(unknown)
    entries = {r.id: {names[e.place]: e.value for e in r.entries} for r in layout.entries(table).collect()}
    vectors = {r.id: {names[i]: x for i, x in enumerate(r.features.toArray()) if x} for r in layout.vectors(table).collect()}
    assert entries == vectors and entries[99] == {}
    for i, a, b, ligne, captain, _ in rows:
        want = {"a": a, "b": b, f"ligne_{'nan' if ligne is None else ligne}": 1.0, f"capitaine_{captain}": 1.0}
        want = {k: v for k, v in want.items() if v and k in names.values()}  # the first categories have no place
        assert entries[i] == want


def test_target_corr_of_many_columns(spark):
    frame, df = wide(spark, k=14)
    want = frame.corr()["c13"]
    for r in corr.target_corr(df, "c13").collect():
        if r["corr"] is not None:
            assert r["corr"] == pytest.approx(want[r["variable"]], abs=1e-9)


def test_prune_drops_already_dropped_competitors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=2000)
    frame = pd.DataFrame({"a": base, "b": base + rng.normal(size=2000) * 0.3, "c": base + rng.normal(size=2000) * 0.3})
    frame["c"] = frame["b"] + rng.normal(size=2000) * 0.3
    frame["y"] = base
    df = spark.createDataFrame(frame).withColumn("label", F.lit("t"))
    plan = {r["variable"]: r["dropped"] for r in corr.prune_plan(df, "y", 0.9).collect()}
    assert plan == {"a": False, "b": True, "c": True}
    assert corr.select_best_features(df, "y", 0.9).columns == ["a", "y", "label"]


def test_modality_corr_equals_indicator_corr(spark):
    frame = pd.DataFrame({"v": ["a", "b", "a", None, "c", "b"], "y": [1, 0, 1, 0, 1, 1]})
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(), "v string, y int")
    got = {r["modality"]: r["corr"] for r in corr.modality_corr(df, "v", "y").collect()}
    for v in ("a", "b", "c"):
        assert got[v] == pytest.approx((frame["v"] == v).astype(int).corr(frame["y"]))
    assert got[None] == pytest.approx(frame["v"].isna().astype(int).corr(frame["y"]))


def test_pca(spark):
    _, df = wide(spark)
    rows = corr.pca_scree(df, ["c0", "c1", "c5"]).collect()
    assert rows[-1]["cumulative"] == pytest.approx(1.0)
    loadings = corr.pca_loadings(df, ["c0", "c1", "c5"]).collect()
    assert max(loadings, key=lambda r: abs(r["loading_x"]))["loading_x"] > 0


# --- imputation -------------------------------------------------------------


def test_impute_strategies(spark):
    df = spark.createDataFrame([(1.0, 1), (None, None), (4.0, 2), (10.0, 2)], "x double, n int")
    assert impute.impute_numeric(df, ["x"]).collect()[1]["x"] == 4.0
    assert impute.impute_numeric(df, ["x"], "mean").collect()[1]["x"] == 5.0
    assert impute.impute_numeric(df, strategy="zero").collect()[1]["n"] == 0
    with pytest.raises(ValueError):
        impute.impute_numeric(df, ["x"], "max")


def test_impute_empty_column_stays_null(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert impute.impute_numeric(df).first()["x"] is None
    assert impute.impute_mode(spark.createDataFrame([(None,)], "s string"), ["s"]).first()["s"] is None


def test_clean_learns_once_and_applies(spark):
    config = {"drop_na_threshold": 0.5, "binary_cols": ["b"], "floor_col": "f", "floor_replace": {"bajo": 0}, "numeric_median_cols": ["f", "x", "absent"], "rent_col": "r", "rent_invalid_below": 0}
    schema = "b int, f string, x string, r double, e double"
    train = spark.createDataFrame([(1, "bajo", "1", 5.0, None), (1, "4", "junk", -1.0, None), (0, None, "3", 9.0, None), (None, "z", "5", None, 1.0)], schema)
    out, stats = impute.clean_data(train, config)
    assert stats == {"cols_to_drop": ["e"], "bin_modes": {"b": "1"}, "floor_median": 2.0, "num_medians": {"f": 2.0, "x": 3.0}, "rent_median": 7.0}
    assert [tuple(r) for r in out.collect()] == [(1, 0.0, 1.0, 5.0), (1, 4.0, 3.0, 7.0), (0, 2.0, 3.0, 9.0), (1, 2.0, 5.0, 7.0)]
    test = spark.createDataFrame([(None, None, None, -3.0, 2.0)], schema)
    again, same = impute.clean_data(test, config, stats)
    assert same == stats and [tuple(r) for r in again.collect()] == [(1, 2.0, 3.0, 7.0)]


# --- text -------------------------------------------------------------------


def test_normalize_text(spark):
    texts = ["ÉlÈve À Noël", "TRUE", "False", None, "Ǻ ș Ž ñ", "éa", "ø ß œ", "naïve ÇA"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")

    def reference(t):
        if t is None or t.lower() in ("true", "false"):
            return t
        return "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not 0x300 <= ord(c) <= 0x36F)

    for full in (False, True):
        got = [r["t"] for r in text.normalize_text_columns(df, full).orderBy("i").collect()]
        assert got == [reference(t) for t in texts]


def test_numbers_and_keywords(spark):
    df = spark.createDataFrame([("1d",), ("1_0",), ("12.5",), (" 7 ",), ("-1e3",), ("x",), (None,), (".5",)], "v string")
    assert sorted(r["v"] for r in text.non_numeric_rows(df, "v").collect()) == ["1_0", "1d", "x"]
    kinds = text.keyword_type(spark.createDataFrame([("casa piso",), ("casa",), ("z",), (None,)], "s string"), "s", {"piso": "P", "casa": "C"})
    assert [r["type"] for r in kinds.collect()] == ["P", "C", None, None]


def test_bool_lower(spark):
    df = spark.createDataFrame([(True, "A"), (None, None)], "b boolean, s string")
    assert [r["b"] for r in text.bool_to_byte(df, ["b"]).collect()] == [1, None]
    assert [r["b"] for r in text.bool_to_byte(df, ["b"], keep_null=False).collect()] == [1, 0]
    assert [r["s"] for r in text.lower_columns(df, ["s", "b", "zz"]).collect()] == ["a", None]


# --- encoding ---------------------------------------------------------------


def test_one_hot_null_and_unknown(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "v string")
    vocabulary = encode.fit_vocabulary(df, ["v"])
    assert vocabulary == {"v": ["a", "b", "c", None]}
    assert encode.one_hot(df, vocabulary).columns == ["v_b", "v_c", "v_nan"]
    unknown = spark.createDataFrame([("z",), (None,)], "v string")
    assert [tuple(r) for r in encode.one_hot(unknown, vocabulary).collect()] == [(0, 0, 0), (0, 0, 1)]
    assert encode.dummies(df).columns == ["v_b", "v_c"]


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (10.0, 5.0)], "x double, k double")
    robust = encode.scale(df, encode.fit_robust(df, ["x", "k"])).collect()
    assert [r["x"] for r in robust] == pytest.approx([-0.5, -1 / 6, 1 / 6, 2.5]) and robust[0]["k"] == 0.0
    standard = [r["x"] for r in encode.scale(df, encode.fit_standard(df, ["x"])).collect()]
    assert np.mean(standard) == pytest.approx(0) and np.std(standard) == pytest.approx(1)
    with pytest.raises(ValueError):
        encode.fit_preprocess(spark.createDataFrame([()], ""))


def test_crossing_matrix_columns(spark):
    rows = [(1, "A", "B1", "Clair", "Cap_01", "W", 90.0, "belle", 3.0, "x"), (0, "B", "B2", None, "Cap_02", "S", 0.0, "?", None, None)]
    df = spark.createDataFrame(rows, "annulation int, ligne string, bateau string, ciel string, capitaine string, vent string, houle double, mer string, vent_noeud double, annulation_motif string")
    tables = encode.model_tables(df)
    assert tables["processed"].columns == ["annulation", "mer", "vent_noeud", "vent_mistral", "houle_mistral", "ligne_B", "bateau_B2", "ciel_nan", "capitaine_Cap_02"]
    assert tables["reduced"].columns == ["annulation", "mer", "vent_noeud", "vent_mistral", "houle_mistral", "ligne_B"]
    first, second = tables["processed"].collect()
    assert tuple(first) == (1, 1, 3.0, 1, 0, 0, 0, 0, 0) and tuple(second) == (0, -1, None, 0, 1, 1, 1, 1, 1)


def test_label_encode(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    assert [r["k"] for r in encode.label_encode(df, "c", "k").collect()] == [1, 0, None]


# --- columns ----------------------------------------------------------------


def test_downcast(spark):
    df = spark.createDataFrame([(0, -5, 2**40, 70_000, 1.5), (65_535, 9, 0, -70_000, 2.5)], "a long, b long, c long, d long, x double")
    plan = {r["column"]: r["to_type"] for r in downcast_plan(df).collect()}
    assert plan == {"a": "int", "b": "smallint", "c": "bigint", "d": "int", "x": "float"}
    assert [t for _, t in downcast(df).dtypes] == ["int", "smallint", "bigint", "int", "float"]
    assert downcast_plan(spark.createDataFrame([(None,)], "a long")).first()["to_type"] == "bigint"


def test_drop_columns_audit(spark):
    df, audit = drop_columns(spark.range(1).withColumn("x", F.lit(1)), ["x"], ["before"])
    assert df.columns == ["id"] and audit == ["before", "x"]
    with pytest.raises(ValueError):
        drop_columns(df, ["zz"])
