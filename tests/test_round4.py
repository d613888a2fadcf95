"""Work that must not gather in one task, and sparse, rank and text operators in bounded parts."""

import hashlib
import random
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from seacast.functions import text
from seacast.models.sparsetree import SparseTree
from seacast.operators import corr, ranks, split
from seacast.plans import queries_wide
from seacast.sources import landing


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_few_classes_are_not_shuffled(spark):
    df = spark.range(400).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    for made in (split.split_stratified(df, "y", ["id"]), split.stratified_folds(df, "y", ["id"], 5), split.balanced_weights(df, "y")):
        assert "hashpartitioning" not in plan_of(made)
        assert made.count() == 400


@pytest.mark.parametrize("held", [1, 12])
def test_rows_of_many_classes(spark, monkeypatch, held):
    monkeypatch.setattr(split, "HELD_CUTS", held)  # the cuts of large classes alone are held
    rows = [(i, None if i % 50 == 0 else 0 if i % 2 else i % 40) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, c int")
    known = [(i, c) for i, c in rows if c is not None]
    sizes = Counter(c for _, c in known)
    weights = {(r.id, r.c): r.weight for r in split.balanced_weights(df, "c").collect()}
    assert weights == {(i, c): None if c is None else pytest.approx(len(known) / (len(sizes) * sizes[c])) for i, c in rows}
    text = {i: hashlib.md5(f"{i}|42".encode()).hexdigest() for i, _ in rows}
    place = {c: sorted(text[i] for i, k in known if k == c) for c in sizes}
    folds = split.stratified_folds(df.where("c IS NOT NULL"), "c", ["id"], 4).collect()
    assert {(r.id, r.c, r.fold) for r in folds} == {(i, c, sum(place[c].index(text[i]) >= sizes[c] * f // 4 for f in (1, 2, 3))) for i, c in known}
    assert split.split_stratified(df.where("c IS NOT NULL"), "c", ["id"]).where("split = 'test'").count() == -(-len(known) // 5)


def test_tree_over_sparse_vectors_wider_than_a_row_could_be(spark):
    width = 1 << 30  # a cell for each place would be 4 GB a row
    rows = [(i, int(i % 7 < 3 or i % 5 == 0), Vectors.sparse(width, {0: float(i % 7), 1: float(i % 3), 2 + i % 5: 1.0, 100 + i: 1.0})) for i in range(210)]
    df = spark.createDataFrame(rows, ["id", "y", "features"]).repartition(3)
    model = SparseTree("y", numeric=2, depth=3).fit(df)
    assert model.numFeatures == width
    # Of all first splits, the third value of i % 7 takes most of the impurity; i % 5 tells the rest.
    assert model.splits[1] == (0, 2.5) and model.splits[3] == (2, 0.5) and 2 not in model.splits
    got = {r.id: r.prediction for r in model.transform(df).collect()}
    assert got == {i: float(y) for i, y, _ in rows}


def test_tree_agrees_with_the_library(spark):
    rng = random.Random(5)
    rows = [(i, Vectors.dense(rng.randrange(40) / 4, rng.random(), float(rng.random() < 0.3), float(rng.random() < 0.5))) for i in range(600)]
    df = spark.createDataFrame([(i, int(v[0] > 4) ^ int(v[2] > 0) if rng.random() < 0.9 else rng.randrange(3), v) for i, v in rows], ["id", "y", "features"])
    mine = SparseTree("y", numeric=2, depth=4, bins=64).fit(df)
    theirs = DecisionTreeClassifier(labelCol="y", maxDepth=4, maxBins=64, seed=1).fit(df)
    right = [m.transform(df).where("prediction = y").count() for m in (mine, theirs)]
    assert abs(right[0] - right[1]) <= 12 and right[0] > 450


def test_tree_without_splits(spark):
    same = spark.createDataFrame([(i, 1, Vectors.sparse(9, {4: 1.0})) for i in range(6)], ["id", "y", "features"])
    assert {r.prediction for r in SparseTree("y", numeric=2).fit(same).transform(same).collect()} == {1.0}
    with pytest.raises(ValueError):
        SparseTree("y", numeric=2).fit(same.withColumn("y", F.lit(None).cast("int")))


def test_ranks_over_many_small_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RANGE_ROWS", 60)
    rng = np.random.default_rng(4)
    data = pd.DataFrame({c: np.where(rng.random(500) < 0.4, 3.0, rng.integers(-4, 40, 500) / 2) for c in "abc"})
    data.loc[rng.random(500) < 0.2, "b"] = np.nan
    df = spark.createDataFrame(data.astype(object).where(data.notna(), None), "a double, b double, c double").repartition(4)
    assert ranks.parts_of(1400) == 24
    rows, names, *_ = ranks.pair_ranks(df, list("abc"))
    known = {"k": slice(None), "k1": data.b.notna()}
    for i, c in enumerate("abc"):
        for f, which in known.items():
            want = data[which][c].rank().dropna()
            both = rows.where(F.col("r1_k").isNotNull()) if f == "k1" else rows
            assert sorted(r[0] for r in both.select(f"r{i}_{f}").where(f"r{i}_{f} IS NOT NULL").collect()) == sorted(want)
    found = {(r.var_a, r.var_b): r["corr"] for r in corr.corr_pairs(df, list("abc"), "spearman").collect()}
    for (x, y), value in found.items():
        assert value == pytest.approx(data[[x, y]].dropna().rank().corr().iloc[0, 1])


def test_marks_are_stripped_a_piece_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(text, "PIECE", 20)
    given = ["Été à la plage", None, "", "TRUE", "plain", "Ǟ" * 30, "한글 ΆΈ", "á", "x" * 50, "ñ"] * 30
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "id int, t string").coalesce(1)

    def plain(t):
        return t if t is None or t.lower() == "true" else "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not "̀" <= c <= "ͯ")

    assert [r.t for r in text.normalize_text_columns(df, full=True).orderBy("id").collect()] == [plain(t) for t in given]


def test_log_files_grow_in_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries_wide, "LOG_ROWS", 20)
    lines = [(k, n, 20 * k, 7 * n, "R" if k % 3 else "A", 5) for k in range(100) for n in (1, 2, 7)]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_quantity int"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    queries_wide._land_log(spark, str(tmp_path), f"{tmp_path}/log")
    names = spark.read.text(f"{tmp_path}/log/a").select(F.input_file_name().alias("f")).distinct().count()
    assert names > 5
    out = queries_wide.landed_records(spark, str(tmp_path))
    assert out.where("rejected IS NULL").count() == 200 and out.where("rejected LIKE 'cut off %-7'").count() == 100


def test_quoted_fields(spark):
    for line, outside, inside in (('a,b', False, True), ('a,"b', True, False), ('"a""b",c', False, False), ('"a\\"b', True, False), ('a"b,"c"d,"', True, True), ("", False, True)):
        assert (landing.open_after(line, False), landing.open_after(line, True)) == (outside, inside), line
    assert landing.cells('a,"b ""c"" \n",,"",x"y,"p\\"q"r,"open, end') == ["a", 'b "c" \n', None, "", 'x"y', 'p"qr', "open, end"]
