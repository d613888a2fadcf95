"""Work whose parts once grew on the driver, or were done again and again."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from seacast.operators import encode
from seacast.plans import queries_wide
from seacast.sources import landing


def test_vectors_hold_no_names_of_places(spark):
    df = spark.range(3000).select("id", (F.col("id") % 4).cast("double").alias("a"), F.concat(F.lit("k"), "id").alias("capitaine"))
    layout = encode.sparse_layout(df, drop=["id"])
    made = layout.vectors(df)
    assert layout.width == 3000 and len(made.schema.json()) < 1000  # a name for each place would be part of the driver's schema
    assert made.schema["features"].metadata == {"ml_attr": {"num_attrs": 3000}}
    got = {r.id: r.features for r in made.where("id % 500 = 3").collect()}
    order = {f"k{i}": at for at, i in enumerate(sorted(range(3000), key=str))}
    assert all(v.size == 3000 and list(v.indices) == [0, order[f"k{i}"]] and list(v.values) == [i % 4, 1.0] for i, v in got.items())


def test_vectors_are_those_of_the_library(spark):
    rows = [(i, None if i % 5 == 0 else i / 7, math.inf if i % 7 == 0 else -0.0, None if i % 8 == 0 else f"l{i % 4}", f"s{i // 3 % 3}") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, `a.b` double, c double, ligne string, ciel string")
    layout = encode.sparse_layout(df, drop=["id"])
    cells = {r.id: {e.place: e.value for e in r.entries} for r in layout.entries(df).collect()}
    plain = spark.createDataFrame([(i, *(cells[i].get(at, 0.0) for at in range(layout.width))) for i in cells], ["id", *(f"c{at}" for at in range(layout.width))])
    want = {r.id: r.v for r in VectorAssembler(inputCols=plain.columns[1:], outputCol="v").transform(plain).collect()}
    got = {r.id: r.features for r in layout.vectors(df).collect()}
    assert got == want and {i: type(v) for i, v in got.items()} == {i: type(v) for i, v in want.items()} and len({type(v) for v in got.values()}) == 2


def test_a_log_is_parsed_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries_wide, "LOG_ROWS", 40)
    lines = [(k, n, 20 * k, 7 * n, "R" if k % 3 else "A", 5) for k in range(100) for n in (1, 2, 7)]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_quantity int"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = queries_wide.landed_records(spark, str(tmp_path))
    assert "Scan text" not in out._jdf.queryExecution().executedPlan().toString()  # each of the two parts read and parsed the log anew, twice
    got = [(r.ligne, r.annulation, r.rejected) for r in out.collect()]
    want = [(None, None, f"cut off {k}-7") if n == 7 else (f"{k}-{n}", "panne" if k % 3 else None, None) for k, n, *_ in lines]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert out.where("meteo LIKE '%\n\"Mer\" : %' ESCAPE '!'").count() == sum(n != 7 and 20 * k % 19 != 0 for k, n, *_ in lines)


def test_the_log_has_a_header_in_each_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries_wide, "LOG_ROWS", 1)
    for rows in ([], [(k, 1, 5, 3, "R", 5) for k in range(40)]):
        root = f"{tmp_path}/{len(rows)}"
        spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_quantity int").write.parquet(f"{root}/lineitem.parquet")
        queries_wide._land_log(spark, root, f"{root}/log")
        texts = [r.value for f in "ab" for r in spark.read.text(f"{root}/log/{f}", wholetext=True).collect()]
        assert len(texts) == 2 * max(5, len(rows)) and all(t.startswith(("Météo,Ligne,", "more,Ligne,")) for t in texts)
        assert queries_wide.landed_records(spark, root).count() == len(rows)


@pytest.mark.parametrize("odd", [False, True])
def test_records_by_bytes_are_those_by_lines(monkeypatch, odd):
    rng = random.Random(7)

    def cell():
        return "".join(rng.choices(["a", "é", " ", "k", "", 'x"', "\\"] if odd and rng.random() < 0.1 else ["a", "bc", "é", " ", "k", ""], k=rng.randrange(4)))

    def quoted():
        return '"' + "".join(rng.choices(["a", ",", "\n", '""', "\r\n", " "], k=rng.randrange(5))) + '"' + rng.choice(["", "", "z"])

    monkeypatch.setattr(landing, "PART_BYTES", 90 if odd else 4_000_000)
    regular = landing.Cut.__init__

    def by_lines(self, value, opened):
        regular(self, value, opened)
        self.regular = False

    for seed in range(60):
        texts = [",".join(rng.choice([cell, quoted])() for _ in range(rng.choice([3, 3, 3, 2]))) for _ in range(40)] + ["", "  ", "v,k, u", "\r"]
        rng.shuffle(texts)
        lines = rng.choice(["\n", "\r\n"]).join(texts).split("\n")
        cuts = sorted(rng.sample(range(len(lines)), 5))
        batches = [pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.repeat("f", len(part)), pa.repeat(0, len(part)), pa.array(range(at, at + len(part)), pa.int64())], ["value", "_file", "_block", "_row"])
                   for at, part in ((a, lines[a:b]) for a, b in zip([0, *cuts], [*cuts, len(lines)]))]
        inside = {"f": ([-1], [True])} if seed % 3 == 0 else {}
        found = []
        for init in (regular, by_lines):
            monkeypatch.setattr(landing.Cut, "__init__", init)
            made = landing.Records(["k", "u", "none"], "k", (inside, {"f": "v,k,u"} if seed % 5 else {}), seed % 2 == 0)(batches)
            found.append(sorted((r for b in made for r in b.to_pylist()), key=lambda r: (r["_row"], r["_number"])))
        assert found[0] == found[1] and len(found[0]) > 3
