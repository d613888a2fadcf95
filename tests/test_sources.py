import csv
import random

import pytest
from pyspark.sql import functions as F, types as T

from seacast.plans import lifecycles
from seacast.schemas import MEASURES, RAW_CROSSINGS, WEATHER_PAYLOAD
from seacast.session import checkpointed, scratch_path, stored
from seacast.sources import landing, tables
from seacast.sources.payload import flatten_payloads, read_payloads
from seacast.streaming.jobs import consolidate_stream


def text_file(spark, name, lines):
    """One text file in its own fresh folder."""
    path = scratch_path(spark, name)
    spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, value string").coalesce(1).select("value").write.text(path)
    return path


def daily(time, names, values):
    return {"daily": {"time": time, **dict.fromkeys(names, values)}}


MARINE = ["wave_height_max", "wave_direction_dominant", "wave_period_max", "wind_wave_height_max", "swell_wave_height_max"]
WEATHER = ["temperature_2m_max", "temperature_2m_min", "wind_speed_10m_max", "wind_gusts_10m_max", "wind_direction_10m_dominant"]


def test_payload_edges(spark):
    rows = [
        ("a", "a", daily(["d1", "d2", "d3"], MARINE, [1.0, 2.0]), daily(["d2", "d1", "d2"], WEATHER, [5.0, 6.0, 7.0])),
        ("b", "b", daily(["d9"], MARINE, [9.0]), None),
        ("c", "c", None, daily(["d7"], WEATHER, [7.0])),
        ("e", "e", daily(["d5"], MARINE, None), daily(["d5"], WEATHER, [])),
    ]
    out = flatten_payloads(spark.createDataFrame(rows, WEATHER_PAYLOAD))
    assert out.columns == ["date", *MEASURES]
    got = {r["date"]: (r["wave_height_max"], r["temperature_max"]) for r in out.collect()}
    assert got == {"d1": (1.0, 6.0), "d2": (2.0, 5.0), "d3": (None, None), "d9": (9.0, None), "d5": (None, None)}


def test_payload_needs_no_shuffle(spark):
    out = flatten_payloads(spark.createDataFrame([], WEATHER_PAYLOAD))
    assert "Exchange" not in out._jdf.queryExecution().sparkPlan().toString()


def test_landing_to_consolidated(spark):
    import json

    marine = daily(["2024-01-30", "2024-01-31", "2024-02-01"], MARINE, [1.0, 2.0, 3.0])
    late = daily(["2024-02-01", "bad"], MARINE, [30.0, 4.0])
    lines = [json.dumps({"period_start": "a", "period_end": "b", "marine_data": m, "weather_data": None}) for m in (marine, late)]
    landing = text_file(spark, "payloads", lines)
    assert read_payloads(spark, landing).count() == 2
    root = scratch_path(spark, "raw")
    manifest = {(r["year"], r["month"]): (r["first_date"], r["last_date"], r["n"]) for r in lifecycles.collect_weather(spark, landing, root).collect()}
    assert manifest == {(2024, 1): ("2024-01-30", "2024-01-31", 2), (2024, 2): ("2024-02-01", "2024-02-01", 2)}


def test_monthly_files_first_row_wins(spark, tmp_path):
    header = "date," + ",".join(MEASURES)
    rest = "," * (len(MEASURES) - 1)
    (tmp_path / "2024").mkdir()
    (tmp_path / "2024" / "meteo_2024_01_01-au-01_31.csv").write_text(f"{header}\n2024-01-01,1.0{rest}\n2024-01-02,2.0{rest}\n2024-01-01,9.0{rest}\n")
    (tmp_path / "2024" / "meteo_2024_02_01-au-02_28.csv").write_text(f"{header}\n2024-01-02,5.0{rest}\n2024-02-01,3.0{rest}\n")
    (tmp_path / "2024" / "other.csv").write_text(f"{header}\n2030-01-01,1.0{rest}\n")
    out = lifecycles.consolidate_weather(spark, str(tmp_path))
    assert sorted((str(r["date"]), r["wave_height_max"]) for r in out.collect()) == [("2024-01-01", 1.0), ("2024-01-02", 2.0), ("2024-02-01", 3.0)]
    assert dict(out.dtypes)["wave_height_max"] == "float"
    with pytest.raises(FileNotFoundError):
        tables.read_monthly(spark, text_file(spark, "none", ["x"]))


def test_monthly_sink_rules(spark):
    df = spark.createDataFrame([("2024-01-05", 1.0), ("junk", 2.0), (None, 3.0), ("2024-01-02", 4.0)], "date string, x double")
    root = scratch_path(spark, "monthly")
    tables.write_monthly(df, root, save_json=True)
    back = spark.read.csv(f"{root}/csv", header=True)
    assert sorted(r["date"] for r in back.collect()) == ["2024-01-02", "2024-01-05"]
    assert spark.read.json(f"{root}/json").count() == 2
    with pytest.raises(ValueError):
        tables.write_monthly(df.drop("date"), root)


def test_raw_log_and_na_texts(spark):
    lines = [
        "Horaire,Ligne,Annulation,Météo,Bateau,Capitaine",
        "01/02/2024 08:30,A,NA,18° Clair Vent : NW 25 Nds/6 Bft Mer : belle0.5/0.9m 270° 5s,B1,Cap_01",
        "01/02/2024 09:30,A,houle,18° Clair Vent : NW 25 Nds/6 Bft Mer : belle0.5/0.9m 270° 5s,B1,Cap_02",
    ]
    out = lifecycles.crossing_table(spark, text_file(spark, "log", lines)).orderBy("horaire").collect()
    assert [(r["annulation"], r["annulation_motif"]) for r in out] == [(0, None), (1, "houle")]


def test_indexed_csv_drops_the_index(spark):
    path = text_file(spark, "idx", [",a,b", "0,x,1", "1,y,2"])
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.IntegerType())])
    assert [tuple(r) for r in tables.read_indexed_csv(spark, path, schema).collect()] == [("x", 1), ("y", 2)]


def test_union_of_files(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3, 4)], "x int, z int")
    assert sorted(map(str, tables.union_files([a, b]).collect())) == ["Row(x=1, y=2, z=None)", "Row(x=3, y=None, z=4)"]


def test_latest_run_reads_one_partition(spark):
    path = scratch_path(spark, "runs")
    df = spark.createDataFrame([("2024-01-01", 1)], "date string, x int").withColumn("date", F.col("date").cast("date"))
    tables.write_consolidated(df, path, "2026-01-01")
    span = tables.write_consolidated(df.withColumn("x", F.lit(2)), path, "2026-01-02").first()
    assert str(span["first_date"]) == "2024-01-01"
    latest = tables.read_latest(spark, path)
    assert [r["x"] for r in latest.collect()] == [2]
    assert "run_date" in latest._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]


def landed(spark, rows, path):
    spark.createDataFrame(rows, "date string, x double, at int").coalesce(1).write.mode("append").parquet(path)


def test_stream_consolidation_is_idempotent(spark):
    source, out = scratch_path(spark, "landing"), scratch_path(spark, "daily")
    schema = "date string, x double, at int"

    def run(checkpoint):
        consolidate_stream(spark.readStream.schema(schema).parquet(source), out, checkpoint, ["at"]).awaitTermination()

    first = scratch_path(spark, "checkpoint")
    landed(spark, [("2024-01-01", 1.0, 1), ("2024-01-01", 2.0, 2), ("bad", 3.0, 3)], source)
    run(first)
    landed(spark, [("2024-01-01", 9.0, 4), ("2024-02-01", 5.0, 5)], source)
    run(first)
    run(scratch_path(spark, "checkpoint"))  # everything replayed
    got = sorted((str(r["date"]), r["x"]) for r in spark.read.parquet(out).collect())
    assert got == [("2024-01-01", 1.0), ("2024-02-01", 5.0)]


def test_stored_and_checkpointed_keep_rows(spark):
    df = spark.range(50).withColumn("y", F.col("id") * 2)
    assert stored(df).count() == checkpointed(df).count() == 50
    assert "Range" not in checkpointed(df)._jdf.queryExecution().optimizedPlan().toString()


def test_line_extracts(spark):
    df = spark.createDataFrame([("Frioul-IF", 1), ("Vieux Port-IF", 2), ("zz", 3)], "ligne string, x int")
    root = scratch_path(spark, "lines")
    got = {r["line_group"]: r["n"] for r in tables.write_line_extracts(df, root, ["Frioul_if", "VP_frioul_if", "unknown"]).collect()}
    assert got == {"Frioul_if": 1, "VP_frioul_if": 2}


def test_malformed_rows_are_reported(spark, tmp_path):
    (tmp_path / "meteo_a.csv").write_text("date," + ",".join(MEASURES) + "\n2024-01-01,oops" + "," * (len(MEASURES) - 1) + "\n")
    landed_rows = tables.read_monthly(spark, str(tmp_path)).cache()
    assert "oops" in tables.corrupt_rows(landed_rows).first()["_corrupt_record"]
    assert landed_rows.first()["wave_height_max"] is None


def test_every_log_has_its_own_header(spark, tmp_path):
    names = RAW_CROSSINGS.names
    for i in range(230):
        order = [*names[i % 6 :], f"more{i}", *names[: i % 6]]
        (tmp_path / f"{i}.csv").write_text(",".join(order) + "\n" + ",".join(f"{n}{i}" for n in order) + "\n")
    got = {r.ligne: r for r in tables.read_raw_crossings(spark, str(tmp_path)).collect()}
    assert len(got) == 230 and all(got[f"Ligne{i}"].capitaine == f"Capitaine{i}" for i in range(230))


def test_records_with_line_breaks_and_bad_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        '\ufeffMétéo,Ligne,Horaire\r\nsheet,row,two\r\n"vent\nfort, ""mer"" belle",L1,01/02/2024 08:30\r\nonly one cell\r\n\r\n5" de houle,L2,02/02/2024 08:30\r\n'
        '"a \\"b\\" c",L3,\r\n"x","y"z,w,too many\r\n'
    )
    (tmp_path / "b.csv").write_text('Horaire,Ligne,Météo\nsheet,row,two\n03/02/2024 10:00,"L\n\n4",NA\n04/02/2024 10:00,L5,"never closed\nL6,x,y\n')
    good = {r.ligne: (r.horaire, r.meteo) for r in tables.read_raw_crossings(spark, str(tmp_path), skip=[1]).collect()}
    want = {
        "L1": ("01/02/2024 08:30", 'vent\nfort, "mer" belle'), "L2": ("02/02/2024 08:30", '5" de houle'), "L3": (None, 'a "b" c'), "L\n\n4": ("03/02/2024 10:00", None),
    }
    last = good.pop("L5")
    assert good == want and last == ("04/02/2024 10:00", "never closed\nL6,x,y")
    bad = sorted(r._corrupt_record for r in tables.rejected_crossings(spark, str(tmp_path)).collect())
    assert bad == ['"x","y"z,w,too many', "only one cell"]


def test_records_across_splits(spark, tmp_path):
    rng = random.Random(4)
    cell = lambda: "".join(rng.choices(["a", "bc", "\n", ",", '"', "é", " ", "x" * 30], k=rng.randrange(9)))
    rows = [[str(i), cell(), cell()] for i in range(400)]
    with open(tmp_path / "a.csv", "w", newline="") as out:
        csv.writer(out, lineterminator="\n").writerows([["k", "u", "v"], *rows])
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("u", T.StringType()), T.StructField("v", T.StringType())])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        for held in (1000, 0):
            df = landing.read_landed(spark, str(tmp_path), schema, "k", held_splits=held)
            assert landing.landed_lines(spark, str(tmp_path)).select("_block").distinct().count() > 3
            got = sorted((r.k, r.u or "", r.v or "", r._corrupt_record) for r in df.collect())
            assert got == [(int(k), u, v, None) for k, u, v in rows]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
