from pyspark.sql import functions as F

from seacast.operators.clean import clean_crossings, drop_reasons, parse_notes, reorganize

FIELDS = ["temperature", "ciel", "vent", "vent_noeud", "vent_beaufort", "mer", "houle_dominante", "houle_max", "houle", "houle_periode"]

NOTES = {
    "18° Ensoleillé Vent : NW 25 Nds/6 Bft Mer : peu agitée0,5/0.9m 270° 5s": (18.0, "Ensoleillé ", "NW", 25.0, 6.0, "peu agitée", 0.5, 0.9, 270.0, 5.0),
    "7° Clair Vent 0 Nds/0 Bft Mer : ridée0.1/0.2m 90° 3s": (7.0, "Clair ", None, 0.0, 0.0, "ridée", 0.1, 0.2, 90.0, 3.0),
    "Vent : SSE 12 Nds/4 Bft Mer : agitée 1.2/2m 180° 7s": (None, None, "SSE", 12.0, 4.0, "agitée ", 1.2, 2.0, 180.0, 7.0),
    "12° Brume Vent : W 8 Nds/3 Bft Mer : forte2/3m 45°": (12.0, "Brume ", "W", 8.0, 3.0, "forte", 2.0, 3.0, 45.0, None),
    "12° Couvert Vent : N 8 Nds/3 Bft Mer : belle 0.4/0.8m 10° 4s": (12.0, "Couvert ", "N", 8.0, 3.0, "belle ", 0.4, 0.8, 10.0, 4.0),
    "-3° Clair Vent : E 5 Nds/2 Bft Mer : belle0.4m": (3.0, "Clair ", "E", 5.0, 2.0, "belle", 0.4, None, None, None),
    "20°Mer : belle0.4/0.5m 12° 2s": (20.0, "", None, None, None, "belle", 0.4, 0.5, 12.0, 2.0),
    "10° EnsoleilléVent : N 5 Nds/2 Bft Mer : belle1/2m 3° 4s": (10.0, "EnsoleilléVent : N 5 Nds/2 Bft ", "N", 5.0, 2.0, "belle", 1.0, 2.0, 3.0, 4.0),
    "10° Clair Vent : N 5 Nds/2 Bft": (10.0, "Clair ", None, None, None, None, None, None, None, None),
    "?": (None,) * 10,
}


def frame(spark, notes):
    return spark.createDataFrame([(i, n) for i, n in enumerate(notes)], "id int, meteo string")


def test_fields_of_each_note(spark):
    rows = parse_notes(frame(spark, [*NOTES, None])).orderBy("id").collect()
    for row, (note, want) in zip(rows, [*NOTES.items(), (None, (None,) * 10)]):
        assert tuple(row[f] for f in FIELDS) == want, note


def test_trimmed_state(spark):
    rows = parse_notes(frame(spark, ["Vent : N 5 Nds/2 Bft Mer : agitée 1.2/2m"]), trim_state=True).collect()
    assert rows[0]["mer"] == "agitée"


def test_regexes_run_once_when_filtered(spark):
    df = parse_notes(frame(spark, list(NOTES))).where(F.col("vent").isNotNull() & F.col("houle").isNotNull())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Bft(?s") == 1
    assert plan.count("(?=Mer") == 1


def raw(spark):
    good = "18° Clair Vent : NW 25 Nds/6 Bft Mer : belle0,5/0.9m 270° 5s"
    rows = [
        ("01/02/2024 08:30", "A", None, good, "B1", "Cap_01"),
        ("1/2/2024 8:30", "A", "panne", good, "B1", "Cap_01"),
        ("junk", "A", None, good, "B1", "Cap_01"),
        (None, "A", None, good, "B1", "Cap_01"),
        ("01/02/2024 09:00", "A", None, "?", "B1", "Cap_01"),
        ("01/02/2024 09:00", "A", None, None, "B1", "Cap_01"),
        ("01/02/2024 09:00", "A", None, "7° Clair Vent 0 Nds/0 Bft Mer : belle0.1/0.2m 90° 3s", "B1", "Cap_01"),
        ("01/02/2024 09:00", "A", None, "7° Clair Vent : N 1 Nds/0 Bft Mer : belle0.1/0.2m", "B1", "Cap_01"),
    ]
    return spark.createDataFrame(rows, "horaire string, ligne string, annulation string, meteo string, bateau string, capitaine string")


def test_clean_chain_keeps_unreadable_times(spark):
    out = reorganize(clean_crossings(raw(spark)))
    assert out.columns[:4] == ["horaire", "annulation", "annulation_motif", "ligne"]
    assert len(out.columns) == 15
    rows = out.collect()
    assert len(rows) == 3
    assert sorted((str(r["horaire"]), r["annulation"], r["annulation_motif"]) for r in rows) == [
        ("2024-02-01 08:30:00", 0, None),
        ("2024-02-01 08:30:00", 1, "panne"),
        ("None", 0, None),
    ]


def test_drop_reasons(spark):
    got = {r["reason"]: r["n"] for r in drop_reasons(raw(spark)).collect()}
    assert got == {"kept": 3, "no_time": 1, "unknown_note": 1, "no_note": 1, "no_wind_direction": 1, "no_swell_direction": 1}
