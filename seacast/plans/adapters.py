"""The driver tables in the shapes the operators expect; the same SQL runs on both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CROSSINGS = """
SELECT o_orderkey AS crossing_id, o_orderdate AS horaire, CAST(o_orderdate AS DATE) AS jour,
  CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN 1 ELSE 0 END AS annulation,
  o_orderpriority AS ligne,
  CASE o_custkey % 17 WHEN 0 THEN 'N' WHEN 1 THEN 'NNE' WHEN 2 THEN 'NE' WHEN 3 THEN 'ENE' WHEN 4 THEN 'E'
    WHEN 5 THEN 'ESE' WHEN 6 THEN 'SE' WHEN 7 THEN 'SSE' WHEN 8 THEN 'S' WHEN 9 THEN 'SSW' WHEN 10 THEN 'SW'
    WHEN 11 THEN 'WSW' WHEN 12 THEN 'W' WHEN 13 THEN 'WNW' WHEN 14 THEN 'NW' WHEN 15 THEN 'NNW' END AS vent,
  CAST(o_custkey % 40 AS DOUBLE) AS vent_noeud,
  CAST(o_orderkey % 25 AS DOUBLE) AS houle_dominante, CAST(o_orderkey % 31 AS DOUBLE) AS houle_max,
  CAST(o_orderkey % 361 AS DOUBLE) AS houle,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 12 AS DOUBLE) END AS houle_periode,
  CASE o_orderkey % 6 WHEN 0 THEN 'ridée' WHEN 1 THEN 'belle' WHEN 2 THEN 'peu agitée' WHEN 3 THEN 'agitée'
    WHEN 4 THEN 'forte' END AS mer,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_custkey % 35 AS DOUBLE) END AS temperature,
  CASE o_custkey % 5 WHEN 0 THEN 'Clair' WHEN 1 THEN 'Couvert' WHEN 2 THEN 'Brume' WHEN 3 THEN 'Ensoleillé' END AS ciel
FROM {orders}
"""

CROSSINGS_TS = """
SELECT event_id AS crossing_id, ts AS horaire, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS annulation,
  user_id % 12 AS ligne_id, value AS vent_noeud
FROM {events}
"""

WEATHER = """
SELECT CAST(l_shipdate AS DATE) AS jour, max(l_quantity) AS wave_height_max,
  CAST(max(l_partkey % 360) AS DOUBLE) AS wave_direction_dominant, CAST(max(l_suppkey % 12) AS DOUBLE) AS wave_period_max,
  min(l_quantity) AS wind_wave_height_max,
  CASE WHEN max(l_suppkey) % 7 = 0 THEN NULL ELSE min(l_quantity) + 1 END AS swell_wave_height_max,
  CAST(max(l_partkey % 35) AS DOUBLE) AS temperature_max, CAST(min(l_partkey % 35) AS DOUBLE) AS temperature_min,
  CASE WHEN min(l_suppkey) % 9 = 0 THEN NULL ELSE CAST(max(l_orderkey % 90) AS DOUBLE) END AS wind_speed_max,
  CAST(max(l_orderkey % 120) AS DOUBLE) AS wind_gusts_max, CAST(min(l_partkey % 360) AS DOUBLE) AS wind_direction_dominant
FROM {lineitem} GROUP BY CAST(l_shipdate AS DATE)
"""

RAW_NOTES = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_returnflag = 'R' THEN 'panne' END AS annulation,
  CASE WHEN l_linenumber = 7 THEN '?' WHEN l_partkey % 19 = 0 THEN NULL ELSE
    CAST(CAST(l_quantity AS INT) AS STRING) || '° ' || CASE l_suppkey % 3 WHEN 0 THEN 'Clair' WHEN 1 THEN 'Ensoleillé' ELSE 'Couvert' END
    || ' Vent : ' || CASE l_partkey % 5 WHEN 0 THEN 'NW ' WHEN 1 THEN 'W ' WHEN 2 THEN 'SSE ' WHEN 3 THEN 'N ' ELSE '' END
    || CAST(l_partkey % 40 AS STRING) || ' Nds/' || CAST(l_suppkey % 9 AS STRING) || ' Bft Mer : '
    || CASE l_suppkey % 5 WHEN 0 THEN 'ridée' WHEN 1 THEN 'belle ' WHEN 2 THEN 'peu agitée' WHEN 3 THEN 'agitée' ELSE 'forte' END
    || CAST(l_linenumber AS STRING) || ',5/' || CAST(l_linenumber + 1 AS STRING) || '.5m '
    || CAST(l_partkey % 361 AS STRING) || '°' || CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE ' ' || CAST(l_suppkey % 15 AS STRING) || 's' END
  END AS meteo
FROM {lineitem}
"""

PREDS = """
SELECT doc_id, quality AS y_true, CASE WHEN (doc_id * 7) % 10 < 3 THEN 1 - quality ELSE quality END AS y_pred,
  CAST((doc_id * 37) % 100 AS DOUBLE) / 100 AS score
FROM {labels}
"""

# The daily weather moved by a whole number of days onto the dates of the events table.
WEATHER_SHIFTED_DAYS = 9497

ADAPTERS = {
    "crossings": (CROSSINGS, ["orders"]),
    "crossings_ts": (CROSSINGS_TS, ["events"]),
    "weather": (WEATHER, ["lineitem"]),
    "raw_notes": (RAW_NOTES, ["lineitem"]),
    "preds": (PREDS, ["labels"]),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adapted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter view as a lazy frame."""
    sql, sources = ADAPTERS[name]
    return spark.sql(sql, **{s: table(spark, sf_dir, s) for s in sources})


def with_views(names: list[str], body: str) -> str:
    """DuckDB text: the named adapters as common table expressions, then ``body``."""
    views = []
    for name in names:
        sql, sources = ADAPTERS[name]
        views.append(f"{name} AS ({sql.format(**{s: s for s in sources})})")
    head = ",\n".join(views)
    return f"WITH {head}{',' if body.lstrip().startswith(',') else ''}\n{body.lstrip().lstrip(',')}"
