"""Queries over daily weather: payloads, consolidation, filling, streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seacast.functions.direction import weather_ratios as ratio_columns
from seacast.functions.timefeat import period_windows as open_windows
from seacast.operators import dedupe
from seacast.operators.align import attach_label
from seacast.operators.daily import binarise, daily_max
from seacast.operators.ordered import fill_both_ways as fill_gaps
from seacast.operators.select import downcast, downcast_plan as plan_types
from seacast.plans.adapters import adapted, table, with_views
from seacast.plans.queries import query, r6
from seacast.schemas import MARINE_MEASURES, MEASURES, WEATHER_MEASURES
from seacast.session import scratch_path
from seacast.sources.payload import flatten_payloads
from seacast.sources.tables import read_latest, union_files as union_tables, write_consolidated, write_monthly
from seacast.streaming.jobs import consolidate_stream

_M = ", ".join(MEASURES)


@query(
    with_views(
        ["weather"],
        """SELECT jour, round(wave_height_max / (swell_wave_height_max + 1e-5), 6) AS wave_to_swell_ratio,
  wave_height_max + swell_wave_height_max AS total_wave_energy, round(wind_speed_max / (wave_height_max + 1e-5), 6) AS wind_to_wave_ratio,
  temperature_max - temperature_min AS temp_range FROM weather""",
    )
)
def weather_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return r6(adapted(spark, sf, "weather").select("jour", *[v.alias(k) for k, v in ratio_columns().items()]))


# --- payloads ---------------------------------------------------------------


def payload_frame(weather: DataFrame) -> DataFrame:
    """Monthly payloads from daily weather, with gaps: the period array misses its last two
    days, and the weather half lacks every fifth day of the month."""
    names = {**{v: k for k, v in MARINE_MEASURES.items()}, **{v: k for k, v in WEATHER_MEASURES.items()}}
    month = F.date_trunc("month", "jour").cast("date")
    rows = weather.groupBy(month.alias("m")).agg(F.sort_array(F.collect_list(F.struct("jour", *MEASURES))).alias("d"))
    dry = F.filter("d", lambda x: F.day(x["jour"]) % 5 != 0)

    def times(days):
        return F.transform(days, lambda x: x["jour"].cast("string")).alias("time")

    def series(days, name):
        values = F.transform(days, lambda x: x[name])
        if name == "wave_period_max":
            values = F.slice(values, F.lit(1), F.greatest(F.size(days) - 2, F.lit(0)))
        return values.alias(names[name])

    marine = F.struct(F.struct(times(F.col("d")), *[series(F.col("d"), n) for n in MARINE_MEASURES.values()]).alias("daily"))
    other = F.struct(F.struct(times(dry), *[series(dry, n) for n in WEATHER_MEASURES.values()]).alias("daily"))
    return rows.select(
        F.array_min("d")["jour"].cast("string").alias("period_start"),
        F.array_max("d")["jour"].cast("string").alias("period_end"),
        marine.alias("marine_data"),
        other.alias("weather_data"),
    )


@query(
    with_views(
        ["weather"],
        """, r AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('month', jour) ORDER BY jour DESC) AS back FROM weather)
SELECT CAST(jour AS VARCHAR) AS date, wave_height_max, wave_direction_dominant, CASE WHEN back > 2 THEN wave_period_max END AS wave_period_max,
  wind_wave_height_max, swell_wave_height_max, """
        + ", ".join(f"CASE WHEN day(jour) % 5 <> 0 THEN {n} END AS {n}" for n in WEATHER_MEASURES.values())
        + " FROM r",
    )
)
def payload_flatten(spark: SparkSession, sf: str) -> DataFrame:
    return flatten_payloads(payload_frame(adapted(spark, sf, "weather")))


@query(
    """WITH s AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY o_custkey),
w AS (SELECT o_custkey, b, CAST(unnest(generate_series(a, b, INTERVAL 30 DAY)) AS DATE) AS period_start FROM s)
SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY period_start) - 1 AS INTEGER) AS period_no, period_start,
  least(period_start + 29, b) AS period_end FROM w"""
)
def period_windows(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    spans = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min(day).alias("a"), F.max(day).alias("b"))
    return open_windows(spans, "a", "b", 30).select("o_custkey", "period_no", "period_start", "period_end")


@query(
    with_views(
        ["crossings", "weather"],
        """, y AS (SELECT jour, CASE WHEN avg(annulation) >= 0.166 THEN 1 ELSE 0 END AS annulation_binary FROM crossings GROUP BY jour)
SELECT w.jour, wave_height_max, temperature_max, annulation_binary FROM weather w JOIN y ON y.jour = w.jour""",
    )
)
def label_attach(spark: SparkSession, sf: str) -> DataFrame:
    labels = binarise(daily_max(adapted(spark, sf, "crossings")))
    out = attach_label(adapted(spark, sf, "weather"), labels, target="annulation_binary")
    return out.select("jour", "wave_height_max", "temperature_max", "annulation_binary")


# --- consolidation ----------------------------------------------------------

_LANDED_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_LANDED = f"""WITH landed AS (SELECT CASE WHEN l_suppkey % 50 = 0 THEN 'illisible' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date,
  l_quantity AS wave_height_max, l_discount AS swell_wave_height_max, {", ".join(_LANDED_ORDER)} FROM lineitem),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY {", ".join(_LANDED_ORDER)}) AS rn FROM landed) WHERE rn = 1)
"""


def landed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as landed weather rows: many per date text, some dates unreadable."""
    text = F.date_format("l_shipdate", "yyyy-MM-dd")
    return table(spark, sf, "lineitem").select(
        F.when(F.col("l_suppkey") % 50 == 0, F.lit("illisible")).otherwise(text).alias("date"),
        F.col("l_quantity").alias("wave_height_max"),
        F.col("l_discount").alias("swell_wave_height_max"),
        *_LANDED_ORDER,
    )


_CONSOLIDATED = _LANDED + "SELECT TRY_CAST(date AS DATE) AS date, wave_height_max, swell_wave_height_max FROM firsts"


@query(_CONSOLIDATED)
def consolidate(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.consolidate(landed_rows(spark, sf), _LANDED_ORDER).drop(*_LANDED_ORDER)


@query(_CONSOLIDATED + " WHERE TRY_CAST(date AS DATE) IS NOT NULL")
def stream_consolidate(spark: SparkSession, sf: str) -> DataFrame:
    """The same through a stream over the landed file and an idempotent merge."""
    source = table(spark, sf, "lineitem")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf)
    text = F.date_format("l_shipdate", "yyyy-MM-dd")
    landed = stream.select(
        F.when(F.col("l_suppkey") % 50 == 0, F.lit("illisible")).otherwise(text).alias("date"),
        F.col("l_quantity").alias("wave_height_max"),
        F.col("l_discount").alias("swell_wave_height_max"),
        *_LANDED_ORDER,
    )
    out = scratch_path(spark, "daily-weather")
    consolidate_stream(landed, out, scratch_path(spark, "checkpoint"), _LANDED_ORDER).awaitTermination()
    return spark.read.parquet(out).drop("year", "month")


@query(
    with_views(
        ["weather"],
        f"SELECT strftime(jour, '%Y-%m-%d') AS date, year(jour) AS year, month(jour) AS month, {_M} FROM weather",
    )
)
def monthly_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Writes the monthly files and reads them back."""
    root = scratch_path(spark, "monthly")
    write_monthly(adapted(spark, sf, "weather").withColumnRenamed("jour", "date"), root)
    schema = "date string, " + ", ".join(f"{m} double" for m in MEASURES) + ", year long, month long"
    return spark.read.schema(schema).csv(f"{root}/csv", header=True)


@query(
    with_views(
        ["weather"],
        """SELECT year(jour) AS year, month(jour) AS month, strftime(min(jour), '%Y-%m-%d') AS first_date,
  strftime(max(jour), '%Y-%m-%d') AS last_date, count(*) AS n FROM weather GROUP BY 1, 2""",
    )
)
def monthly_manifest(spark: SparkSession, sf: str) -> DataFrame:
    from seacast.sources.tables import monthly_manifest as manifest, monthly_rows

    return manifest(monthly_rows(adapted(spark, sf, "weather").withColumnRenamed("jour", "date")))


@query(with_views(["weather"], f"SELECT jour AS date, {_M} FROM weather"))
def consolidated_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Two consolidation runs appended; the newest is read."""
    path = scratch_path(spark, "consolidated")
    weather = adapted(spark, sf, "weather").withColumnRenamed("jour", "date")
    write_consolidated(weather.withColumns({m: F.lit(0.0) for m in MEASURES}), path, "2026-01-01")
    write_consolidated(weather, path, "2026-02-01")
    return read_latest(spark, path)


# --- duplicates and types ---------------------------------------------------


def _duplicates_sql(direction: str) -> str:
    return f"""SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id {direction}) AS rn
FROM events) WHERE rn > 1"""


@query(_duplicates_sql("ASC"))
def duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return dedupe.duplicate_rows(events, ["event_id"])


@query(_duplicates_sql("DESC"))
def duplicate_rows_last(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return dedupe.duplicate_rows(events, ["event_id"], keep="last")


@query(
    with_views(
        ["crossings"],
        """SELECT crossing_id, vent, ciel, temperature FROM (SELECT *, count(*) OVER (PARTITION BY vent, ciel, temperature, jour) AS c FROM crossings) WHERE c > 1""",
    )
)
def duplicate_rows_all(spark: SparkSession, sf: str) -> DataFrame:
    """Nulls in the compared columns are equal to each other."""
    df = adapted(spark, sf, "crossings")
    out = dedupe.duplicate_rows(df, ["crossing_id"], ["vent", "ciel", "temperature", "jour"], keep=False)
    return out.select("crossing_id", "vent", "ciel", "temperature")


@query("SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def count_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.count_duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


_NARROW = "CASE WHEN min({c}) >= 0 AND max({c}) <= 65535 THEN 'int' WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint' WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' ELSE '{t}' END"


@query(
    " UNION ALL ".join(
        [f"SELECT '{c}' AS \"column\", 'bigint' AS from_type, {_NARROW.format(c=c, t='bigint')} AS to_type FROM lineitem" for c in ("l_orderkey", "l_partkey", "l_suppkey")]
        + [f"SELECT 'l_linenumber', 'int', {_NARROW.format(c='l_linenumber', t='int')} FROM lineitem"]
        + [f"SELECT '{c}', 'double', 'float'" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    )
)
def downcast_plan(spark: SparkSession, sf: str) -> DataFrame:
    return plan_types(table(spark, sf, "lineitem"))


@query(
    """SELECT CAST(l_orderkey AS INTEGER) AS l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, CAST(l_extendedprice AS FLOAT) AS l_extendedprice,
  CAST(l_discount AS FLOAT) AS l_discount FROM lineitem"""
)
def downcast_rows(spark: SparkSession, sf: str) -> DataFrame:
    return downcast(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"))


@query(
    """SELECT o_orderkey AS k, o_totalprice AS price, CAST(NULL AS DOUBLE) AS value FROM orders
UNION ALL SELECT event_id, NULL, value FROM events"""
)
def union_files(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of two tables with the outer union of their columns."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    return union_tables([orders, table(spark, sf, "events").select(F.col("event_id").alias("k"), "value")])


# --- filling ----------------------------------------------------------------


def _fill_sql(col: str) -> str:
    return f"""coalesce(last_value({col} IGNORE NULLS) OVER (ORDER BY jour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value({col} IGNORE NULLS) OVER (ORDER BY jour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {col}"""


@query(with_views(["weather"], f"SELECT jour, {_fill_sql('swell_wave_height_max')}, {_fill_sql('wind_speed_max')} FROM weather"))
def fill_both_ways(spark: SparkSession, sf: str) -> DataFrame:
    weather = adapted(spark, sf, "weather").select("jour", "swell_wave_height_max", "wind_speed_max")
    return fill_gaps(weather, ["jour"], ["swell_wave_height_max", "wind_speed_max"])


@query(
    with_views(
        ["crossings"],
        """SELECT crossing_id, ligne, coalesce(last_value(temperature IGNORE NULLS) OVER (PARTITION BY ligne ORDER BY jour, crossing_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(temperature IGNORE NULLS) OVER (PARTITION BY ligne ORDER BY jour, crossing_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS temperature FROM crossings""",
    )
)
def fill_per_line(spark: SparkSession, sf: str) -> DataFrame:
    df = adapted(spark, sf, "crossings").select("crossing_id", "jour", "ligne", "temperature")
    return fill_gaps(df, ["jour", "crossing_id"], ["temperature"], ["ligne"]).drop("jour")
