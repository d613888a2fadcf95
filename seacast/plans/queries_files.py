"""Readers and sinks over the driver's tables, written to files and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seacast.functions import timefeat
from seacast.operators import profile, select
from seacast.plans import lifecycles
from seacast.plans.adapters import adapted, table, with_views
from seacast.plans.queries import query
from seacast.schemas import CLEAN_CROSSINGS, MARINE_MEASURES, MEASURES, WEATHER_MEASURES
from seacast.session import scratch_path
from seacast.sources.payload import flatten_payloads, read_payloads
from seacast.sources.tables import read_indexed_csv, read_raw_crossings


def _land(days: DataFrame, path: str) -> None:
    """One payload per month, as a collector lands them: a time array and a value array per measure."""
    ordered = days.groupBy(F.date_format("jour", "yyyy-MM").alias("month")).agg(F.array_sort(F.collect_list(F.struct("jour", *MEASURES))).alias("d"))

    def values_of(name: str):
        return lambda day: day[name]

    def half(names: dict[str, str]):
        times = F.transform("d", lambda x: F.date_format(x["jour"], "yyyy-MM-dd")).alias("time")
        return F.struct(F.struct(times, *[F.transform("d", values_of(n)).alias(p) for p, n in names.items()]).alias("daily"))

    rows = ordered.select(F.col("month").alias("period_start"), F.col("month").alias("period_end"), half(MARINE_MEASURES).alias("marine_data"), half(WEATHER_MEASURES).alias("weather_data"))
    rows.write.option("ignoreNullFields", False).json(path)


_NARROW = ", ".join(f"round(CAST(CAST({m} AS FLOAT) AS DOUBLE), 4) AS {m}" for m in MEASURES)


@query(with_views(["weather"], f"SELECT jour AS date, {_NARROW} FROM weather"))
def weather_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads landed and collected in two calls for different months, then consolidated to one typed row per date."""
    days, root = adapted(spark, sf, "weather"), scratch_path(spark, "raw")
    for half in (0, 1):
        landing = scratch_path(spark, "payloads")
        _land(days.where(F.month("jour") % 2 == half), landing)
        lifecycles.collect_weather(spark, landing, root)
    got = lifecycles.consolidate_weather(spark, root)
    return got.select(F.col("date").cast("date").alias("date"), *[F.round(F.col(m).cast("double"), 4).alias(m) for m in MEASURES])


@query(with_views(["weather"], f"SELECT strftime(jour, '%Y-%m-%d') AS date, {', '.join(MEASURES)} FROM weather"))
def landed_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Landed JSON payloads read with their schema and flattened."""
    landing = scratch_path(spark, "payloads")
    _land(adapted(spark, sf, "weather"), landing)
    return flatten_payloads(read_payloads(spark, landing))


_LOG = "SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS ligne, annulation, meteo FROM raw_notes"


@query(with_views(["raw_notes"], ", log AS (" + _LOG.replace("STRING", "VARCHAR") + ") SELECT ligne, annulation, meteo FROM log"))
def raw_log_file(spark: SparkSession, sf: str) -> DataFrame:
    """The crossing log as a CSV whose columns are in another order, read by name."""
    path = scratch_path(spark, "log")
    log = spark.sql(_LOG.replace("raw_notes", "{raw_notes}"), raw_notes=adapted(spark, sf, "raw_notes"))
    log.select(F.col("meteo").alias("Météo"), F.col("ligne").alias("Ligne"), F.lit("01/02/2024 08:30").alias("Horaire"), F.col("annulation").alias("Annulation")).write.csv(path, header=True)
    return read_raw_crossings(spark, path).select("ligne", "annulation", "meteo")


@query(with_views(["crossings"], "SELECT ligne, vent, CAST(sum(annulation) AS BIGINT) AS cancelled, count(*) AS n FROM crossings GROUP BY ligne, vent"))
def indexed_csv_file(spark: SparkSession, sf: str) -> DataFrame:
    """A clean table saved with its row index, read without it."""
    path = scratch_path(spark, "indexed")
    rows = adapted(spark, sf, "crossings")
    missing = [F.lit(None).cast("string").alias(f.name) for f in CLEAN_CROSSINGS.fields if f.name not in rows.columns]
    rows.select("*", *missing).select(F.col("crossing_id").alias("_index"), *CLEAN_CROSSINGS.names).write.csv(path, header=True)
    return read_indexed_csv(spark, path).groupBy("ligne", "vent").agg(F.sum("annulation").alias("cancelled"), F.count(F.lit(1)).alias("n"))


@query("SELECT min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE AS last FROM orders")
def date_span(spark: SparkSession, sf: str) -> DataFrame:
    return profile.date_span(table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d")), "d")


@query("SELECT o_orderkey, year(o_orderdate::DATE) AS y, month(o_orderdate::DATE) AS mois, CAST(o_orderkey % 24 AS INT) AS heure_num FROM orders")
def calendar_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """ISO texts parsed, and the month and hour numbers of date and time texts."""
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    hour = F.format_string("%02d:30", F.col("o_orderkey") % 24)
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("date"), hour.alias("heure"))
    rows = rows.withColumns(timefeat.calendar_columns(rows))
    return rows.select("o_orderkey", F.year(timefeat.parse_iso(F.col("date"))).alias("y"), "mois", "heure_num")


@query(with_views(["crossings"], "SELECT crossing_id, annulation, 'vent,mer' AS dropped FROM crossings"))
def dropped_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns dropped with an audit list of their names."""
    rows = adapted(spark, sf, "crossings").select("crossing_id", "annulation", "vent", "mer")
    left, audit = select.drop_columns(rows, ["vent"])
    left, audit = select.drop_columns(left, ["mer"], audit)
    return left.withColumn("dropped", F.lit(",".join(audit)))
