"""Queries over crossings: cleaning, lines, roll-ups, rates, day and night."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seacast.functions.direction import compass_degrees, mistral, sea_ordinal
from seacast.functions.notes import unglue
from seacast.functions.solar import calendar, day_night_minutes, solar_day as sun_table
from seacast.functions.timefeat import in_range
from seacast.operators import clean, daily, lines
from seacast.operators.align import align, daily_weather_merge as merge_days
from seacast.operators.encode import direction_columns
from seacast.plans.adapters import WEATHER_SHIFTED_DAYS, adapted, table, with_views
from seacast.plans.queries import query, r6
from seacast.session import scratch_path
from seacast.sources.tables import write_line_extracts

# Range of the flagship query: dates both sides share.
FIRST_DAY, LAST_DAY = "1995-06-01", "2001-06-30"

GROUPS = {
    "pressing": ["1-URGENT", "2-HIGH"],
    "high": ["2-HIGH"],
    "relaxed": ["4-NOT SPECIFIED", "5-LOW", "3-MEDIUM"],
    "every": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
}


def _mode_sql(view: str, col: str) -> str:
    return (
        f"SELECT jour, {col} FROM (SELECT jour, {col}, row_number() OVER (PARTITION BY jour ORDER BY count(*) DESC, {col}) AS rn "
        f"FROM {view} WHERE {col} IS NOT NULL GROUP BY jour, {col}) WHERE rn = 1"
    )


def _rollup_sql(view: str, sea: str = "max(mer)") -> str:
    return f"""
m_vent AS ({_mode_sql(view, "vent")}), m_dom AS ({_mode_sql(view, "houle_dominante")}), m_ciel AS ({_mode_sql(view, "ciel")}),
m_first AS (SELECT jour, ligne FROM (SELECT jour, ligne, row_number() OVER (PARTITION BY jour ORDER BY horaire, crossing_id) AS rn FROM {view}) WHERE rn = 1),
base AS (SELECT jour, count(annulation) AS n_traversees, CAST(sum(annulation) AS BIGINT) AS n_annulations,
  round(avg(annulation), 6) AS annulation_pct, max(vent_noeud) AS vent_noeud, max(houle_max) AS houle_max,
  round(avg(houle), 6) AS houle, round(avg(houle_periode), 6) AS houle_periode, {sea} AS mer,
  min(temperature) AS temperature_min, max(temperature) AS temperature_max FROM {view} GROUP BY jour),
daily AS (SELECT b.jour, b.n_traversees, b.n_annulations, b.annulation_pct, f.ligne, v.vent, b.vent_noeud, d.houle_dominante,
  b.houle_max, b.houle, b.houle_periode, b.mer, b.temperature_min, b.temperature_max, c.ciel
  FROM base b JOIN m_first f ON f.jour = b.jour LEFT JOIN m_vent v ON v.jour = b.jour
  LEFT JOIN m_dom d ON d.jour = b.jour LEFT JOIN m_ciel c ON c.jour = b.jour)
"""


ORDINAL_SEA = """CASE max(CASE mer WHEN 'ridée' THEN 0 WHEN 'belle' THEN 1 WHEN 'peu agitée' THEN 2 WHEN 'agitée' THEN 3 WHEN 'forte' THEN 4 END)
  WHEN 0 THEN 'ridée' WHEN 1 THEN 'belle' WHEN 2 THEN 'peu agitée' WHEN 3 THEN 'agitée' WHEN 4 THEN 'forte' END"""


@query(with_views(["crossings"], "," + _rollup_sql("crossings") + "SELECT * FROM daily"))
def daily_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return r6(daily.daily_rollup(adapted(spark, sf, "crossings")), "annulation_pct", "houle", "houle_periode")


@query(with_views(["crossings"], "," + _rollup_sql("crossings", ORDINAL_SEA) + "SELECT jour, mer FROM daily"))
def daily_rollup_ordinal_sea(spark: SparkSession, sf: str) -> DataFrame:
    return daily.daily_rollup(adapted(spark, sf, "crossings"), sea="ordinal").select("jour", "mer")


@query(
    with_views(
        ["crossings", "weather"],
        f""", kept AS (SELECT * FROM crossings WHERE jour BETWEEN DATE '{FIRST_DAY}' AND DATE '{LAST_DAY}'),
{_rollup_sql("kept")}
SELECT d.jour, n_traversees, n_annulations, annulation_pct, ligne, vent, vent_noeud, houle_dominante, houle_max, houle,
  houle_periode, mer, d.temperature_min AS crossing_temperature_min, d.temperature_max AS crossing_temperature_max, ciel,
  wave_height_max, wave_direction_dominant, wave_period_max, wind_wave_height_max, swell_wave_height_max,
  w.temperature_max, w.temperature_min, wind_speed_max, wind_gusts_max, wind_direction_dominant,
  CASE WHEN annulation_pct >= 0.166 THEN 1 ELSE 0 END AS annulation_binary
FROM daily d JOIN weather w ON w.jour = d.jour""",
    )
)
def daily_weather_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: date range, roll-up, weather join, binary label."""
    rows = adapted(spark, sf, "crossings").where(in_range(F.col("horaire"), FIRST_DAY, LAST_DAY))
    rolled = r6(daily.daily_rollup(rows), "annulation_pct", "houle", "houle_periode")
    return daily.binarise(merge_days(rolled, adapted(spark, sf, "weather")))


# --- notes ------------------------------------------------------------------

_PARTS = """, parts AS (SELECT *, nullif(regexp_extract(meteo, '^(.*?)\\b(Vent|Mer)\\b', 1), '') AS h,
  nullif(regexp_extract(meteo, '(Vent.*?)Mer\\b', 1), '') AS w, nullif(regexp_extract(meteo, '(Mer\\s*:?.*)$', 1), '') AS s FROM raw_notes),
fields AS (SELECT *, CAST(nullif(regexp_extract(h, '(\\d+)°', 1), '') AS DOUBLE) AS temperature,
  CASE WHEN regexp_matches(h, '(\\d+)°') THEN regexp_extract(h, '\\d+°\\s*(.*)', 1) END AS ciel,
  nullif(regexp_extract(w, '{W}', 1), '') AS vent, CAST(nullif(regexp_extract(w, '{W}', 2), '') AS DOUBLE) AS vent_noeud,
  CAST(nullif(regexp_extract(w, '{W}', 3), '') AS DOUBLE) AS vent_beaufort,
  nullif(regexp_extract(s, '{S}', 1), '') AS mer, CAST(replace(nullif(regexp_extract(s, '{S}', 2), ''), ',', '.') AS DOUBLE) AS houle_dominante,
  CAST(replace(nullif(regexp_extract(s, '{S}', 3), ''), ',', '.') AS DOUBLE) AS houle_max,
  CAST(nullif(regexp_extract(s, '{S}', 4), '') AS DOUBLE) AS houle, CAST(nullif(regexp_extract(s, '{S}', 5), '') AS DOUBLE) AS houle_periode
  FROM parts)
""".replace("{W}", r"Vent\s*:?\s*([A-Z]{1,3})?\s*(\d+)\s*Nds/?(\d+)\s*Bft").replace(
    "{S}", r"Mer\s*:?\s*([^\d]+)?\s*(\d+[.,]?\d*)/?(\d+[.,]?\d*)?m?\s*(\d+)?°?\s*(\d+)?s?"
)
_FIELDS = "temperature, ciel, vent, vent_noeud, vent_beaufort, mer, houle_dominante, houle_max, houle, houle_periode"


@query(with_views(["raw_notes"], _PARTS + f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_FIELDS} FROM fields"))
def parse_notes(spark: SparkSession, sf: str) -> DataFrame:
    return clean.parse_notes(adapted(spark, sf, "raw_notes")).drop("annulation", "meteo")


@query(
    with_views(
        ["raw_notes"],
        _PARTS
        + """SELECT l_orderkey, l_linenumber, CASE WHEN annulation IS NULL THEN 0 ELSE 1 END AS annulation, annulation AS annulation_motif,
  vent, vent_noeud, houle_dominante, houle_max, houle, houle_periode, mer, temperature, ciel
FROM fields WHERE (meteo IS NULL OR meteo <> '?') AND vent IS NOT NULL AND houle IS NOT NULL""",
    )
)
def clean_crossings(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = clean.clean_crossings(adapted(spark, sf, "raw_notes"))
    return clean.reorganize(cleaned, keep=("l_orderkey", "l_linenumber"))


@query(
    with_views(
        ["raw_notes"],
        _PARTS
        + """SELECT l_orderkey, l_linenumber, vent, houle FROM fields
WHERE (meteo IS NULL OR meteo <> '?') AND vent IS NOT NULL AND houle IS NOT NULL AND annulation IS NOT NULL""",
    )
)
def cancelled_only(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = clean.clean_crossings(adapted(spark, sf, "raw_notes"))
    return cleaned.where(F.col("annulation") == 1).select("l_orderkey", "l_linenumber", "vent", "houle")


@query(
    with_views(
        ["raw_notes"],
        _PARTS
        + """SELECT CASE WHEN meteo = '?' THEN 'unknown_note' WHEN meteo IS NULL THEN 'no_note' WHEN vent IS NULL THEN 'no_wind_direction'
  WHEN houle IS NULL THEN 'no_swell_direction' ELSE 'kept' END AS reason, count(*) AS n FROM fields GROUP BY 1""",
    )
)
def drop_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return clean.drop_reasons(adapted(spark, sf, "raw_notes"))


@query(
    """WITH t AS (SELECT o_orderkey, o_orderdate, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y %H:%M')
  WHEN 1 THEN strftime(o_orderdate, '%-d/%-m/%Y %-H:%M') WHEN 2 THEN 'inconnu' END AS horaire FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 1) THEN CAST(o_orderdate AS DATE) END AS date,
  CASE WHEN o_orderkey % 4 IN (0, 1) THEN strftime(o_orderdate, '%H:%M:%S') END AS heure FROM t WHERE horaire IS NOT NULL"""
)
def parse_times(spark: SparkSession, sf: str) -> DataFrame:
    # By key: padded, unpadded, unreadable, or no time text at all (such rows are dropped).
    time = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderkey") % 4 == 0, F.date_format(time, "dd/MM/yyyy HH:mm"))
        .when(F.col("o_orderkey") % 4 == 1, F.date_format(time, "d/M/yyyy H:mm"))
        .when(F.col("o_orderkey") % 4 == 2, F.lit("inconnu"))
    )
    return clean.parse_times(table(spark, sf, "orders").withColumn("horaire", text)).select("o_orderkey", "date", "heure")


@query(
    with_views(
        ["raw_notes"],
        r"SELECT l_orderkey, l_linenumber, l_partkey, regexp_replace(meteo, '([a-zé])(\d)', '\1 \2', 'g') AS meteo FROM raw_notes",
    )
)
def unglued_notes(spark: SparkSession, sf: str) -> DataFrame:
    return adapted(spark, sf, "raw_notes").select("l_orderkey", "l_linenumber", "l_partkey", unglue(F.col("meteo")).alias("meteo"))


# --- lines ------------------------------------------------------------------


@query(with_views(["crossings"], "SELECT crossing_id, ligne, annulation FROM crossings WHERE ligne IN ('1-URGENT', '2-HIGH')"))
def line_group_filter(spark: SparkSession, sf: str) -> DataFrame:
    return lines.select_lines(adapted(spark, sf, "crossings"), "pressing", GROUPS).select("crossing_id", "ligne", "annulation")


_MEMBERS = ", ".join(f"('{g}', '{line}')" for g, found in GROUPS.items() for line in found)


@query(
    with_views(
        ["crossings"],
        f", members(line_group, line) AS (VALUES {_MEMBERS}) SELECT crossing_id, ligne, line_group FROM crossings JOIN members ON line = ligne",
    )
)
def line_group_fanout(spark: SparkSession, sf: str) -> DataFrame:
    out = lines.fan_out_lines(adapted(spark, sf, "crossings"), list(GROUPS), GROUPS)
    return out.select("crossing_id", "ligne", "line_group")


@query(
    with_views(
        ["crossings"],
        f", members(line_group, line) AS (VALUES {_MEMBERS}) SELECT line_group, count(*) AS n FROM crossings JOIN members ON line = ligne GROUP BY line_group",
    )
)
def line_extracts(spark: SparkSession, sf: str) -> DataFrame:
    """All extracts written in one pass and counted from the files."""
    df = adapted(spark, sf, "crossings").drop("horaire")
    return write_line_extracts(df, scratch_path(spark, "lines"), [*GROUPS, "no-such-group"], GROUPS)


# --- directions and sea -----------------------------------------------------

_DEGREES = "CASE vent " + " ".join(
    f"WHEN '{p}' THEN {d}"
    for p, d in zip("N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split(), [i * 22.5 for i in range(16)])
) + " END"


def _flag_sql(angle: str) -> str:
    return f"CASE WHEN (CAST({angle} AS DOUBLE) % 360) >= 270 OR (CAST({angle} AS DOUBLE) % 360) = 0 THEN 1 ELSE 0 END"


def _direction_sql(col: str, angle: str) -> str:
    return (
        f"CAST({angle} AS DOUBLE) AS {col}_deg, round(radians({angle}), 6) AS {col}_rad, round(cos(radians({angle})), 6) + 0.0 AS {col}_x, "
        f"round(sin(radians({angle})), 6) + 0.0 AS {col}_y, {_flag_sql(angle)} AS {col}_mistral"
    )


@query(with_views(["crossings"], f"SELECT crossing_id, {_direction_sql('vent', _DEGREES)}, {_direction_sql('houle', 'houle')} FROM crossings"))
def direction_features(spark: SparkSession, sf: str) -> DataFrame:
    df = adapted(spark, sf, "crossings").select("crossing_id", "vent", "houle")
    df = direction_columns(df, "vent", compass_degrees(F.col("vent")))
    df = direction_columns(df, "houle", F.col("houle")).drop("vent", "houle")
    trig = [f"{c}_{k}" for c in ("vent", "houle") for k in ("rad", "x", "y")]
    return r6(df, *trig).withColumns({c: F.col(c) + F.lit(0.0) for c in trig})


_CODE = "CASE {c} WHEN 'ridée' THEN 0 WHEN 'belle' THEN 1 WHEN 'peu agitée' THEN 2 WHEN 'agitée' THEN 3 WHEN 'forte' THEN 4 ELSE -1 END"


@query(
    with_views(
        ["raw_notes"],
        _PARTS
        + f"SELECT {_CODE.format(c='mer')} AS raw_code, {_CODE.format(c='trim(mer)')} AS trimmed_code, count(*) AS n FROM fields GROUP BY 1, 2",
    )
)
def sea_ordinal_codes(spark: SparkSession, sf: str) -> DataFrame:
    parsed = clean.parse_notes(adapted(spark, sf, "raw_notes"))
    codes = parsed.select(
        sea_ordinal(F.col("mer")).cast("int").alias("raw_code"), sea_ordinal(F.trim("mer")).cast("int").alias("trimmed_code")
    )
    return codes.groupBy("raw_code", "trimmed_code").agg(F.count(F.lit(1)).alias("n"))


@query(with_views(["crossings"], f"SELECT {_flag_sql(_DEGREES)} AS flag, count(annulation) AS n, round(avg(annulation), 6) AS rate FROM crossings GROUP BY 1"))
def mistral_rate(spark: SparkSession, sf: str) -> DataFrame:
    df = adapted(spark, sf, "crossings").withColumn("vent_mistral", mistral(compass_degrees(F.col("vent"))))
    return r6(daily.rate_by_flag(df, "vent_mistral"))


# --- distributions ----------------------------------------------------------


@query(
    with_views(
        ["crossings"],
        """SELECT jour, count(annulation) AS n_traversees, CAST(sum(annulation) AS BIGINT) AS n_annulations,
  max(annulation) AS annulation_max, round(avg(annulation), 6) AS annulation_pct FROM crossings GROUP BY jour""",
    )
)
def daily_max_bias(spark: SparkSession, sf: str) -> DataFrame:
    return r6(daily.daily_max(adapted(spark, sf, "crossings")))


@query(
    with_views(
        ["crossings"],
        """SELECT CAST(date_trunc('month', horaire) AS DATE) AS mois, count(annulation) AS total, CAST(sum(annulation) AS BIGINT) AS annulations,
  round_even(avg(annulation), 3) AS pct FROM crossings GROUP BY 1""",
    )
)
def monthly_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return daily.monthly_distribution(adapted(spark, sf, "crossings"))


@query(with_views(["crossings"], "SELECT count(*) AS n, CAST(sum(annulation) AS BIGINT) AS n_annulations, round(avg(annulation) * 100, 6) AS pct FROM crossings"))
def target_stats(spark: SparkSession, sf: str) -> DataFrame:
    return r6(daily.target_stats(adapted(spark, sf, "crossings")))


@query(
    with_views(
        ["crossings"],
        """, d AS (SELECT jour, avg(annulation) AS p FROM crossings GROUP BY jour)
SELECT count(p) AS n_days, round(avg(p), 6) AS mean, round(stddev_samp(p), 6) AS std, round(min(p), 6) AS min, round(max(p), 6) AS max FROM d""",
    )
)
def day_rate_stats(spark: SparkSession, sf: str) -> DataFrame:
    return r6(daily.day_rate_stats(daily.daily_max(adapted(spark, sf, "crossings"))))


_PERIOD = """SELECT '{name}' AS period, CAST(sum(n) AS BIGINT) AS n_traversees, CAST(sum(s) AS BIGINT) AS n_annulations,
  round(sum(s) * 100.0 / sum(n), 6) AS pct, count(*) AS n_days, CAST(sum(CASE WHEN m = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_days_hit,
  round(avg(CASE WHEN m = 1 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_days_hit, round(avg(n), 6) AS mean_per_day,
  min(n) AS min_per_day, max(n) AS max_per_day
FROM (SELECT jour, count(annulation) AS n, sum(annulation) AS s, max(annulation) AS m FROM crossings WHERE {where} GROUP BY jour)"""


@query(
    with_views(
        ["crossings"],
        _PERIOD.format(name="all", where="true")
        + " UNION ALL "
        + _PERIOD.format(name="range", where="horaire >= TIMESTAMP '1997-01-01' AND horaire <= TIMESTAMP '1999-01-09'"),
    )
)
def period_compare(spark: SparkSession, sf: str) -> DataFrame:
    df = adapted(spark, sf, "crossings")
    return r6(daily.period_compare(df, in_range(F.col("horaire"), "1997-01-01", "1999-01-09", "timestamp")))


@query(
    with_views(
        ["crossings_ts"],
        """SELECT 'date' AS grain, count(*) AS n FROM crossings_ts WHERE CAST(horaire AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
UNION ALL SELECT 'timestamp', count(*) FROM crossings_ts WHERE horaire >= TIMESTAMP '2024-01-05' AND horaire <= TIMESTAMP '2024-01-20'""",
    )
)
def range_grains(spark: SparkSession, sf: str) -> DataFrame:
    df = adapted(spark, sf, "crossings_ts")
    counts = [F.count_if(in_range(F.col("horaire"), "2024-01-05", "2024-01-20", g)).alias(g) for g in ("date", "timestamp")]
    return df.agg(*counts).unpivot([], ["date", "timestamp"], "grain", "n")


_LINES = ["1-URGENT", "3-MEDIUM", "9-NONE"]


@query(
    with_views(
        ["crossings"],
        f""", f AS (SELECT ligne, annulation, {_flag_sql(_DEGREES)} AS vent_mistral, {_flag_sql("houle")} AS houle_mistral FROM crossings),
u AS (SELECT ligne, 'vent_mistral' AS flag, vent_mistral AS value, annulation FROM f UNION ALL SELECT ligne, 'houle_mistral', houle_mistral, annulation FROM f),
cells AS (SELECT * FROM (VALUES ('1-URGENT'), ('3-MEDIUM'), ('9-NONE')) n(name), (VALUES ('vent_mistral'), ('houle_mistral')) g(flag), (VALUES (0), (1)) v(value))
SELECT c.name, c.flag, c.value, coalesce(round(avg(u.annulation), 6), 0.0) AS rate
FROM cells c LEFT JOIN u ON u.ligne = c.name AND u.flag = c.flag AND u.value = c.value GROUP BY c.name, c.flag, c.value""",
    )
)
def rate_by_line_flag(spark: SparkSession, sf: str) -> DataFrame:
    df = adapted(spark, sf, "crossings").withColumns(
        {"vent_mistral": mistral(compass_degrees(F.col("vent"))), "houle_mistral": mistral(F.col("houle"))}
    )
    return r6(daily.rate_by_group_flag(df, "ligne", _LINES, ["vent_mistral", "houle_mistral"]))


@query(
    with_views(
        ["crossings"],
        """SELECT vent, round(count(CASE WHEN annulation = 0 THEN 1 END) / count(*), 6) AS annulation_0,
  round(count(CASE WHEN annulation = 1 THEN 1 END) / count(*), 6) AS annulation_1 FROM crossings WHERE vent IS NOT NULL GROUP BY vent""",
    )
)
def crosstab_norm(spark: SparkSession, sf: str) -> DataFrame:
    return r6(daily.crosstab_share(adapted(spark, sf, "crossings"), "vent", "annulation", [0, 1]))


# --- alignment --------------------------------------------------------------


def shifted_weather(spark: SparkSession, sf: str) -> DataFrame:
    return adapted(spark, sf, "weather").withColumn("jour", F.date_add("jour", WEATHER_SHIFTED_DAYS))


def _align_sql(condition: str) -> str:
    return with_views(
        ["crossings_ts", "weather"],
        f""", moved AS (SELECT * REPLACE (jour + {WEATHER_SHIFTED_DAYS} AS jour) FROM weather)
SELECT crossing_id, annulation, ligne_id, vent_noeud, m.* EXCLUDE (jour) FROM crossings_ts c JOIN moved m ON {condition}""",
    )


@query(_align_sql("CAST(c.horaire AS DATE) = m.jour"))
def align_day(spark: SparkSession, sf: str) -> DataFrame:
    return align(adapted(spark, sf, "crossings_ts"), shifted_weather(spark, sf), "day").drop("horaire")


@query(_align_sql("date_trunc('hour', c.horaire) = CAST(m.jour AS TIMESTAMP)"))
def align_hour(spark: SparkSession, sf: str) -> DataFrame:
    return align(adapted(spark, sf, "crossings_ts"), shifted_weather(spark, sf), "hour").drop("horaire")


# --- sun --------------------------------------------------------------------


def _sun_sql(source: str, jc: str, side: int, out: str) -> str:
    """Nested SQL of one solar event over ``source`` (which has a date column ``jour``)."""
    a = f"SELECT *, {jc} AS jc FROM ({source})"
    b = f"""SELECT *, ((280.46646 + jc * (36000.76983 + jc * 0.0003032)) % 360 + 360) % 360 AS l0,
  357.52911 + jc * (35999.05029 - jc * 0.0001537) AS m, 0.016708634 - jc * (0.000042037 + jc * 0.0000001267) AS e,
  125.04 - jc * 1934.136 AS nd FROM ({a})"""
    c = f"""SELECT *, l0 + (sin(radians(m)) * (1.914602 - jc * (0.004817 + jc * 0.000014)) + sin(radians(m * 2)) * (0.019993 - jc * 0.000101)
  + sin(radians(m * 3)) * 0.000289) - 0.00569 - sin(radians(nd)) * 0.00478 AS la,
  23.0 + (26.0 + (21.448 - jc * (46.815 + jc * (0.00059 - jc * 0.001813))) / 60) / 60 + cos(radians(nd)) * 0.00256 AS ep FROM ({b})"""
    d = f"SELECT *, degrees(asin(sin(radians(ep)) * sin(radians(la)))) AS de, pow(tan(radians(ep / 2)), 2) AS y FROM ({c})"
    return f"""SELECT * EXCLUDE (jc, l0, m, e, nd, la, ep, de, y), (720 - 4 * 5.3698) - degrees(y * sin(radians(l0 * 2)) - e * 2 * sin(radians(m))
  + e * y * 4 * sin(radians(m)) * cos(radians(l0 * 2)) - y * y * 0.5 * sin(radians(l0 * 4)) - e * e * 1.25 * sin(radians(m * 2))) * 4
  - {4 * side} * degrees(acos(cos(radians(90.833)) / (cos(radians(43.2965)) * cos(radians(de))) - tan(radians(43.2965)) * tan(radians(de)))) AS {out}
FROM ({d})"""


_EPOCH = "(CAST(jour - DATE '2000-01-01' AS DOUBLE) - 0.5"


def _solar_sql(source: str) -> str:
    out = source
    for name, side in (("sunrise_min", 1), ("sunset_min", -1)):
        out = _sun_sql(out, f"{_EPOCH}) / 36525", side, "fst")
        out = f"SELECT * EXCLUDE (fst) FROM ({_sun_sql(out, f'{_EPOCH} + fst / 1440) / 36525', side, name)})"
    return out


@query(
    with_views(
        ["crossings"],
        ", span AS (SELECT min(jour) AS a, max(jour) AS b FROM crossings), days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS jour FROM span) "
        f"SELECT jour, round(sunrise_min, 4) AS sunrise_min, round(sunset_min, 4) AS sunset_min FROM ({_solar_sql('SELECT jour FROM days')})",
    )
)
def solar_day(spark: SparkSession, sf: str) -> DataFrame:
    days, _ = calendar(adapted(spark, sf, "crossings"), F.col("jour"))
    return sun_table(days).withColumns({c: F.round(c, 4) for c in ("sunrise_min", "sunset_min")})


# Summer time from the last Sunday of March 03:00 to the last Sunday of October (before 1996:
# September) 02:00, local time; the skipped hour and the repeated hour count as winter time.
_OFFSET = """CASE WHEN horaire >= {mar} + INTERVAL 3 HOUR AND horaire < {oct} + INTERVAL 2 HOUR THEN 120 ELSE 60 END""".format(
    mar="(make_date(year(horaire), 3, 31) - CAST(dayofweek(make_date(year(horaire), 3, 31)) AS INTEGER))",
    oct="(CASE WHEN year(horaire) < 1996 THEN make_date(year(horaire), 9, 30) - CAST(dayofweek(make_date(year(horaire), 9, 30)) AS INTEGER)"
    " ELSE make_date(year(horaire), 10, 31) - CAST(dayofweek(make_date(year(horaire), 10, 31)) AS INTEGER) END)",
)


def night_sql(view: str) -> str:
    return f"""SELECT crossing_id, CAST(round_even(CASE WHEN t < sunrise_min THEN t - sunrise_min WHEN t > sunset_min THEN t - sunset_min ELSE 0 END, 0) AS INTEGER) AS jour_nuit
FROM ({_solar_sql(f"SELECT crossing_id, CAST(horaire AS DATE) AS jour, (epoch_us(horaire) - epoch_us(CAST(CAST(horaire AS DATE) AS TIMESTAMP))) / 60000000.0 - ({_OFFSET}) AS t FROM {view}")})"""


@query(with_views(["crossings_ts"], night_sql("crossings_ts")))
def day_night(spark: SparkSession, sf: str) -> DataFrame:
    return day_night_minutes(adapted(spark, sf, "crossings_ts")).select("crossing_id", "jour_nuit")


@query(
    with_views(
        ["crossings"],
        ", moved AS (SELECT crossing_id, horaire + INTERVAL 1 MINUTE * CAST(crossing_id % 1440 AS INTEGER) AS horaire FROM crossings) "
        + night_sql("moved"),
    )
)
def day_night_all_year(spark: SparkSession, sf: str) -> DataFrame:
    """The same over every season and minute of the day, both clock changes included."""
    df = adapted(spark, sf, "crossings").select(
        "crossing_id", (F.col("horaire") + F.make_dt_interval(mins=(F.col("crossing_id") % 1440).cast("int"))).alias("horaire")
    )
    return day_night_minutes(df).select("crossing_id", "jour_nuit")
