"""Raw crossing log to clean crossings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seacast.functions.notes import note_fields, note_groups, note_parts
from seacast.functions.timefeat import date_part, parse_crossing_time, time_part
from seacast.schemas import CLEAN_CROSSINGS

CLEAN_COLUMNS = [f.name for f in CLEAN_CROSSINGS.fields]
UNKNOWN_NOTE = "?"


def parse_notes(df: DataFrame, note: str = "meteo", trim_state: bool = False) -> DataFrame:
    """Adds the typed fields of the free-text note.

    The regex results pass through a one-element ``inline``: a later filter on a field then
    stops above it, instead of being pushed below and running every regex a second time.
    """
    parts = df.withColumns(note_parts(F.col(note)))
    groups = note_groups(F.col("note_head"), F.col("note_wind"), F.col("note_sea"))
    once = parts.select(*df.columns, F.inline(F.array(groups)))
    fields = note_fields(F.col("head_groups"), F.col("wind_groups"), F.col("sea_groups"), trim_state)
    return once.withColumns(fields).drop("head_groups", "wind_groups", "sea_groups")


def parse_times(df: DataFrame, time: str = "horaire") -> DataFrame:
    """Drops rows without a time text, then parses it; an unreadable text stays as null."""
    return (
        df.where(F.col(time).isNotNull())
        .withColumn(time, parse_crossing_time(F.col(time)))
        .withColumns({"date": date_part(F.col(time)), "heure": time_part(F.col(time))})
    )


def drop_unknown_notes(df: DataFrame, note: str = "meteo") -> DataFrame:
    """Drops notes that read ``?``; a null note stays at this step."""
    return df.where(~F.col(note).eqNullSafe(F.lit(UNKNOWN_NOTE)))


def label_target(df: DataFrame, reason: str = "annulation") -> DataFrame:
    """The reason text becomes ``annulation_motif``; 1 when a reason is given."""
    return df.withColumnRenamed(reason, "annulation_motif").withColumn(
        "annulation", F.col("annulation_motif").isNotNull().cast("int")
    )


def clean_crossings(df: DataFrame, trim_state: bool = False) -> DataFrame:
    """The whole cleaning chain on whichever of the landed columns are present."""
    if "horaire" in df.columns:
        df = parse_times(df)
    parsed = parse_notes(drop_unknown_notes(df), trim_state=trim_state)
    located = parsed.where(F.col("vent").isNotNull() & F.col("houle").isNotNull())
    return label_target(located)


def reorganize(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 15 clean columns in their fixed order, after the ``keep`` columns."""
    return df.select(*keep, *[c for c in CLEAN_COLUMNS if c in df.columns])


def drop_reasons(df: DataFrame, note: str = "meteo") -> DataFrame:
    """How many raw rows each cleaning rule drops (first rule that applies), and how many stay."""
    has_time = F.col("horaire").isNull() if "horaire" in df.columns else F.lit(False)
    parsed = parse_notes(df, note)
    reason = (
        F.when(has_time, "no_time")
        .when(F.col(note).eqNullSafe(F.lit(UNKNOWN_NOTE)), "unknown_note")
        .when(F.col(note).isNull(), "no_note")
        .when(F.col("vent").isNull(), "no_wind_direction")
        .when(F.col("houle").isNull(), "no_swell_direction")
        .otherwise("kept")
    )
    return parsed.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
