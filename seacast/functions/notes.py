"""Weather-note parsing: one free-text note into typed columns.

A note such as ``18° Clair Vent : NW 25 Nds/6 Bft Mer : belle 0,5/0.9m 270° 5s``
has a head (temperature, sky), a wind part and a sea part. All patterns search
(first match, unanchored); an absent group is null. ``(?Ud)`` gives Java the
Unicode classes for blanks and word borders.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The note grammar. ``(?=[VM])`` spares the word-border test elsewhere.
HEAD = r"(?Ud)^(.*?)(?=[VM])\b(Vent|Mer)\b"
WIND_PART = r"(?Ud)(Vent.*?)(?=Mer\b)"
SEA_PART = r"(?Ud)(Mer\s*:?.*)$"
TEMPERATURE_SKY = r"(?Ud)(\d+)°\s*(.*)"
WIND = r"(?Ud)Vent\s*:?\s*([A-Z]{1,3})?\s*(\d+)\s*Nds/?(\d+)\s*Bft"
SEA = (
    r"(?Ud)Mer\s*:?\s*([^\d]+)?\s*(\d+[.,]?\d*)/?(\d+[.,]?\d*)?m?\s*(\d+)?°?\s*(\d+)?s?"
)
GLUED = r"([a-zé])(\d)"

# A control character that no note holds.
SEPARATOR = "\x1f"


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of ``group``, null when the pattern or the group is absent."""
    found = F.regexp_extract(text, pattern, group)
    return F.nullif(found, F.lit(""))


def extract_groups(text: Column, pattern: str, count: int) -> Column:
    """The groups of the first match at places 1 to ``count``, from a single regex evaluation.

    The whole text is rewritten to its groups, each behind a separator, and split there.
    Without a match there is no separator, so the array ends at place 0.
    """
    flags, body = pattern[:5], pattern[5:]
    whole = f"{flags}(?s:^.*?){body}(?s:.*)$"
    marked = F.regexp_replace(text, whole, "".join(f"{SEPARATOR}${i}" for i in range(1, count + 1)))
    return F.split(marked, SEPARATOR, -1)


def decimal_comma(text: Column) -> Column:
    """``0,5`` or ``0.5`` to a double; junk becomes null."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def note_parts(note: Column) -> dict[str, Column]:
    """Head, wind and sea part of a note."""
    return {
        "note_head": extract(note, HEAD),
        "note_wind": extract(note, WIND_PART),
        "note_sea": extract(note, SEA_PART),
    }


def unglue(text: Column) -> Column:
    """Blank between a lower-case letter and the digit glued to it."""
    return F.regexp_replace(text, GLUED, "$1 $2")


def note_groups(head: Column, wind: Column, sea: Column) -> Column:
    """The group arrays of the three parts."""
    return F.struct(
        extract_groups(head, TEMPERATURE_SKY, 2).alias("head_groups"),
        extract_groups(wind, WIND, 3).alias("wind_groups"),
        extract_groups(sea, SEA, 5).alias("sea_groups"),
    )


def note_fields(
    head_groups: Column, wind_groups: Column, sea_groups: Column, trim_state: bool = False
) -> dict[str, Column]:
    """The typed fields from the group arrays.

    The sea-state group is greedy, so a blank before the height stays in the value;
    ``trim_state=True`` removes it so that the ordinal coding recognises the state.
    """

    def group(groups: Column, at: int) -> Column:
        return F.nullif(F.get(groups, F.lit(at)), F.lit(""))

    state = group(sea_groups, 1)
    return {
        "temperature": decimal_comma(group(head_groups, 1)),
        "ciel": F.get(head_groups, F.lit(2)),
        "vent": group(wind_groups, 1),
        "vent_noeud": decimal_comma(group(wind_groups, 2)),
        "vent_beaufort": decimal_comma(group(wind_groups, 3)),
        "mer": F.trim(state) if trim_state else state,
        "houle_dominante": decimal_comma(group(sea_groups, 2)),
        "houle_max": decimal_comma(group(sea_groups, 3)),
        "houle": decimal_comma(group(sea_groups, 4)),
        "houle_periode": decimal_comma(group(sea_groups, 5)),
    }
