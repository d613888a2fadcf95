"""Line groups: filter one group, or fan out to all groups in a single pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

# The named groups of lines.
LINE_GROUPS = {
    "VP_frioul_if": [
        "Vieux Port-Frioul", "Frioul-Vieux Port", "Vieux Port-IF",
        "IF-Frioul", "Frioul-IF", "IF-Vieux Port",
    ],
    "Frioul_if": ["Frioul-IF"],
    "VP_frioul": ["Vieux Port-Frioul"],
    "VP_if": ["Vieux Port-IF"],
    "VP_PR": ["Vieux Port-Pointe Rouge"],
    "VP_estaque": ["Vieux Port-Estaque"],
    "PR_goudes": ["Pointe Rouge-Goudes"],
    "Departs": [
        "Vieux Port-Frioul", "Vieux Port-IF", "Vieux Port-Pointe Rouge",
        "Vieux Port-Estaque", "Pointe Rouge-Goudes",
    ],
    "PointeRouge": [
        "Pointe Rouge-Vieux Port", "Vieux Port-Pointe Rouge",
        "Pointe Rouge-Goudes", "Goudes-Pointe Rouge",
    ],
    "Estaque": ["Estaque-Vieux Port", "Vieux Port-Estaque"],
}

# The groups written as extracts.
EXTRACT_GROUPS = ["VP_frioul_if", "Frioul_if", "VP_frioul", "VP_if", "VP_PR", "VP_estaque", "PR_goudes"]


def select_lines(
    df: DataFrame, group: str, groups: Mapping[str, Sequence[str]] = LINE_GROUPS, col: str = "ligne"
) -> DataFrame:
    """Rows of one group's lines; an unknown group fails when the plan is built."""
    if group not in groups:
        raise ValueError(f"group must be one of {sorted(groups)}, got {group!r}")
    return df.where(F.col(col).isin(*groups[group]))


def fan_out_lines(
    df: DataFrame,
    names: Sequence[str] = tuple(EXTRACT_GROUPS),
    groups: Mapping[str, Sequence[str]] = LINE_GROUPS,
    col: str = "ligne",
) -> DataFrame:
    """One output row per (row, group it belongs to), in one pass and without a shuffle.

    The membership is a literal map from line to group names, so no group is re-read.
    """
    unknown = [n for n in names if n not in groups]
    if unknown:
        raise ValueError(f"unknown groups {unknown}")
    members: dict[str, list[str]] = {}
    for name in names:
        for line in groups[name]:
            members.setdefault(line, []).append(name)
    entries = [x for line, found in members.items() for x in (F.lit(line), F.array(*[F.lit(g) for g in found]))]
    return df.select("*", F.explode(F.try_element_at(F.create_map(*entries), F.col(col))).alias("line_group"))
