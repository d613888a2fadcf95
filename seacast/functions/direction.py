"""Compass, sea-state and derived weather measures."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The 16 compass points in degrees.
COMPASS = {
    "N": 0.0, "NNE": 22.5, "NE": 45.0, "ENE": 67.5,
    "E": 90.0, "ESE": 112.5, "SE": 135.0, "SSE": 157.5,
    "S": 180.0, "SSW": 202.5, "SW": 225.0, "WSW": 247.5,
    "W": 270.0, "WNW": 292.5, "NW": 315.0, "NNW": 337.5,
}

# Sea states from calm to rough.
SEA_STATES = ["ridée", "belle", "peu agitée", "agitée", "forte"]

EPSILON = 1e-5


def lookup(key: Column, mapping: dict) -> Column:
    """Value of ``key`` in a small literal map, null when absent."""
    entries = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.try_element_at(entries, key)


def compass_degrees(point: Column) -> Column:
    return lookup(point, COMPASS)


def direction_parts(degrees: Column) -> dict[str, Column]:
    """Radians and the cosine / sine components of an angle in degrees."""
    radians = F.radians(degrees)
    return {"rad": radians, "x": F.cos(radians), "y": F.sin(radians)}


def mistral(degrees: Column) -> Column:
    """1 for a west-to-north angle (270 to 360, or 0), 0 otherwise and for null."""
    angle = F.pmod(degrees, F.lit(360.0))
    return F.coalesce(((angle >= 270) | (angle == 0)).cast("int"), F.lit(0))


def sea_ordinal(state: Column) -> Column:
    """Rank of the sea state, -1 for an unknown or missing one."""
    codes = {name: code for code, name in enumerate(SEA_STATES)}
    return F.coalesce(lookup(state, codes), F.lit(-1)).cast("byte")


def weather_ratios() -> dict[str, Column]:
    """The four derived weather features."""
    wave, swell = F.col("wave_height_max"), F.col("swell_wave_height_max")
    return {
        "wave_to_swell_ratio": wave / (swell + F.lit(EPSILON)),
        "total_wave_energy": wave + swell,
        "wind_to_wave_ratio": F.col("wind_speed_max") / (wave + F.lit(EPSILON)),
        "temp_range": F.col("temperature_max") - F.col("temperature_min"),
    }
