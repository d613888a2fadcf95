"""End-to-end lifecycles as compositions of operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from seacast.functions.direction import weather_ratios
from seacast.models.train import WEATHER_FEATURES, forest, logistic_baseline, train_weather_model
from seacast.operators.align import align, daily_weather_merge
from seacast.operators.clean import clean_crossings, reorganize
from seacast.operators.daily import binarise, daily_rollup
from seacast.operators.dedupe import consolidate
from seacast.operators.encode import drop_prefixed, dummies, model_matrix, preprocess_crossings
from seacast.operators.ordered import fill_both_ways
from seacast.operators.select import downcast
from seacast.sources.payload import flatten_payloads, read_payloads
from seacast.sources.tables import MONTHLY_ORDER, read_monthly, read_raw_crossings, write_monthly


def crossing_table(spark: SparkSession, path: str) -> DataFrame:
    """Landed log to the clean crossing table."""
    return reorganize(clean_crossings(read_raw_crossings(spark, path)))


def crossing_matrix(clean: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Clean crossings to the crossing-grain model matrix."""
    return model_matrix(preprocess_crossings(clean), keys=keys)


def collect_weather(spark: SparkSession, landing: str, raw_root: str) -> DataFrame:
    """Landed payloads to monthly files; returns the manifest."""
    return write_monthly(flatten_payloads(read_payloads(spark, landing)), raw_root)


def consolidate_weather(spark: SparkSession, raw_root: str) -> DataFrame:
    """Monthly files to one typed row per date, narrow types."""
    landed = read_monthly(spark, raw_root)
    return downcast(consolidate(landed, MONTHLY_ORDER).drop(*MONTHLY_ORDER, "_corrupt_record"))


def training_days(crossings: DataFrame, weather: DataFrame, threshold: float = 0.166) -> DataFrame:
    """Day grain: roll-up joined with weather and the binary label."""
    return binarise(daily_weather_merge(daily_rollup(crossings), weather), threshold=threshold)


def training_crossings(crossings: DataFrame, weather: DataFrame, grain: str = "day") -> DataFrame:
    """Crossing grain: every crossing with the weather of its day (or hour)."""
    return align(crossings, weather, grain)


def weather_features(days: DataFrame, day: str = "jour") -> DataFrame:
    """The 13 weather features with gaps filled along the dates."""
    return fill_both_ways(days.withColumns(weather_ratios()), [day], WEATHER_FEATURES)


def train_days(days: DataFrame, day: str = "jour"):
    """Day-grain model and its test metrics."""
    return train_weather_model(weather_features(days, day), [day])


def train_crossings(table: DataFrame, keys: Sequence[str], target: str = "annulation", trees: int = 200, depth: int | None = None):
    """Crossing-grain fusion model: all non-target, non-key columns, 200 deep trees."""
    encoded = dummies(table).fillna(0)
    matrix = model_matrix(encoded, target, keys)
    features = [c for c in matrix.columns if c != target and c not in keys]
    return train_weather_model(matrix, keys, target, features, forest(target, trees=trees, depth=depth, min_split=2))


def logistic_before_after(clean: DataFrame, keys: Sequence[str], target: str = "annulation", test: float = 0.25) -> DataFrame:
    """Logistic baseline on all encoded features, and again without the wide column families."""
    full = model_matrix(preprocess_crossings(clean), target, keys).fillna(0)
    rows = None
    for name, table in (("full", full), ("reduced", drop_prefixed(full))):
        features = [c for c in table.columns if c != target and c not in keys]
        row = logistic_baseline(table, features, target, keys, test).withColumns(
            {"features": F.lit(name), "n_features": F.lit(len(features))}
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows
