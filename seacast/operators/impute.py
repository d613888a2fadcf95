"""Imputation and the reusable fit/apply cleaning chain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from seacast.functions.text import replace_values, to_number
from seacast.operators.profile import modes, numeric_columns, string_columns
from seacast.operators.quantiles import clean_double, exact_quantiles


def medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Exact median of each column."""
    return {c: q[0.5] for c, q in exact_quantiles(df, cols, [0.5]).items()}


def impute_numeric(df: DataFrame, cols: Sequence[str] | None = None, strategy: str = "median") -> DataFrame:
    """Fills nulls of numeric columns with the median, the mean or zero."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    if strategy == "median":
        values = medians(df, cols)
    elif strategy == "mean":
        row = df.agg(*[F.avg(clean_double(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        values = {c: row[i] for i, c in enumerate(cols)}
    elif strategy == "zero":
        values = dict.fromkeys(cols, 0.0)
    else:
        raise ValueError(f"strategy must be 'median', 'mean' or 'zero', got {strategy!r}")
    return _fill(df, values)


def _fill(df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    """Coalesce per column in one projection; integers widen to double where needed, NaN counts as null."""
    fractions = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    known = {c: F.when(~F.isnan(c), F.col(c)) if c in fractions else F.col(c) for c in values}
    return df.withColumns({c: F.coalesce(known[c], F.lit(v)) for c, v in values.items() if v is not None})


def impute_categorical(df: DataFrame, cols: Sequence[str] | None = None, fill: str = "missing") -> DataFrame:
    return _fill(df, {c: fill for c in (cols if cols is not None else string_columns(df))})


def fit_modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """Mode of each column as text; a column without values has none."""
    return {r["column"]: r["mode"] for r in modes(df, cols).collect()} if cols else {}


def impute_mode(df: DataFrame, cols: Sequence[str], learned: Mapping[str, str] | None = None) -> DataFrame:
    """Fills nulls with the mode learned here or on another table."""
    learned = fit_modes(df, cols) if learned is None else learned
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(learned[c]).cast(df.schema[c].dataType)) for c in cols if c in learned}
    )


def high_na_columns(df: DataFrame, threshold: float) -> list[str]:
    """Columns whose null share is strictly above the threshold."""
    row = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]
    ).first()
    n = row["_n"]
    return [c for i, c in enumerate(df.columns) if n and (n - row[f"c{i}"]) / n > threshold]


def _as_number(df: DataFrame, col: str) -> Column:
    if isinstance(df.schema[col].dataType, T.NumericType):
        return F.col(col).cast("double")
    return to_number(F.col(col))


def clean_data(
    df: DataFrame, config: Mapping[str, Any], stats: Mapping[str, Any] | None = None
) -> tuple[DataFrame, dict[str, Any]]:
    """Configurable cleaning; statistics learned on one table can be applied to another.

    Steps, each skipped when not configured: drop high-null columns (``drop_na_threshold``),
    modes (``binary_cols``), replace then median (``floor_col``, ``floor_replace``), medians
    (``numeric_median_cols``), values below a limit to null then median (``rent_col``,
    ``rent_invalid_below``). All medians come from one set of passes unless a column is
    treated by two steps; then the later step sees the earlier one's result. Statistics that are
    passed in are only applied: they are not changed, and a column they do not know is left as it is.
    """
    learn = stats is None
    stats = {k: dict(v) if isinstance(v, Mapping) else v for k, v in (stats or {}).items()}
    if config.get("drop_na_threshold") is not None:
        if learn:
            stats["cols_to_drop"] = high_na_columns(df, config["drop_na_threshold"])
        df = df.drop(*stats.get("cols_to_drop", []))
    binary = [c for c in config.get("binary_cols", []) if c in df.columns]
    if binary:
        if learn:
            stats["bin_modes"] = fit_modes(df, binary)
        df = impute_mode(df, binary, stats.get("bin_modes", {}))

    steps: list[tuple[str, str | None, str, dict]] = []
    if config.get("floor_col") in df.columns:
        key = config.get("floor_median_key", "floor_median")
        steps.append((key, None, config["floor_col"], {"replace": config.get("floor_replace")}))
    for col in config.get("numeric_median_cols", []):
        if col in df.columns:
            steps.append((config.get("numeric_median_key", "num_medians"), col, col, {}))
    if config.get("rent_col") in df.columns:
        key = config.get("rent_median_key", "rent_median")
        steps.append((key, None, config["rent_col"], {"below": config.get("rent_invalid_below")}))

    while steps:
        level, seen = [], set()
        while steps and steps[0][2] not in seen:
            seen.add(steps[0][2])
            level.append(steps.pop(0))
        casts = {}
        for _, _, col, how in level:
            if how.get("replace"):
                value = to_number(replace_values(F.col(col), how["replace"]))
            else:
                value = _as_number(df, col)
            if how.get("below") is not None:
                value = F.when(value >= F.lit(float(how["below"])), value)
            casts[col] = value
        df = df.withColumns(casts)
        missing = level if learn else []
        learned = medians(df, [s[2] for s in missing])
        for key, sub, col, _ in missing:
            if sub is None:
                stats[key] = learned[col]
            else:
                stats.setdefault(key, {})[sub] = learned[col]
        values = {col: stats.get(key) if sub is None else stats.get(key, {}).get(sub) for key, sub, col, _ in level}
        df = _fill(df, values)
    return df, stats
