"""Every registered query, next to its DuckDB text where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its function name."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def r6(df: DataFrame, *cols: str) -> DataFrame:
    """Six digits for computed doubles (all double columns by default)."""
    names = cols or [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(F.col(c), 6) for c in names})


def load() -> None:
    """Imports the query modules, which register themselves."""
    from seacast.plans import queries_crossing, queries_exact, queries_files, queries_model, queries_table, queries_weather, queries_wide  # noqa: F401
