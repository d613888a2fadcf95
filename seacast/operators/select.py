"""Column dropping and narrowing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

# Value range -> narrower type. Spark has no unsigned types: 0..65535 needs an int.
_INT_TARGETS = [(-32768, 32767, "smallint"), (-2147483648, 2147483647, "int")]


def drop_columns(df: DataFrame, cols: Sequence[str], audit: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """The frame without ``cols`` (each must exist) and the extended audit list."""
    unknown = [c for c in cols if c not in df.columns]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    return df.drop(*cols), [*audit, *cols]


def downcast_plan(df: DataFrame) -> DataFrame:
    """``column, from_type, to_type`` of every numeric column, from one min/max pass."""
    ints = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.LongType, T.IntegerType))]
    plan = [(f.name, "double", "float") for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    if ints:
        row = df.agg(*[F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(f"s{i}") for i, c in enumerate(ints)]).first()
        for i, name in enumerate(ints):
            low, high = row[i]["low"], row[i]["high"]
            source = df.schema[name].dataType.simpleString()
            target = source
            if low is not None:
                if 0 <= low and high <= 65535:
                    target = "int"
                else:
                    target = next((t for a, b, t in _INT_TARGETS if a <= low and high <= b), source)
            plan.append((name, source, target))
    return df.sparkSession.createDataFrame(plan, "column string, from_type string, to_type string")


def downcast(df: DataFrame) -> DataFrame:
    """Doubles to float, integers to the narrowest type that holds their range."""
    plan = downcast_plan(df).where("from_type <> to_type").collect()
    return df.withColumns({r["column"]: F.col(r["column"]).cast(r["to_type"]) for r in plan})
