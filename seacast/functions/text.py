"""Text and cast helpers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMERIC_TEXT = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def _latin_table() -> tuple[str, str]:
    """Every one-letter lower-case Latin character with an accent, and its bare letter."""
    accented, bare = [], []
    for code in range(0x00C0, 0x0250):
        char = chr(code)
        base = unicodedata.normalize("NFD", char)
        stripped = "".join(c for c in base if not 0x0300 <= ord(c) <= 0x036F)
        if char == char.lower() and stripped != char and len(stripped) == 1:
            accented.append(char)
            bare.append(stripped)
    return "".join(accented), "".join(bare)


ACCENTED, BARE = _latin_table()
COMBINING = "[\\u0300-\\u036f]"


#: Bytes of text that are Python strings at once.
PIECE = 1 << 20


def _strip_marks():
    """Arrow UDF: decompose, then remove the combining marks U+0300 to U+036F.

    Texts become Python strings a piece of the batch at a time. Made on demand, so that the function travels with the job and the
    workers need no package.
    """
    piece, marks = PIECE, "[\u0300-\u036f]"

    def strip(values: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
        cuts = (np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // piece)) + 1).tolist()
        parts = [pa.array([], pa.string())]
        for a, b in zip([0, *cuts], [*cuts, len(values)]):
            texts = values.slice(a, b - a).to_pylist()
            parts.append(pa.array([t if t is None or t.isascii() else re.sub(marks, "", unicodedata.normalize("NFD", t)) for t in texts], pa.string()))
        return pa.concat_arrays(parts)

    strip.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(strip, T.StringType())


def normalize_text(text: Column, full: bool = False) -> Column:
    """Lower case without accents; ``true`` / ``false`` texts and nulls stay as they are.

    The default covers Latin letters and combining marks with JVM expressions.
    ``full=True`` decomposes every script through an Arrow UDF.
    """
    lowered = F.lower(text)
    if full:
        plain = _strip_marks()(lowered)
    else:
        plain = F.regexp_replace(F.translate(lowered, ACCENTED, BARE), COMBINING, "")
    return F.when(lowered.isin("true", "false"), text).otherwise(plain)


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def normalize_text_columns(df: DataFrame, full: bool = False) -> DataFrame:
    return df.withColumns({c: normalize_text(F.col(c), full) for c in string_columns(df)})


def lower_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Lower-cases the named columns that exist and hold text."""
    text = set(string_columns(df))
    return df.withColumns({c: F.lower(F.col(c)) for c in cols if c in text})


def to_number(text: Column) -> Column:
    """Text to double, null on junk; texts such as ``1d`` are junk, not a number."""
    as_text = text.cast("string")
    return F.when(as_text.rlike(NUMERIC_TEXT), as_text.try_cast("double"))


def non_numeric_rows(df: DataFrame, col: str) -> DataFrame:
    """The non-null values of ``col`` that are not numbers."""
    return df.where(F.col(col).isNotNull() & to_number(F.col(col)).isNull()).select(col)


def keyword_type(df: DataFrame, source: str, mapping: dict[str, str], out: str = "type") -> DataFrame:
    """Value of the first keyword (a pattern, in mapping order) found in ``source``."""
    hits = [F.when(F.col(source).rlike(key), F.lit(value)) for key, value in mapping.items()]
    return df.withColumn(out, F.coalesce(*hits) if hits else F.lit(None).cast("string"))


def bool_to_byte(df: DataFrame, cols: Sequence[str], keep_null: bool = True) -> DataFrame:
    """Booleans (or 0/1) to a nullable byte; ``keep_null=False`` turns null into 0."""
    casts = {c: F.col(c).cast("boolean").cast("byte") for c in cols}
    if not keep_null:
        casts = {c: F.coalesce(v, F.lit(0).cast("byte")) for c, v in casts.items()}
    return df.withColumns(casts)


def replace_values(value: Column, mapping: dict[str, object]) -> Column:
    """Replacement from a small map of texts, other values unchanged."""
    text = value.cast("string")
    entries = F.create_map(*[F.lit(str(x)) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, text), text)
