"""Encoders, scalers and the full crossing preprocessing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F, types as T

from seacast.functions.direction import compass_degrees, direction_parts, mistral, sea_ordinal
from seacast.functions.solar import day_night_minutes
from seacast.functions.timefeat import calendar_columns
from seacast.operators.profile import numeric_columns
from seacast.operators.ordered import running_totals
from seacast.operators.quantiles import clean_double, exact_quantiles
from seacast.session import stored

NOMINAL = ["ligne", "bateau", "ciel", "capitaine"]
REDUCED_PREFIXES = ("ciel_", "bateau_", "capitaine_")
# Columns of a dense one-hot table at most, by default; :func:`one_hot_sparse` has no such bound.
DENSE_COLUMNS = 5_000
#: Categories of a column that every task may hold.
HELD_CATEGORIES = 20_000


def fit_vocabulary(df: DataFrame, cols: Sequence[str], limit: int = DENSE_COLUMNS) -> dict[str, list[str | None]]:
    """Sorted categories of each column, null last, from one distinct pass.

    They become column names, so more than ``limit`` of them is an error that points to the sparse form.
    """
    slots = F.array(*[F.struct(F.lit(i).alias("i"), F.col(quoted(c)).cast("string").alias("v")) for i, c in enumerate(cols)])
    rows = df.select(F.inline(slots)).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} categories in {list(cols)}: use one_hot_sparse")
    out: dict[str, list[str | None]] = {c: [] for c in cols}
    for i, value in sorted(((r["i"], r["v"]) for r in rows), key=lambda p: (p[0], p[1] is None, p[1] or "")):
        out[cols[i]].append(value)
    return out


def one_hot(
    df: DataFrame, vocabulary: Mapping[str, Sequence[str | None]], null_category: bool = True, drop_first: bool = True
) -> DataFrame:
    """0/1 column per category in one projection; the first category is left out.

    Null is its own last category ``<col>_nan`` unless ``null_category=False``; an unknown
    value gives zeros everywhere.
    """
    flags = []
    for col, categories in vocabulary.items():
        kept = [c for c in categories if c is not None or null_category]
        for category in kept[1:] if drop_first else kept:
            same = F.col(quoted(col)).cast("string").eqNullSafe(F.lit(category))
            flags.append(same.cast("int").alias(f"{col}_{'nan' if category is None else category}"))
    return df.select(*[quoted(c) for c in df.columns if c not in vocabulary], *flags)


def quoted(name: str) -> str:
    """A column name as Spark reads it when it may hold dots or backticks."""
    return "`" + name.replace("`", "``") + "`"


def category_codes(df: DataFrame, col: str) -> DataFrame:
    """``category, code``: the distinct values of a column as text, numbered from 0 in their order; null has none.

    The numbers come from running totals over ranges, so a vocabulary of any size stays distributed.
    """
    values = df.select(F.col(quoted(col)).cast("string").alias("category")).where(F.col("category").isNotNull()).distinct()
    counted = running_totals(values, [F.col("category")], {"upto": F.lit(1)})
    return counted.select("category", (F.col("upto") - 1).cast("int").alias("code"))


def with_codes(df: DataFrame, col: str, codes: DataFrame, out: str) -> DataFrame:
    """``df`` with the code of a column's value; null for null and for unknown values."""
    table = codes.select(F.col("category").alias("_category"), F.col("code").alias("_code"))
    joined = df.join(table, F.col(quoted(col)).cast("string") == F.col("_category"), "left")
    return joined.withColumn(out, F.col("_code")).drop("_category", "_code")


def one_hot_sparse(df: DataFrame, col: str, codes: DataFrame, out: str) -> DataFrame:
    """``df`` with a sparse 0/1 vector over all categories of ``codes`` but the first; null, unknown and the first are all zero."""
    size = codes.agg(F.max("code")).first()[0] or 1
    coded = with_codes(df, col, codes, "_at")
    # The encoder leaves out its last number: there go null, unknown values and the first category.
    place = F.when(F.col("_at") > 0, F.col("_at") - 1).otherwise(size).cast("double")
    numbers = df.sparkSession.range(size + 1).select(F.col("id").cast("double").alias("_place"))
    encoder = OneHotEncoder(inputCols=["_place"], outputCols=[out], dropLast=True).fit(numbers)
    return encoder.transform(coded.withColumn("_place", place)).drop("_at", "_place")


def fit_categories(df: DataFrame, cols: Sequence[str], null_category: bool = True) -> DataFrame:
    """``column, category, code``: the distinct values of several columns as text, numbered from 0 in their order, null last.

    All columns share one shuffle of distinct values, pre-aggregated in each task, and one range order, so vocabularies of any size stay
    distributed.
    """
    slots = F.array(*[F.struct(F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("category")) for c in cols])
    values = df.select(F.inline(slots)).distinct()
    values = values if null_category else values.where(F.col("category").isNotNull())
    counted = running_totals(values, [F.col("category").asc_nulls_last()], {"upto": F.lit(1)}, ["column"])
    return stored(counted.select("column", "category", (F.col("upto") - 1).cast("int").alias("code")), "categories")


class SparseLayout:
    """Places of the columns of a sparse matrix: numeric columns first, then the categories of each text column but the first."""

    def __init__(self, numeric: Sequence[str], categories: DataFrame, cols: Sequence[str]):
        self.numeric, self.cols, self.categories = list(numeric), list(cols), categories
        sizes = {r["column"]: r["n"] for r in categories.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.sizes = {c: sizes.get(c, 0) for c in cols}
        self.offsets, at = {}, len(self.numeric)
        for c in cols:
            self.offsets[c], at = at, at + max(self.sizes[c] - 1, 0)
        self.width = at

    def names(self) -> DataFrame:
        """``place, name`` of all columns; a category's name is ``<column>_<category>``, that of null ``<column>_nan``."""
        spark = self.categories.sparkSession
        numeric = spark.createDataFrame(list(enumerate(self.numeric)), "place int, name string")
        offset = F.create_map(*[x for c, at in self.offsets.items() for x in (F.lit(c), F.lit(at))]) if self.cols else None
        if offset is None:
            return numeric
        text = self.categories.where("code > 0")
        return numeric.unionByName(text.select(
            (offset[F.col("column")] + F.col("code") - 1).cast("int").alias("place"), F.concat_ws("_", "column", F.coalesce("category", F.lit("nan"))).alias("name")
        ))

    def coded(self, df: DataFrame) -> DataFrame:
        """``df`` with the code of each text column as ``_code_<i>``; null for unknown values.

        Tasks hold the tables of columns with few categories, so a category with many rows stays where its rows are; large tables carry
        no hint and meet by a sort-merge join with skew split.
        """
        for i, c in enumerate(self.cols):
            table = self.categories.where(F.col("column") == c).select(F.col("category").alias("_category"), F.col("code").alias(f"_code_{i}"))
            table = F.broadcast(table) if self.sizes[c] <= HELD_CATEGORIES else table
            df = df.join(table, F.col(quoted(c)).cast("string").eqNullSafe(F.col("_category")), "left").drop("_category")
        return df

    def entries(self, df: DataFrame, out: str = "entries") -> DataFrame:
        """``df`` with the non-zero cells of its row as an array of (place, value), in the order of places; null numbers count as 0."""
        cells = [F.when(clean_double(quoted(c)) != 0, F.struct(F.lit(i).alias("place"), clean_double(quoted(c)).alias("value"))) for i, c in enumerate(self.numeric)]
        for i, c in enumerate(self.cols):
            code = F.col(f"_code_{i}")
            cells.append(F.when(code > 0, F.struct((code + F.lit(self.offsets[c] - 1)).alias("place"), F.lit(1.0).alias("value"))))
        coded = self.coded(df)
        return coded.select(*[quoted(c) for c in df.columns], F.array_compact(F.array(*cells)).alias(out))

    def vectors(self, df: DataFrame, out: str = "features") -> DataFrame:
        """``df`` with its row of the matrix as one vector, for MLlib; sparse or dense, whichever is smaller.

        The column's metadata holds the number of places alone: MLlib's encoder and assembler would keep a name for each on the driver.
        """
        cells = F.col("_entries")
        sparse = F.struct(F.lit(0).alias("type"), F.lit(self.width).alias("size"), cells["place"].alias("indices"), cells["value"].alias("values"))
        parts = sparse
        if self.width <= self.sparse_from(len(self.numeric) + len(self.cols)):
            value = F.map_from_entries(cells)
            row = F.array(*[F.coalesce(F.try_element_at(value, F.lit(i)), F.lit(0.0)) for i in range(self.width)]).cast("array<double>")
            dense = F.struct(F.lit(1).alias("type"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("array<int>").alias("indices"), row.alias("values"))
            parts = F.when(self.sparse_from(F.size(cells)) < self.width, sparse).otherwise(dense)
        # No expression makes a vector of its parts, but a schema may name vectors.
        vector = F.from_json(F.to_json(F.struct(parts.alias("v"))), T.StructType([T.StructField("v", VectorUDT())]))["v"]
        return self.entries(df, "_entries").select(*[quoted(c) for c in df.columns], vector.alias(out, metadata={"ml_attr": {"num_attrs": self.width}}))

    @staticmethod
    def sparse_from(cells):
        """The width above which MLlib's assembler makes a vector with so many cells a sparse one."""
        return cells * 1.5 + 2.0


def sparse_layout(df: DataFrame, numeric: Sequence[str] | None = None, cols: Sequence[str] | None = None, drop: Sequence[str] = ()) -> SparseLayout:
    """The learned layout of a table: its numeric columns but ``drop``, and its nominal columns, null being a category of its own."""
    numeric = [c for c in numeric_columns(df) if c not in drop] if numeric is None else numeric
    cols = [c for c in NOMINAL if c in df.columns] if cols is None else cols
    return SparseLayout(numeric, fit_categories(df, cols), cols)


def dummies(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One-hot of all text columns, first category dropped, null all zero."""
    numeric = set(numeric_columns(df, with_bool=True))
    text = [f.name for f in df.schema.fields if f.name not in numeric and f.dataType.simpleString() == "string"]
    return one_hot(df, fit_vocabulary(df, cols or text), null_category=False)


def fit_robust(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Median and interquartile range per column; a zero range counts as 1, a column without values stays as it is."""
    out = {}
    for col, q in exact_quantiles(df, cols, [0.25, 0.5, 0.75]).items():
        out[col] = (0.0, 1.0) if q[0.5] is None else (q[0.5], (q[0.75] - q[0.25]) or 1.0)
    return out


def fit_standard(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column; a zero deviation counts as 1."""
    row = df.agg(
        *[F.struct(F.avg(clean_double(c)).alias("m"), F.stddev_pop(clean_double(c)).alias("s")).alias(f"s{i}") for i, c in enumerate(cols)]
    ).first()
    return {c: (row[i]["m"], row[i]["s"] or 1.0) for i, c in enumerate(cols) if row[i]["m"] is not None}


def scale(df: DataFrame, fitted: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(x - center) / scale with the learned pair of each column."""
    return df.withColumns({c: (clean_double(c) - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items()})


def fit_preprocess(df: DataFrame, numeric: Sequence[str] | None = None, categorical: Sequence[str] | None = None):
    """Learned robust scales and vocabularies; no column at all is an error."""
    if numeric is None or categorical is None:
        numeric = numeric_columns(df)
        categorical = [c for c in df.columns if c not in numeric]
    if not numeric and not categorical:
        raise ValueError("no numeric or categorical column")
    scales = fit_robust(df, numeric) if numeric else {}
    return scales, (fit_vocabulary(df, categorical) if categorical else {})


def apply_preprocess(df: DataFrame, fitted) -> DataFrame:
    """Robust-scaled numeric columns and one-hot categories, nothing else."""
    scales, vocabulary = fitted
    return one_hot(scale(df.select(*scales, *vocabulary), scales), vocabulary)


def label_encode(df: DataFrame, col: str, out: str) -> DataFrame:
    """Sorted classes to 0..k-1, by a join with the table of classes; null stays null."""
    return with_codes(df, col, category_codes(df, col), out)


def crossing_features(df: DataFrame) -> DataFrame:
    """Calendar, day/night, sea, and mistral features; the raw direction columns go."""
    df = df.withColumns(calendar_columns(df))
    if "horaire" in df.columns:
        df = day_night_minutes(df)
    out = {}
    if "mer" in df.columns:
        out["mer"] = sea_ordinal(F.col("mer"))
    if "vent" in df.columns:
        out["vent_mistral"] = mistral(compass_degrees(F.col("vent")))
    if "houle" in df.columns:
        out["houle_mistral"] = mistral(F.col("houle"))
    return df.withColumns(out).drop("annulation_motif", "vent", "houle")


def direction_columns(df: DataFrame, col: str, degrees) -> DataFrame:
    """``<col>_deg``, ``_rad``, ``_x``, ``_y`` and the mistral flag."""
    df = df.withColumn(f"{col}_deg", degrees)
    parts = direction_parts(F.col(f"{col}_deg"))
    return df.withColumns({f"{col}_{k}": v for k, v in parts.items()}).withColumn(
        f"{col}_mistral", mistral(F.col(f"{col}_deg"))
    )


def preprocess_crossings(df: DataFrame, vocabulary: Mapping[str, Sequence[str | None]] | None = None) -> DataFrame:
    """Features plus one-hot of the nominal columns that are present."""
    nominal = [c for c in NOMINAL if c in df.columns]
    vocabulary = fit_vocabulary(df, nominal) if vocabulary is None else vocabulary
    return one_hot(crossing_features(df), vocabulary)


def drop_prefixed(df: DataFrame, prefixes: Sequence[str] = REDUCED_PREFIXES) -> DataFrame:
    """Without the columns of the named families."""
    return df.select(*[quoted(c) for c in df.columns if not c.startswith(tuple(prefixes))])


def model_tables(df: DataFrame, vocabulary=None) -> dict[str, DataFrame]:
    """The processed, numeric and reduced tables."""
    processed = preprocess_crossings(df, vocabulary)
    numeric = processed.select(*[quoted(c) for c in numeric_columns(processed, with_bool=True)])
    return {"processed": processed, "numeric": numeric, "reduced": drop_prefixed(numeric)}


def model_matrix(df: DataFrame, target: str = "annulation", keys: Sequence[str] = ()) -> DataFrame:
    """Numeric features, then the target (and the row keys for joining back)."""
    features = [c for c in numeric_columns(df) if c != target and c not in keys]
    return df.select(*[quoted(c) for c in (*keys, *features, target)])
