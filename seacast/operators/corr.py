"""Correlation: matrices, screening, pruning and principal components."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from seacast.operators.profile import numeric_columns
from seacast.operators.quantiles import clean_double
from seacast.operators.ranks import kendall_pairs, pair_ranks

def _as_rows(items: list[Column], row: DataFrame) -> DataFrame:
    return row.select(F.inline(F.array(*items)))


def corr_pairs(df: DataFrame, cols: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """``var_a, var_b, corr`` of every column pair a < b (in column order)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    if method == "spearman":
        return _spearman_pairs(df, cols)
    if method == "kendall":
        return kendall_pairs(df, cols)
    if method != "pearson":
        raise ValueError(f"method must be 'pearson', 'spearman' or 'kendall', got {method!r}")
    return _gram_pairs(df, cols, *np.triu_indices(len(cols), 1))


def _gram_pairs(df: DataFrame, cols: list[str], left: np.ndarray, right: np.ndarray) -> DataFrame:
    """Pairwise-complete Pearson of the column pairs (left, right) from per-batch Gram sums; NaN counts as null.

    Each Arrow batch adds to k x k sums in its task; a task emits one row per pair once, so the
    shuffle depends on the pairs and the number of tasks only. Values are centred on the column
    means first. A constant or empty pair gives null.
    """
    values = df.select(*[clean_double(c).alias(f"c{i}") for i, c in enumerate(cols)])
    means = values.agg(*[F.avg(c).alias(c) for c in values.columns]).first()
    shift = np.array([0.0 if m is None else m for m in means])

    def gram(batches):
        total = None
        for batch in batches:
            x = batch.to_numpy(dtype="float64", na_value=np.nan) - shift
            known = (~np.isnan(x)).astype("float64")
            x = np.where(known > 0, x, 0.0)
            sums = np.stack(
                [known.T @ known, x.T @ known, known.T @ x, (x * x).T @ known, known.T @ (x * x), x.T @ x]
            )
            total = sums if total is None else total + sums
        if total is not None:
            picked = [t[left, right] for t in total]
            yield pd.DataFrame(dict(zip(["n", "sx", "sy", "sxx", "syy", "sxy"], picked)) | {"i": left, "j": right})

    schema = "n double, sx double, sy double, sxx double, syy double, sxy double, i int, j int"
    sums = (
        values.mapInPandas(gram, schema)
        .groupBy("i", "j")
        .agg(*[F.sum(c).alias(c) for c in ["n", "sx", "sy", "sxx", "syy", "sxy"]])
    )
    n = F.col("n")
    # What rounding leaves of the spread of a constant column is far below this share of its squares.
    wide = {v: n * F.col(f"s{v}{v}") - F.col(f"s{v}") * F.col(f"s{v}") for v in "xy"}
    none = (wide["x"] <= n * F.col("sxx") * 1e-12) | (wide["y"] <= n * F.col("syy") * 1e-12)
    spread = F.when(~none, F.sqrt(F.greatest(wide["x"], F.lit(0.0)) * F.greatest(wide["y"], F.lit(0.0))))
    names = F.array(*[F.lit(c) for c in cols])
    return sums.select(
        F.get(names, F.col("i")).alias("var_a"),
        F.get(names, F.col("j")).alias("var_b"),
        F.try_divide(n * F.col("sxy") - F.col("sx") * F.col("sy"), spread).alias("corr"),
    )


def _spearman_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson of the average ranks that the columns of a pair have among the rows that know both."""
    rows, names, left, right, pairs = pair_ranks(df, cols)
    found = _gram_pairs(rows, names, np.array(left, np.int64), np.array(right, np.int64))
    told = F.create_map(*[x for (a, b), i, j in zip(pairs, left, right) for x in (F.lit(f"{names[i]} {names[j]}"), F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b")))])
    return found.select(F.element_at(told, F.concat_ws(" ", "var_a", "var_b")).alias("of"), "corr").select("of.*", "corr")


def corr_matrix(df: DataFrame, cols: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """Full matrix in long form, the diagonal included (null where a column is constant)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    pairs = corr_pairs(df, cols, method)
    both = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("var_a"), F.col("var_b"), F.col("corr")),
                F.struct(F.col("var_b").alias("var_a"), F.col("var_a").alias("var_b"), F.col("corr")),
            )
        )
    )
    spread = df.agg(*[F.stddev_pop(clean_double(c)).alias(f"s{i}") for i, c in enumerate(cols)])
    diagonal = _as_rows(
        [
            F.struct(
                F.lit(c).alias("var_a"),
                F.lit(c).alias("var_b"),
                F.when(F.col(f"s{i}") > 0, F.lit(1.0)).alias("corr"),
            )
            for i, c in enumerate(cols)
        ],
        spread,
    )
    return both.unionByName(diagonal)


def collinear_pairs(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.8) -> DataFrame:
    """Column pairs with absolute correlation strictly above the threshold, strongest first."""
    return (
        corr_pairs(df, cols)
        .select("var_a", "var_b", F.abs("corr").alias("corr"))
        .where(F.col("corr") > threshold)
        .orderBy(F.desc("corr"), "var_a", "var_b")
    )


def target_corr(df: DataFrame, target: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Signed correlation of each numeric column with the target, highest first."""
    cols = [c for c in (cols if cols is not None else numeric_columns(df)) if c != target]
    every = np.arange(len(cols))
    pairs = _gram_pairs(df, [*cols, target], every, np.full(len(cols), len(cols)))
    out = pairs.select(F.col("var_a").alias("variable"), "corr")
    return out.orderBy(F.desc_nulls_last("corr"), "variable")


def target_corr_top(df: DataFrame, target: str, cols: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """The ``n`` columns with the strongest absolute correlation with the target."""
    return (
        target_corr(df, target, cols)
        .select("variable", F.abs("corr").alias("corr"))
        .orderBy(F.desc_nulls_last("corr"), "variable")
        .limit(n)
    )


def top_sub_matrix(df: DataFrame, target: str, cols: Sequence[str] | None = None, n: int = 15) -> DataFrame:
    """Correlation matrix of the target and its ``n`` strongest columns."""
    names = [r["variable"] for r in target_corr_top(df, target, cols, n).collect()]
    return corr_matrix(df, [*names, target])


def modality_corr(df: DataFrame, variable: str, target: str) -> DataFrame:
    """Correlation of each category's indicator with the target, without building indicators.

    Needs per category only its count and the sums of the target.
    """
    y = clean_double(target)
    known = df.where(y.isNotNull())
    total = known.agg(F.count(y).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("ss")).first()
    n, s = F.lit(float(total["n"])), F.lit(total["s"] or 0.0)
    spread_y = (total["n"] * (total["ss"] or 0.0)) - (total["s"] or 0.0) ** 2
    groups = known.groupBy(F.col(variable).alias("modality")).agg(F.count(y).cast("double").alias("n"), F.sum(y).alias("s"))
    top = n * F.col("s") - F.col("n") * s
    spread = F.sqrt(F.col("n") * (n - F.col("n")) * F.lit(max(spread_y, 0.0)))
    return groups.select("modality", F.try_divide(top, spread).alias("corr"))


def prune_plan(df: DataFrame, target: str, threshold: float = 0.90) -> DataFrame:
    """``variable, target_corr, dropped`` of each numeric feature.

    Of each pair above the threshold the feature less correlated with the target goes; on a
    tie the earlier one goes. Every pair is judged on its own: a feature already marked still
    competes, so the result does not depend on the order of the pairs. One pass computes the
    matrix of features and target; it has one row per column pair, whatever the table's
    length, and is kept as such.
    """
    cols = [c for c in numeric_columns(df) if c != target]
    matrix = corr_pairs(df, [*cols, target])
    matrix = df.sparkSession.createDataFrame(matrix.collect(), matrix.schema)
    strength = matrix.where(F.col("var_b") == target).select(
        F.col("var_a").alias("variable"), F.abs("corr").alias("strength")
    )
    pairs = matrix.where((F.col("var_b") != target) & (F.abs("corr") > threshold))
    judged = pairs.join(
        strength.withColumnsRenamed({"variable": "var_a", "strength": "a"}), "var_a"
    ).join(strength.withColumnsRenamed({"variable": "var_b", "strength": "b"}), "var_b")
    losers = judged.select(
        F.when(F.col("a") > F.col("b"), F.col("var_b")).otherwise(F.col("var_a")).alias("variable")
    ).distinct()
    return strength.join(losers.withColumn("dropped", F.lit(True)), "variable", "left").select(
        "variable", "strength", F.coalesce("dropped", F.lit(False)).alias("dropped")
    )


def select_best_features(df: DataFrame, target: str, threshold: float = 0.90) -> DataFrame:
    """``df`` without the features that :func:`prune_plan` drops; other columns stay."""
    drop = [r["variable"] for r in prune_plan(df, target, threshold).where("dropped").collect()]
    return df.drop(*drop)


def scatter_points(df: DataFrame, target: str, cols: Sequence[str], log_target: bool = False) -> DataFrame:
    """``variable, x, y`` point rows of each column against the target; null x left out."""
    y = F.col(target).cast("double")
    points = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in cols])
    return df.select(F.inline(points), (F.log1p(y) if log_target else y).alias("y")).where(F.col("x").isNotNull())


def fit_pca(df: DataFrame, cols: Sequence[str], k: int | None = None):
    """PCA model of the complete rows of ``cols``."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    vectors = VectorAssembler(inputCols=list(cols), outputCol="features").transform(rows)
    return PCA(k=k or len(cols), inputCol="features", outputCol="components").fit(vectors)


def pca_scree(df: DataFrame, cols: Sequence[str], k: int | None = None) -> DataFrame:
    """Explained and cumulative variance share per component."""
    shares = [float(v) for v in fit_pca(df, cols, k).explainedVariance]
    rows = [(i + 1, share, float(sum(shares[: i + 1]))) for i, share in enumerate(shares)]
    return df.sparkSession.createDataFrame(rows, "component int, explained double, cumulative double")


def pca_loadings(df: DataFrame, cols: Sequence[str], components: tuple[int, int] = (0, 1)) -> DataFrame:
    """Loadings of two components per variable; the largest loading of each is made positive."""
    model = fit_pca(df, cols, max(components) + 1)
    matrix = model.pc.toArray()[:, list(components)]
    signs = [1.0 if col[np.argmax(np.abs(col))] >= 0 else -1.0 for col in matrix.T]
    shares = [float(model.explainedVariance[c]) for c in components]
    rows = [
        (name, float(matrix[i, 0] * signs[0]), float(matrix[i, 1] * signs[1]), shares[0], shares[1])
        for i, name in enumerate(cols)
    ]
    return df.sparkSession.createDataFrame(
        rows, "variable string, loading_x double, loading_y double, share_x double, share_y double"
    )
