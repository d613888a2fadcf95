"""Classification and regression metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seacast.operators.ordered import running_totals

SCORES = ["accuracy", "precision", "recall", "f1"]


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def binary_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """One row: confusion counts, accuracy, precision, recall, F1 (a zero division gives 0)."""
    t, p = F.col(y_true) == 1, F.col(y_pred) == 1
    counts = df.agg(
        F.count_if(~t & ~p).alias("tn"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(t & p).alias("tp"),
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns(
        {
            "n": tn + fp + fn + tp,
            "accuracy": _ratio(tp + tn, tn + fp + fn + tp),
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _ratio(tp * 2, tp * 2 + fp + fn),
            "target_rate": _ratio(tp + fn, tn + fp + fn + tp),
        }
    )


def confusion_matrix(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """``label, prediction, n`` for the pairs that occur; predictions take the label's type."""
    kind = df.schema[y_true].dataType
    return df.groupBy(F.col(y_true).alias("label"), F.col(y_pred).cast(kind).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_report(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted rows."""
    cells = confusion_matrix(df, y_true, y_pred)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("label").cast("string").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.alias("tp")),
                F.struct(F.col("prediction").cast("string").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")),
            )
        )
    )
    per_class = (
        sides.groupBy("class")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
        .select(
            "class",
            _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
            _ratio(F.col("tp"), F.col("support")).alias("recall"),
            _ratio(F.col("tp") * 2, F.col("predicted") + F.col("support")).alias("f1"),
            "support",
            "tp",
        )
    )
    total = F.sum("support")

    def weighted(c: str) -> Column:
        return _ratio(F.sum(F.col(c) * F.col("support")), total)

    def line(name: str, p: Column, r: Column, f: Column) -> Column:
        zero = F.lit(0.0)
        values = {"precision": p, "recall": r, "f1": f}
        scores = [F.coalesce(v, zero).alias(k) for k, v in values.items()]
        return F.struct(F.lit(name).alias("class"), *scores, total.alias("support"))

    accuracy = _ratio(F.sum("tp"), total)
    summary = per_class.agg(
        F.array(
            line("accuracy", accuracy, accuracy, accuracy),
            line("macro avg", F.avg("precision"), F.avg("recall"), F.avg("f1")),
            line("weighted avg", weighted("precision"), weighted("recall"), weighted("f1")),
        ).alias("rows")
    ).select(F.inline("rows"))
    return per_class.drop("tp").unionByName(summary)


def _score_counts(df: DataFrame, y_true: str, score: str) -> DataFrame:
    return df.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(y_true) == 1).alias("pos"), F.count_if(F.col(y_true) == 0).alias("neg")
    )


def _score_totals(df: DataFrame, y_true: str, score: str) -> DataFrame:
    return running_totals(
        _score_counts(df, y_true, score), [F.desc("threshold")], {"tps": F.col("pos"), "fps": F.col("neg")}
    )


def roc_points(df: DataFrame, y_true: str = "y_true", score: str = "score") -> DataFrame:
    """Every point of the ROC curve, the origin (threshold infinity) included."""
    points = _score_totals(df, y_true, score)
    n_pos, n_neg = df.agg(F.count_if(F.col(y_true) == 1), F.count_if(F.col(y_true) == 0)).first()
    origin = df.sparkSession.createDataFrame([(float("inf"), 0, 0)], "threshold double, tps long, fps long")
    return (
        points.select(F.col("threshold").cast("double").alias("threshold"), "tps", "fps")
        .unionByName(origin)
        .select(
            "threshold",
            "tps",
            "fps",
            _ratio(F.col("tps"), F.lit(n_pos)).alias("tpr"),
            _ratio(F.col("fps"), F.lit(n_neg)).alias("fpr"),
        )
    )


def roc_auc(df: DataFrame, y_true: str = "y_true", score: str = "score") -> DataFrame:
    """Area under the curve: each score's negatives times the positives above it, ties half."""
    points = _score_totals(df, y_true, score)
    area = F.sum(F.col("neg") * (F.col("tps") - F.col("pos") / 2.0))
    return points.agg(F.try_divide(area, F.sum("pos") * F.sum("neg")).alias("auc"))


def regression_metrics(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """R2, RMSE and MAE from one pass."""
    error = F.col(y_true) - F.col(y_pred)
    sse, sst = F.sum(error * error), F.var_pop(y_true) * F.count(y_true)
    return df.where(F.col(y_true).isNotNull() & F.col(y_pred).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        (F.lit(1.0) - F.try_divide(sse, sst)).alias("r2"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
    )
