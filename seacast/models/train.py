"""MLlib training, scoring and search."""

from __future__ import annotations

import itertools
import random
from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool
from typing import Any, NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, functions as F

from seacast.functions.direction import lookup, weather_ratios
from seacast.models.kernel import RandomFourier
from seacast.models.metrics import binary_metrics, class_report, confusion_matrix, regression_metrics
from seacast.models.neighbours import knn_vote
from seacast.operators.encode import fit_vocabulary
from seacast.operators.split import balanced_weights, split_stratified, stratified_folds
from seacast.schemas import MEASURES
from seacast.session import stored

# The model's weather features (wind direction is collected but not used).
BASE_FEATURES = [m for m in MEASURES if m != "wind_direction_dominant"]
RATIO_FEATURES = ["wave_to_swell_ratio", "total_wave_energy", "wind_to_wave_ratio", "temp_range"]
WEATHER_FEATURES = BASE_FEATURES + RATIO_FEATURES


def assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


def forest(label: str, trees: int = 100, depth: int | None = 10, min_split: int = 5, seed: int = 42, weight: str | None = None):
    """Random forest; unlimited depth becomes MLlib's limit of 30.

    MLlib bounds the rows of a leaf, not of a split: two leaves of ``min_split // 2`` rows
    are the closest setting.
    """
    model = RandomForestClassifier(
        labelCol=label, featuresCol="features", numTrees=trees, maxDepth=30 if depth is None else depth,
        minInstancesPerNode=max(1, min_split // 2), featureSubsetStrategy="sqrt", seed=seed,
    )
    return model.setWeightCol(weight) if weight else model


def classifiers(label: str, seed: int = 42) -> dict[str, Any]:
    """The trained classifiers of the model comparison (:func:`compare_models` adds :func:`knn_vote`)."""
    return {
        "logistic": LogisticRegression(labelCol=label, maxIter=100),
        "forest": forest(label, seed=seed),
        "tree": DecisionTreeClassifier(labelCol=label, maxDepth=10, seed=seed),
        "svm": rbf_svm(label, seed=seed),
    }


def rbf_svm(label: str, features: str = "features", size: int = 256, width: int = len(WEATHER_FEATURES), seed: int = 42) -> Pipeline:
    """Support vector machine with a radial basis kernel: standardised features, their random Fourier features (gamma is
    1 / width, as the features have variance 1), and a linear machine on them."""
    scaled = StandardScaler(inputCol=features, outputCol="_scaled", withMean=True, withStd=True)
    wide = RandomFourier(inputCol="_scaled", outputCol="_fourier", gamma=1.0 / width, size=size, seed=seed)
    return Pipeline(stages=[scaled, wide, LinearSVC(labelCol=label, featuresCol="_fourier", maxIter=50, standardization=False)])


def with_ratios(df: DataFrame) -> DataFrame:
    """Adds the derived weather features that are not there yet."""
    return df.withColumns({k: v for k, v in weather_ratios().items() if k not in df.columns})


#: Rows of a forest's training table that one task passes over.
FOREST_ROWS = 100_000


def spread(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``cols`` of a forest's training rows, in partitions of ``FOREST_ROWS`` rows; a table of so many at most stays as it is.

    A narrow table of millions of rows is one small file, so one task would grow all trees. The number of tasks follows
    from the rows alone and they are in order there, so the sampled rows do not depend on the machines.
    """
    rows = train.select(*dict.fromkeys(cols))
    parts = -(-rows.count() // FOREST_ROWS)
    return rows.repartition(parts).sortWithinPartitions(*rows.columns) if parts > 1 else rows


def fit_model(train: DataFrame, features: Sequence[str], estimator) -> PipelineModel:
    if isinstance(estimator, RandomForestClassifier):
        weight = [estimator.getWeightCol()] if estimator.isDefined(estimator.weightCol) else []
        train = spread(train, [*features, estimator.getLabelCol(), *weight])
    return Pipeline(stages=[assembler(features), estimator]).fit(train)


def model_features(model: PipelineModel) -> list[str]:
    return model.stages[0].getInputCols()


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds predicted class, probability of class 1 and confidence; null features count as 0.

    The derived ratios are computed from the raw measures. A missing feature column fails
    when the plan is built. Works on batch and streaming frames alike.
    """
    features = model_features(model)
    kept = df.columns
    if set(RATIO_FEATURES) & set(features) - set(df.columns) and set(BASE_FEATURES) <= set(df.columns):
        df = with_ratios(df)
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"missing features {missing}")
    filled = {f"_in_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features}
    scored = model.copy({model.stages[0].inputCols: list(filled)}).transform(df.withColumns(filled))
    probability = vector_to_array("probability")
    return scored.select(
        *kept,
        F.col("prediction").cast("int").alias("annulation_predicted"),
        probability[1].alias("annulation_probability"),
        F.array_max(probability).alias("confidence"),
    )


def _one_row(df: DataFrame) -> DataFrame:
    """A one-row result computed now, so that it does not repeat its training input later."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def train_weather_model(
    df: DataFrame, keys: Sequence[str], label: str = "annulation_binary", features: Sequence[str] = tuple(WEATHER_FEATURES), estimator=None
):
    """Stratified split, fit on train, metrics on test. Returns model and one-row metrics."""
    parts = split_stratified(stored(df, "training"), label, keys)
    model = fit_model(parts.where("split = 'train'"), features, estimator or forest(label))
    scored = model.transform(parts.where("split = 'test'"))
    return model, _one_row(binary_metrics(scored, label, "prediction"))


def logistic_baseline(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], test: float = 0.25) -> DataFrame:
    """Test metrics of one logistic regression, one row."""
    parts = split_stratified(stored(df.select(*keys, *features, label), "training"), label, keys, test)
    model = fit_model(parts.where("split = 'train'"), features, LogisticRegression(labelCol=label, maxIter=100))
    return _one_row(binary_metrics(model.transform(parts.where("split = 'test'")), label, "prediction"))


def compare_models(
    df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], names: Sequence[str] | None = None
) -> DataFrame:
    """Test metrics of each classifier and of the nearest-neighbour vote (``knn``), one row per model, best accuracy first."""
    parts = split_stratified(stored(df.select(*keys, *features, label), "training"), label, keys)
    train, test = parts.where("split = 'train'"), parts.where("split = 'test'")
    rows = None
    for name, estimator in [*classifiers(label).items(), ("knn", None)]:
        if names is not None and name not in names:
            continue
        if estimator is None:
            scored = knn_vote(train, test, features, label, keys[0]).join(test.select(keys[0], label), keys[0])
        else:
            scored = fit_model(train, features, estimator).transform(test)
        row = _one_row(binary_metrics(scored, label, "prediction")).withColumn("model", F.lit(name))
        rows = row if rows is None else rows.unionByName(row)
    return rows.orderBy(F.desc("accuracy"), "model")


# --- search -----------------------------------------------------------------

_METRICS = {"accuracy": "accuracy", "recall": "recallByLabel", "f1": "fMeasureByLabel", "precision": "precisionByLabel"}


def scorer(label: str, scoring: str = "accuracy"):
    """Evaluator of a score; recall, precision and F1 are those of class 1."""
    if scoring in ("r2", "rmse", "mae"):
        return RegressionEvaluator(labelCol=label, metricName=scoring)
    return MulticlassClassificationEvaluator(labelCol=label, metricName=_METRICS[scoring], metricLabel=1.0)


def logistic_params(c: float, penalty: str, n: int) -> dict[str, Any]:
    """Inverse strength ``C`` and penalty as MLlib parameters."""
    return {"regParam": 1.0 / (c * n), "elasticNetParam": 1.0 if penalty == "l1" else 0.0, "standardization": False}


def param_maps(estimator, grid: Mapping[str, Sequence[Any]], draws: int | None = None, seed: int = 42):
    """All combinations of a grid as MLlib's parameters, or a seeded sample of ``draws`` of them."""
    return [{estimator.getParam(n): v for n, v in chosen.items()} for chosen in combinations_of(grid, draws, seed)]


class Searched(NamedTuple):
    """What a search gives, named as the fitted validator's parts."""

    maps: list[dict]
    avgMetrics: list[float]
    bestModel: Any

    def getEstimatorParamMaps(self) -> list[dict]:
        return self.maps


def search(train: DataFrame, features: Sequence[str], estimator, grid, label: str, keys: Sequence[str],
           scoring: str = "accuracy", folds: int = 5, draws: int | None = None, seed: int = 42, parallelism: int = 4, more: Sequence[str] = ()):
    """Cross-validated search; ``draws`` makes it a random search.

    ``more`` are columns that the estimator reads besides. A grid with ``class_weight`` (None or 'balanced') sets
    weights from the classes of each fold's training rows, so no fold's test rows take part in them. The folds are written once; the fits of
    a fold run ``parallelism`` at a time. The best set (the first of equal ones) is fitted to all rows.
    """
    rows = stored(train.select(*keys, *features, label, *more), "search")
    vectors = assembler(features).transform(stratified_folds(rows, label, keys, folds, seed))
    if "class_weight" not in grid:
        validator = CrossValidator(
            estimator=estimator, estimatorParamMaps=param_maps(estimator, grid, draws, seed),
            evaluator=scorer(label, scoring), numFolds=folds, foldCol="fold", parallelism=parallelism,
        )
        return validator.fit(vectors)
    vectors = stored(vectors.select(*keys, label, *more, "features", "fold"), "folds")
    sets, evaluator = combinations_of(grid, draws, seed), scorer(label, scoring)

    def fitted(chosen: dict, part: DataFrame):
        params = {estimator.getParam(n): v for n, v in chosen.items() if n != "class_weight"}
        return estimator.copy(params | {estimator.weightCol: "_" + (chosen["class_weight"] or "even")}).fit(part)

    def weighted(part: DataFrame) -> DataFrame:
        return balanced_weights(part, label, "_balanced").withColumn("_even", F.lit(1.0))

    scores = [0.0] * len(sets)
    with ThreadPool(parallelism) as pool:
        for fold in range(folds):
            part = stored(weighted(vectors.where(F.col("fold") != fold)), "fold")
            held = vectors.where(F.col("fold") == fold)
            for k, value in enumerate(pool.map(lambda chosen: evaluator.evaluate(fitted(chosen, part).transform(held)), sets)):
                scores[k] += value / folds
    best = max(range(len(sets)), key=lambda k: (scores[k] if evaluator.isLargerBetter() else -scores[k], -k))
    named = [{SetOf(n): v for n, v in chosen.items()} for chosen in sets]
    return Searched(named, scores, fitted(sets[best], weighted(vectors)))


class SetOf(NamedTuple):
    """A name in a searched set, as a parameter shows it."""

    name: str


# The searched forests and how many sets are drawn. Unlimited depth is MLlib's 30.
FOREST_GRID = {"trees": [100, 300, 500], "depth": [None, 10, 20], "min_split": [2, 5], "min_leaf": [1, 2], "class_weight": [None, "balanced"]}
FOREST_DRAWS, FOREST_FOLDS = 20, 3


def search_forests(train: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], grid: Mapping[str, Sequence[Any]] = FOREST_GRID,
                   draws: int | None = FOREST_DRAWS, folds: int = FOREST_FOLDS, scoring: str = "recall", seed: int = 42, parallelism: int = 4):
    """Random search over forests for the recall of class 1.

    MLlib bounds the rows of a leaf, not of a split, so both bounds of a set become the larger of ``min_leaf`` and half of ``min_split``.
    """
    names = {"trees": "numTrees", "depth": "maxDepth", "class_weight": "class_weight"}
    sets = []
    for chosen in combinations_of(grid, draws, seed):
        one = {names[n]: (30 if n == "depth" and v is None else v) for n, v in chosen.items() if n in names}
        sets.append(one | {"minInstancesPerNode": max(chosen["min_leaf"], chosen["min_split"] // 2)})
    estimator = RandomForestClassifier(labelCol=label, featuresCol="features", featureSubsetStrategy="sqrt", seed=seed)
    return search(train, features, estimator, SetList(sets), label, keys, scoring, folds, parallelism=parallelism)


class SetList(dict):
    """Sets that are already chosen, in place of a grid."""

    def __init__(self, sets: list[dict]):
        super().__init__({n: [s[n] for s in sets] for n in sets[0]})
        self.sets = sets


def combinations_of(grid: Mapping[str, Sequence[Any]], draws: int | None = None, seed: int = 42) -> list[dict[str, Any]]:
    """All combinations of a grid, or a seeded sample of ``draws`` of them."""
    if isinstance(grid, SetList):
        return grid.sets
    names = sorted(grid)
    combos = list(itertools.product(*[grid[n] for n in names]))
    if draws is not None and draws < len(combos):
        combos = random.Random(seed).sample(combos, draws)
    return [dict(zip(names, c)) for c in combos]


def search_scores(spark, model) -> DataFrame:
    """Mean score of each parameter set, best first."""
    rows = [
        ("; ".join(f"{p.name}={v}" for p, v in sorted(params.items(), key=lambda x: x[0].name)), float(s))
        for params, s in zip(model.getEstimatorParamMaps(), model.avgMetrics)
    ]
    return spark.createDataFrame(rows, "params string, score double").orderBy(F.desc("score"), "params")


def cross_val_scores(df: DataFrame, features: Sequence[str], estimator, label: str, keys: Sequence[str], scoring: str = "accuracy", folds: int = 5):
    """Score of each fold of one estimator."""
    rows_in = stored(df.select(*keys, *features, label), "folds")
    vectors = assembler(features).transform(stratified_folds(rows_in, label, keys, folds))
    evaluator = scorer(label, scoring)
    rows = []
    for fold in range(folds):
        model = estimator.fit(vectors.where(F.col("fold") != fold))
        rows.append((fold, float(evaluator.evaluate(model.transform(vectors.where(F.col("fold") == fold))))))
    return df.sparkSession.createDataFrame(rows, "fold int, score double")


def eval_classification(train: DataFrame, test: DataFrame, features: Sequence[str], estimator, label: str, keys: Sequence[str],
                        grid=None, search_type: str = "grid", scoring: str = "accuracy", cv: int = 5, draws: int = 10) -> dict[str, Any]:
    """Fit (with or without a search) and report on the test rows.

    A text label is coded by its sorted training classes; the report shows the class names.
    """
    if search_type not in ("grid", "random"):
        raise ValueError(f"search_type must be 'grid' or 'random', got {search_type!r}")
    classes = None
    if train.schema[label].dataType.simpleString() == "string":
        classes = [c for c in fit_vocabulary(train, [label])[label] if c is not None]
        codes = {c: i for i, c in enumerate(classes)}
        train, test = (df.withColumn(label, lookup(F.col(label), codes)) for df in (train, test))
    if grid is None:
        model = estimator.fit(assembler(features).transform(train))
        cv_results = cross_val_scores(train, features, estimator, label, keys, scoring, cv)
    else:
        found = search(train, features, estimator, grid, label, keys, scoring, cv, draws if search_type == "random" else None)
        model, cv_results = found.bestModel, search_scores(train.sparkSession, found)
    scored = model.transform(assembler(features).transform(test)).withColumn("prediction", F.col("prediction").cast("int"))
    report = class_report(scored, label, "prediction")
    if classes is not None:
        names = {str(i): c for i, c in enumerate(classes)}
        report = report.withColumn("class", F.coalesce(lookup(F.col("class"), names), F.col("class")))
    return {
        "best_params": {p.name: v for p, v in model.extractParamMap().items()},
        "accuracy": scorer(label, "accuracy").evaluate(scored.withColumn("prediction", F.col("prediction").cast("double"))),
        "classification_report": report,
        "confusion_matrix": confusion_matrix(scored, label, "prediction"),
        "cv_results": cv_results,
        "best_model": model,
    }


def evaluate_regression(train: DataFrame, test: DataFrame, features: Sequence[str], estimator, label: str, keys: Sequence[str],
                        grid=None, search_type: str = "grid", scoring: str = "r2", cv: int = 5, draws: int = 10) -> dict[str, Any]:
    """Fit (with or without a search); R2, RMSE and MAE on the test rows."""
    if search_type not in ("grid", "random"):
        raise ValueError(f"search_type must be 'grid' or 'random', got {search_type!r}")
    by_hash = train.withColumn("_one", F.lit(1))
    if grid is None:
        model = estimator.fit(assembler(features).transform(train))
        cv_results = None
    else:
        vectors = assembler(features).transform(stratified_folds(by_hash, "_one", keys, cv))
        maps = param_maps(estimator, grid, draws if search_type == "random" else None)
        found = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=scorer(label, scoring), numFolds=cv, foldCol="fold").fit(vectors)
        model, cv_results = found.bestModel, search_scores(train.sparkSession, found)
    scored = model.transform(assembler(features).transform(test))
    row = regression_metrics(scored, label, "prediction").first()
    return {"best_params": {p.name: v for p, v in model.extractParamMap().items()}, "r2": row["r2"], "rmse": row["rmse"],
            "mae": row["mae"], "cv_results": cv_results, "best_model": model}


def weighted_forest(train: DataFrame, features: Sequence[str], label: str, **options) -> PipelineModel:
    """Forest with balanced class weights."""
    return fit_model(balanced_weights(train, label), features, forest(label, weight="weight", **options))
