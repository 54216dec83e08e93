"""Attack classification with Spark ML."""

from __future__ import annotations

import random

from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import dims
from tidewatch.lineage import checkpointed
from tidewatch.operators import ordering as od
from tidewatch.operators.metrics import averages, class_report
from tidewatch.operators.sequences import class_weights, feature_vector

# default search space: value lists per tree parameter
SEARCH_SPACE = {"numTrees": [50, 100, 200], "maxDepth": [4, 6, 8, 10], "subsamplingRate": [0.6, 0.8, 1.0],
                "minInstancesPerNode": [1, 3, 5]}


def _estimator(kind: str, seed: int):
    common = {"featuresCol": "features", "labelCol": "label_no", "weightCol": "weight"}
    if kind == "linear":
        return LogisticRegression(family="multinomial", maxIter=50, regParam=0.01, **common)
    return RandomForestClassifier(numTrees=100, maxDepth=6, seed=seed, **common)


def fit_classifier(train: DataFrame, names: list[str] | None = None, label: str = "attack_type",
                   kind: str = "forest", seed: int = 42, params: dict | None = None) -> Model:
    """Class-weighted multiclass model; labels are indexed in sorted order.

    The model needs a ``features`` vector (:func:`feature_vector`) at prediction.
    """
    # the stages of the fit read their rows several times: stored once, with the model's columns only
    data = checkpointed(feature_vector(class_weights(train, label), names).select(label, "weight", "features"))
    est = _estimator(kind, seed)
    if params:
        est = est.copy({est.getParam(k): v for k, v in params.items()})
    index = StringIndexer(inputCol=label, outputCol="label_no", stringOrderType="alphabetAsc", handleInvalid="keep")
    return Pipeline(stages=[index, est]).fit(data)


def class_names(model: Model) -> list[str]:
    """Class texts in the order of the probability vector."""
    return list(model.stages[0].labels)


class MacroF1(Evaluator):
    """Plain mean of the per-class F1, which Spark ML does not offer."""

    def __init__(self, label: str = "label_no", prediction: str = "prediction"):
        super().__init__()
        self.label, self.prediction = label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        return averages(class_report(dataset, self.prediction, self.label)).first()["f1_macro"] or 0.0

    def isLargerBetter(self) -> bool:
        return True


def tune(train: DataFrame, names: list[str] | None = None, label: str = "attack_type", space: dict | None = None,
         n_iter: int = 40, folds: int = 3, seed: int = 42, parallelism: int = 4):
    """Random search: ``n_iter`` draws of the space, stratified folds, macro F1.

    Returns (best parameters, best score).
    """
    space = space or SEARCH_SPACE
    rng = random.Random(seed)
    draws, grid = set(), []
    total = 1
    for v in space.values():
        total *= len(v)
    while len(grid) < min(n_iter, total):
        pick = tuple(rng.choice(v) for v in space.values())
        if pick not in draws:
            draws.add(pick)
            grid.append(pick)
    est = _estimator("forest", seed)
    maps = [{est.getParam(k): v for k, v in zip(space, g)} for g in grid]
    fold = stratified_folds(train, label, folds, seed)
    data = feature_vector(class_weights(fold, label), names)
    data = StringIndexer(inputCol=label, outputCol="label_no", stringOrderType="alphabetAsc").fit(data).transform(data)
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps or ParamGridBuilder().build(), evaluator=MacroF1(),
                        numFolds=folds, foldCol="fold", parallelism=parallelism, seed=seed).fit(data)
    best = max(range(len(maps)), key=lambda i: cv.avgMetrics[i])
    return dict(zip(space, grid[best])), cv.avgMetrics[best]


def stratified_folds(df: DataFrame, label: str, folds: int, seed: int = 42, key: str = "session_id") -> DataFrame:
    """``fold`` 0..folds-1 with equal class shares: rank by hash modulo folds."""
    d = df.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))))
    d, o = od.order_by(d, [label], F.conv(F.substring("_h", 1, 15), 16, 10).cast("long"), ["_h", key])
    d = od.done(od.position_and_lag(d, o, "_r"))
    return d.withColumn("fold", (F.col("_r") % folds).cast("int")).drop("_h", "_r")


def top_k(probs: str | Column, classes: list, k: int = 3) -> Column:
    """The k likeliest classes as array<struct<attack, probability>>, probabilities
    rounded to four digits; the earlier class on ties."""
    p = F.col(probs) if isinstance(probs, str) else probs
    names = F.array(*[F.lit(c) for c in classes])
    pairs = F.transform(p, lambda x, i: F.struct((-x).alias("o"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k),
                       lambda s: F.struct(F.get(names, s["i"]).alias("attack"), F.round(-s["o"], 4).alias("probability")))


def predict(df: DataFrame, classes: list, probs: str = "probs", k: int = 3) -> DataFrame:
    """Prediction, confidence and top-k from a probability array."""
    t = top_k(probs, classes, k)
    return (df.withColumn("top_predictions", t)
            .withColumn("predicted_label", F.col("top_predictions")[0]["attack"])
            .withColumn("confidence", F.col("top_predictions")[0]["probability"]))


def apply_model(df: DataFrame, model: Model, names: list[str] | None = None, k: int = 3) -> DataFrame:
    """Features to predictions with a fitted classifier."""
    classes = class_names(model)
    scored = model.stages[-1].transform(feature_vector(df, names))
    probs = F.slice(vector_to_array("probability"), 1, len(classes))
    scored = scored.withColumn("probs", probs).drop("rawPrediction", "probability", "prediction", "features")
    return predict(scored, classes, "probs", k)


def prediction_table(pred: DataFrame, label: str = "attack_type", key: str = "session_id") -> DataFrame:
    """One flat row per session: truth, prediction, correctness, three best classes."""
    def at(i: int, f: str, empty):
        return F.coalesce(F.get("top_predictions", i)[f], F.lit(empty))
    cols = [c for i in range(3) for c in (at(i, "attack", "").alias(f"top_{i + 1}"),
                                          at(i, "probability", 0.0).alias(f"top_{i + 1}_prob"))]
    return pred.select(key, F.col(label).alias("true_label"), "predicted_label", "confidence",
                       (F.col("predicted_label") == F.col(label)).cast("int").alias("correct"), *cols)


def importance(model: Model, names: list[str] | None = None, n: int | None = None) -> DataFrame:
    """Feature importances (gain), ranked; the model has one number per feature."""
    from pyspark.sql import SparkSession

    names = names or dims.MODEL_FEATURES
    values = model.stages[-1].featureImportances.toArray()
    ranked = sorted(zip(names, map(float, values)), key=lambda r: (-r[1], r[0]))
    rows = [(i + 1, f, v) for i, (f, v) in enumerate(ranked)]
    return SparkSession.active().createDataFrame(rows[:n], "rank int, feature string, importance double")


def fit_summary(train_pred: DataFrame, val_pred: DataFrame, label: str = "attack_type") -> DataFrame:
    """Accuracy and F1 on training and validation predictions; one row."""
    def part(p: DataFrame, name: str) -> DataFrame:
        a = averages(class_report(p, "predicted_label", label))
        return a.select(*[F.col(c).alias(f"{name}_{c}") for c in ("accuracy", "f1_macro", "f1_weighted")])
    return part(train_pred, "train").crossJoin(part(val_pred, "val"))  # one row each
