"""Trained pair classifiers, with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import CONFIDENCE, LEFT, RIGHT, SCORE
from ..storage import materialize
from .pairs import paired
from .scoring import Comparison

MODELS = ("LOGISTIC_REG", "BOOSTED_TREE_CLASSIFIER", "RANDOM_FOREST_CLASSIFIER", "DNN_CLASSIFIER")


#: So many distinct rows of values are broadcast.
FEW = 50_000


def feature_matrix(candidates: DataFrame, records: DataFrame, comparisons: Sequence[Comparison], labels: DataFrame | Column | None = None, matches: DataFrame | None = None) -> DataFrame:
    """left, right, a double for each comparison, and is_match: from labels, or else whether a
    match's confidence is a half or more. Pairs without a label are left out. labels: a table of pairs,
    or a condition on the candidates' own columns, which needs no join."""
    names = {x for c in comparisons for x in c.test.columns()}
    own = [labels.cast("int").alias("is_match")] if isinstance(labels, Column) else []
    df = paired(candidates, records, names).select(F.col(LEFT), F.col(RIGHT), *(F.coalesce(c.test.value().cast("double"), F.lit(0.0)).alias(c.label) for c in comparisons), *own)
    if own:
        return df.where("is_match IS NOT NULL")
    if labels is not None:
        return df.join(labels.select(LEFT, RIGHT, F.col("is_match").cast("int")), [LEFT, RIGHT])
    if matches is None:
        return df
    known = matches.select(LEFT, RIGHT, (F.col(CONFIDENCE) >= 0.5).cast("int").alias("is_match"))
    return df.join(known, [LEFT, RIGHT])


def train(matrix: DataFrame, features: Sequence[str], model_type: str = "LOGISTIC_REG", label: str = "is_match", max_iterations: int = 20, l1: float = 0.0, l2: float = 0.0, learn_rate: float | None = None, balance_classes: bool = True, seed: int = 1) -> PipelineModel:
    rows = matrix.withColumn("_label", F.col(label).cast("double"))
    times = F.lit(1.0)
    if model_type == "LOGISTIC_REG" and not l1 and not l2:
        # Equal rows are one row of their summed weight, which has the same likelihood: iterations read few rows.
        # Not under a penalty, which Spark scales by a deviation that depends on how weight is split over rows.
        rows = materialize(rows.groupBy("_label", *features).agg(F.count("*").alias("_times")))
        times = F.col("_times")
    if balance_classes:
        n = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.sum(times).alias("n")).collect()}  # one row a class
        total = sum(n.values())
        weight = F.lit(1.0)
        for value, count in n.items():
            weight = F.when(F.col("_label") == value, total / (len(n) * count)).otherwise(weight)
        rows = rows.withColumn("_weight", weight * times)
    else:
        rows = rows.withColumn("_weight", F.lit(1.0) * times)
    common = {"featuresCol": "_features", "labelCol": "_label"}
    if model_type == "LOGISTIC_REG":
        reg = l1 + l2
        learner = LogisticRegression(maxIter=max_iterations, regParam=reg, elasticNetParam=l1 / reg if reg else 0.0, weightCol="_weight", **common)
    elif model_type == "BOOSTED_TREE_CLASSIFIER":
        learner = GBTClassifier(maxIter=max_iterations, stepSize=learn_rate or 0.1, weightCol="_weight", seed=seed, **common)
    elif model_type == "RANDOM_FOREST_CLASSIFIER":
        learner = RandomForestClassifier(weightCol="_weight", seed=seed, **common)
    elif model_type == "DNN_CLASSIFIER":
        learner = MultilayerPerceptronClassifier(layers=[len(features), 16, 8, 2], maxIter=max_iterations, seed=seed, **common)
    else:
        raise ValueError(f"model type {model_type!r} is none of {', '.join(MODELS)}")
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), learner]).fit(rows)


def predict(model: PipelineModel, matrix: DataFrame, matches: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """left, right, ml_probability, ml_is_match, and the rule's score and confidence where there are matches."""
    features = model.stages[0].getInputCols()
    seen = materialize(matrix.select(*features).distinct())
    said = model.transform(seen).select(*features, vector_to_array("probability")[1].alias("ml_probability"))
    if seen.count() <= FEW:
        # Each distinct row of features is predicted once.
        out = matrix.join(F.broadcast(materialize(said)), list(features)).select(LEFT, RIGHT, "ml_probability")
    else:
        out = model.transform(matrix).select(LEFT, RIGHT, vector_to_array("probability")[1].alias("ml_probability"))
    out = out.withColumn("ml_is_match", F.col("ml_probability") >= threshold)
    return out if matches is None else out.join(matches.select(LEFT, RIGHT, SCORE, CONFIDENCE), [LEFT, RIGHT], "left")


def evaluate(model: PipelineModel, matrix: DataFrame, label: str = "is_match") -> dict[str, float]:
    scored = model.transform(matrix.withColumn("_label", F.col(label).cast("double")))
    many = MulticlassClassificationEvaluator(labelCol="_label", metricLabel=1.0)
    names = {"precision": "precisionByLabel", "recall": "recallByLabel", "accuracy": "accuracy", "f1_score": "fMeasureByLabel", "log_loss": "logLoss"}
    out = {k: many.setMetricName(v).evaluate(scored) for k, v in names.items()}
    return out | {"roc_auc": BinaryClassificationEvaluator(labelCol="_label", rawPredictionCol="probability").evaluate(scored)}


def feature_importance(model: PipelineModel) -> dict[str, float]:
    names = model.stages[0].getInputCols()
    return dict(zip(names, map(float, model.stages[-1].featureImportances.toArray()), strict=True))


def model_weights(model: PipelineModel) -> dict[str, float]:
    last = model.stages[-1]
    return dict(zip(model.stages[0].getInputCols(), map(float, last.coefficients), strict=True)) | {"__INTERCEPT__": float(last.intercept)}
