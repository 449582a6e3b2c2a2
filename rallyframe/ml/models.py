"""Classifiers, calibration on validation rows, and prediction rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.ml.preprocess import encoder, imputed
from rallyframe.util import discard, materialize

PATIENCE = 25
PART_ROWS = 100_000
FAMILIES = ("logistic_regression", "random_forest", "gradient_boosted_trees")


@dataclass
class Fitted:
    """A fitted classifier with its preprocessing: ``score(rows)`` adds ``score`` and ``raw_probability``."""

    family: str
    prepare: object
    pipeline: object
    model: object

    def score(self, rows: DataFrame) -> DataFrame:
        out = self.model.transform(self.pipeline.transform(self.prepare(rows)))
        p = vector_to_array("probability")[1]
        margin = vector_to_array("rawPrediction")[1] if self.family == "logistic_regression" else p
        drop = [c for c in out.columns if c not in rows.columns]
        return out.withColumns({"raw_probability": p, "score": margin}).drop(*[c for c in drop if c not in ("raw_probability", "score")])


def best_iteration(losses: list[float], patience: int = PATIENCE) -> int:
    """Trees up to the least loss, where the search ends after ``patience`` trees without a lesser one."""
    best = 0
    for k, loss in enumerate(losses):
        if loss < losses[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


def _first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    java, spark = model._java_obj, SparkSession.active()
    kind = spark._jvm.org.apache.spark.ml
    trees = spark.sparkContext._gateway.new_array(kind.regression.DecisionTreeRegressionModel, n)
    weights = spark.sparkContext._gateway.new_array(spark._jvm.double, n)
    for k, (tree, weight) in enumerate(zip(list(java.trees())[:n], list(java.treeWeights())[:n], strict=True)):
        trees[k], weights[k] = tree, weight
    return GBTClassificationModel(kind.classification.GBTClassificationModel(java.uid(), trees, weights, java.numFeatures(), java.numClasses()))


def fit(train: DataFrame, numeric: list[str], categorical: list[str], family: str = FAMILIES[0], label: str = "y", trees: int = 400, seed: int = 42) -> Fitted:
    """Fit one family on the training rows.

    Logistic regression: L2 with strength 1/n on scaled features.  Boosting
    leaves out the rows flagged in ``is_tail``, if that column exists, and keeps
    the trees up to their least loss (``best_iteration``).
    """
    tail = None
    if family in ("gradient_boosted_trees", "xgboost") and "is_tail" in train.columns:
        train, tail = train.where("not is_tail"), train.where("is_tail")
    prepare = imputed(train, numeric, categorical, scale=family == FAMILIES[0])
    ready = prepare(train)
    pipeline = encoder(numeric, categorical).fit(ready)
    rows = pipeline.transform(ready).select("features", F.col(label).cast("double").alias("_label"))
    # a fit is many short jobs: parts of measured size, kept while it lasts
    n = max(1, rows.count())
    rows = rows.coalesce(max(1, math.ceil(n / PART_ROWS))).persist()
    common = {"featuresCol": "features", "labelCol": "_label"}
    if family == "logistic_regression":
        learner = LogisticRegression(maxIter=1000, regParam=1.0 / n, elasticNetParam=0.0, standardization=False, **common)
    elif family == "random_forest":
        learner = RandomForestClassifier(numTrees=trees, maxDepth=12, maxMemoryInMB=1024, cacheNodeIds=True, seed=seed, **common)
    elif family in ("gradient_boosted_trees", "xgboost"):
        learner = GBTClassifier(maxIter=trees, stepSize=0.05, maxDepth=6, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed, **common)
    else:
        raise ValueError(f"unknown family {family}; known: {FAMILIES}")
    model = learner.fit(rows)
    rows.unpersist()
    if tail is not None:
        # Spark's own early stopping ends at the first tree that gains too little: it has no patience
        held = pipeline.transform(prepare(tail)).withColumn("_label", F.col(label).cast("double"))
        model = _first_trees(model, best_iteration(model.evaluateEachIteration(held)))
    return Fitted(family, prepare, pipeline, model)


@dataclass
class Calibrator:
    """Sigmoid or isotonic map from ``score`` to ``p``; ``model`` can be saved like any other.

    A sigmoid of no rows has no ``model`` and gives null ``p``.
    """

    kind: str
    model: object

    def __call__(self, rows: DataFrame) -> DataFrame:
        if self.model is None:
            return rows.withColumn("p", F.lit(None).cast("double"))
        if self.kind == "sigmoid":
            slope, shift = float(self.model.coefficients[0]), float(self.model.intercept)
            return rows.withColumn("p", 1 / (1 + F.exp(-(F.col("score") * slope + shift))))
        return self.model.transform(rows).withColumn("p", F.least(F.greatest(F.col("p"), F.lit(0.0)), F.lit(1.0)))


def platt(scored: DataFrame, label: str = "y") -> Calibrator:
    """Sigmoid calibration of ``score`` with Platt's smoothed targets; without rows there is none (``Calibrator``)."""
    # each job of the fit would else carry the classifier and score the rows again
    scored = materialize(scored.select("score", label))
    counts = scored.agg(F.sum(label).alias("pos"), F.count(F.lit(1)).alias("n")).first()
    if not counts.n:
        discard(scored)
        return Calibrator("sigmoid", None)
    high, low = (counts.pos + 1.0) / (counts.pos + 2.0), 1.0 / (counts.n - counts.pos + 2.0)
    target = F.when(F.col(label) == 1, F.lit(high)).otherwise(F.lit(low))
    both = scored.select("score", F.explode(F.array(F.struct(F.lit(1.0).alias("l"), target.alias("w")), F.struct(F.lit(0.0).alias("l"), (1 - target).alias("w")))).alias("t"))
    rows = VectorAssembler(inputCols=["score"], outputCol="x").transform(both.select("score", "t.l", "t.w"))
    model = LogisticRegression(featuresCol="x", labelCol="l", weightCol="w", regParam=0.0, maxIter=100).fit(rows)
    discard(scored)
    return Calibrator("sigmoid", model)


def isotonic(scored: DataFrame, label: str = "y") -> Calibrator:
    """Isotonic calibration of ``score``; values outside are clamped."""
    learner = IsotonicRegression(featuresCol="score", labelCol="_label", predictionCol="p")
    return Calibrator("isotonic", learner.fit(scored.withColumn("_label", F.col(label).cast("double"))))


def prediction_rows(calibrated: DataFrame, keep: list[str]) -> DataFrame:
    p = F.col("p")
    return calibrated.select(
        *keep, "raw_probability", p.alias("calibrated_probability"), F.when(p >= 0.5, "A").when(p < 0.5, "B").alias("favoured_side"),
        F.greatest(p, 1 - p).alias("favoured_probability"),
    )
