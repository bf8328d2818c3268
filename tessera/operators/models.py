"""Boosted trees that prune and match pairs, and a fixed score for runs without training."""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir


def _vectors(df: DataFrame, features: list[str]) -> DataFrame:
    plain = df.withColumns({f"__{c}": F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in features})
    return VectorAssembler(inputCols=[f"__{c}" for c in features], outputCol="features").transform(plain).drop(*[f"__{c}" for c in features])


#: Rows that one task learns from; a round is several jobs, which cost more than such rows do.
ROWS_A_TASK = 50_000


def _dealt(rows: DataFrame) -> DataFrame:
    """rows in as many partitions as their number asks for."""
    return rows.repartition(max(1, math.ceil(rows.count() / ROWS_A_TASK)))


def train_pruner(pairs: DataFrame, features: list[str], seed: int = 7, rounds: int = 200) -> GBTClassificationModel:
    """Trees of depth 6 (about 64 leaves) on context features and the label y."""
    shared_dir(pairs.sparkSession)  # long fits cut their lineage there
    gbt = GBTClassifier(labelCol="y", maxDepth=6, maxIter=rounds, stepSize=0.1, minInstancesPerNode=20, subsamplingRate=0.8, featureSubsetStrategy="0.9", seed=seed)
    return gbt.fit(_dealt(_vectors(pairs, features).select("features", F.col("y").cast("double").alias("y"))))


def best_round(losses: list[float], patience: int) -> tuple[int, bool]:
    """(the number of trees with the least loss, as far as one looks; whether so many rounds without a gain came after it)."""
    if any(map(math.isnan, losses)):
        return len(losses), True  # no rows to measure on
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model after so many rounds."""
    java, gateway = model._java_obj, SparkSession.active().sparkContext._gateway
    ml = gateway.jvm.org.apache.spark.ml
    trees, weights = gateway.new_array(ml.regression.DecisionTreeRegressionModel, n), gateway.new_array(gateway.jvm.double, n)
    for i, (tree, weight) in enumerate(zip(java.trees()[:n], java.treeWeights()[:n], strict=True)):
        trees[i], weights[i] = tree, weight
    made = ml.classification.GBTClassificationModel(java.uid(), trees, weights, java.numFeatures(), java.numClasses())
    return GBTClassificationModel(java.copyValues(made, java.extractParamMap()))


def train_matcher(pairs: DataFrame, features: list[str], tune: str = "is_tune", seed: int = 7, rounds: int = 600, patience: int = 50) -> GBTClassificationModel:
    """Deeper trees; boosting stops once the loss on the rows marked in the column tune has not fallen for so many
    rounds, and the trees up to the least loss are kept. Fits start anew with more rounds until that is so:
    the first trees of a longer fit are those of a shorter one."""
    shared_dir(pairs.sparkSession)  # long fits cut their lineage there
    rows = _vectors(pairs, features).select("features", F.col("y").cast("double").alias("y"), F.col(tune))
    learn, held = _dealt(rows.where(~F.col(tune))).drop(tune).cache(), _dealt(rows.where(tune)).cache()
    gbt = GBTClassifier(labelCol="y", maxDepth=7, stepSize=0.05, minInstancesPerNode=10, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)
    n = min(rounds, 3 * patience)
    while True:
        model = gbt.copy({gbt.maxIter: n}).fit(learn)
        best, stopped = best_round(model.evaluateEachIteration(held), patience)
        if stopped or n == rounds:
            learn.unpersist()
            held.unpersist()
            return first_trees(model, best)
        n = min(rounds, 2 * n)


def score(pairs: DataFrame, model: GBTClassificationModel, features: list[str], out: str) -> DataFrame:
    scored = model.transform(_vectors(pairs, features))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def importance(model: GBTClassificationModel, features: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, map(float, model.featureImportances.toArray()), strict=True), key=lambda x: (-x[1], x[0]))


def save(model: GBTClassificationModel, path: str) -> None:
    PipelineModel([model]).write().overwrite().save(path)


def load(path: str) -> GBTClassificationModel:
    return PipelineModel.load(path).stages[0]


def fixed_score(pairs: DataFrame, out: str = "p") -> DataFrame:
    """A logistic score of the two cosines and the rank, with fixed weights: the same on every engine."""
    x = 9 * F.coalesce("name_cos", F.lit(0.0)) + 5 * F.coalesce("addr_cos", F.lit(0.0)) - 0.8 * F.col("t_rank") - 5
    return pairs.withColumn(out, F.round(1 / (1 + F.exp(-x)), 6))
