"""Training and scoring of a multilayer perceptron."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armspan.session import kept

# The network and the training settings of the measured job.
LAYERS = (784, 256, 128, 10)
ITERATIONS_PER_EPOCH = 10
BLOCK_SIZE = 128
SEED = 42


def train_mlp(
    features: DataFrame,
    layers: Sequence[int] = LAYERS,
    epochs: int = 5,
    block_size: int = BLOCK_SIZE,
    seed: int = SEED,
    label: str = "label",
) -> MultilayerPerceptronClassificationModel:
    """Fits the network on the columns ``features`` and ``label``.

    Every iteration reads all rows, so only these two columns are kept for it.
    """
    classifier = MultilayerPerceptronClassifier(
        featuresCol="features",
        labelCol=label,
        layers=list(layers),
        maxIter=epochs * ITERATIONS_PER_EPOCH,
        blockSize=block_size,
        seed=seed,
    )
    with kept(features.select("features", F.col(label).cast("double").alias(label))) as rows:
        return classifier.fit(rows)


def predict(model: MultilayerPerceptronClassificationModel, features: DataFrame) -> DataFrame:
    return model.transform(features).drop("rawPrediction", "probability")


def confusion(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Row counts per pair of true and predicted class."""
    return predictions.groupBy(
        F.col(label).cast("double").alias("label"), F.col(prediction).cast("double").alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def _side(name: str, true_n: Column, pred_n: Column, hits: Column) -> Column:
    return F.struct(
        F.col(name).alias("class"), true_n.alias("true_n"), pred_n.alias("pred_n"), hits.alias("hits")
    )


def scores(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and F1 weighted by true class, from one pass over the predictions."""
    pairs = confusion(predictions, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    none = F.lit(0).cast("long")
    sides = F.array(
        _side("label", F.col("n"), none, hit),
        _side("prediction", none, F.col("n"), none),
    )
    classes = (
        pairs.select(F.inline(sides))
        .groupBy("class")
        .agg(F.sum("true_n").alias("true_n"), F.sum("pred_n").alias("pred_n"), F.sum("hits").alias("hits"))
    )
    f1 = 2.0 * F.col("hits") / (F.col("true_n") + F.col("pred_n"))
    total = F.nullif(F.sum("true_n"), F.lit(0))
    return classes.agg(
        (F.sum("hits") / total).alias("accuracy"),
        (F.sum(F.col("true_n") * f1) / total).alias("f1_score"),
        F.sum("true_n").alias("n"),
    )


def accuracy(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return scores(predictions, label, prediction).select("accuracy", "n")


def weighted_f1(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return scores(predictions, label, prediction).select("f1_score", "n")
