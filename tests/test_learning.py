import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from armspan.functions.pixels import assemble_array
from armspan.operators import learning


def test_scores_equal_the_evaluators(spark):
    rows = spark.range(997).select(
        (F.col("id") % 7).cast("double").alias("label"),
        F.pmod(F.xxhash64("id"), F.lit(9)).cast("double").alias("prediction"),
    )
    found = learning.scores(rows).first()
    for metric, column in (("accuracy", "accuracy"), ("f1", "f1_score")):
        expected = MulticlassClassificationEvaluator(metricName=metric).evaluate(rows)
        assert found[column] == pytest.approx(expected, abs=1e-12)
    assert found["n"] == 997


def test_scores_of_no_rows(spark):
    rows = spark.createDataFrame([], "label double, prediction double")
    assert tuple(learning.scores(rows).first()) == (None, None, None)


def test_perceptron_learns_separable_classes(spark):
    ids = spark.range(300)
    label = F.col("id") % 3
    rows = ids.select(
        label.cast("int").alias("label"),
        F.array(*[(label == k).cast("float") + (F.col("id") % 7) / 100 for k in range(3)]).alias("v"),
    )
    features = assemble_array(rows, "v")
    model = learning.train_mlp(features, [3, 4, 3], epochs=5)
    assert learning.scores(learning.predict(model, features)).first()["accuracy"] > 0.95
    assert not any(d.is_cached for d in (features,))
