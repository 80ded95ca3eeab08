"""One training run: fit, score and the metrics that describe it."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame

from armspan.operators import learning
from armspan.plans.profiling import now


def train_and_score(
    train: DataFrame,
    test: DataFrame,
    epochs: int = 5,
    batch_size: int = learning.BLOCK_SIZE,
    layers: Sequence[int] = learning.LAYERS,
    dataset: str = "fashion-mnist",
) -> dict:
    """Metrics of a perceptron fitted on ``train`` and scored on ``test`` (columns features and label).

    ``batch_size`` is the number of rows stacked into one block of the solver.
    """
    started, start = now(), time.perf_counter()
    model = learning.train_mlp(train, layers, epochs, batch_size)
    training = time.perf_counter() - start
    scored = learning.scores(learning.predict(model, test.select("features", "label"))).first()
    return {
        "training_time_seconds": training,
        "accuracy": scored["accuracy"],
        "f1_score": scored["f1_score"],
        "epochs": epochs,
        "architecture": list(layers),
        "job_start_time": started,
        "job_end_time": now(),
        "total_job_time_seconds": time.perf_counter() - start,
        "dataset": dataset,
        "batch_size": batch_size,
    }
