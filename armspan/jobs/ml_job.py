"""spark-submit entry: trains and scores the perceptron on a train and a test table."""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armspan.functions.pixels import assemble_columns
from armspan.operators import learning
from armspan.plans import repeats
from armspan.plans.training import train_and_score
from armspan.session import require_new
from armspan.sinks.tables import write_document
from armspan.sources.features import read_split


def run(
    spark: SparkSession,
    data_path: str,
    output_path: str,
    epochs: int = 5,
    batch_size: int = learning.BLOCK_SIZE,
    layers: Sequence[int] = learning.LAYERS,
    dataset: str = "fashion-mnist",
    arm: str | None = None,
    rates: DataFrame | None = None,
) -> dict:
    """Trains, scores and stores the metrics; returns them.

    ``batch_size`` is the number of rows stacked into one block of the solver. With ``arm`` the run is
    stored as a run record too, with its timings and what they cost by ``rates`` (by default the known
    shapes and prices), also if it fails.
    """
    start = time.perf_counter()

    def load() -> tuple[DataFrame, DataFrame]:
        return tuple(assemble_columns(part, layers[0]) for part in read_split(spark, data_path))

    if arm is None:
        record = train_and_score(*load(), epochs, batch_size, layers, dataset)
    else:
        require_new(spark, f"{output_path}/runs")
        attempts = repeats.repeat([repeats.training_kind(load, epochs, batch_size, layers, dataset)], 1)
        repeats.write_attempts(spark, attempts, output_path, arm, rates)
        if attempts[0].outcome.metrics is None:
            raise RuntimeError(attempts[0].outcome.errors[0]["message"])
        record = dict(attempts[0].outcome.metrics)
    record["total_job_time_seconds"] = time.perf_counter() - start
    columns = [
        F.array(*[F.lit(n) for n in value]).alias(name) if isinstance(value, list) else F.lit(value).alias(name)
        for name, value in record.items()
    ]
    write_document(spark.range(1).select(*columns), f"{output_path}/metrics")
    return record


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--dataset", default="fashion-mnist", choices=["fashion-mnist"])
    parser.add_argument("--epochs", type=int, default=5)
    parser.add_argument("--batch-size", type=int, default=learning.BLOCK_SIZE)
    parser.add_argument("--data-path", required=True)
    parser.add_argument("--output-path", required=True)
    parser.add_argument("--arm", help="stores a run record of this arm")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("ml-training").getOrCreate()
    record = run(
        spark, args.data_path, args.output_path, args.epochs, args.batch_size, dataset=args.dataset, arm=args.arm
    )
    print(f"accuracy {record['accuracy']:.4f}, F1 {record['f1_score']:.4f}")


if __name__ == "__main__":
    main()
