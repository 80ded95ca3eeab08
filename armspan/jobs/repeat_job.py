"""spark-submit entry: repeats jobs of several kinds as one arm and stores their runs."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from armspan.functions.identity import ARMS
from armspan.functions.pixels import assemble_columns
from armspan.operators import cost, learning, runstats
from armspan.plans import repeats as jobs
from armspan.session import require_new
from armspan.sinks.tables import write_aggregates
from armspan.sources.features import read_split
from armspan.sources.transactions import MODE_SIZES_GB, mode_registry, read_mode

def run(
    spark: SparkSession,
    data_path: str | None,
    output_path: str,
    arm: str = ARMS[0],
    mode: str = "sample",
    repeats: int = 3,
    sample_key: str | None = None,
    rates: DataFrame | None = None,
    training_path: str | None = None,
    storage_folder: str | None = None,
    epochs: int = 5,
    layers: Sequence[int] = learning.LAYERS,
    sizes_mb: Sequence[int] = (5,),
) -> None:
    """Runs each kind of job ``repeats`` times; stores all attempts, failed ones too, and the statistics over them.

    The transactions suite runs on ``data_path``, the training on the split under ``training_path`` and the
    storage tests under ``storage_folder``, on the transactions or else the training table; what is None
    does not run. ``rates`` prices the arm, by default the known shapes and prices.
    """
    require_new(spark, f"{output_path}/runs")
    kinds = []
    load = None
    if data_path is not None:
        registry = mode_registry({mode: data_path})
        load = lambda: read_mode(spark, registry, mode, sample_key=sample_key)
        kinds.append(jobs.transactions_kind(load, mode=mode, data_path=data_path, data_gb=MODE_SIZES_GB[mode]))
    if training_path is not None:
        split = lambda: tuple(assemble_columns(part, layers[0]) for part in read_split(spark, training_path))
        kinds.append(jobs.training_kind(split, epochs, layers=layers))
    if storage_folder is not None:
        load = load or (lambda: read_split(spark, training_path)[0])
        kinds.append(jobs.storage_kind(load, storage_folder, sizes_mb=sizes_mb))
    if not kinds or (data_path is None and training_path is None):
        raise ValueError("name the data of at least one kind of job")
    attempts = jobs.repeat(kinds, repeats)
    rates = cost.rate_table(spark) if rates is None else rates
    jobs.write_attempts(spark, attempts, output_path, arm, rates)
    records = jobs.run_records(spark, attempts, arm, rates)
    write_aggregates(runstats.timing_key_stats(records, ["provider"]), f"{output_path}/timings")
    write_aggregates(runstats.cost_key_stats(records, ["provider"]), f"{output_path}/costs")
    write_aggregates(runstats.multi_run_summary(records), f"{output_path}/summary")


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--data-path", help="transactions; without it their suite does not run")
    parser.add_argument("--training-path", help="a split of features; without it nothing is trained")
    parser.add_argument("--storage-folder", help="where storage is tested; without it it is not")
    parser.add_argument("--epochs", type=int, default=5)
    parser.add_argument("--output-path", required=True)
    parser.add_argument("--arm", default=ARMS[0], help="a known arm, or any name with the prices below")
    parser.add_argument("--workers", type=int, default=2)
    parser.add_argument("--machine-price", type=float, help="USD per machine and hour")
    parser.add_argument("--node-fee", type=float, default=0.0, help="USD per machine and hour on top")
    parser.add_argument("--storage-price", type=float, default=0.0, help="USD per GB and month")
    parser.add_argument("--dataset-mode", choices=["sample", "large", "full"], default="sample")
    parser.add_argument("--repeats", type=int, default=3)
    parser.add_argument("--sample-key")
    args = parser.parse_args(argv)
    if args.machine_price is None and args.arm not in ARMS:
        parser.error(f"name the machine price of {args.arm}")
    spark = SparkSession.builder.appName(f"repeat-{args.arm}").getOrCreate()
    rates = None
    if args.machine_price is not None:
        shape = cost.ClusterShape(args.arm, "machine", "machine", args.workers, "fee", False, 1, "storage")
        listed = {"machine": args.machine_price, "fee": args.node_fee, "storage": args.storage_price}
        rates = cost.rate_table(spark, [shape], [(args.arm, item, price) for item, price in listed.items()])
    run(
        spark,
        args.data_path,
        args.output_path,
        args.arm,
        args.dataset_mode,
        args.repeats,
        args.sample_key,
        rates,
        args.training_path,
        args.storage_folder,
        args.epochs,
    )


if __name__ == "__main__":
    main()
