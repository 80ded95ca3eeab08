"""spark-submit entry: runs the transactions suite on a CSV dataset."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from armspan.plans import profiling
from armspan.session import require_new
from armspan.sinks.tables import write_new_document
from armspan.sources.transactions import mode_registry, read_mode


def run(
    spark: SparkSession,
    data_path: str,
    output_path: str,
    mode: str = "sample",
    sample_key: str | None = None,
    infer: bool = False,
    preview_rows: int = 0,
) -> dict:
    """Profiles the suite and stores its record; returns the record."""
    document = f"{output_path}/benchmark_results.json"
    require_new(spark, document)
    registry = mode_registry({mode: data_path})
    suite = profiling.profile_suite(
        lambda: read_mode(spark, registry, mode, infer=infer, sample_key=sample_key),
        mode=mode,
        data_path=data_path,
        sample_fraction=registry[mode].sample_fraction,
        preview_rows=preview_rows,
    )
    write_new_document(profiling.suite_row(spark, suite), document)
    return suite


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--data-path", required=True)
    parser.add_argument("--output-path", required=True)
    parser.add_argument("--dataset-mode", choices=["sample", "large", "full"], default="sample")
    parser.add_argument("--sample-key", help="column whose hash decides the sample")
    parser.add_argument("--infer-schema", action="store_true")
    parser.add_argument("--preview-rows", type=int, default=5)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"transactions-{args.dataset_mode}").getOrCreate()
    suite = run(
        spark,
        args.data_path,
        args.output_path,
        args.dataset_mode,
        args.sample_key,
        args.infer_schema,
        args.preview_rows,
    )
    for operation in suite["operations"]:
        print(f"{operation['name']:30} {operation['duration_seconds']:8.3f}s success={operation['success']}")
    print(f"rows {suite['total_rows']}, total {suite['total_duration_seconds']:.2f}s")


if __name__ == "__main__":
    main()
