"""spark-submit entry: compares two arms from the records of their runs."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from armspan.functions.identity import ARMS
from armspan.plans.results import (
    compare_records,
    compare_results,
    compare_runs,
    label_runs,
    read_benchmarks,
    write_comparison,
)
from armspan.session import kept
from armspan.sources.records import read_ml_metrics, read_run_records, read_storage_records


def run(
    spark: SparkSession,
    results_path: str | Sequence[str],
    output_path: str,
    base: str = ARMS[0],
    candidate: str = ARMS[1],
    lines: bool = False,
    fill_missing: bool = False,
    sections: bool = False,
    skip_broken: bool = False,
    storage_path: Sequence[str] = (),
    training_path: Sequence[str] = (),
) -> None:
    """Compares a folder of result documents or, with ``lines``, runs stored as JSON lines.

    With lines, ``storage_path`` and ``training_path`` are the folders of storage records and training
    metrics as the repeat job stores them; both together give their tables too.
    """
    if bool(storage_path) != bool(training_path):
        raise ValueError("name the folders of both storage records and training metrics")
    if lines:
        stored = read_run_records(spark, results_path, documents=False, skip_broken=skip_broken)
        runs = label_runs(stored, sorted({*ARMS, base, candidate}))
    else:
        runs = read_benchmarks(spark, results_path, skip_broken=skip_broken)
    # Several tables come from the runs, and parsing JSON is the costly part.
    with kept(runs):
        if lines and storage_path:
            storage = read_storage_records(spark, storage_path, documents=False, skip_broken=skip_broken)
            training = read_ml_metrics(spark, training_path, None, documents=False)
            result = compare_records(runs, storage, training, base, candidate, fill_missing)
        elif lines:
            result = compare_runs(runs, base, candidate, fill_missing)
        else:
            result = compare_results(spark, results_path, base, candidate, runs, fill_missing, skip_broken)
        write_comparison(result, output_path, base, candidate, sections)


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--results-path", required=True, nargs="+")
    parser.add_argument("--output-path", required=True)
    parser.add_argument("--base", default=ARMS[0])
    parser.add_argument("--candidate", default=ARMS[1])
    parser.add_argument("--lines", action="store_true", help="the paths hold JSON lines of the repeat job")
    parser.add_argument("--storage-path", nargs="*", default=[], help="storage records of the repeat job")
    parser.add_argument("--training-path", nargs="*", default=[], help="training metrics of the repeat job")
    parser.add_argument("--zero-filled", action="store_true", help="a run without a total time counts as 0")
    parser.add_argument("--sections", action="store_true", help="state runs, total time and notes in the report")
    parser.add_argument("--skip-broken", action="store_true", help="leave out records that do not fit")
    args = parser.parse_args(argv)
    if not args.lines and len(args.results_path) > 1:
        parser.error("result documents lie under one folder")
    spark = SparkSession.builder.appName("compare-arms").getOrCreate()
    paths = args.results_path if args.lines else args.results_path[0]
    run(
        spark,
        paths,
        args.output_path,
        args.base,
        args.candidate,
        args.lines,
        args.zero_filled,
        args.sections,
        args.skip_broken,
        args.storage_path,
        args.training_path,
    )


if __name__ == "__main__":
    main()
