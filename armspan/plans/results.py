"""Comparison of two arms from the result files of their runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from armspan.functions.identity import ARMS, parse_run_name
from armspan.operators import comparison, runstats
from armspan.session import kept
from armspan.sinks import tables as sinks
from armspan.sources import records

# Folder and file names of the run records of each benchmark.
RUN_FILES = {
    "PySpark Sample": ("pyspark", "pyspark_*_sample_*.json"),
    "PySpark Large": ("pyspark", "pyspark_*_large_*.json"),
    "ML": ("ml", "ml_*.json"),
}
# Folder and file names of the storage records.
STORAGE_FILES = ("storage", "storage_*.json")
# Folders of the training metrics of each arm.
METRIC_FOLDERS = {"aws": "cloud_results/aws", "gcp": "cloud_results/gcp_results"}


def _run_columns() -> list[Column | str]:
    return [
        "timings",
        "costs",
        "errors",
        F.col("summary.total_time_seconds").alias("total_time"),
        F.col("summary.total_cost_usd").alias("total_cost"),
    ]


def read_benchmarks(
    spark: SparkSession,
    root: str,
    files: Mapping[str, tuple[str, str]] = RUN_FILES,
    skip_broken: bool = False,
) -> DataFrame:
    """Run records of all benchmarks, with the columns that the comparison reads."""
    parts = [
        records.read_run_records(spark, f"{root}/{folder}", glob, skip_broken=skip_broken).select(
            "experiment_id",
            "provider",
            F.lit(name).alias("benchmark"),
            *_run_columns(),
        )
        for name, (folder, glob) in files.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def read_training(
    spark: SparkSession, root: str, folders: Mapping[str, str] = METRIC_FOLDERS
) -> DataFrame:
    """Training metrics of all arms; the folder tells the arm."""
    parts = [
        records.read_ml_metrics(spark, f"{root}/{folder}").withColumn("provider", F.lit(arm))
        for arm, folder in folders.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def label_runs(runs: DataFrame, arms: Sequence[str] = ARMS) -> DataFrame:
    """Run records with the benchmark that their names state: kind and mode.

    A run whose name states no kind is a benchmark of its own, under its whole name.
    """
    parsed = parse_run_name(F.col("experiment_id"), F.col("provider"), arms)
    named = runs.withColumn("_name", parsed)
    return named.select(
        "experiment_id",
        F.col("_name.arm").alias("provider"),
        F.when(F.col("_name.type").isNull(), F.col("experiment_id"))
        .otherwise(F.concat_ws(" ", "_name.type", "_name.mode"))
        .alias("benchmark"),
        *_run_columns(),
    )


@dataclass(frozen=True)
class RunComparison:
    """Tables over the runs of two arms, all lazy."""

    by_arm: DataFrame
    rows: DataFrame
    timings: DataFrame
    costs: DataFrame


@dataclass(frozen=True)
class ResultComparison(RunComparison):
    """The same with the storage tests and the training metrics."""

    storage: DataFrame
    training: DataFrame


def zero_filled(runs: DataFrame) -> DataFrame:
    """Runs whose totals come from their timing and cost maps, where a lacking time is 0.

    A run without the map has no total. The totals in run summaries, which comparisons
    take otherwise, are null where a run recorded none and then stay out of the means.
    """
    recorded = F.coalesce(F.try_element_at("timings", F.lit("total_time")), F.lit(0.0))
    return runs.withColumns(
        {
            "total_time": F.when(F.col("timings").isNotNull(), recorded),
            "total_cost": runstats.total_recorded(F.col("costs")),
        }
    )


def compare_runs(
    runs: DataFrame, base: str = ARMS[0], candidate: str = ARMS[1], fill_missing: bool = False
) -> RunComparison:
    """All tables over the runs; ``fill_missing`` compares the totals of ``zero_filled``."""
    runs = zero_filled(runs) if fill_missing else runs
    by = ["benchmark", "provider"]
    values = {"time": F.col("total_time"), "cost": F.col("total_cost")}
    return RunComparison(
        by_arm=runstats.describe_by(runs, by, values),
        rows=comparison.compare_arms(runs, base, candidate),
        timings=runstats.timing_key_stats(runs, by),
        costs=runstats.cost_key_stats(runs, by),
    )


def compare_results(
    spark: SparkSession,
    root: str,
    base: str = ARMS[0],
    candidate: str = ARMS[1],
    runs: DataFrame | None = None,
    fill_missing: bool = False,
    skip_broken: bool = False,
) -> ResultComparison:
    """Compares the result files under ``root``; ``runs`` are its run records if already read."""
    runs = read_benchmarks(spark, root, skip_broken=skip_broken) if runs is None else runs
    folder, glob = STORAGE_FILES
    stored = records.read_storage_records(spark, f"{root}/{folder}", glob, skip_broken=skip_broken)
    return compare_records(runs, stored, read_training(spark, root), base, candidate, fill_missing)


def compare_records(
    runs: DataFrame,
    storage: DataFrame,
    training: DataFrame,
    base: str = ARMS[0],
    candidate: str = ARMS[1],
    fill_missing: bool = False,
) -> ResultComparison:
    """All tables over run records, storage records and training metrics."""
    tables = compare_runs(runs, base, candidate, fill_missing)
    return ResultComparison(
        **{field.name: getattr(tables, field.name) for field in fields(tables)},
        storage=comparison.compare_storage(records.storage_operations(storage, "provider"), base, candidate),
        training=comparison.compare_ml_metrics(training, base, candidate),
    )


def write_comparison(
    result: RunComparison, out: str, base: str = ARMS[0], candidate: str = ARMS[1], sections: bool = False
) -> None:
    """Every table of the comparison under ``out``: report, CSV and JSON.

    With ``sections`` the report also states the runs, their total time and notes.
    """
    runs = result.by_arm if sections else None
    with kept(result.rows) as rows:
        sinks.write_report(rows, f"{out}/report", base, candidate, list(RUN_FILES), runs)
        sinks.write_comparison_csv(rows, f"{out}/comparison_csv", base, candidate)
    for field in fields(result):
        if field.name != "rows":
            sinks.write_aggregates(getattr(result, field.name), f"{out}/{field.name}")
