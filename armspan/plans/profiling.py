"""Timing of Spark operations: single ones, suites, repeats and table I/O."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from armspan.functions import identity
from armspan.functions.measures import transfer_record
from armspan.operators import cost
from armspan.operators import transactions as tx
from armspan.operators.runstats import succeeded, total_recorded
from armspan.schemas import OPERATION_RESULT, SUITE_RESULT


@dataclass(frozen=True)
class Operation:
    """A named operation; ``build`` returns the lazy result for the loaded table."""

    name: str
    description: str
    build: Callable[[DataFrame], DataFrame]


# The names and arguments of the measured operations.
TRANSACTION_OPERATIONS = (
    Operation(
        "filter_expense_type",
        "Rows of two categories",
        lambda df: tx.filter_category(df, ["Housing", "Entertainment"]),
    ),
    Operation(
        "filter_complex",
        "Rows of one category and two years above an amount",
        lambda df: tx.filter_conjunctive(df, "Housing", 300, [2018, 2019]),
    ),
    Operation("agg_by_customer", "Sum, count and mean of each customer", tx.agg_by_customer),
    Operation("agg_by_expense_type", "Sum, count and mean of each category", tx.agg_by_category),
    Operation("agg_monthly_trends", "Sum and count of each month, in order", tx.agg_monthly),
    Operation("sort_by_amount_desc", "All rows, largest amount first", tx.sort_by_amount),
    Operation("join_customer_summary", "Each row beside the figures of its customer", tx.join_customer_summary),
)


def now() -> str:
    return datetime.now(timezone.utc).replace(tzinfo=None).isoformat()


def drain(rows: DataFrame) -> int:
    """Computes every column of every row without keeping them; returns the row count.

    ``count()`` would not do: the optimizer drops sorts and unused aggregates under it.
    """
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    return seen.get["rows"]


def profile_operation(operation: Operation, table: DataFrame, preview_rows: int = 0) -> dict:
    """Runs one operation; a failure becomes part of the record.

    With ``preview_rows`` the first rows are shown after the clock has stopped.
    """
    record = {"name": operation.name, "description": operation.description}
    start = time.perf_counter()
    try:
        result = operation.build(table)
        rows = drain(result)
        record |= {"duration_seconds": round(time.perf_counter() - start, 3), "result_rows": rows, "success": True}
        if preview_rows:
            result.show(preview_rows, truncate=False)
    except Exception as problem:
        duration = round(time.perf_counter() - start, 3)
        record |= {"duration_seconds": duration, "error": str(problem), "success": False}
    return record


def operation_rows(spark: SparkSession, records: Sequence[Mapping]) -> DataFrame:
    """Operation records as a table, one row each."""
    names = OPERATION_RESULT.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in records], OPERATION_RESULT)


def profile_suite(
    load: Callable[[], DataFrame],
    operations: Sequence[Operation] = TRANSACTION_OPERATIONS,
    mode: str = "sample",
    data_path: str = "",
    sample_fraction: float = 1.0,
    cache: bool = True,
    preview_rows: int = 0,
) -> dict:
    """Loads a table, runs every operation on it and returns the suite record.

    With ``cache`` the operations read the table from memory, so their times leave out
    the scan; without it filters and column pruning reach the source.
    """
    suite = {
        "benchmark_type": "big_data",
        "dataset_mode": mode,
        "data_path": data_path,
        "timestamp": now(),
    }
    start = time.perf_counter()
    table = load()
    if cache:
        table = table.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        suite["total_rows"] = table.count()
        suite["data_load_time_seconds"] = round(time.perf_counter() - start, 3)
        suite["sampled"] = sample_fraction < 1.0
        suite["sample_fraction"] = sample_fraction
        results = [profile_operation(operation, table, preview_rows) for operation in operations]
    finally:
        if cache:
            table.unpersist()
    suite["operations"] = results
    suite["total_duration_seconds"] = round(time.perf_counter() - start, 3)
    passed = sum(r["success"] for r in results)
    suite["success_rate"] = round(passed / len(results) * 100, 2) if results else 0.0
    return suite


def suite_row(spark: SparkSession, suite: Mapping) -> DataFrame:
    """A suite record as a one-row table for the document sinks."""
    fields = OPERATION_RESULT.fieldNames()
    operations = [tuple(op.get(f) for f in fields) for op in suite["operations"]]
    values = {**suite, "operations": operations}
    return spark.createDataFrame([tuple(values.get(n) for n in SUITE_RESULT.fieldNames())], SUITE_RESULT)


def suite_outcome(suite: Mapping, build: Callable) -> object:
    """``build`` of a suite's seconds by operation and in all, and of the errors of its operations."""
    timings = {op["name"]: op["duration_seconds"] for op in suite["operations"]}
    timings["benchmark_execution"] = suite["total_duration_seconds"]
    errors = [
        {"timestamp": now(), "message": op["error"], "type": op["name"]} for op in suite["operations"] if not op["success"]
    ]
    return build(timings, errors)


def profile_repeated(run: Callable[[int], Mapping], repeats: int) -> list[dict]:
    """Attempts a suite several times; a failed attempt is kept as a record with its error."""
    attempts = []
    for number in range(1, repeats + 1):
        start = time.perf_counter()
        try:
            timings, errors = suite_outcome(run(number), lambda *found: found)
        except Exception as problem:
            timings, errors = {}, [{"timestamp": now(), "message": str(problem), "type": type(problem).__name__}]
        timings["total_time"] = time.perf_counter() - start
        attempts.append({"run": number, "timestamp": now(), "timings": timings, "errors": errors})
    return attempts


_ATTEMPT = (
    "run int, timestamp string, timings map<string,double>, "
    "errors array<struct<timestamp string, message string, type string>>"
)


def attempt_rows(spark: SparkSession, attempts: Sequence[Mapping], provider: str) -> DataFrame:
    """Attempts of one arm as a table, ready for the statistics over runs."""
    rows = [
        (
            attempt["run"],
            attempt["timestamp"],
            attempt["timings"],
            [(e["timestamp"], e["message"], e["type"]) for e in attempt["errors"]],
        )
        for attempt in attempts
    ]
    return spark.createDataFrame(rows, _ATTEMPT).withColumn("provider", F.lit(provider))


def run_records(
    attempts: DataFrame, rates: DataFrame, kind: str, mode: str | None, data_gb: float = cost.DEFAULT_DATA_GB
) -> DataFrame:
    """Attempts as run records: named, priced, and summarised. Without a mode their names have none.

    The cluster costs what its provisioning, if recorded, and the execution took. An
    attempt that did not come to an end has no cost entries.
    """
    started = F.col("timestamp").cast("timestamp")
    taken = lambda key: F.try_element_at("timings", F.lit(key))
    timed = attempts.withColumns(
        {
            "_seconds": taken("total_time"),
            "_cluster": F.coalesce(taken("cluster_provisioning"), F.lit(0.0)) + taken("benchmark_execution"),
        }
    )
    priced = cost.experiment_cost(timed, rates, "_cluster", F.lit(data_gb), arm="provider")
    costs = F.when(F.col("_cluster").isNotNull(), cost.cost_map("provider"))
    stamp, mode_name = F.date_format(started, "yyyyMMdd_HHmmss"), F.lit(mode).cast("string")
    named = identity.run_name(F.lit(kind), F.col("run"), stamp, F.col("provider"), mode_name)
    records = priced.select(
        named.alias("experiment_id"),
        "provider",
        started.alias("timestamp"),
        "timings",
        F.coalesce(costs, F.create_map().cast("map<string,double>")).alias("costs"),
        F.struct(F.lit(kind).alias("benchmark_type"), mode_name.alias("dataset_mode")).alias("metadata"),
        "errors",
        F.col("_seconds"),
    )
    summary = F.struct(
        F.col("_seconds").alias("total_time_seconds"),
        total_recorded(F.col("costs")).alias("total_cost_usd"),
        succeeded(F.col("errors")).alias("success"),
    )
    return records.withColumn("summary", summary).drop("_seconds")


def synthetic_rows(spark: SparkSession, megabytes: int, row_bytes: int = 1024) -> DataFrame:
    """Rows of text that add up to ``megabytes`` and hardly compress, made by the executors."""
    digests = [F.sha2(F.concat_ws(":", F.col("id"), F.lit(i)), 256) for i in range(-(-row_bytes // 64))]
    text = F.substring(F.concat(*digests), 1, row_bytes)
    return spark.range(megabytes * 1024 * 1024 // row_bytes).select("id", text.alias("payload"))


def _bytes_under(spark: SparkSession, path: str) -> int:
    """Stored size as the file system reports it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getContentSummary(target).getLength()


def table_io_profile(rows: DataFrame, path: str) -> DataFrame:
    """Writes a table as Parquet, scans it back and reports rows, MB, seconds and MB/s of both."""
    spark = rows.sparkSession
    figures = []
    start = time.perf_counter()
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    figures.append(("write", seen.get["rows"], time.perf_counter() - start))
    start = time.perf_counter()
    scanned = drain(spark.read.parquet(path))
    figures.append(("sequential_read", scanned, time.perf_counter() - start))
    size_mb = _bytes_under(spark, path) / (1024.0 * 1024.0)
    measured = spark.createDataFrame(
        [(name, count, size_mb, seconds) for name, count, seconds in figures],
        "operation string, result_rows bigint, mb double, seconds double",
    )
    return measured.select(
        "operation",
        "result_rows",
        *transfer_record(F.col("mb"), F.col("seconds")),
        F.lit(None).cast("string").alias("error"),
    )


@contextmanager
def _split_size(spark: SparkSession, megabytes: int) -> Iterator[None]:
    """Scans planned inside read files in pieces of this size."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, f"{megabytes}m")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _tested(operation: str, key: str, size_field: str, act: Callable[[], float], **more: float) -> dict:
    """Times one storage test; ``act`` returns the megabytes. A failure is kept with its error."""
    start = time.perf_counter()
    try:
        size = act()
    except Exception as problem:
        return {"operation": operation, "key": key, **more, "error": str(problem)}
    seconds = time.perf_counter() - start
    rate = round(size / seconds, 2) if seconds > 0 else 0.0
    return {
        "operation": operation, "key": key, size_field: round(size, 2), **more,
        "duration_seconds": round(seconds, 3), "throughput_mbps": rate,
    }


def storage_tests(
    rows: DataFrame, folder: str, name: str = "table", sizes_mb: Sequence[int] = (5,), chunk_mb: int = 1
) -> dict:
    """Storage tests under ``folder`` as a record: all tests, and what they were made on.

    ``rows`` are written (upload), read back whole (download) and in pieces of ``chunk_mb``
    (sequential_read); then synthetic rows of each of ``sizes_mb`` are written. Sizes are those that the
    file system reports. A test that fails is kept with its error; without the copy there is nothing to
    read, and these tests are left out. The written files are deleted at the end.
    """
    spark = rows.sparkSession
    root = f"{folder.rstrip('/')}/storage-test-{uuid.uuid4().hex}"
    copy = f"{root}/{name}"
    started = now()

    def written(table: DataFrame, path: str) -> float:
        table.write.parquet(path)
        return _bytes_under(spark, path) / (1024.0 * 1024.0)

    def scanned() -> float:
        drain(spark.read.parquet(copy))
        return _bytes_under(spark, copy) / (1024.0 * 1024.0)

    try:
        tests = [_tested("upload", copy, "file_size_mb", lambda: written(rows, copy))]
        if "error" not in tests[0]:
            tests.append(_tested("download", copy, "file_size_mb", scanned))
            with _split_size(spark, chunk_mb):
                tests.append(_tested("sequential_read", copy, "total_mb_read", scanned, chunk_size_mb=float(chunk_mb)))
        for number, size in enumerate(sizes_mb):
            key = f"{root}/write-{number}"
            act = lambda size=size, key=key: written(synthetic_rows(spark, size), key)
            tests.append(_tested("write", key, "data_size_mb", act))
    finally:
        _delete(spark, root)
    return {
        "timestamp": started, "test_file": name, "file_size_mb": tests[0].get("file_size_mb"), "bucket": folder, "tests": tests,
    }


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
