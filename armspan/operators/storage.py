"""Statistics of storage tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armspan.functions.rounding import exact_sum, round_exact
from armspan.operators.runstats import spread

# The order in which reports list the operations.
OPERATION_ORDER = ("upload", "download", "sequential_read", "write")


def operation_rank(operation: Column) -> Column:
    """Position in reports; an unlisted operation comes last."""
    listed = F.array_position(F.array(*[F.lit(name) for name in OPERATION_ORDER]), operation)
    return F.when(listed > 0, listed).otherwise(F.lit(len(OPERATION_ORDER) + 1)).cast("int")


def summarise_tests(
    tests: DataFrame,
    by: Sequence[str] = (),
    rate_digits: int | None = 2,
    seconds_digits: int | None = 3,
) -> DataFrame:
    """Average rate and duration per operation over the tests without an error.

    A test that lacks a figure counts as 0 for it. The digits are the decimals of the
    recorded figures; with them the averages do not depend on the order of the tests,
    which would show where an average falls between two rounded values.
    """
    rate = F.coalesce("throughput_mbps", F.lit(0.0))
    seconds = F.coalesce("duration_seconds", F.lit(0.0))
    totals = (
        tests.filter(F.col("error").isNull())
        .groupBy(*by, "operation")
        .agg(
            exact_sum(rate, rate_digits).alias("_rate"),
            exact_sum(seconds, seconds_digits).alias("_seconds"),
            F.count(F.lit(1)).alias("count"),
        )
    )
    return totals.select(
        *by,
        "operation",
        round_exact(F.col("_rate") / F.col("count"), 2).alias("avg_throughput_mbps"),
        round_exact(F.col("_seconds") / F.col("count"), 3).alias("avg_duration_seconds"),
        "count",
    )


def summary_records(summaries: DataFrame, by: Sequence[str]) -> DataFrame:
    """Operation summaries folded into one record per ``by`` with a ``summary`` map.

    A map holds one entry per kind of operation, however many tests there were.
    """
    stats = F.struct("avg_throughput_mbps", "avg_duration_seconds", "count")
    entries = F.collect_list(F.struct(F.col("operation"), stats))
    return summaries.groupBy(*by).agg(F.map_from_entries(entries).alias("summary"))


def stats_by_operation(operations: DataFrame, arm: str = "provider") -> DataFrame:
    """Spread of the runs' average durations per operation and arm."""
    return (
        operations.groupBy("operation", arm)
        .agg(*spread({"duration": F.col("avg_duration_seconds")}))
        .withColumn("order_col", operation_rank(F.col("operation")))
    )
