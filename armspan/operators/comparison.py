"""Two arms side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armspan.functions.identity import ARMS
from armspan.functions.measures import pct_difference, winner
from armspan.operators.runstats import describe_by
from armspan.operators.storage import stats_by_operation

# Metric names in comparison reports.
TIME_METRIC = "Total Time (seconds)"
COST_METRIC = "Total Cost (USD)"


def pair_arms(
    stats: DataFrame,
    by: Sequence[str],
    values: Sequence[str],
    base: str = ARMS[0],
    candidate: str = ARMS[1],
    arm: str = "provider",
) -> DataFrame:
    """One row per ``by`` with ``base_*`` and ``cand_*`` values; both arms must be there.

    ``stats`` holds one row per arm and ``by``. Each side is picked out while grouping,
    so the input is read once, where a self-join would read it twice.
    """
    is_base, is_candidate = F.col(arm) == base, F.col(arm) == candidate
    sides = [("base", is_base), ("cand", is_candidate)]
    picked = [F.max(F.when(test, F.col(v))).alias(f"{side}_{v}") for side, test in sides for v in values]
    return (
        stats.filter(F.col(arm).isin(base, candidate))
        .groupBy(*by)
        .agg(F.count_if(is_base).alias("_base"), F.count_if(is_candidate).alias("_cand"), *picked)
        .filter((F.col("_base") > 0) & (F.col("_cand") > 0))
        .drop("_base", "_cand")
    )


def with_verdict(
    pairs: DataFrame, base: str = ARMS[0], candidate: str = ARMS[1], value: str = "mean", guard: bool = True
) -> DataFrame:
    """Adds ``difference_pct`` and the ``winner``, the arm's name in capitals or Tie."""
    difference = pct_difference(F.col(f"base_{value}"), F.col(f"cand_{value}"), guard)
    return pairs.withColumn("difference_pct", difference).withColumn(
        "winner", winner(F.col("difference_pct"), base.upper(), candidate.upper())
    )


def time_and_cost(
    runs: DataFrame,
    arm: str = "provider",
    benchmark: str = "benchmark",
    time: str = "total_time",
    cost: str = "total_cost",
) -> DataFrame:
    """Mean and deviation of both report metrics per arm and benchmark, one row per metric."""
    stats = describe_by(runs, [arm, benchmark], {"time": F.col(time), "cost": F.col(cost)})
    metrics = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                F.col(f"{value}_mean").alias("mean"),
                F.col(f"{value}_std").alias("std"),
            )
            for name, value in ((TIME_METRIC, "time"), (COST_METRIC, "cost"))
        ]
    )
    rows = stats.select(arm, F.col(benchmark).alias("benchmark"), F.inline(metrics))
    return rows.filter(F.col("mean").isNotNull())


def compare_arms(
    runs: DataFrame,
    base: str = ARMS[0],
    candidate: str = ARMS[1],
    arm: str = "provider",
    benchmark: str = "benchmark",
    time: str = "total_time",
    cost: str = "total_cost",
) -> DataFrame:
    """Comparison rows of every benchmark that both arms ran."""
    stats = time_and_cost(runs, arm, benchmark, time, cost)
    pairs = pair_arms(stats, ["benchmark", "metric"], ["mean", "std"], base, candidate, arm)
    return with_verdict(pairs, base, candidate)


def compare_storage(
    operations: DataFrame, base: str = ARMS[0], candidate: str = ARMS[1], arm: str = "provider"
) -> DataFrame:
    """Storage operations of both arms with the difference of their mean durations."""
    stats = stats_by_operation(operations, arm)
    figures = ["duration_n", "duration_mean", "duration_std", "duration_min", "duration_max"]
    pairs = pair_arms(stats, ["operation", "order_col"], figures, base, candidate, arm)
    return with_verdict(pairs, base, candidate, "duration_mean", guard=False).drop("winner")


def compare_ml_metrics(
    metrics: DataFrame, base: str = ARMS[0], candidate: str = ARMS[1], arm: str = "provider"
) -> DataFrame:
    """Accuracy and F1 of both arms: spread per arm and difference of the means."""
    long = metrics.select(
        arm,
        F.stack(
            F.lit(2), F.lit("accuracy"), F.col("accuracy"), F.lit("f1_score"), F.col("f1_score")
        ).alias("metric", "score"),
    )
    stats = describe_by(long, [arm, "metric"], {"score": F.col("score")})
    figures = ["score_n", "score_mean", "score_std", "score_min", "score_max"]
    pairs = pair_arms(stats, ["metric"], figures, base, candidate, arm)
    return with_verdict(pairs, base, candidate, "score_mean", guard=False).drop("winner")


def win_tally(rows: DataFrame, base: str = ARMS[0], candidate: str = ARMS[1]) -> DataFrame:
    return rows.agg(
        F.count_if(F.col("winner") == base.upper()).alias("base_wins"),
        F.count_if(F.col("winner") == candidate.upper()).alias("candidate_wins"),
        F.count_if(F.col("winner") == "Tie").alias("ties"),
    )
