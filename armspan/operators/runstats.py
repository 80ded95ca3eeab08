"""Statistics over run records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armspan.functions.rounding import round_exact

TOTAL_KEY = "total"
# Parts that the keys of a group are dealt to.
_KEY_BUCKETS = 64
# Fixed value: the cost entry that repeats the sum of its parts.
COMPUTE_SUBTOTAL = "total_compute"


def spread(values: Mapping[str, Column], counted: bool = True) -> list[Column]:
    """Mean, population deviation, minimum and maximum of each named column.

    If ``counted``, with the number of values behind them; nulls are left out of all.
    """
    measures = []
    for name, column in values.items():
        measures += [F.count(column).alias(f"{name}_n")] if counted else []
        measures += [
            F.avg(column).alias(f"{name}_mean"),
            F.stddev_pop(column).alias(f"{name}_std"),
            F.min(column).alias(f"{name}_min"),
            F.max(column).alias(f"{name}_max"),
        ]
    return measures


def describe_by(runs: DataFrame, by: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """Spread of each value per group. The values are computed once per row."""
    narrow = runs.select(*by, *[column.alias(f"_v_{name}") for name, column in values.items()])
    return narrow.groupBy(*by).agg(*spread({name: F.col(f"_v_{name}") for name in values}))


def total_recorded(costs: Column) -> Column:
    """Sum of all cost entries, as records state it: compute parts and their subtotal."""
    return F.aggregate(F.map_values(costs), F.lit(0.0), lambda total, v: total + v)


def total_net(costs: Column) -> Column:
    """Sum of the cost entries with compute counted once."""
    return total_recorded(F.map_filter(costs, lambda key, _: key != COMPUTE_SUBTOTAL))


def _entry(key: Column, value: Column) -> Column:
    return F.struct(key.cast("string").alias("key"), value.cast("double").alias("value"))


def metric_key_stats(
    runs: DataFrame,
    metrics: str,
    by: Sequence[str],
    fill_missing: bool = True,
    with_total: bool = False,
) -> DataFrame:
    """Mean, population deviation, min, max and count of every key of a metric map.

    With ``fill_missing`` a run whose map lacks a key counts as 0 for that key; a run
    without the map is left out. Each run adds one marker entry without a key, so one
    scan gives both the key statistics and the number of runs per group, from which the
    zeros are folded in; no row is made for a missing entry. Windows run over the
    statistics, one row per distinct key, in ``_KEY_BUCKETS`` parts of each group. ``with_total`` adds the sum of each map as the
    key ``total``, in place of an entry of that name.
    """
    if not by:
        raise ValueError("name at least one grouping column")
    source, columns, extra = F.col(metrics), {}, []
    if with_total:
        others = F.map_filter(source, lambda key, _: key != TOTAL_KEY)
        columns["_map"] = F.when(F.map_contains_key(source, TOTAL_KEY), others).otherwise(source)
        # Summed before the entries are unfolded, which stays compiled code this way.
        columns["_total"] = total_recorded(source)
        extra.append(_entry(F.lit(TOTAL_KEY), F.col("_total")))
    else:
        columns["_map"] = source
    if fill_missing:
        extra.append(_entry(F.lit(None), F.lit(None)))
    entries = F.map_entries("_map")
    if extra:
        entries = F.concat(entries, F.array(*extra))
    stats = (
        runs.select(*by, *[column.alias(name) for name, column in columns.items()])
        .select(*by, F.inline(entries))
        .groupBy(*by, "key")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.count("value").alias("_n"),
            F.avg("value").alias("mean"),
            F.var_pop("value").alias("_var"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )
    if not fill_missing:
        return stats.select(
            *by, "key", F.col("_n").alias("count"), "mean", F.sqrt("_var").alias("std"), "min", "max"
        )
    # Markers go to every bucket of their group and keys to one: no task gets all keys of a group.
    place = F.pmod(F.xxhash64("key"), F.lit(_KEY_BUCKETS))
    places = F.when(F.col("key").isNull(), F.sequence(F.lit(0).cast("bigint"), F.lit(_KEY_BUCKETS - 1).cast("bigint")))
    dealt = stats.select("*", F.explode(F.coalesce(places, F.array(place))).alias("_bucket"))
    marked = F.max(F.when(F.col("key").isNull(), F.col("_rows"))).over(Window.partitionBy(*by, "_bucket"))
    present = dealt.withColumn("count", marked).filter(F.col("key").isNotNull())
    share = F.col("_n") / F.col("count")
    zeros = F.col("_n") < F.col("count")
    # Variance of two merged groups, one of which is all zeros.
    variance = share * F.col("_var") + share * (1.0 - share) * F.col("mean") * F.col("mean")
    return present.select(
        *by,
        "key",
        "count",
        (F.col("mean") * share).alias("mean"),
        F.sqrt(variance).alias("std"),
        F.when(zeros, F.least("min", F.lit(0.0))).otherwise(F.col("min")).alias("min"),
        F.when(zeros, F.greatest("max", F.lit(0.0))).otherwise(F.col("max")).alias("max"),
    )


def timing_key_stats(runs: DataFrame, by: Sequence[str], fill_missing: bool = True) -> DataFrame:
    return metric_key_stats(runs, "timings", by, fill_missing)


def cost_key_stats(runs: DataFrame, by: Sequence[str], fill_missing: bool = True) -> DataFrame:
    """Statistics per cost key, with each run's recorded sum as the key ``total``."""
    return metric_key_stats(runs, "costs", by, fill_missing, with_total=True)


def succeeded(errors: Column) -> Column:
    """True for a run whose error list is empty or absent."""
    return errors.isNull() | (F.size(errors) == 0)


def _success_counts() -> list[Column]:
    return [
        F.count_if(succeeded(F.col("errors"))).alias("successful_runs"),
        F.count_if(~succeeded(F.col("errors"))).alias("failed_runs"),
    ]


def run_success_counts(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("num_runs"), *_success_counts())


def multi_run_summary(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Run counts with the spread of total time and recorded total cost.

    A run that lacks ``total_time`` counts as 0, as in ``metric_key_stats``. Without
    groups an empty input gives one row of zeros.
    """
    recorded = F.try_element_at("timings", F.lit("total_time"))
    time = F.when(F.col("timings").isNotNull(), F.coalesce(recorded, F.lit(0.0)))
    cost = total_recorded(F.col("costs"))
    narrow = runs.select(*by, "errors", time.alias("_time"), cost.alias("_cost"))
    measures = spread({"total_time": F.col("_time"), "total_cost": F.col("_cost")}, counted=False)
    summary = narrow.groupBy(*by).agg(F.count(F.lit(1)).alias("num_runs"), *_success_counts(), *measures)
    figures = [c for c in summary.columns if c.startswith(("total_time_", "total_cost_"))]
    return summary.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in figures})


def suite_success_rate(operations: DataFrame, by: Sequence[str], success: str = "success") -> DataFrame:
    """Percentage of successful operations per suite, 0 for a suite without any."""
    counted = operations.groupBy(*by).agg(
        F.count(success).alias("operations"), F.count_if(success).alias("successful")
    )
    rate = F.col("successful") / F.nullif("operations", F.lit(0)) * 100.0
    return counted.withColumn("success_rate", F.coalesce(round_exact(rate, 2), F.lit(0.0)))
