"""Cost of cluster time and stored data, from price and shape tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from armspan.functions.measures import hours, months

# USD per hour, and per GB and month for storage.
PRICES = (
    ("aws", "m4.large", 0.10),
    ("aws", "emr_fee_per_instance", 0.03),
    ("aws", "s3_storage", 0.023),
    ("gcp", "n1-standard-2", 0.095),
    ("gcp", "dataproc_fee_per_vcpu", 0.010),
    ("gcp", "gcs_storage", 0.020),
)

# Names of the cost entries of each arm.
COST_ENTRIES = {
    "aws": ("master_ec2", "master_emr_fee", "core_ec2", "core_emr_fee"),
    "gcp": ("master_vm", "master_dataproc_fee", "worker_vm", "worker_dataproc_fee"),
}

# Data size and storage time that an experiment has by default.
DEFAULT_DATA_GB = 0.5
DEFAULT_STORAGE_HOURS = 24.0

_PARTS = ("master_vm", "master_fee", "worker_vm", "worker_fee")
_RATE_COLUMNS = ("master_rate", "worker_rate", "node_fee", "storage_rate", "worker_count")

# Literal tables up to this many rows carry a broadcast hint; larger ones take any join.
DIMENSION_ROWS = 10_000


@dataclass(frozen=True)
class ClusterShape:
    """The machines of one arm. A fee is charged per node, or per vCPU of each node."""

    arm: str
    master_type: str
    worker_type: str
    worker_count: int
    fee_item: str
    fee_per_vcpu: bool
    vcpus: int
    storage_item: str


# The measured clusters. The fee counts 4 vCPUs a node although the
# machine has 2; the recorded costs were computed that way.
SHAPES = (
    ClusterShape("aws", "m4.large", "m4.large", 2, "emr_fee_per_instance", False, 4, "s3_storage"),
    ClusterShape("gcp", "n1-standard-2", "n1-standard-2", 2, "dataproc_fee_per_vcpu", True, 4, "gcs_storage"),
)


def dimension(spark: SparkSession, rows: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """A literal table, marked for broadcast up to ``DIMENSION_ROWS`` rows."""
    if not rows:
        raise ValueError("a literal table needs a row to tell its types")
    table = spark.createDataFrame(
        pa.table({name: pa.array([row[i] for row in rows]) for i, name in enumerate(names)})
    )
    return F.broadcast(table) if len(rows) <= DIMENSION_ROWS else table


def price_table(spark: SparkSession, prices: Sequence[tuple[str, str, float]] = PRICES) -> DataFrame:
    if len({(arm, item) for arm, item, _ in prices}) != len(prices):
        raise ValueError("an item has two prices for one arm")
    return dimension(spark, prices, ["arm", "item", "unit_price"])


def price_lookup(
    rows: DataFrame, prices: DataFrame, item: str, out: str = "unit_price", arm: str = "arm"
) -> DataFrame:
    """Adds the price of each row's item; an item without a price fails the query."""
    listed = prices.select(
        F.col("arm").alias("_arm"), F.col("item").alias("_item"), F.col("unit_price").alias("_price")
    )
    joined = rows.join(listed, (F.col(arm) == F.col("_arm")) & (F.col(item) == F.col("_item")), "left")
    problem = F.concat_ws(" ", F.lit("no price for"), F.col(arm), F.col(item))
    checked = F.when(F.col("_price").isNull(), F.raise_error(problem)).otherwise(F.col("_price"))
    return joined.withColumn(out, checked).drop("_arm", "_item", "_price")


def _looked_up(spark: SparkSession, shapes: Sequence[ClusterShape], prices: DataFrame) -> DataFrame:
    """The rates of ``rate_table`` from a price table of any size, one row per shape."""
    wanted = [
        (shape.arm, shape.worker_count, role, item, float(factor))
        for shape in shapes
        for role, item, factor in (
            ("master_rate", shape.master_type, 1),
            ("worker_rate", shape.worker_type, 1),
            ("node_fee", shape.fee_item, shape.vcpus if shape.fee_per_vcpu else 1),
            ("storage_rate", shape.storage_item, 1),
        )
    ]
    items = dimension(spark, wanted, ["arm", "worker_count", "role", "item", "factor"])
    # Few prices are needed, so the rest is left out where the table is read.
    needed = prices.filter(F.col("item").isin(*{item for _, _, _, item, _ in wanted}))
    priced = price_lookup(items, needed, "item")

    def rate(role: str) -> Column:
        is_role = F.col("role") == role
        problem = F.raise_error(F.concat_ws(" ", F.lit("two prices for the"), F.lit(role), F.lit("of"), F.col("arm")))
        price = F.max(F.when(is_role, F.col("unit_price") * F.col("factor")))
        return F.when(F.count_if(is_role) > 1, problem).otherwise(price).alias(role)

    rates = priced.groupBy("arm", "worker_count").agg(*[rate(role) for role in _RATE_COLUMNS[:-1]])
    rates = rates.select(F.col("arm").alias("_rate_arm"), *_RATE_COLUMNS)
    return F.broadcast(rates) if len(shapes) <= DIMENSION_ROWS else rates


def rate_table(
    spark: SparkSession,
    shapes: Sequence[ClusterShape] = SHAPES,
    prices: Sequence[tuple[str, str, float]] | DataFrame = PRICES,
) -> DataFrame:
    """Hourly and storage rates, one row per arm.

    The prices of a shape are settled here, so a run needs a single lookup, by its arm.
    Prices given as a table (arm, item, unit_price) are looked up by a join; an item
    without a price or with two then fails the query that needs it.
    """
    if len({shape.arm for shape in shapes}) != len(shapes):
        raise ValueError("an arm has two cluster shapes")
    if isinstance(prices, DataFrame):
        return _looked_up(spark, shapes, prices)
    listed = {(arm, item): price for arm, item, price in prices}

    def price(arm: str, item: str) -> float:
        if (arm, item) not in listed:
            raise ValueError(f"no price for {arm} {item}")
        return listed[arm, item]

    rows = []
    for shape in shapes:
        fee = price(shape.arm, shape.fee_item)
        rows.append(
            (
                shape.arm,
                price(shape.arm, shape.master_type),
                price(shape.arm, shape.worker_type),
                fee * shape.vcpus if shape.fee_per_vcpu else fee,
                price(shape.arm, shape.storage_item),
                shape.worker_count,
            )
        )
    return dimension(spark, rows, ["_rate_arm", *_RATE_COLUMNS])


def with_rates(runs: DataFrame, rates: DataFrame, arm: str = "arm") -> DataFrame:
    """Adds the rates of each run's arm; an arm without a shape fails the query."""
    joined = runs.join(rates, F.col(arm) == F.col("_rate_arm"), "left")
    problem = F.raise_error(F.concat_ws(" ", F.lit("no cluster shape for arm"), F.col(arm)))
    unknown = F.col("_rate_arm").isNull()
    # Checked per column, as columns that a cost does not use are pruned.
    checked = {name: F.when(unknown, problem).otherwise(F.col(name)) for name in _RATE_COLUMNS}
    return joined.withColumns(checked).drop("_rate_arm")


def cluster_components(runtime_hours: Column, worker_count: Column | None = None) -> dict[str, Column]:
    """Machine and fee cost of the master and of all workers, over the rate columns."""
    workers = F.col("worker_count") if worker_count is None else worker_count
    parts = {
        "master_vm": F.col("master_rate") * runtime_hours,
        "master_fee": F.col("node_fee") * runtime_hours,
        "worker_vm": F.col("worker_rate") * runtime_hours * workers,
        "worker_fee": F.col("node_fee") * runtime_hours * workers,
    }
    total = parts["master_vm"] + parts["master_fee"] + parts["worker_vm"] + parts["worker_fee"]
    return {**parts, "total_compute": total}


def storage_usd(data_gb: Column, duration_hours: Column) -> Column:
    return F.col("storage_rate") * data_gb * months(duration_hours)


def cluster_cost(runs: DataFrame, rates: DataFrame, seconds: str, arm: str = "arm") -> DataFrame:
    """Adds the cost components of each run's cluster time."""
    parts = cluster_components(hours(F.col(seconds)))
    return with_rates(runs, rates, arm).withColumns(parts).drop(*_RATE_COLUMNS)


def storage_cost(
    runs: DataFrame, rates: DataFrame, data_gb: str, duration_hours: str, arm: str = "arm"
) -> DataFrame:
    cost = storage_usd(F.col(data_gb), F.col(duration_hours))
    return with_rates(runs, rates, arm).withColumn("storage", cost).drop(*_RATE_COLUMNS)


def experiment_cost(
    runs: DataFrame,
    rates: DataFrame,
    seconds: str,
    data_gb: Column | None = None,
    storage_hours: Column | None = None,
    arm: str = "arm",
) -> DataFrame:
    """Adds cluster components, storage cost and their total."""
    parts = cluster_components(hours(F.col(seconds)))
    gb = F.lit(DEFAULT_DATA_GB) if data_gb is None else data_gb
    kept = F.lit(DEFAULT_STORAGE_HOURS) if storage_hours is None else storage_hours
    storage = storage_usd(gb, kept)
    costs = {**parts, "storage": storage, "total": parts["total_compute"] + storage}
    return with_rates(runs, rates, arm).withColumns(costs).drop(*_RATE_COLUMNS)


def hourly_rate(
    runs: DataFrame, rates: DataFrame, arm: str = "arm", worker_count: Column | None = None
) -> DataFrame:
    """Adds the cost of one hour of each run's cluster."""
    rate = cluster_components(F.lit(1.0), worker_count)["total_compute"]
    return with_rates(runs, rates, arm).withColumn("hourly_rate", rate).drop(*_RATE_COLUMNS)


def cost_by_mode(
    runs: DataFrame,
    rates: DataFrame,
    mode_sizes: DataFrame,
    execution_seconds: str,
    provisioning_seconds: str,
    reused: str,
    mode: str = "mode",
    arm: str = "arm",
) -> DataFrame:
    """Experiment cost with the data size of each run's dataset mode.

    Provisioning is charged unless the run reused a cluster.
    """
    sized = runs.join(mode_sizes, mode, "left")
    problem = F.concat_ws(" ", F.lit("no data size for mode"), F.col(mode))
    gb = F.when(F.col("size_gb").isNull(), F.raise_error(problem)).otherwise(F.col("size_gb"))
    provisioning = F.when(F.col(reused), F.lit(0.0)).otherwise(F.col(provisioning_seconds))
    runtime = sized.withColumn("cluster_seconds", provisioning + F.col(execution_seconds))
    return experiment_cost(runtime, rates, "cluster_seconds", gb, arm=arm)


def cost_map(arm: str = "arm") -> Column:
    """The component columns as the cost map of a run record.

    The known arms have their own entry names; any other arm has those of the columns.
    """
    shared = [x for name in ("total_compute", "storage") for x in (F.lit(name), F.col(name))]

    def entries(names: Sequence[str]) -> Column:
        return F.create_map(*[x for name, part in zip(names, _PARTS) for x in (F.lit(name), F.col(part))], *shared)

    costs = entries(_PARTS)
    for known, names in COST_ENTRIES.items():
        costs = F.when(F.col(arm) == known, entries(names)).otherwise(costs)
    return costs
