"""The given tables in the shapes that the operators expect.

Every binding is a projection of a whole table: no row is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armspan.functions.identity import run_name
from armspan.functions.measures import throughput
from armspan.functions.pixels import grid
from armspan.functions.rounding import round_exact
from armspan.operators.runstats import succeeded, total_recorded

EMBEDDING_SIZE = 64


# Schemas of the given tables, so that opening one reads no file footers.
_SCHEMAS = {
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions, with the numeric ids they are stored with."""
    when = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("CUST_ID"),
        F.col("o_orderkey").alias("TRANS_ID"),
        F.year(when).alias("YEAR"),
        F.month(when).alias("MONTH"),
        F.day(when).alias("DAY"),
        F.col("o_orderpriority").alias("EXP_TYPE"),
        F.col("o_totalprice").alias("AMOUNT"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the layout of the transactions file: text ids and all ten columns."""
    date = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("CUST_ID"),
        date.alias("START_DATE"),
        F.lit(None).cast("date").alias("END_DATE"),
        F.col("o_orderkey").cast("string").alias("TRANS_ID"),
        date.alias("DATE"),
        F.year(date).alias("YEAR"),
        F.month(date).alias("MONTH"),
        F.day(date).alias("DAY"),
        F.col("o_orderpriority").alias("EXP_TYPE"),
        F.col("o_totalprice").alias("AMOUNT"),
    )


def _arm(key: Column) -> Column:
    return F.when(key % 2 == 0, "aws").otherwise("gcp")


def _mode(key: Column) -> Column:
    return F.when(key % 3 == 0, "sample").when(key % 3 == 1, "large").otherwise("full")


def named_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an arm, a dataset mode and a run name; some names lack the arm."""
    user = F.col("user_id")
    name = run_name(
        kind=F.col("event_type"),
        run=user % 20 + 1,
        stamp=F.date_format("ts", "yyyyMMdd_HHmmss"),
        arm=F.when(user % 5 != 0, _arm(user)),
        mode=F.when(user % 4 != 0, _mode(user)),
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        "user_id",
        F.col("event_type").alias("benchmark"),
        "value",
        _arm(user).alias("provider"),
        _mode(user).alias("mode"),
        name.alias("experiment_id"),
    )


def _present(*entries: Column) -> Column:
    return F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as run records. Keys are missing from some maps, some runs lack a whole
    map or the error list, and the cost keys differ by arm."""
    user, value, kind = F.col("user_id"), F.col("value"), F.col("benchmark")
    is_aws = F.col("provider") == "aws"
    timings = _present(
        F.lit("total_time"),
        value,
        F.lit("benchmark_execution"),
        F.when(user % 3 != 0, value * 0.75),
        F.lit("ml_training"),
        F.when(kind == "purchase", value * 0.5),
    )
    costs = _present(
        F.when(is_aws, "master_ec2").otherwise("master_vm"),
        value * 0.001,
        F.when(is_aws, "core_ec2").otherwise("worker_vm"),
        value * 0.002,
        F.lit("total_compute"),
        value * 0.001 + value * 0.002,
        F.lit("storage"),
        F.when(kind != "view", F.lit(0.0005)),
    )
    stamp = F.col("ts").cast("string")
    failure = F.array(F.struct(stamp.alias("timestamp"), F.lit("failed").alias("message"), kind.alias("type")))
    none = F.array().cast("array<struct<timestamp:string,message:string,type:string>>")
    metadata = F.struct(kind.alias("benchmark_type"), F.col("mode").alias("dataset_mode"))
    shaped = named_events(spark, sf_dir).select(
        "event_id",
        "experiment_id",
        "provider",
        "benchmark",
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(user % 7 != 0, timings).alias("timings"),
        F.when(user % 11 != 0, costs).alias("costs"),
        metadata.alias("metadata"),
        F.when(kind == "error", failure).when(user % 5 != 0, none).alias("errors"),
    )
    summary = F.struct(
        F.try_element_at("timings", F.lit("total_time")).alias("total_time_seconds"),
        total_recorded(F.col("costs")).alias("total_cost_usd"),
        succeeded(F.col("errors")).alias("success"),
    )
    return shaped.withColumn("summary", summary)


def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total time and cost of every run."""
    return named_events(spark, sf_dir).select(
        "event_id",
        "provider",
        "benchmark",
        F.col("value").alias("total_time"),
        (F.col("value") * 0.001 + 0.0005).alias("total_cost"),
    )


def storage_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as storage tests; an order is a record, and returned items failed."""
    step = F.col("l_linenumber") % 4
    operation = (
        F.when(step == 0, "upload").when(step == 1, "download").when(step == 2, "sequential_read").otherwise("write")
    )
    seconds = F.rint(F.col("l_tax") * 100.0)
    failed = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("record_id"),
        _arm(F.col("l_orderkey")).alias("provider"),
        operation.alias("operation"),
        F.col("l_quantity").alias("file_size_mb"),
        F.when(~failed, seconds).alias("duration_seconds"),
        F.when(~failed, round_exact(throughput(F.col("l_quantity"), seconds), 2)).alias("throughput_mbps"),
        F.when(failed, "returned").alias("error"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as images of 8 by 8 values."""
    return embeddings(spark, sf_dir).select("vec_id", "label", grid(F.col("embedding"), 8, 8).alias("image"))


def byte_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings scaled to byte intensities."""
    intensity = F.transform(
        "embedding", lambda v: (F.floor(F.abs(v.cast("double")) * 1000.0) % 256).cast("int")
    )
    return embeddings(spark, sf_dir).select("vec_id", "label", intensity.alias("pixels"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("quality").alias("label"), F.col("toxic").alias("prediction")
    )


def training_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One training record per arm and run number; every fourth lacks its F1."""
    run = F.col("user_id") % 20
    rate = lambda kind: F.count_if(F.col("benchmark") == kind) / F.count(F.lit(1))
    grouped = named_events(spark, sf_dir).groupBy("provider", run.cast("int").alias("run")).agg(
        rate("purchase").alias("accuracy"), rate("click").alias("_f1")
    )
    return grouped.select("provider", "run", "accuracy", F.when(F.col("run") % 4 != 0, F.col("_f1")).alias("f1_score"))


def as_schema(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``rows`` that ``schema`` knows."""
    return rows.select(*[name for name in schema.names if name in rows.columns])
