"""Train and test feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The tables ``train.parquet`` and ``test.parquet`` of a folder."""
    return spark.read.parquet(f"{folder}/train.parquet"), spark.read.parquet(f"{folder}/test.parquet")


def split_counts(train: DataFrame, test: DataFrame) -> DataFrame:
    """Rows per split, counted in one job."""
    tagged = train.select(F.lit("train").alias("split")).unionAll(test.select(F.lit("test").alias("split")))
    return tagged.groupBy("split").agg(F.count(F.lit(1)).alias("row_count"))
