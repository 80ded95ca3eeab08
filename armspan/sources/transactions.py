"""The transactions table: CSV scans and the registry of dataset modes."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armspan.operators.sampling import sample_by_hash, sample_rows
from armspan.schemas import TRANSACTIONS

_CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class DatasetMode:
    """Where the data of one mode lies, its size for the cost model and the share to read."""

    path: str
    size_gb: float
    sample_fraction: float = 1.0


# Data size in GB and sampled share of each dataset mode.
MODE_SIZES_GB = {"sample": 0.08, "large": 5.0, "full": 21.0}
MODE_FRACTIONS = {"sample": 1.0, "large": 0.5, "full": 1.0}


def mode_registry(paths: Mapping[str, str]) -> dict[str, DatasetMode]:
    return {
        mode: DatasetMode(path, MODE_SIZES_GB[mode], MODE_FRACTIONS[mode]) for mode, path in paths.items()
    }


def _csv(spark: SparkSession, mode: str) -> DataFrameReader:
    # Whether a row has all its fields shows only when none of them is left out.
    return spark.read.option("header", True).option("mode", mode).option("columnPruning", False)


def _judged(spark: SparkSession, path: str) -> DataFrame:
    """All rows, with the text of those that do not fit the schema in ``_corrupt_record``."""
    wider = T.StructType([*TRANSACTIONS.fields, T.StructField(_CORRUPT, T.StringType())])
    reader = _csv(spark, "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT)
    rows = reader.schema(wider).option("enforceSchema", False).csv(path)
    # Names every field, so that a row fits or not whatever a query selects from it.
    every_field = F.size(F.array(*[F.col(name).isNull() for name in TRANSACTIONS.names])) > 0
    return rows.filter(every_field)


def read_transactions(
    spark: SparkSession, path: str, infer: bool = False, skip_malformed: bool = False
) -> DataFrame:
    """CSV with a header. Inferring the types costs a pass over the whole file and can
    take ids such as T1 for timestamps, so the schema is explicit unless asked. A file
    whose header differs from the schema fails instead of filling the wrong columns.

    A row with too few or too many fields fails the query, and so does a field of another
    type that the query selects. With ``skip_malformed``, which needs the explicit schema,
    such rows are left out instead; ``rejected_transactions`` returns them.
    """
    if infer:
        if skip_malformed:
            raise ValueError("without a schema no row is malformed by its types")
        return _csv(spark, "FAILFAST").option("inferSchema", True).csv(path)
    if skip_malformed:
        return _judged(spark, path).filter(F.col(_CORRUPT).isNull()).drop(_CORRUPT)
    return _csv(spark, "FAILFAST").schema(TRANSACTIONS).option("enforceSchema", False).csv(path)


def rejected_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Text of the rows that do not fit the schema."""
    return _judged(spark, path).filter(F.col(_CORRUPT).isNotNull()).select(F.col(_CORRUPT).alias("text"))


def read_mode(
    spark: SparkSession,
    registry: Mapping[str, DatasetMode],
    mode: str,
    infer: bool = False,
    sample_key: str | None = None,
    seed: int = 42,
) -> DataFrame:
    """The transactions of one mode, sampled where the mode says so.

    With ``sample_key`` the sample depends on that column alone; without it the
    rows are drawn by partition, so another file layout gives another sample.
    """
    if mode not in registry:
        raise ValueError(f"unknown dataset mode {mode!r}; known: {sorted(registry)}")
    chosen = registry[mode]
    rows = read_transactions(spark, chosen.path, infer=infer)
    if chosen.sample_fraction >= 1.0:
        return rows
    if sample_key is not None:
        return sample_by_hash(rows, sample_key, chosen.sample_fraction, seed)
    return sample_rows(rows, chosen.sample_fraction, seed)
