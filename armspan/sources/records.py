"""Run, storage and training records kept as JSON."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armspan.schemas import ML_METRICS, RUN_RECORD, STORAGE_RECORD

_CORRUPT = "_corrupt_record"


def _reader(
    spark: SparkSession, name_glob: str | None, documents: bool, schema: T.StructType, mode: str
) -> DataFrameReader:
    reader = (
        spark.read.schema(schema)
        .option("mode", mode)
        .option("multiLine", documents)
        .option("timeZone", "UTC")
        .option("recursiveFileLookup", documents)
    )
    return reader if name_glob is None else reader.option("pathGlobFilter", name_glob)


def _load(reader: DataFrameReader, path: str | Sequence[str]) -> DataFrame:
    """All records under the paths.

    Each path is read on its own, as its folders tell its partition columns (``arm``).
    """
    parts = [
        reader.json(one).select("*", F.col("_metadata.file_path").alias("source_file"))
        for one in ([path] if isinstance(path, str) else path)
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _judged(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, name_glob: str | None, documents: bool
) -> DataFrame:
    """All records, with the text of those that do not fit the schema in ``_corrupt_record``."""
    wider = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    reader = _reader(spark, name_glob, documents, wider, "PERMISSIVE")
    rows = _load(reader.option("columnNameOfCorruptRecord", _CORRUPT), path)
    # The check names every field: the parser leaves out fields that nobody reads, and
    # whether a record fits must not depend on what a query selects from it.
    every_field = F.size(F.array(*[F.col(name).isNull() for name in schema.names])) > 0
    return rows.filter(every_field)


def _read_json(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    name_glob: str | None,
    documents: bool,
    skip_broken: bool,
) -> DataFrame:
    """Records with the file each came from.

    A record that does not parse fails the query that reads it, and so does a field of
    another type that the query selects; fields it does not select are not parsed. With
    ``skip_broken`` the records that do not fit the schema are left out instead, the same
    ones whatever a query selects; ``rejected_records`` returns them. ``documents`` reads
    files that hold one pretty-printed object each, in folders of any depth; otherwise
    every line is a record, large files split over tasks, and folders such as ``arm=x``
    give a column by which whole folders are left out.
    """
    if skip_broken:
        rows = _judged(spark, path, schema, name_glob, documents)
        return rows.filter(F.col(_CORRUPT).isNull()).drop(_CORRUPT)
    return _load(_reader(spark, name_glob, documents, schema, "FAILFAST"), path)


def rejected_records(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType = RUN_RECORD,
    name_glob: str | None = None,
    documents: bool = True,
) -> DataFrame:
    """File and text of the records that a reader with ``skip_broken`` leaves out."""
    rows = _judged(spark, path, schema, name_glob, documents).filter(F.col(_CORRUPT).isNotNull())
    return rows.select("source_file", F.col(_CORRUPT).alias("text"))


def read_run_records(
    spark: SparkSession,
    path: str | Sequence[str],
    name_glob: str | None = None,
    documents: bool = True,
    skip_broken: bool = False,
) -> DataFrame:
    """Run records; ``timings`` and ``costs`` are maps because their keys differ by arm."""
    return _read_json(spark, path, RUN_RECORD, name_glob, documents, skip_broken)


def read_storage_records(
    spark: SparkSession,
    path: str | Sequence[str],
    name_glob: str | None = None,
    documents: bool = True,
    skip_broken: bool = False,
) -> DataFrame:
    return _read_json(spark, path, STORAGE_RECORD, name_glob, documents, skip_broken)


def storage_operations(records: DataFrame, *keep: str) -> DataFrame:
    """One row per record and operation of the ``summary`` map."""
    return records.select(*keep, F.explode("summary").alias("operation", "_stats")).select(
        *keep, "operation", "_stats.*"
    )


def storage_tests(records: DataFrame, *keep: str) -> DataFrame:
    """One row per single test of each record."""
    return records.select(*keep, F.explode("tests").alias("_test")).select(*keep, "_test.*")


def read_ml_metrics(
    spark: SparkSession, path: str | Sequence[str], name_glob: str | None = "part-*.txt", documents: bool = True
) -> DataFrame:
    """Training metrics from text part files or, without ``documents``, from JSON lines that state their arm.

    Metrics that do not parse are skipped; an absent accuracy or F1 counts as 0.
    """
    schema = ML_METRICS if documents else T.StructType([*ML_METRICS.fields, T.StructField("provider", T.StringType())])
    rows = _read_json(spark, path, schema, name_glob, documents, skip_broken=True)
    return rows.withColumns(
        {name: F.coalesce(F.col(name), F.lit(0.0)) for name in ("accuracy", "f1_score")}
    )
