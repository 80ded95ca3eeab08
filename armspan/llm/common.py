"""Helpers of the training-data operators: exact column picks, stored tables, numbering."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from armspan.session import fresh_path

# Bits that monotonically_increasing_id gives to the row number inside a partition.
ROW_BITS = 33
# ASCII white space, as in the class [\x20\x09-\x0D].
WORD = r"[^\x20\x09-\x0D]+"
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Paths of the tables stored for whoever owns them just now.
_owned: ContextVar[list[str] | None] = ContextVar("owned", default=None)
_ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()),
    "array<string>": pa.list_(pa.string()),
    "array<float>": pa.list_(pa.float32()),
}


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns with exactly these names, whatever other columns are called.

    Columns go by position, so an extra column that differs only in case does not clash.
    """
    places = {name: place for place, name in reversed(list(enumerate(df.columns)))}
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{places[name]}").alias(name) for name in names])


def nested(df: DataFrame) -> tuple[DataFrame, Callable[[str], Column]]:
    """``df`` as one struct column ``row``, and how to reach a column in it by exact name.

    Field names are positions: whatever columns an operator adds beside ``row`` cannot clash.
    """
    places = {name: place for place, name in reversed(list(enumerate(df.columns)))}
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(F.struct("*").alias("row")), lambda name: F.col(f"row.c{places[name]}")


def unnested(df: DataFrame, columns: list[str], *added: str) -> DataFrame:
    """Undoes ``nested``; input columns that carry an added name are left out."""
    taken = {name.lower() for name in added}
    kept = [F.col(f"row.c{i}").alias(name) for i, name in enumerate(columns) if name.lower() not in taken]
    return df.select(*kept, *added)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared scratch folder and reads it back.

    Later jobs read files that every executor can reach, so a lost executor costs no
    recomputation and values such as row numbers stay as they were written.
    """
    path = fresh_path(df.sparkSession, label)
    with _tidy(df.sparkSession):
        df.write.parquet(path)
    if (mine := _owned.get()) is not None:
        mine.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Queries inside leave no shuffle files behind, which else stay until the driver collects its garbage."""
    before = spark.conf.get(_TIDY)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


@contextmanager
def owned() -> Iterator[list[str]]:
    """The paths of the tables that are stored inside, for who has to delete them."""
    tables: list[str] = []
    before = _owned.set(tables)
    try:
        yield tables
    finally:
        _owned.reset(before)


def discard(spark: SparkSession, tables: list[str]) -> None:
    """Deletes stored tables; no result that is still to be read may need them."""
    for path in tables:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def numbered(df: DataFrame, order: list[Column], group: str | None, label: str, name: str) -> DataFrame:
    """Adds ``name``: the gapless position from 0 in ``order``, per ``group`` if given.

    ``order`` has to keep the rows of a group together. The rows are range-partitioned once
    and stored; partitions are then numbered from their counts, so no task holds a group.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), label)
    part = F.shiftright("_at", ROW_BITS)
    keys = ["_part", *([group] if group else [])]
    counts = rows.withColumn("_part", part).groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys[1:]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    starts = starts.select(*keys, (F.col("_start") - F.col("_first")).alias("_shift"))
    # One row a partition and group border: bounded by the number of shuffle partitions and groups.
    joined = rows.withColumn("_part", part).join(F.broadcast(starts), keys)
    return joined.withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def running_before(df: DataFrame, groups: list[str], chunk: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over earlier rows of the group, by (chunk, order).

    Sums of chunks come first, so a group is spread over as many tasks as it has chunks.
    Groups must not be null.
    """
    sums = df.groupBy(*groups, chunk).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*groups).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*groups, chunk, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*groups, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    total = F.col("_start") + F.col("_local")
    return local.join(starts, [*groups, chunk]).withColumn(name, total).drop("_start", "_local")


def arrow_map(df: DataFrame, each: Callable[[Iterator[dict]], Iterable[tuple]], schema: str, rows: int = 2048) -> DataFrame:
    """Runs ``each`` over the rows of a partition, given one after another as dictionaries.

    Results leave in Arrow batches of ``rows`` rows; only one input and one output batch are held.
    """
    target = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for result in each(_rows(batches)):
            held.append(result)
            if len(held) >= rows:
                yield _batch(held, target)
                held = []
        if held:
            yield _batch(held, target)

    return df.mapInArrow(run, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        names, columns = batch.schema.names, batch.columns
        for i in range(batch.num_rows):
            yield {name: column[i].as_py() for name, column in zip(names, columns, strict=True)}


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(values, field.type) for values, field in zip(zip(*held, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string of flat columns."""
    columns = [column.split() for column in ddl.split(",")]
    return pa.schema([(name, _ARROW[kind]) for name, kind in columns])
