"""Jobs of several kinds run again and again in one session, and what they leave as records.

Every attempt is a run record. Storage runs leave storage records beside it, training runs metrics.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armspan.operators import cost, learning
from armspan.operators import storage as storage_operators
from armspan.plans import profiling
from armspan.plans.training import train_and_score
from armspan.schemas import ML_METRICS, STORAGE_RECORD
from armspan.sinks.tables import write_run_records


@dataclass(frozen=True)
class Outcome:
    """What one run leaves: seconds by name, errors, and by its kind metrics or a storage record."""

    timings: Mapping[str, float]
    errors: Sequence[Mapping] = ()
    metrics: Mapping | None = None
    storage: Mapping | None = None


@dataclass(frozen=True)
class Kind:
    """A kind of job: its name and dataset mode as run names have them, and how a numbered run goes."""

    name: str
    run: Callable[[int], Outcome]
    mode: str | None = None
    data_gb: float = cost.DEFAULT_DATA_GB


@dataclass(frozen=True)
class Attempt:
    kind: Kind
    number: int
    timestamp: str
    outcome: Outcome = field(default_factory=lambda: Outcome({}))

    def as_record(self) -> dict:
        """The form that ``profiling.attempt_rows`` takes."""
        return {
            "run": self.number,
            "timestamp": self.timestamp,
            "timings": dict(self.outcome.timings),
            "errors": list(self.outcome.errors),
        }


def _error(message: str, kind: str) -> dict:
    return {"timestamp": profiling.now(), "message": message, "type": kind}


def transactions_kind(
    load: Callable[[], DataFrame],
    operations: Sequence[profiling.Operation] = profiling.TRANSACTION_OPERATIONS,
    mode: str = "sample",
    data_path: str = "",
    data_gb: float = cost.DEFAULT_DATA_GB,
) -> Kind:
    """The transactions suite; an operation that failed is an error of the run."""

    def run(number: int) -> Outcome:
        suite = profiling.profile_suite(load, operations, mode, data_path)
        return profiling.suite_outcome(suite, Outcome)

    return Kind("pyspark", run, mode, data_gb)


def training_kind(
    load: Callable[[], tuple[DataFrame, DataFrame]],
    epochs: int = 5,
    batch_size: int = learning.BLOCK_SIZE,
    layers: Sequence[int] = learning.LAYERS,
    dataset: str = "fashion-mnist",
) -> Kind:
    """Training and scoring of the train and test table that ``load`` returns."""

    def run(number: int) -> Outcome:
        start = time.perf_counter()
        metrics = train_and_score(*load(), epochs, batch_size, layers, dataset)
        taken = {"ml_training": metrics["training_time_seconds"], "benchmark_execution": time.perf_counter() - start}
        return Outcome(taken, metrics=metrics)

    return Kind("ml", run)


def storage_kind(
    load: Callable[[], DataFrame],
    folder: str,
    name: str = "table",
    sizes_mb: Sequence[int] = (5,),
    chunk_mb: int = 1,
) -> Kind:
    """The storage tests of ``profiling.storage_tests`` on the table that ``load`` returns.

    A test that failed is kept in the storage record, with its error, and is an error of the run.
    """

    def run(number: int) -> Outcome:
        start = time.perf_counter()
        record = profiling.storage_tests(load(), folder, name, sizes_mb, chunk_mb)
        taken: dict[str, float] = {}
        for test in record["tests"]:
            if test.get("error") is None:
                taken[test["operation"]] = taken.get(test["operation"], 0.0) + test["duration_seconds"]
        taken["benchmark_execution"] = time.perf_counter() - start
        errors = [_error(test["error"], test["operation"]) for test in record["tests"] if test.get("error") is not None]
        return Outcome(taken, errors, storage=record)

    return Kind("storage", run)


def repeat(kinds: Sequence[Kind], repeats: int) -> list[Attempt]:
    """Every kind ``repeats`` times, one kind after another.

    An attempt that raises is kept, with its error and the time it took.
    """
    attempts = []
    for kind in kinds:
        for number in range(1, repeats + 1):
            timestamp, start = profiling.now(), time.perf_counter()
            try:
                outcome = kind.run(number)
            except Exception as problem:
                outcome = Outcome({}, [_error(str(problem), type(problem).__name__)])
            timings = {**outcome.timings, "total_time": time.perf_counter() - start}
            whole = Outcome(timings, outcome.errors, outcome.metrics, outcome.storage)
            attempts.append(Attempt(kind, number, timestamp, whole))
    return attempts


def run_records(spark: SparkSession, attempts: Sequence[Attempt], arm: str, rates: DataFrame) -> DataFrame:
    """A run record for every attempt, priced by its kind's data."""
    kinds = {(a.kind.name, a.kind.mode, a.kind.data_gb): None for a in attempts}
    parts = []
    for name, mode, data_gb in kinds:
        mine = [a.as_record() for a in attempts if (a.kind.name, a.kind.mode, a.kind.data_gb) == (name, mode, data_gb)]
        rows = profiling.attempt_rows(spark, mine, arm)
        parts.append(profiling.run_records(rows, rates, name, mode, data_gb))
    return reduce(DataFrame.unionByName, parts)


def storage_records(spark: SparkSession, attempts: Sequence[Attempt], arm: str) -> DataFrame:
    """A storage record for every attempt that has one: all its tests, and the summary of those without an error."""
    found = [a.outcome.storage for a in attempts if a.outcome.storage is not None]
    plain = STORAGE_RECORD.fieldNames()[:-1]
    test_fields = STORAGE_RECORD["tests"].dataType.elementType.fieldNames()
    rows = []
    for number, record in enumerate(found):
        tests = [tuple(test.get(name) for name in test_fields) for test in record["tests"]]
        values = {**record, "provider": arm, "tests": tests}
        rows.append((number, *(values.get(name) for name in plain)))
    schema = STORAGE_RECORD.__class__([f for f in STORAGE_RECORD.fields if f.name in plain])
    records = spark.createDataFrame(rows, "record int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema))
    tests = records.select("record", F.explode("tests").alias("test")).select("record", "test.*")
    summaries = storage_operators.summary_records(storage_operators.summarise_tests(tests, ["record"]), ["record"])
    none = F.create_map().cast(STORAGE_RECORD["summary"].dataType)
    return records.join(summaries, "record", "left").select(*plain, F.coalesce("summary", none).alias("summary"))


def training_metrics(spark: SparkSession, attempts: Sequence[Attempt], arm: str) -> DataFrame:
    """The metrics of every attempt that trained to its end, with the arm as provider."""
    names = ML_METRICS.fieldNames()
    found = [a.outcome.metrics for a in attempts if a.outcome.metrics is not None]
    rows = spark.createDataFrame([tuple(m.get(n) for n in names) for m in found], ML_METRICS)
    return rows.withColumn("provider", F.lit(arm))


def write_attempts(
    spark: SparkSession, attempts: Sequence[Attempt], path: str, arm: str, rates: DataFrame | None = None
) -> None:
    """All records as JSON lines under ``path``, in folders runs, storage and training, by arm.

    The folders of storage and training are written if there are such records. ``rates`` prices the
    arm, by default the known shapes and prices.
    """
    rates = cost.rate_table(spark) if rates is None else rates
    write_run_records(run_records(spark, attempts, arm, rates), f"{path}/runs")
    if any(a.outcome.storage is not None for a in attempts):
        write_run_records(storage_records(spark, attempts, arm), f"{path}/storage")
    if any(a.outcome.metrics is not None for a in attempts):
        write_run_records(training_metrics(spark, attempts, arm), f"{path}/training")
