import json

import pytest
from pyspark.sql import functions as F

from armspan.operators import cost, runstats
from armspan.operators import transactions as tx
from armspan.plans import bindings, profiling
from armspan.session import kept
from armspan.sinks.tables import write_new_document


def test_drain_counts_rows(spark):
    assert profiling.drain(spark.range(123)) == 123
    assert profiling.drain(spark.range(0)) == 0
    assert profiling.drain(spark.createDataFrame([], "a int")) == 0


def test_failure_does_not_stop_the_suite(spark):
    operations = [
        profiling.Operation("bad", "fails while running", lambda df: df.select(F.raise_error(F.lit("boom")))),
        profiling.Operation("worse", "fails while planning", lambda df: df.select("no_such_column")),
        profiling.Operation("good", "runs", lambda df: df),
    ]
    suite = profiling.profile_suite(lambda: spark.range(5), operations)
    bad, worse, good = suite["operations"]
    assert not bad["success"] and "boom" in bad["error"] and "result_rows" not in bad
    assert not worse["success"] and "no_such_column" in worse["error"]
    assert good["success"] and good["result_rows"] == 5
    assert suite["success_rate"] == 33.33 and suite["total_rows"] == 5
    rows = profiling.operation_rows(spark, suite["operations"])
    rate = runstats.suite_success_rate(rows.withColumn("suite", F.lit(1)), ["suite"]).first()
    assert rate["success_rate"] == 33.33


def test_suite_of_the_transactions_file(spark, small_dir, tmp_path):
    suite = profiling.profile_suite(lambda: bindings.transactions(spark, small_dir), data_path="orders", preview_rows=1)
    assert [op["name"] for op in suite["operations"]] == [op.name for op in profiling.TRANSACTION_OPERATIONS]
    assert suite["success_rate"] == 100.0
    rows = {op["name"]: op["result_rows"] for op in suite["operations"]}
    assert rows["sort_by_amount_desc"] == rows["join_customer_summary"] == suite["total_rows"] == 1500
    write_new_document(profiling.suite_row(spark, suite), str(tmp_path / "suite"))
    stored = json.loads(spark.read.text(str(tmp_path / "suite")).first()["value"])
    assert stored["operations"] == suite["operations"] and stored["sampled"] is False


def test_the_table_is_released(spark):
    profiling.profile_suite(lambda: spark.range(5), [])
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_operations_read_the_kept_table(spark, small_dir):
    """Whatever else the session keeps: the suite's table is kept while its operations run, and not after."""
    seen = []

    def watched(df):
        seen.append((df, df._jdf.queryExecution().executedPlan().toString()))
        return df.groupBy("EXP_TYPE").count()

    facts = lambda: bindings.facts(spark, small_dir)
    profiling.profile_suite(facts, [profiling.Operation("a", "", watched), profiling.Operation("b", "", watched)])
    assert len(seen) == 2 and all("InMemoryTableScan" in plan for _, plan in seen)
    assert not seen[0][0].storageLevel.useMemory and not seen[0][0].storageLevel.useDisk
    profiling.profile_suite(facts, [profiling.Operation("c", "", watched)], cache=False)
    assert "InMemoryTableScan" not in seen[2][1]


def test_training_reads_kept_columns(spark):
    rows = spark.range(5).withColumn("x", F.rand(1))
    with kept(rows) as same:
        assert "InMemoryTableScan" in same._jdf.queryExecution().executedPlan().toString()
        with kept(same) as again:
            assert again.storageLevel.useMemory
        assert same.storageLevel.useMemory
    assert not rows.storageLevel.useMemory


def test_failed_attempts_are_kept(spark):
    def run(number):
        if number == 2:
            raise RuntimeError("lost")
        return profiling.profile_suite(lambda: spark.range(3), [profiling.Operation("all", "", lambda df: df)])

    attempts = profiling.attempt_rows(spark, profiling.profile_repeated(run, 3), "local")
    counts = runstats.run_success_counts(attempts, ["provider"]).first()
    assert (counts["num_runs"], counts["successful_runs"], counts["failed_runs"]) == (3, 2, 1)
    stats = {r["key"]: r["count"] for r in runstats.timing_key_stats(attempts, ["provider"]).collect()}
    assert stats == {"all": 3, "benchmark_execution": 3, "total_time": 3}


def test_table_io(spark, tmp_path):
    rows = profiling.synthetic_rows(spark, 2)
    assert rows.count() == 2048
    found = profiling.table_io_profile(rows, str(tmp_path / "io")).collect()
    assert [r["operation"] for r in found] == ["write", "sequential_read"]
    assert [r["result_rows"] for r in found] == [2048, 2048]
    assert all(r["duration_seconds"] > 0 and r["error"] is None for r in found)


def _text(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_drained_sort_keeps_its_sort(spark, small_dir):
    facts = bindings.facts(spark, small_dir)
    watched = tx.sort_by_amount(facts).observe("o", F.count(F.lit(1)).alias("n"))
    assert "Sort" in _text(watched)


@pytest.mark.parametrize("preview", [0, 2])
def test_preview_comes_after_the_clock(spark, preview, capfd):
    operation = profiling.Operation("all", "", lambda df: df)
    assert profiling.profile_operation(operation, spark.range(5), preview)["result_rows"] == 5


def test_runs_cost_what_their_execution_took(spark):
    attempts = [
        {"run": 1, "timings": {"benchmark_execution": 940.267, "total_time": 940.664}},
        {"run": 2, "timings": {"cluster_provisioning": 1800.0, "benchmark_execution": 1800.0, "total_time": 9000.0}},
        {"run": 3, "timings": {"total_time": 5.0}},
    ]
    attempts = [{**a, "timestamp": "2025-11-05T11:27:03", "errors": []} for a in attempts]
    rows = profiling.attempt_rows(spark, attempts, "aws")
    records = profiling.run_records(rows, cost.rate_table(spark), "pyspark", "large", 5.0)
    found = [r["costs"] for r in records.orderBy("experiment_id").collect()]
    assert found[0]["master_ec2"] == pytest.approx(0.0261185, abs=1e-7)
    assert found[1]["master_ec2"] == pytest.approx(0.1) and found[2] == {}


def test_synthetic_rows_do_not_compress(spark, tmp_path):
    profiling.synthetic_rows(spark, 2).write.parquet(str(tmp_path / "io"))
    assert profiling._bytes_under(spark, str(tmp_path / "io")) > 1024 * 1024
