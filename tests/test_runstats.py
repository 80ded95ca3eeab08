import statistics

import pytest
from pyspark.sql import functions as F

from armspan.operators import comparison, runstats, storage

RUN = (
    "provider string, timings map<string,double>, costs map<string,double>, "
    "errors array<struct<timestamp:string,message:string,type:string>>"
)


@pytest.fixture(scope="module")
def runs(spark):
    failure = [("t", "boom", "X")]
    rows = [
        (
            "aws",
            {"a": 2.0, "b": 4.0, "total_time": 9.0},
            {"master": 1.0, "worker": 2.0, "total_compute": 3.0, "storage": 0.5},
            [],
        ),
        ("aws", {"a": 4.0}, {"master": 2.0, "total": 99.0}, failure),
        ("aws", None, None, None),
        ("gcp", {"a": -1.0}, {}, []),
        ("gcp", {}, None, []),
        (None, {"a": 5.0}, None, []),
    ]
    return spark.createDataFrame(rows, RUN)


def _by_key(rows):
    return {(r["provider"], r["key"]): r for r in rows.collect()}


def test_missing_keys_count_as_zero(runs):
    found = _by_key(runstats.timing_key_stats(runs, ["provider"]))
    a, b = found["aws", "a"], found["aws", "b"]
    assert (a["count"], a["mean"], a["std"], a["min"], a["max"]) == (2, 3.0, 1.0, 2.0, 4.0)
    assert (b["count"], b["mean"], b["std"], b["min"], b["max"]) == (2, 2.0, 2.0, 0.0, 4.0)
    negative = found["gcp", "a"]
    assert (negative["count"], negative["mean"], negative["min"], negative["max"]) == (2, -0.5, -1.0, 0.0)
    assert found[None, "a"]["count"] == 1
    assert set(found) == {("aws", "a"), ("aws", "b"), ("aws", "total_time"), ("gcp", "a"), (None, "a")}


def test_missing_keys_left_out(runs):
    found = _by_key(runstats.timing_key_stats(runs, ["provider"], fill_missing=False))
    assert (found["aws", "b"]["count"], found["aws", "b"]["mean"]) == (1, 4.0)


def test_zero_fill_matches_brute_force(spark):
    values = {i: {f"k{j}": float((i * 7 + j * 3) % 11) for j in range(6) if (i + j) % 3} for i in range(200)}
    rows = spark.createDataFrame([("x", values[i]) for i in values], "provider string, timings map<string,double>")
    for row in runstats.timing_key_stats(rows, ["provider"]).collect():
        expected = [v.get(row["key"], 0.0) for v in values.values()]
        assert row["count"] == 200
        assert row["mean"] == pytest.approx(statistics.fmean(expected))
        assert row["std"] == pytest.approx(statistics.pstdev(expected))
        assert (row["min"], row["max"]) == (min(expected), max(expected))


def test_group_columns_are_required(runs):
    with pytest.raises(ValueError):
        runstats.timing_key_stats(runs, [])


def test_cost_totals(runs):
    found = _by_key(runstats.cost_key_stats(runs, ["provider"]))
    total = found["aws", "total"]
    assert (total["count"], total["min"], total["max"]) == (2, 6.5, 101.0)
    assert found["gcp", "total"]["mean"] == 0.0
    first = runs.select(
        runstats.total_recorded(F.col("costs")).alias("recorded"), runstats.total_net(F.col("costs")).alias("net")
    ).first()
    assert (first["recorded"], first["net"]) == (6.5, 3.5)


def test_success_counts(runs):
    row = runstats.run_success_counts(runs).first()
    assert (row["num_runs"], row["successful_runs"], row["failed_runs"]) == (6, 5, 1)


def test_summary_of_no_runs_is_zero(spark):
    row = runstats.multi_run_summary(spark.createDataFrame([], RUN)).collect()
    assert len(row) == 1 and all(value == 0 for value in row[0])


def test_summary_fills_total_time(runs):
    row = runstats.multi_run_summary(runs).first()
    assert row["num_runs"] == 6 and row["total_time_mean"] == pytest.approx(9 / 5) and row["total_time_min"] == 0.0


def test_success_rate(spark):
    operations = spark.createDataFrame(
        [("a", True), ("a", True), ("a", False), ("b", None)], "suite string, success boolean"
    )
    found = {r["suite"]: r["success_rate"] for r in runstats.suite_success_rate(operations, ["suite"]).collect()}
    assert found == {"a": 66.67, "b": 0.0}


def test_one_arm_gives_no_pairs(spark):
    rows = [("aws", "ml", 1.0), ("aws", "io", 2.0), ("gcp", "ml", 3.0)]
    stats = spark.createDataFrame(rows, "provider string, benchmark string, mean double")
    pairs = comparison.pair_arms(stats, ["benchmark"], ["mean"]).collect()
    assert [tuple(r) for r in pairs] == [("ml", 1.0, 3.0)]


def test_compare_arms_and_tally(spark):
    rows = [("aws", "x", 2.0, 1.0), ("aws", "x", 4.0, 1.0), ("gcp", "x", 6.0, 1.0)]
    rows += [("aws", "y", 1.0, None), ("gcp", "y", 0.5, 1.0)]
    runs = spark.createDataFrame(rows, "provider string, benchmark string, total_time double, total_cost double")
    compared = comparison.compare_arms(runs)
    found = {(r["benchmark"], r["metric"]): r for r in compared.collect()}
    time = found["x", comparison.TIME_METRIC]
    assert (time["base_mean"], time["base_std"], time["difference_pct"], time["winner"]) == (3.0, 1.0, 100.0, "AWS")
    assert found["x", comparison.COST_METRIC]["winner"] == "Tie"
    assert ("y", comparison.COST_METRIC) not in found
    assert tuple(comparison.win_tally(compared).first()) == (1, 1, 1)


def test_failed_tests_are_skipped(spark):
    tests = spark.createDataFrame(
        [("upload", 2.0, 3.0, None), ("upload", None, 1.0, None), ("download", 9.0, 9.0, "lost")],
        "operation string, throughput_mbps double, duration_seconds double, error string",
    )
    assert [tuple(r) for r in storage.summarise_tests(tests).collect()] == [("upload", 1.0, 2.0, 2)]
    plain = storage.summarise_tests(tests, rate_digits=None, seconds_digits=None)
    assert [tuple(r) for r in plain.collect()] == [("upload", 1.0, 2.0, 2)]


def test_unlisted_operation_ranks_last(spark):
    names = spark.createDataFrame([("write",), ("upload",), ("scan",), (None,)], "op string")
    assert [r[0] for r in names.select(storage.operation_rank(F.col("op"))).collect()] == [4, 1, 5, 5]
