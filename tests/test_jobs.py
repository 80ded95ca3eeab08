import json
import os

import pytest
from pyspark.sql import functions as F

from armspan import session
from armspan.jobs import compare_job, ml_job, repeat_job, transactions_job
from armspan.functions.pixels import flatten_to_columns
from armspan.operators import cost, storage
from armspan.operators.sampling import split_by_hash
from armspan.plans import bindings, repeats
from armspan.sinks.tables import write_run_records, write_split
from armspan.sources.records import read_run_records, read_storage_records, storage_operations, storage_tests


def test_transactions_job(spark, small_dir, tmp_path):
    data = str(tmp_path / "csv")
    bindings.transactions(spark, small_dir).write.option("header", True).csv(data)
    suite = transactions_job.run(spark, data, str(tmp_path / "out"), "large", sample_key="TRANS_ID")
    assert suite["success_rate"] == 100.0 and suite["sample_fraction"] == 0.5 and 600 < suite["total_rows"] < 900
    stored = json.loads(spark.read.text(str(tmp_path / "out" / "benchmark_results.json")).first()["value"])
    assert stored["dataset_mode"] == "large" and len(stored["operations"]) == 7
    with pytest.raises(Exception, match="already exists"):
        transactions_job.run(spark, data, str(tmp_path / "out"))


def test_two_arms_from_runs_to_report(spark, small_dir, tmp_path):
    data = str(tmp_path / "csv")
    bindings.transactions(spark, small_dir).write.option("header", True).csv(data)
    folders = {arm: str(tmp_path / arm) for arm in ("aws", "gcp")}
    for arm, folder in folders.items():
        repeat_job.run(spark, data, folder, arm, repeats=2)
    summary = spark.read.json(f"{folders['gcp']}/summary").first()
    assert (summary["num_runs"], summary["failed_runs"]) == (2, 0)
    assert summary["total_cost_mean"] > 0
    out = str(tmp_path / "out")
    compare_job.run(spark, [f"{folder}/runs" for folder in folders.values()], out, lines=True)
    lines = [r["value"] for r in spark.read.text(f"{out}/report").collect()]
    assert lines[2].startswith("| pyspark sample | Total Time (seconds) | ") and len(lines) == 10
    keys = {r["key"] for r in spark.read.json(f"{out}/costs").collect()}
    assert {"master_ec2", "master_vm", "total_compute", "storage", "total"} <= keys


def test_an_arm_of_any_name(spark, small_dir, tmp_path):
    data = str(tmp_path / "csv")
    bindings.transactions(spark, small_dir).write.option("header", True).csv(data)
    shape = cost.ClusterShape("lab", "machine", "machine", 3, "fee", False, 1, "storage")
    prices = [("lab", item, price) for item, price in (("machine", 1.0), ("fee", 0.0), ("storage", 0.0))]
    rates = cost.rate_table(spark, [shape], prices)
    repeat_job.run(spark, data, str(tmp_path / "lab"), "lab", repeats=1, rates=rates)
    repeat_job.run(spark, data, str(tmp_path / "aws"), "aws", repeats=1)
    compare_job.run(
        spark, [str(tmp_path / arm / "runs") for arm in ("aws", "lab")], str(tmp_path / "out"), "aws", "lab", lines=True
    )
    rows = spark.read.option("header", True).csv(str(tmp_path / "out" / "comparison_csv")).collect()
    assert {r["benchmark"] for r in rows} == {"pyspark sample"} and len(rows) == 2
    with pytest.raises(FileExistsError):
        repeat_job.run(spark, data, str(tmp_path / "lab"), "lab", repeats=1, rates=rates)


def test_three_kinds_on_two_arms_to_a_report(spark, small_dir, tmp_path):
    """Transactions, training and storage runs of two arms, from their repeats to the comparison."""
    data = str(tmp_path / "csv")
    bindings.transactions(spark, small_dir).write.option("header", True).csv(data)
    wide = flatten_to_columns(bindings.images(spark, small_dir), "image", 64, "vec_id", "label")
    write_split(*split_by_hash(wide, "vec_id", 0.8), str(tmp_path / "split"))
    for arm in ("aws", "gcp"):
        repeat_job.run(
            spark, data, str(tmp_path / arm), arm, repeats=2, training_path=str(tmp_path / "split"),
            storage_folder=str(tmp_path / "io"), epochs=1, layers=[64, 8, 10], sizes_mb=(1, 2),
        )
    assert not any((tmp_path / "io").iterdir())
    folders = lambda name: [str(tmp_path / arm / name) for arm in ("aws", "gcp")]
    out = str(tmp_path / "out")
    compare_job.run(
        spark, folders("runs"), out, lines=True, storage_path=folders("storage"), training_path=folders("training")
    )
    lines = [r["value"] for r in spark.read.text(f"{out}/report").collect()]
    for benchmark in ("pyspark sample", "ml", "storage"):
        assert sum(line.startswith(f"| {benchmark} | ") for line in lines) == 2
    tests = {r["operation"]: (r["base_duration_n"], r["cand_duration_n"]) for r in spark.read.json(f"{out}/storage").collect()}
    assert tests == {name: (2, 2) for name in ("upload", "download", "sequential_read", "write")}
    scores = {r["metric"]: r["base_score_n"] for r in spark.read.json(f"{out}/training").collect()}
    assert scores == {"accuracy": 2, "f1_score": 2}
    with pytest.raises(ValueError, match="both"):
        compare_job.run(spark, folders("runs"), out, lines=True, storage_path=folders("storage"))
    with pytest.raises(ValueError, match="at least one"):
        repeat_job.run(spark, None, str(tmp_path / "none"))


def test_attempts_that_fail_are_kept(spark, tmp_path):
    def lost(number):
        if number == 1:
            raise RuntimeError("lost")
        return repeats.Outcome({"benchmark_execution": 2.0})

    kind = repeats.storage_kind(lambda: spark.range(5).select(F.raise_error(F.lit("boom")).alias("x")), str(tmp_path / "io"))
    attempts = repeats.repeat([repeats.Kind("ml", lost), kind], 2)
    repeats.write_attempts(spark, attempts, str(tmp_path / "out"), "aws")
    runs = read_run_records(spark, str(tmp_path / "out" / "runs"), documents=False).collect()
    runs = {"_".join(r["experiment_id"].split("_")[:3]): r for r in runs}
    assert sorted(runs) == ["ml_aws_run01", "ml_aws_run02", "storage_aws_run01", "storage_aws_run02"]
    lost = runs["ml_aws_run01"]
    assert lost["errors"][0]["message"] == "lost" and lost["costs"] == {} and not lost["summary"]["success"]
    assert runs["ml_aws_run02"]["summary"]["success"] and runs["ml_aws_run02"]["costs"]
    assert runs["storage_aws_run01"]["errors"][0]["type"] == "upload" and runs["storage_aws_run01"]["costs"]
    records = read_storage_records(spark, str(tmp_path / "out" / "storage"), documents=False)
    assert [r["operation"] for r in storage_operations(records).collect()] == ["write", "write"]
    failed = storage_tests(records).where("error is not null").collect()
    assert [r["operation"] for r in failed] == ["upload", "upload"] and "boom" in failed[0]["error"]
    assert not (tmp_path / "out" / "training").exists()


def test_storage_round_trip(spark, tmp_path):
    """What the tests say is what readers and statistics give back."""
    kind = repeats.storage_kind(lambda: spark.range(50_000), str(tmp_path / "io"), "numbers", (1, 1, 2))
    attempts = repeats.repeat([kind], 3)
    rows = repeats.storage_records(spark, attempts, "lab")
    write_run_records(rows, str(tmp_path / "storage"))
    back = read_storage_records(spark, str(tmp_path / "storage"), documents=False)
    names = rows.columns
    assert sorted(map(str, back.select(*names).collect())) == sorted(map(str, rows.collect()))
    for r in back.collect():
        assert (r["test_file"], r["provider"], r["bucket"]) == ("numbers", "lab", str(tmp_path / "io"))
        writes = [t for t in r["tests"] if t["operation"] == "write"]
        assert len(writes) == 3 and r["summary"]["write"]["count"] == 3
        mean = sum(t["duration_seconds"] for t in writes) / 3
        assert r["summary"]["write"]["avg_duration_seconds"] == pytest.approx(mean, abs=6e-4)
        assert next(t for t in r["tests"] if t["operation"] == "sequential_read")["chunk_size_mb"] == 1.0
    stats = storage.stats_by_operation(storage_operations(back, "provider"))
    assert {r["operation"]: r["duration_n"] for r in stats.collect()} == dict.fromkeys(storage.OPERATION_ORDER, 3)


def test_ml_job_leaves_a_run_record(spark, small_dir, tmp_path):
    wide = flatten_to_columns(bindings.images(spark, small_dir), "image", 64, "vec_id", "label")
    write_split(*split_by_hash(wide, "vec_id", 0.8), str(tmp_path / "data"))
    record = ml_job.run(spark, str(tmp_path / "data"), str(tmp_path / "out"), epochs=1, layers=[64, 8, 10], arm="aws")
    run = read_run_records(spark, str(tmp_path / "out" / "runs"), documents=False).first()
    assert run["experiment_id"].startswith("ml_aws_run01_") and run["costs"]["total_compute"] > 0
    assert run["timings"]["ml_training"] == record["training_time_seconds"] <= run["timings"]["total_time"]


def test_ml_job(spark, small_dir, tmp_path):
    wide = flatten_to_columns(bindings.images(spark, small_dir), "image", 64, "vec_id", "label")
    write_split(*split_by_hash(wide, "vec_id", 0.8), str(tmp_path / "data"))
    record = ml_job.run(spark, str(tmp_path / "data"), str(tmp_path / "out"), epochs=1, layers=[64, 8, 10])
    stored = json.loads(spark.read.text(str(tmp_path / "out" / "metrics")).first()["value"])
    assert stored == record and 0 <= record["accuracy"] <= 1


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    configured = session.shared_folder(spark)
    assert session.fresh_path(spark, "x").startswith(configured)
    assert session.fresh_path(spark, "x") != session.fresh_path(spark, "x")

    class Elsewhere:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Elsewhere())


def test_a_local_session_falls_back_to_a_folder_of_its_own():
    class Local:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master, applicationId = "local[2]", "local-test"

    folder = session.shared_folder(Local())
    assert os.path.isdir(folder) and session.shared_folder(Local()) == folder
    assert session.fresh_path(Local(), "x").startswith(folder)
