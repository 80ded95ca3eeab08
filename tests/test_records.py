import datetime
import json

import pytest
from pyspark.sql import functions as F

from armspan.jobs import compare_job
from armspan.operators import comparison
from armspan.plans import results
from armspan.sinks import tables as sinks
from armspan.sources import features, records
from armspan.sources import transactions as tx_source


def _run(arm, number, seconds, kind="pyspark", mode="sample"):
    return {
        "experiment_id": f"{kind}_{mode}_run{number:02d}_20251105_112703",
        "provider": arm,
        "timestamp": "2025-11-05T16:27:03.794496",
        "timings": {"total_time": seconds},
        "costs": {"master_vm": seconds / 100, "total_compute": seconds / 100},
        "metadata": {
            "dataset_mode": mode,
            "cluster_config": {"core_instance_count": 2},
            "cluster_id": "c-1",
            "step_id": "s-1",
            "ml_config": {"epochs": 5, "split": [0.8, 0.2]},
        },
        "errors": [],
        "summary": {"total_time_seconds": seconds, "total_cost_usd": seconds / 50, "success": True},
    }


def _storage(arm, seconds):
    stats = {"avg_throughput_mbps": 1.5, "avg_duration_seconds": seconds, "count": 1}
    test = {"operation": "upload", "duration_seconds": seconds, "throughput_mbps": 1.5}
    failed = {"operation": "download", "error": "lost"}
    return {"provider": arm, "tests": [test, failed], "summary": {"upload": stats}}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("results")

    def save(path, record):
        target = folder / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(record if isinstance(record, str) else json.dumps(record, indent=2))

    for arm, base in (("aws", 10.0), ("gcp", 20.0)):
        for number in (1, 2):
            tag = f"run{number:02d}_20251105_112703.json"
            save(f"pyspark/pyspark_{arm}_sample_{tag}", _run(arm, number, base + number))
            save(f"pyspark/pyspark_{arm}_large_{tag}", _run(arm, number, base * 10 + number, mode="large"))
            save(f"ml/ml_{arm}_{tag}", _run(arm, number, base, kind="ml"))
            save(f"storage/storage_{arm}_{tag}", _storage(arm, base + number))
            metrics = {"accuracy": 0.5 + number / 10, "architecture": [4, 2]}
            sub = "aws" if arm == "aws" else "gcp_results"
            save(f"cloud_results/{sub}/ml_run{number:02d}/metrics/part-0000{number}.txt", metrics)
    save("cloud_results/aws/ml_run03/metrics/part-00000.txt", "{broken")
    save("cloud_results/aws/ml_run03/metrics/other.txt", {"accuracy": 9.0})
    return str(folder)


def test_run_documents(spark, root):
    rows = records.read_run_records(spark, f"{root}/pyspark", "pyspark_*_sample_*").collect()
    assert len(rows) == 4
    row = min(rows, key=lambda r: r["timings"]["total_time"])
    assert row["costs"] == {"master_vm": 0.11, "total_compute": 0.11}
    assert row["metadata"]["cluster_config"] == {"core_instance_count": "2"}
    assert (row["metadata"]["cluster_id"], row["metadata"]["step_id"]) == ("c-1", "s-1")
    ml_config = row["metadata"]["ml_config"]
    assert ml_config["epochs"] == "5" and json.loads(ml_config["split"]) == [0.8, 0.2]
    assert row["timestamp"] == datetime.datetime(2025, 11, 5, 16, 27, 3, 794496)
    assert row["source_file"].endswith("_112703.json")


def test_corrupt_and_other_files_are_skipped(spark, root):
    rows = records.read_ml_metrics(spark, f"{root}/cloud_results/aws").collect()
    assert sorted((r["accuracy"], r["f1_score"]) for r in rows) == [(0.6, 0.0), (0.7, 0.0)]


def test_storage_documents(spark, root):
    rows = records.read_storage_records(spark, f"{root}/storage", "storage_*.json")
    operations = records.storage_operations(rows, "provider").collect()
    assert len(operations) == 4 and operations[0]["operation"] == "upload"
    tests = records.storage_tests(rows, "provider")
    assert tests.count() == 8 and tests.filter("error is null").count() == 4


def test_compare_results(spark, root, tmp_path):
    result = results.compare_results(spark, root)
    rows = {(r["benchmark"], r["metric"]): r for r in result.rows.collect()}
    assert len(rows) == 6
    assert rows["ML", comparison.TIME_METRIC]["difference_pct"] == 100.0
    assert rows["PySpark Sample", comparison.TIME_METRIC]["base_mean"] == 11.5
    assert result.storage.first()["base_duration_n"] == 2
    assert result.training.filter("metric = 'accuracy'").first()["difference_pct"] == 0.0
    assert result.timings.count() == 6 and result.costs.count() == 18
    results.write_comparison(result, str(tmp_path / "out"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out" / "report")).collect()]
    assert lines[0] == "| Benchmark | Metric | AWS (Mean ± Std) | GCP (Mean ± Std) | Difference | Winner |"
    assert lines[2] == "| PySpark Sample | Total Time (seconds) | 11.50 ± 0.50s | 21.50 ± 0.50s | +87.0% | **AWS** |"
    assert lines[3].startswith("| PySpark Sample | Total Cost (USD) | $0.2300 ± $0.0100 |")
    assert lines[-3:] == ["- AWS Wins: 6", "- GCP Wins: 0", "- Ties: 0"]
    assert len(lines) == 2 + 6 + 6


def test_comparison_csv(spark, root, tmp_path):
    rows = results.compare_results(spark, root).rows
    assert sinks.write_comparison_csv(rows.limit(0), str(tmp_path / "none")) is None
    assert not (tmp_path / "none").exists()
    assert sinks.write_report(rows.limit(0), str(tmp_path / "none")) is None
    path = sinks.write_comparison_csv(rows, str(tmp_path / "some"))
    stored = spark.read.option("header", True).csv(path)
    figures = ["aws_mean", "aws_std", "gcp_mean", "gcp_std"]
    assert stored.columns == ["benchmark", "metric", *figures, "difference_pct", "winner"]
    assert stored.count() == 6


def test_new_document_does_not_overwrite(spark, tmp_path):
    path = str(tmp_path / "doc")
    record = spark.range(1).select(F.lit(3).alias("x"))
    sinks.write_new_document(record, path)
    with pytest.raises(Exception, match="already exists"):
        sinks.write_new_document(record, path)
    sinks.write_document(record.select(F.lit(4).alias("x")), path)
    assert [r["value"] for r in spark.read.text(path).collect()] == ['{"x":4}']


def test_run_records_are_kept_by_arm(spark, root, tmp_path):
    runs = records.read_run_records(spark, f"{root}/ml", "ml_*.json").drop("source_file")
    sinks.write_run_records(runs, str(tmp_path / "runs"))
    assert {p.name for p in (tmp_path / "runs").iterdir() if p.is_dir()} == {"arm=aws", "arm=gcp"}
    again = records.read_run_records(spark, str(tmp_path / "runs"), documents=False)
    assert again.count() == 4
    one_arm = again.filter("arm = 'gcp'")
    plan = one_arm._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(arm" in plan and {r["provider"] for r in one_arm.collect()} == {"gcp"}
    both = records.read_run_records(spark, [str(tmp_path / "runs")] * 2, documents=False)
    assert both.count() == 8
    ordered = ["provider", "experiment_id"]
    stored = [tuple(r) for r in again.drop("source_file", "arm").orderBy(*ordered).collect()]
    assert stored == [tuple(r) for r in runs.orderBy(*ordered).collect()]


def test_skipping_does_not_depend_on_the_selection(spark, tmp_path):
    good = json.dumps({"provider": "aws", "timings": {"t": 1.0}})
    wrong = json.dumps({"provider": "aws", "timings": {"t": "soon"}})
    (tmp_path / "runs.json").write_text(f"{good}\n{wrong}\n{{broken\n")
    rows = records.read_run_records(spark, str(tmp_path), documents=False, skip_broken=True)
    assert rows.count() == len(rows.collect()) == rows.select("provider").count() == 1
    rejected = records.rejected_records(spark, str(tmp_path), documents=False)
    assert sorted(r["text"] for r in rejected.collect()) == [wrong, "{broken"]


@pytest.mark.parametrize("read", [records.read_run_records, records.read_storage_records])
@pytest.mark.parametrize("text", ['{"provider": "aws", "summ', '{"provider": "aws", "summary": "soon"}'])
def test_a_record_that_does_not_fit_fails(spark, tmp_path, read, text):
    (tmp_path / "one.json").write_text(text)
    with pytest.raises(Exception):
        read(spark, str(tmp_path)).collect()
    assert read(spark, str(tmp_path), skip_broken=True).count() == 0


def test_a_field_that_nobody_reads_is_no_reason_to_fail(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"provider": "aws", "timings": {"t": "soon"}}))
    assert records.read_run_records(spark, str(tmp_path)).select("provider").first()["provider"] == "aws"


def test_runs_with_other_names_stay_apart(spark):
    names = ["etl2_aws_run01_20251105_112703", "nightly-7", "ml_aws_run01_20251105_112703"]
    runs = spark.createDataFrame(
        [(name, "aws") for name in names],
        "experiment_id string, provider string",
    )
    for name, kind in (("timings", "map<string,double>"), ("costs", "map<string,double>"), ("errors", "array<string>")):
        runs = runs.withColumn(name, F.lit(None).cast(kind))
    runs = runs.withColumn(
        "summary", F.lit(None).cast("struct<total_time_seconds:double,total_cost_usd:double>")
    )
    found = {r["experiment_id"]: r["benchmark"] for r in results.label_runs(runs).collect()}
    assert found == {names[0]: names[0], names[1]: names[1], names[2]: "ml"}


CSV = """CUST_ID,START_DATE,END_DATE,TRANS_ID,DATE,YEAR,MONTH,DAY,EXP_TYPE,AMOUNT
C1,2018-01-01,,T1,2018-02-03,2018,2,3,Housing,10.50
C2,2018-01-01,,T2,2018-02-04,2018,2,4,Savings,20.25
"""


@pytest.fixture(scope="module")
def csv_path(tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "transactions.csv"
    path.write_text(CSV)
    return str(path)


def test_csv_schema_is_explicit(spark, csv_path):
    rows = tx_source.read_transactions(spark, csv_path)
    assert dict(rows.dtypes)["TRANS_ID"] == "string" and dict(rows.dtypes)["END_DATE"] == "date"
    first = rows.first()
    assert (first["TRANS_ID"], first["END_DATE"], first["AMOUNT"]) == ("T1", None, 10.5)
    inferred = dict(tx_source.read_transactions(spark, csv_path, infer=True).dtypes)
    assert inferred["AMOUNT"] == "double" and inferred["TRANS_ID"] != "string"


def test_csv_with_another_header_fails(spark, csv_path, tmp_path):
    path = tmp_path / "other.csv"
    path.write_text(CSV.replace("CUST_ID,START_DATE,END_DATE,TRANS_ID", "TRANS_ID,START_DATE,END_DATE,CUST_ID"))
    with pytest.raises(Exception, match="(?i)header"):
        tx_source.read_transactions(spark, str(path)).collect()
    rows = tx_source.read_transactions(spark, csv_path)
    assert rows.count() == 2 and [r[0] for r in rows.select("AMOUNT").collect()] == [10.5, 20.25]
    assert rows.groupBy("EXP_TYPE").agg(F.sum("AMOUNT")).count() == 2


@pytest.mark.parametrize("row", ["C3,2018-01-01,,T3,2018-02-05,2018,2,5,Housing,oops", "C3,2018-01-01,,T3"])
def test_a_malformed_csv_row_fails(spark, tmp_path, row):
    path = tmp_path / "bad.csv"
    path.write_text(CSV + row + "\n")
    with pytest.raises(Exception):
        tx_source.read_transactions(spark, str(path)).agg(F.sum("AMOUNT")).collect()
    kept = tx_source.read_transactions(spark, str(path), skip_malformed=True)
    assert kept.count() == kept.select("CUST_ID").count() == 2
    assert [r["text"] for r in tx_source.rejected_transactions(spark, str(path)).collect()] == [row]


def test_compare_job_on_documents(spark, root, tmp_path):
    compare_job.run(spark, root, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "training")).count() == 2
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_modes(spark, csv_path):
    registry = tx_source.mode_registry({"sample": csv_path, "large": csv_path})
    assert (registry["large"].sample_fraction, registry["large"].size_gb) == (0.5, 5.0)
    assert tx_source.read_mode(spark, registry, "sample").count() == 2
    assert tx_source.read_mode(spark, registry, "large").count() <= 2
    with pytest.raises(ValueError, match="unknown dataset mode"):
        tx_source.read_mode(spark, registry, "full")


def test_feature_split(spark, tmp_path):
    rows = spark.range(10)
    sinks.write_split(rows.filter("id < 7"), rows.filter("id >= 7"), str(tmp_path / "f"))
    counts = features.split_counts(*features.read_split(spark, str(tmp_path / "f")))
    assert {r["split"]: r["row_count"] for r in counts.collect()} == {"train": 7, "test": 3}


def test_report_with_sections(spark, root, tmp_path):
    compare_job.run(spark, root, str(tmp_path / "out"), sections=True)
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out" / "report")).collect()]
    assert lines[:4] == ["# AWS vs GCP Comparison", "", "## Benchmark Configuration", ""]
    assert "- ML AWS runs: 2" in lines and "**Total Benchmark Duration:** 0.20 hours" in lines
    assert lines.index("## Performance Comparison") < lines.index("## Summary") < lines.index("## Notes")


def test_missing_totals_count_as_zero_on_demand(spark):
    schema = (
        "provider string, benchmark string, timings map<string,double>, costs map<string,double>, "
        "total_time double, total_cost double"
    )
    rows = [("aws", "ml", {"total_time": 4.0}, {"a": 1.0, "b": 2.0}, 9.0, None), ("aws", "ml", {}, None, None, 1.0)]
    runs = spark.createDataFrame(rows + [("gcp", *rows[0][1:])], schema)
    filled = results.compare_runs(runs, fill_missing=True).by_arm.filter("provider = 'aws'").first()
    assert (filled["time_n"], filled["time_mean"], filled["cost_n"], filled["cost_mean"]) == (2, 2.0, 1, 3.0)
    plain = results.compare_runs(runs).by_arm.filter("provider = 'aws'").first()
    assert (plain["time_n"], plain["time_mean"], plain["cost_n"], plain["cost_mean"]) == (1, 9.0, 1, 1.0)
