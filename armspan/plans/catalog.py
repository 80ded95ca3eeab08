"""The registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from armspan.functions import identity, measures, pixels
from armspan.operators import comparison, cost, learning, runstats, sampling, storage
from armspan.operators import transactions as tx
from armspan.plans import bindings as b
from armspan.plans import profiling, repeats
from armspan.schemas import RUN_RECORD, STORAGE_RECORD
from armspan.session import fresh_path
from armspan.sinks import tables as sinks
from armspan.sources import features as feature_source
from armspan.sources import records as record_source
from armspan.sources import transactions as tx_source

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The arguments of the filter operations on the orders table.
CATEGORIES = ("1-URGENT", "5-LOW")
NARROW = {"value": "1-URGENT", "above": 300000.0, "years": (1996, 1997)}
LAYERS = (b.EMBEDDING_SIZE, 32, 16, 10)
TRAIN_SHARE = 0.8


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(rows: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return rows.withColumns({name: F.round(name, digits) for name in names})


# Sources


def _csv_copy(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "transactions")
    b.transactions(spark, sf_dir).write.option("header", True).csv(path)
    return path


def _with_text_dates(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("string") for c in ("START_DATE", "END_DATE", "DATE")})


@query
def scan_csv_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_text_dates(tx_source.read_transactions(spark, _csv_copy(spark, sf_dir)))


@query
def scan_dataset_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _csv_copy(spark, sf_dir)
    registry = tx_source.mode_registry({mode: path for mode in identity.MODES})
    rows = tx_source.read_mode(spark, registry, "large", sample_key="TRANS_ID")
    return rows.select("TRANS_ID", "CUST_ID", "EXP_TYPE", "YEAR", "MONTH", "DAY", "AMOUNT")


@query
def scan_parquet_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "split")
    sinks.write_split(*sampling.split_by_hash(b.embeddings(spark, sf_dir), "vec_id", TRAIN_SHARE), folder)
    return feature_source.split_counts(*feature_source.read_split(spark, folder))


def _run_record_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "runs")
    sinks.write_run_records(b.as_schema(b.run_records(spark, sf_dir), RUN_RECORD), path)
    return record_source.read_run_records(spark, path, "*.json", documents=False)


def _entry_count(entries: str) -> Column:
    return F.when(F.col(entries).isNull(), 0).otherwise(F.size(entries))


@query
def scan_run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _run_record_copy(spark, sf_dir)
    return runs.select(
        "experiment_id",
        "provider",
        F.col("metadata.dataset_mode").alias("mode"),
        _entry_count("timings").alias("timing_keys"),
        _entry_count("costs").alias("cost_keys"),
        F.col("summary.total_time_seconds").alias("total_time"),
        F.col("summary.success").cast("int").alias("success"),
    )


def _metrics_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training records as one small text file per run, beside one that does not parse."""
    path = fresh_path(spark, "metrics")
    docs = b.training_metrics(spark, sf_dir).select(
        "provider", "run", F.to_json(F.struct("accuracy", "f1_score")).alias("value")
    )
    docs.repartition("provider", "run").write.partitionBy("provider", "run").text(path)
    broken = docs.select("provider", F.lit(-1).alias("run"), F.lit("{broken").alias("value")).distinct()
    broken.write.mode("append").partitionBy("provider", "run").text(path)
    metrics = record_source.read_ml_metrics(spark, path)
    part = lambda pattern: F.regexp_extract("source_file", pattern, 1)
    return metrics.withColumns(
        {"provider": part(r"provider=([a-z]+)/"), "run": part(r"run=(-?\d+)/").cast("int")}
    )


@query
def scan_ml_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics_copy(spark, sf_dir).select("provider", "run", "accuracy", "f1_score")


def _storage_record_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "storage")
    tests = storage.summarise_tests(b.storage_tests(spark, sf_dir), ["provider", "record_id"])
    records = storage.summary_records(tests, ["provider", "record_id"])
    named = records.select("provider", F.col("record_id").cast("string").alias("test_file"), "summary")
    sinks.write_run_records(b.as_schema(named, STORAGE_RECORD), path)
    return record_source.read_storage_records(spark, path, documents=False)


def _storage_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows straight from the tests, without a JSON copy between."""
    return storage.summarise_tests(b.storage_tests(spark, sf_dir), ["provider", "record_id"])


@query
def scan_storage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_source.storage_operations(_storage_record_copy(spark, sf_dir), "provider", "test_file")


# Sinks


@query
def sink_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "features")
    wide = pixels.flatten_to_columns(b.images(spark, sf_dir), "image", b.EMBEDDING_SIZE, "vec_id", "label")
    sinks.write_features(wide, path)
    stored = spark.read.parquet(path)
    gathered = pixels.gather_columns(stored, b.EMBEDDING_SIZE, "vec_id", "label")
    return gathered.select("vec_id", "label", _float_sum(F.col("features")).alias("feature_sum"))


def _float_sum(values: Column) -> Column:
    """Sum of the values, each times its position, so that their order counts."""
    placed = F.transform(values, lambda v, i: v.cast("double") * (i + 1))
    return F.round(F.aggregate(placed, F.lit(0.0), lambda total, v: total + v), 6)


@query
def sink_text_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "document")
    summary = multi_run_summary(spark, sf_dir)
    sinks.write_document(summary, path)
    return spark.read.schema(summary.schema).json(path)


@query
def sink_text_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "suite")
    kinds = b.named_events(spark, sf_dir).groupBy(F.col("benchmark").alias("name")).agg(
        F.count(F.lit(1)).alias("result_rows")
    )
    operations = kinds.select("name", "result_rows", (F.col("name") != "error").alias("success"))
    suite = operations.agg(F.sort_array(F.collect_list(F.struct("*"))).alias("operations"))
    sinks.write_new_document(suite, path)
    stored = spark.read.schema("operations array<struct<name:string,result_rows:bigint,success:boolean>>").json(path)
    rows = stored.select(F.inline("operations"))
    return rows.withColumn("success", F.col("success").cast("int"))


@query
def sink_run_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _run_record_copy(spark, sf_dir)
    return runs.select(
        "experiment_id", "provider", F.explode("costs").alias("component", "usd")
    )


@query
def sink_aggregate_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "aggregates")
    aggregates = timing_key_stats(spark, sf_dir)
    sinks.write_aggregates(aggregates, path)
    return spark.read.schema(aggregates.schema).json(path)


@query
def sink_comparison_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "comparison")
    rows = comparison.compare_arms(b.run_totals(spark, sf_dir))
    sinks.write_comparison_csv(rows, path)
    schema = sinks.comparison_columns(rows).schema
    stored = spark.read.schema(schema).option("header", True).csv(path)
    return rounded(stored, "aws_mean", "aws_std", "gcp_mean", "gcp_std", "difference_pct")


@query
def sink_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "report")
    sinks.write_report(comparison.compare_arms(b.run_totals(spark, sf_dir)), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


# Rows: projections, filters, samples


@query
def filter_category_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.filter_category(b.facts(spark, sf_dir), CATEGORIES)


@query
def filter_conjunctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.filter_conjunctive(b.facts(spark, sf_dir), **NARROW)


@query
def sample_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_by_hash(b.facts(spark, sf_dir), "TRANS_ID", 0.5)


@query
def sample_fraction_bernoulli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_rows(b.facts(spark, sf_dir), 0.5)


@query
def assemble_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    assembled = pixels.assemble_array(b.embeddings(spark, sf_dir), "embedding")
    values = vector_to_array("features")
    return assembled.select("vec_id", "label", F.size(values).alias("n"), _float_sum(values).alias("feature_sum"))


@query
def assemble_wide_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = pixels.flatten_to_columns(b.images(spark, sf_dir), "image", b.EMBEDDING_SIZE, "vec_id", "label")
    assembled = pixels.assemble_columns(wide, b.EMBEDDING_SIZE)
    values = vector_to_array("features")
    return assembled.select("vec_id", "label", F.size(values).alias("n"), _float_sum(values).alias("feature_sum"))


@query
def normalise_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = pixels.normalise_pixels(F.col("pixels"))
    return b.byte_pixels(spark, sf_dir).select(
        "vec_id",
        F.get(scaled, F.lit(0)).cast("double").alias("first_pixel"),
        F.array_max(scaled).cast("double").alias("max_pixel"),
        _float_sum(scaled).alias("pixel_sum"),
    )


@query
def flatten_to_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = pixels.flatten_to_columns(b.images(spark, sf_dir), "image", b.EMBEDDING_SIZE, "vec_id", "label")
    return wide.withColumns(
        {f"pixel{i}": F.col(f"pixel{i}").cast("double") for i in range(b.EMBEDDING_SIZE)}
    )


@query
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    size_mb = measures.megabytes(F.col("l_quantity") * 1000000.0)
    return b.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", *measures.transfer_record(size_mb, F.col("l_tax") * 100.0)
    )


@query
def time_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.col("value") * 100.0
    return b.named_events(spark, sf_dir).select(
        "event_id",
        measures.hours(seconds).alias("hours"),
        measures.minutes(seconds).alias("minutes"),
        measures.months(measures.hours(seconds)).alias("months"),
        measures.duration_unit(seconds).alias("unit"),
        measures.duration_text(seconds).alias("duration_text"),
    )


def _two_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.rint(F.col("l_tax") * 100.0).alias("base"),
        F.rint(F.col("l_discount") * 100.0).alias("candidate"),
    )


@query
def pct_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, candidate = F.col("base"), F.col("candidate")
    return _two_rates(spark, sf_dir).withColumns(
        {
            "difference_pct": measures.pct_difference(base, candidate),
            "difference_unguarded": measures.pct_difference(base, candidate, guard=False),
        }
    )


@query
def winner_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    difference = measures.pct_difference(F.col("base"), F.col("candidate"))
    return _two_rates(spark, sf_dir).withColumn("winner", measures.winner(difference, *identity.ARMS))


@query
def parse_experiment_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = identity.parse_run_name(F.col("experiment_id"), F.col("provider"))
    return b.named_events(spark, sf_dir).select("event_id", "experiment_id", parsed.alias("_p")).select(
        "event_id",
        "experiment_id",
        F.col("_p.type").alias("kind"),
        F.col("_p.arm").alias("arm"),
        F.col("_p.mode").alias("mode"),
        F.col("_p.run").alias("run"),
        F.col("_p.time").alias("stamp"),
    )


@query
def normalise_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    typed = F.when(user % 3 == 0, F.upper("provider")).when(user % 3 == 1, F.initcap("provider"))
    name = F.coalesce(typed, F.col("provider"))
    return b.named_events(spark, sf_dir).select("event_id", identity.normalise_arm(name).alias("arm"))


# Joins


@query
def join_customer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.join_customer_summary(b.facts(spark, sf_dir))


@query
def pair_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = comparison.time_and_cost(b.run_totals(spark, sf_dir))
    pairs = comparison.pair_arms(stats, ["benchmark", "metric"], ["mean", "std"])
    return rounded(pairs, "base_mean", "base_std", "cand_mean", "cand_std")


def _priced_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    position = (F.col("user_id") % 3).cast("int")
    aws, gcp = (
        F.get(F.array(*[F.lit(item) for owner, item, _ in cost.PRICES if owner == arm]), position)
        for arm in identity.ARMS
    )
    item = F.when(F.col("provider") == "aws", aws).otherwise(gcp)
    return b.named_events(spark, sf_dir).select("event_id", F.col("provider").alias("arm"), item.alias("item"))


@query
def price_lookup_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.price_lookup(_priced_items(spark, sf_dir), cost.price_table(spark), "item")


# Aggregates


@query
def agg_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.agg_by_customer(b.facts(spark, sf_dir))


@query
def agg_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.agg_by_category(b.facts(spark, sf_dir))


@query
def agg_monthly_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.agg_monthly(b.facts(spark, sf_dir))


@query
def count_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.count_rows(b.facts(spark, sf_dir))


@query
def describe_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"time": F.col("total_time"), "cost": F.col("total_cost")}
    stats = runstats.describe_by(b.run_totals(spark, sf_dir), ["provider"], values)
    return rounded(stats, "time_mean", "time_std", "cost_mean", "cost_std")


@query
def storage_stats_by_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = comparison.compare_storage(_storage_operations(spark, sf_dir))
    inexact = [f"{side}_duration_{figure}" for side in ("base", "cand") for figure in ("mean", "std")]
    return rounded(rows, *inexact, "difference_pct")


@query
def timing_key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runstats.timing_key_stats(b.run_records(spark, sf_dir), ["provider"]), "mean", "std")


@query
def timing_key_stats_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = runstats.timing_key_stats(b.run_records(spark, sf_dir), ["provider"], fill_missing=False)
    return rounded(stats, "mean", "std")


@query
def cost_key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runstats.cost_key_stats(b.run_records(spark, sf_dir), ["provider"]), "mean", "std")


@query
def run_total_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = F.col("costs")
    return b.run_records(spark, sf_dir).select(
        "event_id",
        runstats.total_recorded(costs).alias("total_recorded"),
        runstats.total_net(costs).alias("total_net"),
    )


@query
def run_success_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runstats.run_success_counts(b.run_records(spark, sf_dir), ["provider", "benchmark"])


@query
def suite_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    operations = b.table(spark, sf_dir, "events").select("user_id", (F.col("event_type") != "error").alias("success"))
    return runstats.suite_success_rate(operations, ["user_id"])


@query
def storage_test_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.summarise_tests(b.storage_tests(spark, sf_dir))


@query
def win_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.win_tally(comparison.compare_arms(b.run_totals(spark, sf_dir)))


@query
def ml_metrics_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = comparison.compare_ml_metrics(_metrics_copy(spark, sf_dir))
    inexact = [f"{side}_score_{figure}" for side in ("base", "cand") for figure in ("mean", "std")]
    return rounded(rows, *inexact, "difference_pct")


@query
def multi_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = runstats.multi_run_summary(b.run_records(spark, sf_dir))
    return rounded(summary, "total_time_mean", "total_time_std", "total_cost_mean", "total_cost_std")


# Order


@query
def sort_amount_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.sort_by_amount(b.facts(spark, sf_dir))


@query
def preview_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.preview(b.facts(spark, sf_dir), 5)


# Cost model


def _timed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.named_events(spark, sf_dir).select(
        "event_id", "user_id", "mode", F.col("provider").alias("arm"), "value"
    )


_COMPONENTS = ("master_vm", "master_fee", "worker_vm", "worker_fee", "total_compute")


def _cluster_cost(spark: SparkSession, sf_dir: str, fee_per_vcpu: bool) -> DataFrame:
    """Cluster cost of all runs with the fee of either arm charged in the same way."""
    shapes = [replace(shape, fee_per_vcpu=fee_per_vcpu) for shape in cost.SHAPES]
    costs = cost.cluster_cost(_timed_runs(spark, sf_dir), cost.rate_table(spark, shapes), "value")
    return costs.select("event_id", "arm", *_COMPONENTS)


@query
def cluster_cost_per_node_fee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cluster_cost(spark, sf_dir, fee_per_vcpu=False)


@query
def cluster_cost_per_vcpu_fee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cluster_cost(spark, sf_dir, fee_per_vcpu=True)


@query
def storage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _timed_runs(spark, sf_dir).withColumn("kept_hours", (F.col("user_id") % 48).cast("double"))
    costs = cost.storage_cost(runs, cost.rate_table(spark), "value", "kept_hours")
    return costs.select("event_id", "arm", "storage")


@query
def experiment_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = cost.experiment_cost(_timed_runs(spark, sf_dir), cost.rate_table(spark), "value")
    return costs.select("event_id", "arm", *_COMPONENTS, "storage", "total")


@query
def hourly_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and rate of every cluster size in use."""
    workers = F.col("user_id") % 5 + 1
    sized = _timed_runs(spark, sf_dir).groupBy("arm", workers.cast("int").alias("workers")).agg(
        F.count(F.lit(1)).alias("runs")
    )
    return cost.hourly_rate(sized, cost.rate_table(spark), worker_count=F.col("workers"))


@query
def cost_by_dataset_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _timed_runs(spark, sf_dir).withColumns(
        {"provisioning": F.lit(180.0), "reused": F.col("user_id") % 2 == 0}
    )
    sizes = cost.dimension(spark, list(tx_source.MODE_SIZES_GB.items()), ["mode", "size_gb"])
    costs = cost.cost_by_mode(runs, cost.rate_table(spark), sizes, "value", "provisioning", "reused")
    return costs.select("event_id", "arm", "mode", "cluster_seconds", "total_compute", "storage", "total")


# Machine learning


def _training_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tidy = pixels.assemble_array(b.embeddings(spark, sf_dir), "embedding").drop("embedding")
    return sampling.split_by_hash(tidy, "vec_id", TRAIN_SHARE)


@query
def mlp_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _training_parts(spark, sf_dir)
    model = learning.train_mlp(train, LAYERS, epochs=2)
    objective = model.summary().objectiveHistory
    return train.agg(F.count(F.lit(1)).alias("training_rows")).select(
        "training_rows",
        F.lit(model.weights.size).alias("weights"),
        F.lit(int(objective[-1] < objective[0])).alias("objective_fell"),
        F.array(*[F.lit(n) for n in LAYERS]).cast("string").alias("architecture"),
    )


@query
def mlp_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _training_parts(spark, sf_dir)
    predicted = learning.predict(learning.train_mlp(train, LAYERS, epochs=2), test)
    is_class = F.col("prediction").isin(*[float(n) for n in range(LAYERS[-1])])
    return predicted.select("vec_id", "label", is_class.cast("int").alias("is_class"))


@query
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.accuracy(b.predictions(spark, sf_dir))


@query
def weighted_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.weighted_f1(b.predictions(spark, sf_dir))


@query
def ml_result_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _training_parts(spark, sf_dir)
    start = time.perf_counter()
    model = learning.train_mlp(train, LAYERS, epochs=2)
    record = learning.scores(learning.predict(model, test)).select(
        F.lit(time.perf_counter() - start).alias("training_time_seconds"),
        "accuracy",
        "f1_score",
        F.lit(2).alias("epochs"),
        F.array(*[F.lit(n) for n in LAYERS]).alias("architecture"),
    )
    path = fresh_path(spark, "ml")
    sinks.write_document(record, path)
    inside = F.col("accuracy").between(0, 1) & F.col("f1_score").between(0, 1) & (F.col("training_time_seconds") > 0)
    return record_source.read_ml_metrics(spark, path).select(
        "epochs", F.to_json("architecture").alias("architecture"), inside.cast("int").alias("in_bounds")
    )


# Profiling


def _orders_operations() -> list[profiling.Operation]:
    """The suite with the filter arguments that suit the orders table."""
    arguments = {
        "filter_expense_type": lambda df: tx.filter_category(df, CATEGORIES),
        "filter_complex": lambda df: tx.filter_conjunctive(df, **NARROW),
    }
    return [
        profiling.Operation(op.name, op.description, arguments.get(op.name, op.build))
        for op in profiling.TRANSACTION_OPERATIONS
    ]


def _outcome(rows: DataFrame) -> DataFrame:
    """What an operation record says apart from its time."""
    return rows.select("name", "description", "result_rows", F.col("success").cast("int").alias("success"))


@query
def profile_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    operation = profiling.Operation("agg_by_customer", "Totals of each customer", tx.agg_by_customer)
    record = profiling.profile_operation(operation, b.facts(spark, sf_dir))
    return _outcome(profiling.operation_rows(spark, [record]))


@query
def profile_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    suite = profiling.profile_suite(lambda: b.facts(spark, sf_dir), _orders_operations(), data_path=sf_dir)
    return _outcome(profiling.operation_rows(spark, suite["operations"]))


@query
def profile_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = lambda number: profiling.profile_suite(lambda: b.facts(spark, sf_dir), _orders_operations())
    runs = profiling.attempt_rows(spark, profiling.profile_repeated(run, 2), "local")
    return runstats.timing_key_stats(runs, ["provider"]).select("provider", "key", "count")


@query
def repeat_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storage tests repeated on the line items, read back from the records that they left."""
    path = fresh_path(spark, "repeats")
    kind = repeats.storage_kind(lambda: b.table(spark, sf_dir, "lineitem"), fresh_path(spark, "io"), "lineitem", (1, 2))
    repeats.write_attempts(spark, repeats.repeat([kind], 2), path, "aws")
    records = record_source.read_storage_records(spark, f"{path}/storage", documents=False)
    tests = record_source.storage_tests(records, "provider", "test_file")
    counted = tests.groupBy("provider", "test_file", "operation").agg(
        F.count("*").alias("tests"), F.count("error").alias("failed")
    )
    stats = storage.stats_by_operation(record_source.storage_operations(records, "provider"))
    return counted.join(stats.select("provider", "operation", F.col("duration_n").alias("runs")), ["provider", "operation"])


@query
def repeat_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training repeated on the embeddings: metrics and run records as they were stored."""
    path = fresh_path(spark, "repeats")
    kind = repeats.training_kind(lambda: _training_parts(spark, sf_dir), 1, layers=LAYERS, dataset="embeddings")
    repeats.write_attempts(spark, repeats.repeat([kind], 2), path, "gcp")
    metrics = record_source.read_ml_metrics(spark, f"{path}/training", None, documents=False)
    runs = record_source.read_run_records(spark, f"{path}/runs", documents=False)
    scored = metrics.groupBy("provider", "dataset", F.concat_ws(",", "architecture").alias("layers")).agg(
        F.count_if(F.col("accuracy").between(0, 1) & F.col("f1_score").between(0, 1)).alias("scored")
    )
    return scored.join(runstats.run_success_counts(runs, ["provider"]), "provider")


@query
def compare_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = comparison.compare_arms(b.run_totals(spark, sf_dir))
    return rounded(rows, "base_mean", "base_std", "cand_mean", "cand_std", "difference_pct")


@query
def table_io_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = profiling.table_io_profile(b.table(spark, sf_dir, "lineitem"), fresh_path(spark, "io"))
    return measured.select("operation", "result_rows")
