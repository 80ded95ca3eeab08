"""Times the headline queries and prints one JSON line.

Every query is built anew and drained into the noop sink, so all of its columns are
computed; ``count()`` would let the optimizer drop sorts and aggregates. The time is
the median of three runs after one warm-up pass over the tables.

The suite also runs as the published one does: from a CSV file of at least a million rows,
which every operation loads anew. Writing that file is not timed; reading it is timed alone too.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armspan.plans import bindings
from armspan.plans.catalog import QUERIES
from armspan.plans.profiling import TRANSACTION_OPERATIONS, drain
from armspan.session import fresh_path, local_session
from armspan.sources.transactions import read_transactions

# The seven suite operations, then one query per further area of the library.
SUITE = (
    "filter_category_in",
    "filter_conjunctive",
    "agg_by_customer",
    "agg_by_category",
    "agg_monthly_trends",
    "sort_amount_desc",
    "join_customer_summary",
)
FURTHER = (
    "scan_csv_transactions",
    "scan_run_records",
    "sample_fraction",
    "preview_top_n",
    "timing_key_stats",
    "cost_key_stats",
    "multi_run_summary",
    "experiment_cost",
    "storage_test_summary",
    "storage_stats_by_op",
    "throughput",
    "parse_experiment_id",
    "compare_arms",
    "assemble_features",
    "weighted_f1",
    "mlp_train",
)
RUNS = 3
CSV_ROWS = 1_000_000


def median_seconds(build: Callable[[], DataFrame]) -> float:
    times = []
    for _ in range(RUNS):
        start = time.perf_counter()
        drain(build())
        times.append(time.perf_counter() - start)
    return round(statistics.median(times), 3)


def csv_suite(spark: SparkSession, sf_dir: str) -> dict:
    """Seconds of the suite over a CSV file: all orders, repeated up to ``CSV_ROWS`` rows or more."""
    orders = bindings.transactions(spark, sf_dir)
    copies = -(-CSV_ROWS // orders.count())
    repeated = orders.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    # Categories and years that the filters of the suite ask for.
    kinds = F.create_map(*map(F.lit, ("1-URGENT", "Housing", "2-HIGH", "Entertainment")))
    named = repeated.select(
        *[F.col(name) for name in orders.columns if name not in ("TRANS_ID", "EXP_TYPE", "YEAR")],
        F.concat_ws("-", "TRANS_ID", "_copy").alias("TRANS_ID"),
        F.coalesce(kinds[F.col("EXP_TYPE")], "EXP_TYPE").alias("EXP_TYPE"),
        (F.col("YEAR") + 24).alias("YEAR"),
    ).select(*orders.columns)
    path = fresh_path(spark, "bench-csv")
    named.write.option("header", True).csv(path)
    rows = read_transactions(spark, path).count()
    seconds = {"read": median_seconds(lambda: read_transactions(spark, path))}
    for operation in TRANSACTION_OPERATIONS:
        seconds[operation.name] = median_seconds(lambda op=operation: op.build(read_transactions(spark, path)))
    suite = round(sum(s for name, s in seconds.items() if name != "read"), 3)
    return {"rows": rows, "format": "csv", "suite_seconds": suite, "queries": seconds}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    partitions = int(cpus) if cpus.isdigit() else 8
    spark = local_session("bench", cpus, partitions)
    for name in ("orders", "lineitem", "events", "embeddings"):
        drain(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    seconds = {name: median_seconds(lambda n=name: QUERIES[n](spark, sf_dir)) for name in (*SUITE, *FURTHER)}
    result = {
        "metric": "transactions_suite_seconds",
        "value": round(sum(seconds[name] for name in SUITE), 3),
        "unit": "sec",
        "queries": seconds,
        "all_queries_seconds": round(sum(seconds.values()), 3),
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
        "cpus": cpus,
        "csv_suite": csv_suite(spark, sf_dir),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
