"""Explicit schemas of the tables and records the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names of the transactions file.
TRANSACTIONS = T.StructType(
    [
        T.StructField("CUST_ID", T.StringType()),
        T.StructField("START_DATE", T.DateType()),
        T.StructField("END_DATE", T.DateType()),
        T.StructField("TRANS_ID", T.StringType()),
        T.StructField("DATE", T.DateType()),
        T.StructField("YEAR", T.IntegerType()),
        T.StructField("MONTH", T.IntegerType()),
        T.StructField("DAY", T.IntegerType()),
        T.StructField("EXP_TYPE", T.StringType()),
        T.StructField("AMOUNT", T.DoubleType()),
    ]
)

_METRIC_MAP = T.MapType(T.StringType(), T.DoubleType())
# Values of any JSON type, nested ones as their text.
_TEXT_MAP = T.MapType(T.StringType(), T.StringType())

_ERROR = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("type", T.StringType()),
    ]
)

# The timing and cost keys differ between arms, so both are maps; metadata is the
# union of the fields that any arm records.
RUN_RECORD = T.StructType(
    [
        T.StructField("experiment_id", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("timings", _METRIC_MAP),
        T.StructField("costs", _METRIC_MAP),
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField("benchmark_type", T.StringType()),
                    T.StructField("dataset_mode", T.StringType()),
                    T.StructField("cluster_config", _TEXT_MAP),
                    T.StructField("reused_cluster", T.BooleanType()),
                    T.StructField("using_existing_cluster", T.BooleanType()),
                    T.StructField("cluster_id", T.StringType()),
                    T.StructField("cluster_name", T.StringType()),
                    T.StructField("step_id", T.StringType()),
                    T.StructField("job_id", T.StringType()),
                    T.StructField("script_s3_uri", T.StringType()),
                    T.StructField("script_gcs_uri", T.StringType()),
                    T.StructField("ml_config", _TEXT_MAP),
                    T.StructField("test_summary", _TEXT_MAP),
                ]
            ),
        ),
        T.StructField("errors", T.ArrayType(_ERROR)),
        T.StructField(
            "summary",
            T.StructType(
                [
                    T.StructField("total_time_seconds", T.DoubleType()),
                    T.StructField("total_cost_usd", T.DoubleType()),
                    T.StructField("success", T.BooleanType()),
                ]
            ),
        ),
    ]
)

STORAGE_TEST = T.StructType(
    [
        T.StructField("operation", T.StringType()),
        T.StructField("file_size_mb", T.DoubleType()),
        T.StructField("total_mb_read", T.DoubleType()),
        T.StructField("chunk_size_mb", T.DoubleType()),
        T.StructField("data_size_mb", T.DoubleType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("throughput_mbps", T.DoubleType()),
        T.StructField("key", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

STORAGE_STATS = T.StructType(
    [
        T.StructField("avg_throughput_mbps", T.DoubleType()),
        T.StructField("avg_duration_seconds", T.DoubleType()),
        T.StructField("count", T.LongType()),
    ]
)

STORAGE_RECORD = T.StructType(
    [
        T.StructField("provider", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("test_file", T.StringType()),
        T.StructField("file_size_mb", T.DoubleType()),
        T.StructField("bucket", T.StringType()),
        T.StructField("tests", T.ArrayType(STORAGE_TEST)),
        T.StructField("summary", T.MapType(T.StringType(), STORAGE_STATS)),
    ]
)

ML_METRICS = T.StructType(
    [
        T.StructField("training_time_seconds", T.DoubleType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("f1_score", T.DoubleType()),
        T.StructField("epochs", T.IntegerType()),
        T.StructField("architecture", T.ArrayType(T.IntegerType())),
        T.StructField("job_start_time", T.StringType()),
        T.StructField("job_end_time", T.StringType()),
        T.StructField("total_job_time_seconds", T.DoubleType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("batch_size", T.IntegerType()),
    ]
)

OPERATION_RESULT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("result_rows", T.LongType()),
        T.StructField("error", T.StringType()),
        T.StructField("success", T.BooleanType()),
    ]
)

SUITE_RESULT = T.StructType(
    [
        T.StructField("benchmark_type", T.StringType()),
        T.StructField("dataset_mode", T.StringType()),
        T.StructField("data_path", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("operations", T.ArrayType(OPERATION_RESULT)),
        T.StructField("total_rows", T.LongType()),
        T.StructField("data_load_time_seconds", T.DoubleType()),
        T.StructField("sampled", T.BooleanType()),
        T.StructField("sample_fraction", T.DoubleType()),
        T.StructField("total_duration_seconds", T.DoubleType()),
        T.StructField("success_rate", T.DoubleType()),
    ]
)
