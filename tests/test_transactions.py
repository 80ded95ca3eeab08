import pytest
from pyspark.sql import functions as F

from armspan.functions.identity import hash_below
from armspan.operators import sampling
from armspan.operators import transactions as tx
from armspan.plans import bindings

SCHEMA = "CUST_ID string, TRANS_ID string, YEAR int, MONTH int, EXP_TYPE string, AMOUNT double"


@pytest.fixture(scope="module")
def facts(spark):
    rows = [
        ("C1", "T1", 2018, 1, "Housing", 400.0),
        ("C1", "T2", 2018, 2, "Housing", 100.5),
        ("C2", "T3", 2019, 1, None, 5.25),
        (None, "T4", 2020, 1, "Housing", 900.0),
        ("C3", "T5", 2019, 1, "Savings", None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_filters_drop_nulls(facts):
    assert [r["TRANS_ID"] for r in tx.filter_category(facts, ["Housing", "Other"]).collect()] == ["T1", "T2", "T4"]
    assert [r["TRANS_ID"] for r in tx.filter_conjunctive(facts, "Housing", 300, [2018, 2019]).collect()] == ["T1"]


def test_null_key_forms_a_group(facts):
    found = {r["CUST_ID"]: tuple(r)[1:] for r in tx.agg_by_customer(facts).collect()}
    assert found == {"C1": (500.5, 2, 250.25), "C2": (5.25, 1, 5.25), None: (900.0, 1, 900.0), "C3": (None, 1, None)}
    assert None in {r["EXP_TYPE"] for r in tx.agg_by_category(facts).collect()}


def test_months_come_in_order(facts):
    found = [(r["YEAR"], r["MONTH"], r["monthly_count"]) for r in tx.agg_monthly(facts).collect()]
    assert found == [(2018, 1, 1), (2018, 2, 1), (2019, 1, 2), (2020, 1, 1)]


def test_sort_puts_nulls_last(facts):
    assert [r["TRANS_ID"] for r in tx.sort_by_amount(facts).collect()] == ["T4", "T1", "T2", "T3", "T5"]
    assert [r["TRANS_ID"] for r in tx.preview(facts, 2).collect()] == ["T4", "T1"]


def test_sorted_whole_table(spark, sf_dir):
    amounts = [r["AMOUNT"] for r in tx.sort_by_amount(bindings.facts(spark, sf_dir)).collect()]
    assert len(amounts) == 15000 and all(a >= b for a, b in zip(amounts, amounts[1:]))


def test_join_drops_null_keys(facts):
    joined = tx.join_customer_summary(facts).collect()
    found = {r["TRANS_ID"]: (r["total_spent"], r["total_transactions"]) for r in joined}
    assert found == {"T1": (500.5, 2), "T2": (500.5, 2), "T3": (5.25, 1), "T5": (None, 1)}


@pytest.fixture
def small_partitions(spark):
    """Sizes at which adaptive execution splits, scaled down to the tables and partitions of the tests."""
    sizes = {
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50000",
    }
    for name, value in sizes.items():
        spark.conf.set(name, value)
    yield spark
    for name in sizes:
        spark.conf.unset(name)


def test_join_splits_a_frequent_key(small_partitions):
    """A third of the rows has one key: its partition is split by its bytes."""
    key = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 5000)
    rows = small_partitions.range(0, 90_000, 1, 8)
    facts = rows.select(key.alias("CUST_ID"), F.col("id").alias("TRANS_ID"), (F.col("id") % 997 / 4).alias("AMOUNT"))
    totals = {r["CUST_ID"]: tuple(r)[1:] for r in tx.agg_by_customer(facts).collect()}
    joined = tx.join_customer_summary(facts)
    assert joined.columns[:3] == facts.columns
    found = joined.collect()
    assert sorted(r["TRANS_ID"] for r in found) == list(range(90_000))
    assert all(tuple(r)[3:] == totals[r["CUST_ID"]] for r in found)
    final = joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin(skew=true)" in final


def test_hash_sample_ignores_partitioning(spark):
    ids = spark.range(4000)
    few = {r["id"] for r in sampling.sample_by_hash(ids.repartition(2), "id", 0.5).collect()}
    many = {r["id"] for r in sampling.sample_by_hash(ids.repartition(9), "id", 0.5).collect()}
    assert few == many and 1800 < len(few) < 2200
    other = {r["id"] for r in sampling.sample_by_hash(ids, "id", 0.5, seed=7).collect()}
    assert other != few


def test_split_is_complete(spark):
    ids = spark.range(1000).select(F.nullif("id", F.lit(5)).alias("id"))
    train, test = sampling.split_by_hash(ids, "id", 0.8)
    assert train.count() + test.count() == 1000
    assert {r["id"] for r in train.collect()}.isdisjoint({r["id"] for r in test.collect()})


def test_row_sample_is_repeatable(spark):
    ids = spark.range(2000)
    first = [r["id"] for r in sampling.sample_rows(ids, 0.5).collect()]
    assert first == [r["id"] for r in sampling.sample_rows(ids, 0.5).collect()]


@pytest.mark.parametrize("fraction", [0.2, 0.5, 0.8])
def test_rows_without_a_key_are_sampled_like_others(spark, fraction):
    rows = spark.range(1000).select(F.lit(None).cast("string").alias("key"), "id")
    few = {r["id"] for r in sampling.sample_by_hash(rows.repartition(2), "key", fraction).collect()}
    many = {r["id"] for r in sampling.sample_by_hash(rows.repartition(9), "key", fraction).collect()}
    assert few == many and abs(len(few) - 1000 * fraction) < 60
    named = {r["id"] for r in sampling.sample_by_hash(rows, "key", fraction, instead=["id"]).collect()}
    assert named == few


def test_a_null_key_alone_decides_nothing(spark):
    rows = spark.createDataFrame([(None,), ("a",)], "key string")
    with pytest.raises(Exception, match="a null key decides no sample"):
        rows.filter(hash_below(F.col("key"), 0.5, 42)).collect()
