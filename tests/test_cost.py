from dataclasses import replace

import pytest

from armspan.operators import cost


@pytest.fixture(scope="module")
def rates(spark):
    return cost.rate_table(spark)


def test_recorded_costs(spark, rates):
    """The cost entries of two recorded runs, from their runtimes."""
    runs = spark.createDataFrame([("aws", 3600.0), ("gcp", 1800.0)], "arm string, seconds double")
    found = {r["arm"]: r for r in cost.experiment_cost(runs, rates, "seconds").collect()}
    aws, gcp = found["aws"], found["gcp"]
    assert (aws["master_vm"], aws["master_fee"], aws["worker_vm"], aws["worker_fee"]) == (0.1, 0.03, 0.2, 0.06)
    assert aws["total_compute"] == pytest.approx(0.39)
    assert gcp["master_fee"] == pytest.approx(0.02) and gcp["worker_fee"] == pytest.approx(0.04)
    assert gcp["worker_vm"] == pytest.approx(0.095)
    assert aws["storage"] == pytest.approx(0.023 * 0.5 * 24 / 730)
    assert aws["total"] == aws["total_compute"] + aws["storage"]


def test_vcpus_and_workers_are_parameters(spark):
    shape = replace(cost.SHAPES[1], worker_count=5, vcpus=2)
    rates = cost.rate_table(spark, [shape])
    runs = spark.createDataFrame([("gcp",)], "arm string")
    assert cost.hourly_rate(runs, rates).first()["hourly_rate"] == pytest.approx(6 * (0.095 + 0.02))


def test_machine_without_price_fails(spark):
    shape = replace(cost.SHAPES[0], master_type="r8g.xlarge")
    with pytest.raises(ValueError, match="no price for aws r8g.xlarge"):
        cost.rate_table(spark, [shape])


def test_unknown_item_and_arm_fail(spark, rates):
    items = spark.createDataFrame([("aws", "m4.large"), ("aws", "r8g.xlarge")], "arm string, item string")
    with pytest.raises(Exception, match="no price for aws r8g.xlarge"):
        cost.price_lookup(items, cost.price_table(spark), "item").collect()
    runs = spark.createDataFrame([("azure", 1.0)], "arm string, seconds double")
    for build in (
        lambda: cost.cluster_cost(runs, rates, "seconds"),
        lambda: cost.storage_cost(runs, rates, "seconds", "seconds"),
    ):
        with pytest.raises(Exception, match="no cluster shape for arm azure"):
            build().collect()


def test_ambiguous_tables_fail(spark):
    with pytest.raises(ValueError):
        cost.price_table(spark, [("aws", "x", 1.0), ("aws", "x", 2.0)])
    with pytest.raises(ValueError):
        cost.rate_table(spark, [cost.SHAPES[0], cost.SHAPES[0]])
    with pytest.raises(ValueError):
        cost.dimension(spark, [], ["a"])


def test_unknown_mode_fails(spark, rates):
    columns = "arm string, mode string, s double, p double, r boolean"
    runs = spark.createDataFrame([("aws", "huge", 1.0, 2.0, True)], columns)
    sizes = cost.dimension(spark, [("sample", 0.08)], ["mode", "size_gb"])
    with pytest.raises(Exception, match="no data size for mode huge"):
        cost.cost_by_mode(runs, rates, sizes, "s", "p", "r").collect()


def test_cost_map_uses_the_names_of_the_arm(spark, rates):
    runs = spark.createDataFrame([("gcp", 3600.0)], "arm string, seconds double")
    entries = cost.experiment_cost(runs, rates, "seconds").select(cost.cost_map().alias("m")).first()["m"]
    assert set(entries) == {*cost.COST_ENTRIES["gcp"], "total_compute", "storage"}


def test_price_tables_of_any_size(spark, rates):
    many = [(*entry,) for entry in cost.PRICES] + [("aws", f"type{i}", float(i)) for i in range(20_000)]
    table = cost.price_table(spark, many)
    looked_up = cost.rate_table(spark, prices=table)
    by_arm = lambda rows: sorted(tuple(r) for r in rows.collect())
    assert by_arm(looked_up) == by_arm(rates)
    items = spark.createDataFrame([("aws", "type19999")], "arm string, item string")
    assert cost.price_lookup(items, table, "item").first()["unit_price"] == 19999.0


def test_prices_of_a_table_are_checked(spark):
    prices = spark.createDataFrame(list(cost.PRICES[1:]), "arm string, item string, unit_price double")
    with pytest.raises(Exception, match="no price for aws m4.large"):
        cost.rate_table(spark, prices=prices).collect()
    twice = spark.createDataFrame([*cost.PRICES, cost.PRICES[0]], "arm string, item string, unit_price double")
    with pytest.raises(Exception, match="two prices for the master_rate of aws"):
        cost.rate_table(spark, prices=twice).collect()


def test_cost_map_of_another_arm(spark):
    shape = replace(cost.SHAPES[0], arm="lab")
    rates = cost.rate_table(spark, [shape], [("lab", item, price) for arm, item, price in cost.PRICES if arm == "aws"])
    runs = spark.createDataFrame([("lab", 3600.0)], "arm string, seconds double")
    entries = cost.experiment_cost(runs, rates, "seconds").select(cost.cost_map().alias("m")).first()["m"]
    assert entries["master_vm"] == 0.1 and entries["total_compute"] == pytest.approx(0.39)
