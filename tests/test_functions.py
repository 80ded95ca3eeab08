import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from armspan.functions import identity, measures, pixels
from armspan.functions.rounding import exact_sum, fixed_text, round_exact


def _numbers():
    generator = random.Random(7)
    ties = [k / 8 for k in range(-40, 41)] + [0.285, 1.005, 2.675, 1.115, -82.55, 0.35, 0.25, 1e15 + 0.3]
    spread = [generator.uniform(-1, 1) * 10 ** generator.randint(-6, 9) for _ in range(3000)]
    cents = [generator.randint(-(10**7), 10**7) / 1000 for _ in range(3000)]
    return ties + spread + cents + [0.0, 1e300, -1e17]


def test_round_exact_is_binary_half_even(spark):
    rows = spark.createDataFrame([(v,) for v in _numbers()], "v double")
    found = rows.select("v", *[round_exact(F.col("v"), d).alias(f"r{d}") for d in range(5)]).collect()
    for row in found:
        for digits in range(5):
            assert row[f"r{digits}"] == round(row["v"], digits), (row["v"], digits)


def test_fixed_text(spark):
    values = [v for v in _numbers() if abs(v) < 1e12]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    text = rows.select("v", fixed_text(F.col("v"), 1, signed=True).alias("a"), fixed_text(F.col("v"), 4).alias("b"))
    for row in text.collect():
        assert row["a"] == f"{row['v']:+.1f}" and row["b"] == f"{row['v']:.4f}"


def test_round_exact_keeps_null_and_rejects_digits(spark):
    assert spark.range(1).select(round_exact(F.lit(None).cast("double"), 2)).first()[0] is None
    with pytest.raises(ValueError):
        round_exact(F.lit(1.0), 7)


def test_exact_sum_does_not_depend_on_order(spark):
    generator = random.Random(3)
    cents = [generator.randint(-(10**14), 10**14) for _ in range(5000)]
    rows = spark.createDataFrame([(c / 100,) for c in cents], "v double")
    for partitions in (1, 7):
        total = rows.repartition(partitions).agg(exact_sum(F.col("v"))).first()[0]
        assert total == sum(cents) / 100


@pytest.mark.parametrize("kind", ["thousandths", "sizes", "cancelling", "small"])
def test_exact_sum_has_the_same_bits_for_any_partitioning(spark, kind):
    generator = random.Random(11)
    makers = {
        "thousandths": lambda: generator.randint(-(10**9), 10**9) / generator.choice([10, 100, 1000, 10**5]),
        "sizes": lambda: generator.uniform(-1, 1) * 10.0 ** generator.randint(-4, 18),
        "cancelling": lambda: generator.choice([1e17 + 64, -1e17 - 64, 0.125, 1 / 3, -2 / 3]),
        "small": lambda: generator.uniform(-1, 1) * 1e-4,
    }
    values = [makers[kind]() for _ in range(4000)]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    found = {rows.repartition(n, "i").agg(exact_sum(F.col("v"))).first()[0] for n in (1, 7, 200)}
    assert len(found) == 1
    total = found.pop()
    exact = sum(Fraction(v) for v in values)
    assert abs(Fraction(total) - exact) <= Fraction(math.ulp(max(map(abs, values)))) + abs(exact) * Fraction(2) ** -51


def test_exact_sum_of_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    groups = {
        1: [1.25, nan, 2.0], 2: [inf, 1.005, -7.0], 3: [inf, -inf], 4: [-inf, 1e300, 1e26], 5: [None, None], 6: [None, 0.005],
        7: [1e18, 1e18, 0.1, -1e18], 8: [-0.0], 9: [1e17, 1.5, -1e17], 10: [5e-324], 11: [1e300, 1.0],
        12: [-(2.0**61), 0.001, 2.0**61],
    }
    rows = spark.createDataFrame([(k, v) for k, found in groups.items() for v in found], "k int, v double")
    found = dict(tuple(r) for r in rows.repartition(5).groupBy("k").agg(exact_sum(F.col("v"))).collect())
    assert math.isnan(found[1]) and math.isnan(found[3]) and found[2] == inf and found[4] == -inf and found[5] is None
    assert (found[6], found[7], found[8], found[9], found[11]) == (0.005, 1e18, 0.0, 1.5, 1e300)
    assert found[10] == 0.0 and found[12] == pytest.approx(0.001, rel=1e-9)


def test_exact_sum_passes_the_range_of_double(spark):
    rows = spark.range(1000).select((F.lit(90_000_000_000_000.01)).alias("v"))
    unit = round(90_000_000_000_000.01 * 100)
    assert rows.agg(exact_sum(F.col("v"))).first()[0] == unit * 1000 / 100
    assert rows.limit(0).agg(exact_sum(F.col("v"))).first()[0] is None
    assert spark.range(3).agg(exact_sum(F.col("id") / 4, None)).first()[0] == 0.75


def test_throughput_guards_zero_time(spark):
    rows = spark.createDataFrame([(5.0, 0.0), (5.0, 2.0), (1.0, -1.0)], "mb double, s double")
    found = [r[0] for r in rows.select(measures.throughput(F.col("mb"), F.col("s"))).collect()]
    assert found == [0.0, 2.5, 0.0]


def test_duration_units(spark):
    rows = spark.createDataFrame([(59.99,), (60.0,), (3599.0,), (3600.0,)], "s double")
    found = [r[0] for r in rows.select(measures.duration_text(F.col("s"))).collect()]
    assert found == ["59.99 seconds", "1.00 minutes", "59.98 minutes", "1.00 hours"]


def test_difference_and_winner(spark):
    rows = spark.createDataFrame(
        [(0.0, 0.0), (0.0, 5.0), (4.0, 5.0), (4.0, 3.0), (4.0, 4.0)], "base double, cand double"
    )
    base, cand = F.col("base"), F.col("cand")
    found = rows.select(
        measures.pct_difference(base, cand).alias("guarded"),
        measures.pct_difference(base, cand, guard=False).alias("plain"),
        measures.winner(measures.pct_difference(base, cand), "A", "B").alias("winner"),
    ).collect()
    assert [r["guarded"] for r in found] == [0.0, 100.0, 25.0, -25.0, 0.0]
    assert [r["plain"] for r in found] == [None, None, 25.0, -25.0, 0.0]
    assert [r["winner"] for r in found] == ["Tie", "A", "A", "B", "Tie"]


@pytest.mark.parametrize(
    "name, record_arm, expected",
    [
        ("pyspark_aws_large_run01_20251105_112703", "gcp", ("pyspark", "aws", "large", 1, "20251105_112703")),
        ("ml_run07_20251104_122150", "gcp", ("ml", "gcp", None, 7, "20251104_122150")),
        ("file:/x/y/storage_gcp_run12_20251105_132149.json", None, ("storage", "gcp", None, 12, "20251105_132149")),
        ("pyspark_sample_run100_20251105_112703", None, ("pyspark", None, "sample", 100, "20251105_112703")),
        ("no such name", "aws", (None, "aws", None, None, None)),
        ("a/b/c/d/e", None, (None, None, None, None, None)),
    ],
)
def test_parse_run_name(spark, name, record_arm, expected):
    parsed = identity.parse_run_name(F.lit(name), F.lit(record_arm).cast("string"))
    assert tuple(spark.range(1).select(parsed.alias("p")).select("p.*").first()) == expected


def test_run_name_takes_other_arms(spark):
    name = identity.run_name(F.lit("scan"), F.lit(3), F.lit("20250101_000000"), arm=F.lit("left"))
    parsed = identity.parse_run_name(name, arms=("left", "right"))
    row = spark.range(1).select(name.alias("n"), parsed.alias("p")).first()
    assert row["n"] == "scan_left_run03_20250101_000000" and row["p"]["arm"] == "left"


def test_unknown_arm_fails(spark):
    rows = spark.createDataFrame([("AWS",), ("azure",)], "arm string")
    with pytest.raises(Exception, match="unknown arm: azure"):
        rows.select(identity.normalise_arm(F.col("arm"))).collect()


def test_images_flatten_and_gather(spark):
    image = [[float(10 * r + c) for c in range(3)] for r in range(2)]
    rows = spark.createDataFrame([(image, 4)], "image array<array<float>>, label int")
    wide = pixels.flatten_to_columns(rows, "image", 6, "label")
    assert wide.columns == [f"pixel{i}" for i in range(6)] + ["label"]
    assert list(wide.first()) == [0.0, 1.0, 2.0, 10.0, 11.0, 12.0, 4]
    assert pixels.gather_columns(wide, 6, "label").first()["features"] == [0.0, 1.0, 2.0, 10.0, 11.0, 12.0]


def test_pixels_are_floats_in_unit_range(spark):
    rows = spark.range(1).select(pixels.normalise_pixels(F.array(*[F.lit(v) for v in (0, 51, 255)])).alias("p"))
    assert rows.schema["p"].dataType.elementType.typeName() == "float"
    assert [round(v, 6) for v in rows.first()["p"]] == [0.0, 0.2, 1.0]


def test_null_features_fail(spark):
    wide = spark.createDataFrame([(1.0, None)], "pixel0 double, pixel1 double")
    with pytest.raises(Exception):
        pixels.assemble_columns(wide, 2).collect()
    tidy = spark.createDataFrame([([1.0, None],)], "v array<float>")
    with pytest.raises(Exception, match="null in feature column v"):
        pixels.assemble_array(tidy, "v").collect()


@pytest.mark.parametrize("values", [[0.004] * 1000, [0.1, float("nan")], [1e17, 0.25, -3.0], [float("inf"), 1.0]])
def test_amounts_that_are_no_whole_cents_are_summed_exactly(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    assert repr(rows.agg(exact_sum(F.col("v"))).first()[0]) == repr(math.fsum(values))


def test_one_group_does_not_decide_for_another(spark):
    rows = spark.createDataFrame([("a", 0.1)] * 10 + [("b", 0.001)] * 3 + [("c", None)], "k string, v double")
    found = dict(tuple(r) for r in rows.groupBy("k").agg(exact_sum(F.col("v"))).collect())
    assert found == {"a": 1.0, "b": pytest.approx(0.003), "c": None}
