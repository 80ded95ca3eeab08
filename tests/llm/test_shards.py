"""Histogram shards against a running sum."""

import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from armspan.llm import queries
from armspan.llm.histogram_shards import shard_by_bytes


def expected(rows, shards):
    """Sizes by shard of rows (key, size) in order."""
    total = sum(size for _, size in rows)
    below, out = 0, []
    for key, size in rows:
        out.append((key, size, below * shards // total if total else 0))
        below += size
    return out


@pytest.mark.parametrize("keys", [range(500), range(-250, 250), [7] * 300 + list(range(200)), [2**62, -(2**63), 2**63 - 1, 0] * 20])
def test_matches_running_sum(spark, keys):
    rows = sorted((k, (i * 37) % 91 + 1) for i, k in enumerate(keys))
    df = spark.createDataFrame(rows, "k bigint, s bigint").repartition(5)
    found = shard_by_bytes(df, "k", "s", shards=7).collect()
    assert len(found) == len(rows)
    total, most = sum(s for _, s in rows), max(s for _, s in rows)
    for shard in range(7):
        mine = [r for r in found if r["shard"] == shard]
        assert abs(sum(r.s for r in mine) - total / 7) <= most
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert [r.k for r in sorted(mine, key=lambda r: r.slot)] == sorted(r.k for r in mine)
    if len(set(keys)) == len(rows):
        assert sorted((r.k, r.s, r["shard"]) for r in found) == expected(rows, 7)


def test_odd_rows(odd_docs, no_docs):
    sized = odd_docs.select("*", F.octet_length("text").alias("bytes"), F.lit("old").alias("Shard"))
    found = shard_by_bytes(sized, "doc_id", "bytes", shards=3)
    assert [c for c in found.columns if c.lower() == "shard"] == ["shard"]
    rows = found.collect()
    assert len(rows) == 9 and min(rows, key=lambda r: (r["shard"], r.slot)).doc_id is None
    assert shard_by_bytes(no_docs.withColumn("b", F.lit(1)), "doc_id", "b").count() == 0
    zero = shard_by_bytes(odd_docs.withColumn("b", F.lit(0)), "doc_id", "b", shards=3).collect()
    assert {r["shard"] for r in zero} == {0} and sorted(r.slot for r in zero) == list(range(9))


def test_tolerance_bounds_sizes(spark):
    df = spark.range(10_000).select("id", F.lit(10).alias("s"))
    sums = shard_by_bytes(df, "id", "s", shards=4, tolerance=0.05).groupBy("shard").agg(F.sum("s").alias("n")).collect()
    assert len(sums) == 4 and all(abs(r.n - 25_000) <= 2 * 0.05 * 25_000 for r in sums)


def test_shards_are_native(spark):
    """No Python on rows: plans hold no Python, Pandas or Arrow node."""
    df = spark.range(100).select("id", F.lit(1).alias("s"))
    plan = shard_by_bytes(df, "id", "s")._jdf.queryExecution().toString()
    assert not any(word in plan for word in itertools.chain(("Python", "Pandas", "Arrow")))


def test_query_against_plain_python(spark, small_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in queries.documents(spark, small_dir).collect()}
    rows = queries.op2_histogram_shards(spark, small_dir).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {i: (len(t) + 8, zlib.crc32(t)) for i, t in texts.items()}
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)} and {r.shard for r in rows} <= set(range(24))
    total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for shard in range(24):
        mine = [r for r in rows if r.shard == shard]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / 24) <= most
