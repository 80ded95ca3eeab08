"""Top products and near duplicates against brute force."""

import math
import random

import numpy as np
import oracle
import pytest
import xxhash
from pyspark.sql import functions as F

from armspan.llm import norm_buckets, queries
from armspan.llm.norm_buckets import top_products
from armspan.llm.simhash_trie import fingerprint, linked, near_duplicates, one_of_each

VECTORS = "vec_id bigint, embedding array<float>, label int, V string, len string"


def brute(rows, is_query, k):
    whole = [(i, [math.floor(256 * x) for x in np.array(v, "f4").astype("f8")]) for i, v in rows]
    out = set()
    for q, qv in {i: v for i, v in whole if i is not None and is_query(i)}.items():
        scores = [(-sum(a * b for a, b in zip(qv, v)), i is None, i or 0, i) for i, v in whole if i != q]
        for rank, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1):
            out.add((q, rank, i, -s))
    return out


@pytest.mark.parametrize("shape", ["random", "skewed", "parallel", "equal"])
def test_top_products(spark, shape):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 8))
    if shape == "skewed":
        base *= np.exp(rng.normal(size=(300, 1)) * 2)
    if shape == "parallel":
        base = np.abs(base[:1]) * np.linspace(0.1, 4, 300)[:, None] + rng.normal(size=(300, 8)) * 0.01
    if shape == "equal":
        base[50:] = base[50]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    df = spark.createDataFrame([(i, v, None, None, None) for i, v in rows], VECTORS)
    found = top_products(df, F.col("vec_id") % 10 == 0, k=5, bucket_rows=40, query_rows=12)
    assert {tuple(r) for r in found.collect()} == brute(rows, lambda i: i % 10 == 0, 5)


def test_candidates_go_to_the_blocks_that_reach_them(spark, monkeypatch):
    """With skewed lengths most queries need the longest buckets only, and the others are not repeated for them."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(2000, 8)) * np.exp(rng.normal(size=(2000, 1)) * 2)
    df = spark.createDataFrame([(i, [float(x) for x in v], None, None, None) for i, v in enumerate(base)], VECTORS)
    copies = []

    def counted(placed, met, dealt=norm_buckets._dealt):
        out = dealt(placed, met)
        copies.append((out.count(), met.select("block").distinct().count()))
        return out

    monkeypatch.setattr(norm_buckets, "_dealt", counted)
    assert top_products(df, F.col("vec_id") % 5 == 0, k=5, bucket_rows=100, query_rows=20).count() == 2000
    repeated, blocks = copies[-1]
    assert blocks > 10 and repeated < 0.5 * blocks * len(base)


def test_no_join_is_a_nested_loop(spark, monkeypatch):
    plans = []

    def planned(placed, met, dealt=norm_buckets._dealt):
        out = dealt(placed, met)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(norm_buckets, "_dealt", planned)
    rows = [(i, [float(i % 7), float(i % 5)], None, None, None) for i in range(60)]
    top_products(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0, k=3, bucket_rows=10, query_rows=3).count()
    assert len(plans) == 2 and not any("NestedLoop" in plan or "Cartesian" in plan for plan in plans)


def test_more_buckets_than_cuts(spark, monkeypatch):
    monkeypatch.setattr(norm_buckets, "_CUTS", 2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(1).normal(size=(120, 4)))]
    df = spark.createDataFrame([(i, v, None, None, None) for i, v in rows], VECTORS)
    found = top_products(df, F.col("vec_id") % 10 == 0, k=3, bucket_rows=10, query_rows=3)
    assert {tuple(r) for r in found.collect()} == brute(rows, lambda i: i % 10 == 0, 3)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 2.0]), (10, [0.5]), (3, []), (4, [-1.0, -1.0]), (None, [9.0, 9.0]), (0, [1.0, 2.0]), (5, [1e7, 1e8])]
    bad = [(1, None), (2, [nan, 1.0]), (20, [inf, 0.0]), (6, [None, 1.0])]
    df = spark.createDataFrame([(i, v, None, None, None) for i, v in good + bad], VECTORS)
    pad = [(i, v + [0.0] * (2 - len(v))) for i, v in good]
    found = {tuple(r) for r in top_products(df, F.col("vec_id") % 10 == 0).collect()}
    assert found == brute(pad, lambda i: i % 10 == 0, 5)
    assert top_products(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_top_products_match_sql(spark, sf_dir):
    found = queries.op3_top_products(spark, sf_dir)
    assert oracle.compare(found, oracle.connect(sf_dir), queries.ORACLES["op3_top_products"]) == []


def slow_print(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Smallest id reachable over pairs of at most three differing bits; prints: (id, print)."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (doc_id, _) in enumerate(prints):
        least.setdefault(root(i), []).append(doc_id)
    return [min((x for x in least[root(i)] if x is not None), default=None) for i in range(len(prints))]


def test_fingerprints():
    for text in [None, "", "a", "A b", "a b c d", "É é x\x0by\x1cz", "w " * 70_000 + "end of it"]:
        assert fingerprint(text) == slow_print(text)


@pytest.mark.parametrize("bucket_rows", [10, 200_000])
def test_links_reach_what_all_pairs_reach(spark, bucket_rows):
    random.seed(4)
    prints = {0, (1 << 64) - 1}
    for _ in range(30):
        at = random.getrandbits(64)
        for _ in range(random.randint(1, 12)):
            prints.add(at)
            for bit in random.sample(range(64), random.randint(1, 4)):
                at ^= 1 << bit
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint")
    edges = [tuple(x % (1 << 64) for x in r) for r in linked(df, 3, bucket_rows).collect()]
    assert all((a ^ b).bit_count() and len({a, b}) == 2 for a, b in edges)
    at = {p: i for i, p in enumerate(prints)}
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[max(root(at[a]), root(at[b]))] = min(root(at[a]), root(at[b]))
    assert [root(i) for i in range(len(prints))] == components(list(enumerate(prints)))


def test_near_duplicates_of_documents(spark, small_dir):
    found = {r.doc_id: r for r in queries.op9_simhash_trie(spark, small_dir).collect()}
    prints = [(r.doc_id, slow_print(r.text)) for r in queries.documents(spark, small_dir).collect()]
    assert {i: (f"{p:016x}", c) for (i, p), c in zip(prints, components(prints))} == {
        i: (r.fingerprint, r.component_id) for i, r in found.items()
    }


def test_chains_of_near_copies(spark):
    """Copies with a word changed after another: links form chains over several fingerprints."""
    random.seed(6)
    rows = []
    for group in range(6):
        words = [f"w{random.randint(0, 9999)}" for _ in range(900)]
        for step in range(8):
            rows.append((group * 100 + step * 7 % 50, " ".join(words)))
            words[random.randrange(900)] = f"changed{step}"
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    prints = [(i, slow_print(text)) for i, text in rows]
    wanted = dict(zip([i for i, _ in rows], components(prints), strict=True))
    assert len(set(wanted.values())) < len({p for _, p in prints}) < len(rows) + 1
    assert {r.doc_id: r.component_id for r in near_duplicates(df).collect()} == wanted
    assert {r.doc_id for r in one_of_each(df).collect()} == set(wanted.values())


def test_odd_documents(odd_docs, no_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == 9 and {r.component_id for r in rows if r.doc_id in (2, 3, 5)} == {2}
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    kept = one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 6, 7, 8]
    assert near_duplicates(no_docs).count() == 0 and one_of_each(no_docs).count() == 0
