"""Clusters and vector codes against plain Python and SQL, and what their bounds prune."""

import hashlib
import math

import numpy as np
import oracle
import pytest

from armspan.llm import pivot_codes, queries, simplex_clusters
from armspan.llm.pivot_codes import compress
from armspan.llm.simplex_clusters import Simplex, cluster

VECTORS = "vec_id bigint, embedding array<float>, label int, V string, cluster string, code string"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, None, "x", "y") for i, v, label in rows], VECTORS).repartition(3)


def whole(v, scale):
    return [math.floor(scale * x) for x in np.array(v, "f4").astype("f8").tolist()]


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def lloyd(vectors, places, rounds):
    near = lambda v: min((squared(v, c), n) for n, c in enumerate(places))
    for _ in range(rounds):
        found = [near(v)[1] for v in vectors]
        for n in range(len(places)):
            mine = [v for v, k in zip(vectors, found, strict=True) if k == n]
            if mine:
                places[n] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    return [near(v) for v in vectors]


def digest(numbers):
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def brute_clusters(rows, k, rounds, dims):
    kept = [(i, whole(v, 256)) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    places = [list(v) for _, v in named[:k]]
    found = lloyd([v for _, v in kept], places, rounds) if places else []
    sums = {}
    for d, n in found:
        sums[n] = sums.get(n, 0) + d
    return sorted(
        (str(i), n, d, sums[n], sum(sums.values()), digest(places[n])) for (i, _), (d, n) in zip(kept, found, strict=True)
    )


def brute_codes(rows, entries, rounds, parts):
    kept = [(i, whole(v, 1024), label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts)) * parts
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    step, codes, errors, books = width // parts, [""] * len(kept), [0] * len(kept), []
    for p in range(parts):
        cut = lambda v: v[p * step : (p + 1) * step]
        book = [list(cut(v)) for _, v, _ in first]
        for at, (d, n) in enumerate(lloyd([cut(v) for _, v, _ in kept], book, rounds)):
            codes[at] += f"{n:02x}"
            errors[at] += d
        books += [x for entry in book for x in entry]
    by_label = {}
    for (_, _, label), error in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + error
    return sorted(
        (str(i), str(label), code, error, by_label[label], digest(books))
        for (i, _, label), code, error in zip(kept, codes, errors, strict=True)
    )


def data(shape, n=150, dims=8):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(n, dims))
    if shape == "groups":
        base = rng.normal(size=(6, dims))[rng.integers(0, 6, n)] * 4 + base * 0.05
    if shape == "copies":
        base[40:] = base[rng.integers(0, 40, n - 40)]
    if shape == "line":
        base = np.outer(np.arange(n) // 3, np.ones(dims)) / 64
    if shape == "equal":
        base[:] = base[0]
    return [(i, [float(x) for x in v], [None, 1, 2][i % 3]) for i, v in enumerate(base)]


ODD = [
    (1, [1.0, 2.0, 3.0, 4.0], 1), (1, [1.0, 2.0, 3.0, 4.0], 1), (2, [-1.0, -2.0, -3.0, -4.5], None), (None, [0.1, 0.2, 0.3, 0.4], 2),
    (3, None, 1), (4, [NAN, 1.0, 1.0, 1.0], 1), (5, [INF, 1.0, 1.0, 1.0], 1), (6, [None, 1.0, 1.0, 1.0], 1), (7, [], 3),
    (8, [0.5], 3), (9, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], None), (10, [500.0, -500.0, 0.0, 0.0], 2), (1, [0.0, 0.0, 0.0, 0.0], 9),
]


def clusters_of(rows):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((str(r["vec_id"]), *(r[n] for n in names[1:])) for r in rows.collect())


def codes_of(rows):
    names = ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((str(r["vec_id"]), str(r["label"]), *(r[n] for n in names[2:])) for r in rows.collect())


@pytest.mark.parametrize("shape", ["random", "groups", "copies", "line", "equal"])
def test_clusters(spark, shape):
    rows = data(shape)
    assert clusters_of(cluster(frame(spark, rows), centroids=12, rounds=3, dims=8)) == brute_clusters(rows, 12, 3, 8)


@pytest.mark.parametrize("shape", ["random", "groups", "copies", "line", "equal"])
def test_codes(spark, shape):
    rows = data(shape)
    assert codes_of(compress(frame(spark, rows), entries=20, rounds=3, pivots=5)) == brute_codes(rows, 20, 3, 4)


def test_odd_vectors(spark):
    df = frame(spark, ODD)
    assert clusters_of(cluster(df, centroids=3, rounds=2, dims=4)) == brute_clusters(ODD, 3, 2, 4)
    assert codes_of(compress(df, entries=4, rounds=2)) == brute_codes(ODD, 4, 2, 4)
    for none in (df.limit(0), df.where("vec_id = 3"), df.where("vec_id = 4")):
        assert cluster(none, dims=4).count() == 0 and compress(none).count() == 0
    # Without ids nothing starts a cluster, but codes can be given.
    assert cluster(df.where("vec_id is null"), dims=4).count() == 0
    assert compress(df.where("vec_id is null")).count() == 1
    with pytest.raises(Exception, match="not below"):
        cluster(frame(spark, [(1, [1e9] * 4, 1)]), dims=4)


def test_apexes_bound_distances():
    rng = np.random.default_rng(9)
    vectors = rng.integers(-500, 500, (300, 16))
    simplex = Simplex(vectors[:20], 10)
    apexes = simplex.project(vectors)
    assert apexes.shape == (300, 10)
    for i in range(0, 300, 7):
        low = np.sqrt(np.square(apexes - apexes[i]).sum(axis=1))
        turned = apexes * np.array([1] * 9 + [-1])
        high = np.sqrt(np.square(turned - apexes[i]).sum(axis=1))
        exact = np.sqrt(np.square(vectors - vectors[i]).sum(axis=1))
        assert (low <= exact + 1e-6).all() and (exact <= high + 1e-6).all()
    # Pivots that add no dimension are not used.
    assert len(Simplex(np.outer(np.arange(9), np.ones(4, int)), 5).pivots) == 2
    assert len(Simplex(np.ones((9, 4), int), 5).pivots) == 1


def test_bounds_prune():
    rows = np.array([whole(v, 256) for _, v, _ in data("groups", 600, 16)])
    simplex = Simplex(rows[:40], 40)
    _, _, compared = simplex_clusters.nearest(rows, simplex.project(rows), rows[:40], simplex.project(rows[:40]))
    assert compared < 0.3 * len(rows) * 40
    pivots = pivot_codes.pivots_of(rows[:200], 8)
    known = pivot_codes.to_pivots(rows, pivots)
    _, _, evaluated = pivot_codes.nearest(rows, known, rows[:200], known[:200])
    assert evaluated < 0.5 * len(rows) * 200


@pytest.mark.parametrize("name", ["op12_simplex_clusters", "op13_pivot_codes"])
def test_queries_match_sql(spark, sf_dir, name):
    assert oracle.compare(queries.QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), queries.ORACLES[name]) == []
