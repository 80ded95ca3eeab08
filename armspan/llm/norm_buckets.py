"""Exact top-k by inner product: vectors bucketed by length, pruned per bucket, verified."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armspan.llm.common import pick, stored

# Above this local cosine threshold a bucket is searched along the query's largest
# coordinates; below it, by length.
_COORDINATE_COSINE = 0.8
_COORDINATES = 3
# Lengths that separate buckets, at most; larger buckets are cut into parts.
_CUTS = 2_000
# Cells of the score matrix held at once.
_CELLS = 4_000_000
# Room for rounding in bounds that are computed in floating point.
_ROOM = 1e-9
_FOUND = "query_id bigint, vec_id bigint, score bigint"
# Whole numbers up to this size are exact in a double.
_EXACT = 2.0**53


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component, x as double; null if any component is null or not finite."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)))
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    return F.when(vector.isNotNull() & finite, whole)


def top_products(
    df: DataFrame, is_query: Column, k: int = 5, bucket_rows: int = 16_384, query_rows: int = 4_096
) -> DataFrame:
    """For each query vector its ``k`` highest integer inner products with all other rows.

    ``df`` has vec_id and embedding; ``is_query`` is a condition on vec_id. Returns query_id,
    rank (from 1), vec_id, score; ties go to the smaller vec_id; all rows if fewer than ``k``.

    Vectors are grouped by length into buckets of about ``bucket_rows``; buckets of equal
    lengths are split by a hash, so no bucket outgrows its task. The longest bucket gives each
    query a first threshold. A query then meets only buckets in which length times length can
    reach its threshold. Within a bucket the threshold becomes a cosine: if it is high, only
    candidates whose coordinates lie in the feasible range along the query's largest
    coordinates are verified; otherwise the longest prefix of the bucket is. All that is left
    is multiplied out exactly. Queries travel to the buckets in blocks of ``query_rows``.

    Vectors that are null or hold null or non-finite components take no part. Vectors of
    different dimension are compared as if padded by zeros. Components saturate at the
    range of bigint and scores likewise. A query's own row is every row with its vec_id, so
    repeated vec_ids are not each other's candidates; repeated query rows give their result
    once. Null vec_ids take part as candidates and come last among ties, never as queries.
    """
    spark = df.sparkSession
    vectors = pick(df, "vec_id", "embedding").select("vec_id", quantised(F.col("embedding")).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    # Salts decide the place of equal vectors, so that a very common one is spread.
    rows = stored(
        vectors.where(F.col("v").isNotNull()).select(
            "vec_id", "v", length.alias("len"), F.xxhash64("vec_id", F.lit(7)).alias("h")
        ),
        "vectors",
    )
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    buckets, edges = _bucketed(rows, total, bucket_rows)
    placed = stored(buckets, "placed")
    queries = rows.where(is_query & F.col("vec_id").isNotNull()).dropDuplicates(["vec_id"])
    # The longest vectors give every query its first threshold. Stored as columns, as a join on constants is a nested loop.
    zeros = [F.lit(0).alias(name) for name in ("far", "bucket", "part")]
    queries = stored(queries.select("vec_id", "v", "len", *zeros), "queries")
    longest = _in_blocks(queries, query_rows).withColumn("least", F.lit(None).cast("bigint"))
    first = _matched(placed.where("bucket = 0 and part = 0"), longest, k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    kth = first.withColumn("r", F.row_number().over(best)).where(F.col("r") == k)
    kth = kth.select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))

    # Buckets are in descending order of length: a query meets a prefix of them.
    reach = lambda edge: F.col("len") * edge * (1.0 + _ROOM) >= F.col("least")
    far = F.aggregate(edges, F.lit(0), lambda n, edge: n + reach(edge).cast("int"))
    far = F.when(F.col("least").isNull(), F.size(edges)).otherwise(far)
    armed = queries.select("vec_id", "v", "len").join(kth, "vec_id", "left")
    armed = stored(armed.withColumn("far", far), "armed")
    met = _in_blocks(armed, query_rows).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("far"))))
    # One row a bucket.
    parts = placed.groupBy("bucket").agg(F.max("part").alias("last"))
    met = met.join(F.broadcast(parts), "bucket").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("last"))))
    found = _matched(placed, met, k)
    ranked = found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _in_blocks(queries: DataFrame, query_rows: int) -> DataFrame:
    """Adds block: about ``query_rows`` queries that reach equally ``far``, so they meet the same buckets."""
    sizes = queries.groupBy("far").agg(F.ceil(F.count("*") / F.lit(float(query_rows))).alias("_blocks"))
    # One row a bucket: at most _CUTS + 1.
    joined = queries.join(F.broadcast(sizes), "far")
    block = F.struct("far", F.pmod(F.xxhash64("vec_id"), F.col("_blocks")).alias("number"))
    return joined.withColumn("block", block).drop("_blocks")


def _bucketed(rows: DataFrame, total: int, bucket_rows: int) -> tuple[DataFrame, Column]:
    """Adds bucket (0: longest) and part (of a bucket that is too large).

    Also gives what no length in a bucket exceeds, for all buckets but the first.
    """
    n = min(-(-total // bucket_rows), _CUTS + 1)
    cuts: list[float] = []
    if n > 1:
        shares = [i / n for i in range(1, n)]
        cuts = sorted({-x for x in rows.agg(F.percentile_approx("len", shares, 10 * n)).first()[0]})
    edges = F.array(*[F.lit(-c) for c in cuts]).cast("array<double>")
    bucket = F.aggregate(edges, F.lit(0), lambda b, edge: b + (F.col("len") < edge).cast("int"))
    in_bucket = rows.withColumn("bucket", bucket)
    counts = in_bucket.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(float(bucket_rows))).alias("parts"))
    # One row a bucket: bounded by the number of cuts.
    joined = in_bucket.join(F.broadcast(counts), "bucket")
    part = F.pmod(F.xxhash64("h"), F.col("parts")).cast("int")
    return joined.select("vec_id", "v", "len", "bucket", part.alias("part")), edges


def _dealt(placed: DataFrame, met: DataFrame) -> DataFrame:
    """Every candidate once for each block of queries that meets its part of a bucket."""
    return placed.join(met.select("bucket", "part", "block").distinct(), ["bucket", "part"])


def _matched(placed: DataFrame, met: DataFrame, k: int) -> DataFrame:
    """Top ``k`` of each part of a bucket for each query that meets it."""
    met = met.withColumn("bucket", F.col("bucket").cast("int")).withColumn("part", F.col("part").cast("int"))
    keys = ["bucket", "part", "far", "number"]
    candidates = _dealt(placed, met).select("bucket", "part", "block.*", "vec_id", "v", "len")
    met = met.select("bucket", "part", "block.*", "vec_id", "v", "len", "least")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return _search(left, right, k)

    return candidates.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInPandas(search, _FOUND)


def _search(candidates: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    candidates = candidates.sort_values("len", ascending=False, kind="stable")
    width = max(candidates["v"].map(len).max(), queries["v"].map(len).max())
    c, q = _matrix(candidates["v"], width), _matrix(queries["v"], width)
    c_len, q_len = candidates["len"].to_numpy(), queries["len"].to_numpy()
    ids = candidates["vec_id"].astype("Int64")
    # Null ids come last among ties.
    id_null = ids.isna().to_numpy()
    id_value = ids.fillna(0).to_numpy("int64")
    q_id = queries["vec_id"].to_numpy("int64")
    least = queries["least"].astype("Float64").fillna(-np.inf).to_numpy("float64")
    # A length of zero reaches no positive threshold; the threshold then is no cosine.
    scale = q_len * c_len[0]
    cosine = np.divide(least, scale, out=np.full(len(q), -np.inf), where=scale > 0)
    # How many candidates are long enough, for positive thresholds; else all of them.
    need = np.divide(least * (1 - _ROOM), q_len, out=np.full(len(q), -np.inf), where=q_len > 0)
    prefix = np.where(least > 0, np.searchsorted(-c_len, -need, side="right"), len(c))
    steep = cosine >= _COORDINATE_COSINE
    out: list[tuple] = []

    def keep(query: int, scores: np.ndarray, rows: np.ndarray) -> None:
        own = (id_value[rows] == q_id[query]) & ~id_null[rows]
        scores, rows = scores[~own], rows[~own]
        if len(scores) > k:
            bar = max(np.partition(scores, len(scores) - k)[len(scores) - k], least[query])
        else:
            bar = least[query]
        near = np.flatnonzero(scores >= bar)
        order = np.lexsort((id_value[rows[near]], id_null[rows[near]], -scores[near]))[:k]
        for i in near[order]:
            row = rows[i]
            out.append((q_id[query], None if id_null[row] else id_value[row], int(scores[i])))

    coordinate_order = {}
    unit = np.divide(c.astype("float64"), c_len[:, None], out=np.zeros(c.shape), where=c_len[:, None] > 0)
    for query in np.flatnonzero(steep):
        direction = q[query].astype("float64") / q_len[query]
        alpha = np.arccos(min(1.0, cosine[query] * (1 - _ROOM)))
        alive = None
        for axis in np.argsort(-np.abs(direction))[:_COORDINATES]:
            if axis not in coordinate_order:
                order = np.argsort(unit[:, axis], kind="stable")
                coordinate_order[axis] = (order, unit[order, axis])
            order, sorted_values = coordinate_order[axis]
            beta = np.arccos(np.clip(direction[axis], -1.0, 1.0))
            low = -1.0 if alpha + beta >= np.pi else np.cos(alpha + beta)
            high = 1.0 if alpha >= beta else np.cos(beta - alpha)
            lo = np.searchsorted(sorted_values, low - _ROOM, side="left")
            hi = np.searchsorted(sorted_values, high + _ROOM, side="right")
            mask = np.zeros(len(c), bool)
            mask[order[lo:hi]] = True
            alive = mask if alive is None else alive & mask
        rows = np.flatnonzero(alive)
        rows = rows[rows < prefix[query]]
        if len(rows):
            keep(query, _products(q[query : query + 1], c[rows])[0], rows)
    flat = np.flatnonzero(~steep & (prefix > 0))
    flat = flat[np.argsort(prefix[flat], kind="stable")]
    step = max(1, _CELLS // len(c))
    for at in range(0, len(flat), step):
        some = flat[at : at + step]
        scores = _products(q[some], c[: prefix[some].max()])
        for i, query in enumerate(some):
            n = prefix[query]
            keep(query, scores[i, :n], np.arange(n))
    frame = pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
    return frame.astype({"query_id": "int64", "vec_id": "Int64", "score": "int64"})


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """The vectors as rows of doubles, or of Python whole numbers where doubles are not exact."""
    values = np.zeros((len(vectors), width), "int64")
    for i, vector in enumerate(vectors):
        values[i, : len(vector)] = vector
    return values


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products, saturated at the range of bigint."""
    most = float(np.abs(q.astype("float64")).max(initial=0)) * float(np.abs(c.astype("float64")).max(initial=0))
    if most * q.shape[1] < _EXACT:
        return (q.astype("float64") @ c.astype("float64").T).astype("int64")
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype("int64")
