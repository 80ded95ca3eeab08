"""SimHash fingerprints, linked by a self-join of a binary trie, and their components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armspan.llm.common import nested, pick, stored, unnested

_BITS = 64
_SEED = 42
# Node pairs held at once while a trie is traversed.
_FRONTIER = 400_000
# Shingles whose bits are counted at once.
_COUNTED = 65_536
_ALL = (1 << 64) - 1


def fingerprint(text: str | None, words: int = 3, seed: int = _SEED) -> int:
    """64-bit SimHash of the word shingles of a text; 0 if it has no words.

    A-Z are lower-cased, words are runs of anything but ASCII white space. A text with fewer
    words than a shingle is one shingle. A bit is set if over half of the shingles set it.
    """
    from xxhash import xxh64_intdigest

    # bytes.lower and bytes.split know ASCII only, which is what is wanted.
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    n = max(1, len(found) - words + 1)
    ends = np.cumsum([len(word) + 1 for word in found])
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(words, len(found)) - 1 :] - 1)[:n].tolist()
    counts = np.zeros(_BITS, "int64")
    for at in range(0, n, _COUNTED):
        hashes = np.array(
            [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[at : at + _COUNTED], stops[at : at + _COUNTED])],
            "<u8",
        )
        counts += _bit_counts(hashes)
    return _majority(counts, n)


def simhash(hashes: np.ndarray) -> int:
    """64-bit SimHash of 64-bit hashes; 0 if there are none."""
    counts = np.zeros(_BITS, "int64")
    for at in range(0, len(hashes), _COUNTED):
        counts += _bit_counts(hashes[at : at + _COUNTED])
    return _majority(counts, len(hashes))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype="int64")


def _majority(counts: np.ndarray, n: int) -> int:
    return sum(1 << bit for bit in np.flatnonzero(counts * 2 > n).tolist())


def near_duplicates(df: DataFrame, words: int = 3, distance: int = 3, bucket_rows: int = 200_000) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (16 hex digits) and component_id.

    Rows link when their fingerprints differ in ``distance`` bits or fewer; a component is all
    that links reach, and its id is the smallest doc_id in it (nulls are ignored; a component
    of nulls alone has a null id). Empty and null texts have fingerprint zero and link as any.
    Equal fingerprints are grouped before anything is compared, so copies cost nothing. Extra
    columns are ignored; repeated rows stay; an empty table gives no rows.
    """
    rows = pick(df, "doc_id", "text").select("doc_id", _udf(words)("text").alias("fp"))
    marked = stored(rows, "prints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = _components(distinct, linked(distinct.select("fp"), distance, bucket_rows))
    # hex shows a bigint as its unsigned 64 bits.
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(roots, "fp").select(
        "doc_id", text.alias("fingerprint"), F.col("least").alias("component_id")
    )


def one_of_each(df: DataFrame, words: int = 3, distance: int = 3, bucket_rows: int = 200_000) -> DataFrame:
    """The rows of ``df`` with one left of each component: that with the smallest doc_id.

    Null ids come last; of repeated rows any one stays. Columns and values are unchanged.
    """
    rows, col = nested(df)
    marked = stored(
        rows.select(
            "row", col("doc_id").alias("id"), _udf(words)(col("text")).alias("fp"),
            F.monotonically_increasing_id().alias("t"),
        ),
        "marked",
    )
    distinct = marked.groupBy("fp").agg(F.min("id").alias("least"))
    roots = _components(distinct, linked(distinct.select("fp"), distance, bucket_rows))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("first")
    kept = marked.select("fp", "id", "t").join(roots.select("fp", "root"), "fp").groupBy("root").agg(first)
    left = marked.join(kept.select(F.col("first.t").alias("t")), "t", "left_semi")
    return unnested(left, df.columns)


def _udf(words: int):
    @F.pandas_udf("bigint")
    def signed(texts: pd.Series) -> pd.Series:
        prints = np.array([fingerprint(text, words) for text in texts], "u8")
        return pd.Series(prints.view("i8"))

    return signed


def linked(prints: DataFrame, distance: int = 3, bucket_rows: int = 200_000) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints ``fp`` as all pairs within ``distance`` do.

    Of distance + 1 disjoint groups of bits two linked fingerprints agree on one. So the
    fingerprints are dealt to the sub-tries that share one group; in each the trie is joined
    with itself. A sub-trie of over ``bucket_rows`` is cut further by the same argument on its
    other bits, until none is large. Per sub-trie a spanning forest leaves the task, not all pairs.
    """
    masks = _split(_ALL, distance + 1)
    buckets = _dealt(prints, F.array(*[F.lit(_signed(m)) for m in masks]))
    whole = []
    while True:
        sizes = buckets.groupBy("mask", "val").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows)
        # One row for each bucket of over bucket_rows rows: bounded by rows / bucket_rows.
        large = stored(sizes.select("mask", "val"), "large-buckets")
        splits = {m: _split(_ALL & ~m, distance + 1) for m in masks if bin(m).count("1") < _BITS}
        if not splits or large.isEmpty():
            whole.append(buckets)
            break
        whole.append(buckets.join(F.broadcast(large), ["mask", "val"], "left_anti"))
        finer = F.create_map(
            *[
                part
                for m, rest in splits.items()
                for part in (F.lit(_signed(m)), F.array(*[F.lit(_signed(m | r)) for r in rest]))
            ]
        )
        rest = buckets.join(F.broadcast(large), ["mask", "val"], "left_semi")
        buckets = stored(_dealt(rest, finer[F.col("mask")]), "buckets")
        masks = sorted({m | r for m, rest in splits.items() for r in rest})
    rows = whole[0]
    for more in whole[1:]:
        rows = rows.unionByName(more)
    dealt = rows.repartition("mask", "val").sortWithinPartitions("mask", "val")

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mask, val, fp in _whole_buckets(batches):
            a, b = _forest(mask, val, fp, distance)
            yield pa.RecordBatch.from_arrays([pa.array(a.view("i8")), pa.array(b.view("i8"))], names=["a", "b"])

    return dealt.select("mask", "val", "fp").mapInArrow(traverse, "a bigint, b bigint")


def _dealt(rows: DataFrame, masks: Column) -> DataFrame:
    dealt = rows.select("fp", F.explode(masks).alias("mask"))
    return dealt.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("val"), "fp")


def _split(bits: int, parts: int) -> list[int]:
    """The set bits of ``bits`` in up to ``parts`` groups of nearly equal size, high bits first."""
    places = [p for p in reversed(range(_BITS)) if bits >> p & 1]
    if len(places) < parts:
        return [bits]
    cuts = [len(places) * i // parts for i in range(parts + 1)]
    return [sum(1 << p for p in places[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _whole_buckets(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[list[np.ndarray]]:
    """Sorted rows in pieces of about ``rows`` that end where a bucket ends."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [column.to_numpy(zero_copy_only=False) for column in batch.columns]
        held = new if held is None else [np.concatenate(pair) for pair in zip(held, new, strict=True)]
        if len(held[0]) < rows:
            continue
        last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
        if len(last):
            cut = last[-1] + 1
            yield [column[:cut] for column in held]
            held = [column[cut:].copy() for column in held]
    if held is not None and len(held[0]):
        yield held


def _forest(mask: np.ndarray, val: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the pairs within ``distance`` in each bucket."""
    change = np.concatenate(([True], (mask[1:] != mask[:-1]) | (val[1:] != val[:-1])))
    bucket = np.cumsum(change)
    prints = np.ascontiguousarray(fp).view("u8")
    order = np.lexsort((prints, bucket))
    prints, starts = prints[order], np.flatnonzero(change)
    ends = np.concatenate((starts[1:], [len(prints)]))
    large = ends - starts > 1
    parent = np.arange(len(prints))
    # A node is a range of the sorted prints; a frontier holds pairs of nodes and their differing bits.
    roots = (starts[large], ends[large], starts[large], ends[large], np.zeros(large.sum(), "i8"))
    stack = [(_BITS - 1, roots)]
    zeros: dict[int, np.ndarray] = {}
    while stack:
        bit, (a0, a2, b0, b2, err) = stack.pop()
        if bit not in zeros:
            is_zero = (prints >> np.uint64(bit) & np.uint64(1)) == 0
            zeros[bit] = np.concatenate(([0], np.cumsum(is_zero)))
        below = zeros[bit]
        a1, b1 = a0 + below[a2] - below[a0], b0 + below[b2] - below[b0]
        # The children of a node paired with itself are taken once.
        twice = (a0 != b0) | (a2 != b2)
        parts = (
            (a0, a1, b0, b1, err),
            (a1, a2, b1, b2, err),
            (a0, a1, b1, b2, err + 1),
            tuple(x[twice] for x in (a1, a2, b0, b1, err + 1)),
        )
        pairs = [np.concatenate(x) for x in zip(*parts, strict=True)]
        lone = (pairs[0] == pairs[2]) & (pairs[1] - pairs[0] == 1) & (pairs[3] - pairs[2] == 1)
        live = (pairs[0] < pairs[1]) & (pairs[2] < pairs[3]) & (pairs[4] <= distance) & ~lone
        pairs = [x[live] for x in pairs]
        single = (pairs[1] - pairs[0] == 1) & (pairs[3] - pairs[2] == 1)
        i, j = pairs[0][single], pairs[2][single]
        near = np.bitwise_count(prints[i] ^ prints[j]) <= distance
        _unite(parent, i[near], j[near])
        pairs = [x[~single] for x in pairs]
        # Distinct prints differ in some bit, so no pair of larger nodes outlives the last one.
        for at in range(0, len(pairs[0]), _FRONTIER):
            stack.append((bit - 1, tuple(x[at : at + _FRONTIER] for x in pairs)))
    root = _root(parent, np.arange(len(prints)))
    moved = root != np.arange(len(prints))
    return prints[moved], prints[root[moved]]


def _root(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    while True:
        up = parent[at]
        if (up == at).all():
            return at
        at = parent[up]


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    while len(i):
        i, j = _root(parent, i), _root(parent, j)
        apart = i != j
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))


def _components(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """fp, root (the same in a component) and least (smallest id in it) of every fingerprint.

    Edges are contracted: each end moves to the neighbour that a hash of the round ranks
    first, which leaves a constant fraction of the vertices on average.
    """
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    ends = edges.select(F.col("a").alias("fp")).union(edges.select("b")).distinct()
    places = stored(ends.select("fp", F.col("fp").alias("at")), "places")
    step = 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        rank = lambda name: F.struct(F.xxhash64(name, F.lit(step)).alias("order"), F.col(name).alias("vertex"))
        best = both.groupBy("u").agg(F.min(rank("v")).alias("best"))
        moves = best.select("u", F.least(rank("u"), F.col("best"))["vertex"].alias("to"))
        moves = stored(moves, "moves")
        left = edges.join(moves.toDF("a", "a2"), "a").join(moves.toDF("b", "b2"), "b").where("a2 != b2")
        edges = stored(
            left.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges"
        )
        moved = places.join(moves.toDF("at", "to"), "at", "left")
        places = stored(moved.select("fp", F.coalesce("to", "at").alias("at")), "places")
        step += 1
    rooted = distinct.join(places, "fp", "left").select("fp", "least", F.coalesce("at", "fp").alias("root"))
    rooted = stored(rooted, "roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("least"))
    return rooted.select("fp", "root").join(least, "root")
