"""Exact centroid clustering of whole-number vectors, filtered by n-simplex projection."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armspan.llm.common import pick, stored
from armspan.llm.whole_vectors import floor_means, matrix, squared, totals, totals_batch, whole

# Room for rounding in bounds that are computed in floating point, as a share of the squared lengths.
_ROOM = 1e-7
# A pivot is used if it stands out of the others' simplex by this share of the largest distance.
_STANDS_OUT = 0.02
# Rows whose bounds are held at once.
_ROWS = 4096
_FOUND = "vec_id bigint, cluster int, distance bigint"


class Simplex:
    """The simplex that some pivots span, and the apex that distances to them give a vector.

    Distances to n pivots place a vector in n dimensions: n - 1 coordinates in the space of the pivots
    and its altitude above it. The distance of two apexes is a lower bound of the vectors' distance;
    with one altitude turned to the other side it is an upper bound.
    """

    def __init__(self, candidates: np.ndarray, n: int):
        """Takes up to ``n`` of the candidates, each the farthest from the simplex so far."""
        chosen = [0]
        self._base = np.zeros((1, 0))
        self.pivots = candidates[:1]
        while len(chosen) < min(n, len(candidates)):
            apexes = self.apexes(_distances(candidates, self.pivots))
            altitudes = apexes[:, -1]
            best = int(np.argmax(altitudes))
            if len(chosen) == 1:
                largest = altitudes[best]
            if altitudes[best] <= _STANDS_OUT * largest:
                break
            chosen.append(best)
            # The pivot's apex is a vertex of the next simplex; earlier ones lie at altitude zero.
            self._base = np.vstack([np.pad(self._base, ((0, 0), (0, 1))), apexes[best]])
            self.pivots = candidates[chosen]

    def apexes(self, distances: np.ndarray) -> np.ndarray:
        """Coordinates from squared distances to the pivots, the altitude last."""
        out = np.zeros((len(distances), len(self.pivots)))
        own = distances[:, 0].astype("f8")
        for i in range(1, len(self.pivots)):
            vertex = self._base[i]
            twice = own + vertex @ vertex - distances[:, i] - 2 * out[:, : i - 1] @ vertex[: i - 1]
            out[:, i - 1] = twice / (2 * vertex[i - 1])
        rest = own - np.einsum("ij,ij->i", out[:, :-1], out[:, :-1])
        out[:, -1] = np.sqrt(np.maximum(rest, 0))
        return out

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return self.apexes(_distances(vectors, self.pivots))


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    every = np.arange(len(vectors))
    columns = [squared(vectors, pivots, every, np.full(len(vectors), i)) for i in range(len(pivots))]
    return np.stack(columns, axis=1) if columns else np.zeros((len(vectors), 0), "i8")


def nearest(
    vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, tops: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid of each vector (ties: the smallest), its squared distance, and pairs compared.

    ``apexes`` and ``tops`` are the apexes of vectors and centroids. A centroid whose lower bound exceeds
    the least upper bound, or the distance to the centroid of the least lower bound, is not compared.
    """
    clusters, distances = np.empty(len(vectors), "i4"), np.empty(len(vectors), "i8")
    compared = 0
    for at in range(0, len(vectors), _ROWS):
        rows, own = vectors[at : at + _ROWS], apexes[at : at + _ROWS]
        base = np.zeros((len(rows), len(centroids)))
        for i in range(own.shape[1] - 1):
            base += np.square(own[:, i, None] - tops[None, :, i])
        low = base + np.square(own[:, -1, None] - tops[None, :, -1])
        high = base + np.square(own[:, -1, None] + tops[None, :, -1])
        room = _ROOM * (1 + np.square(own).sum(axis=1) + np.square(tops).sum(axis=1).max())
        every, first = np.arange(len(rows)), np.argmin(low, axis=1)
        exact = np.full(low.shape, np.iinfo("i8").max)
        exact[every, first] = squared(rows, centroids, every, first)
        limit = np.minimum(high.min(axis=1), exact[every, first]) + room
        left = low - room[:, None] <= limit[:, None]
        left[every, first] = False
        i, j = np.nonzero(left)
        exact[i, j] = squared(rows, centroids, i, j)
        compared += len(rows) + len(i)
        clusters[at : at + _ROWS] = exact.argmin(axis=1)
        distances[at : at + _ROWS] = exact.min(axis=1)
    return clusters, distances, compared


def cluster(
    df: DataFrame, centroids: int = 40, rounds: int = 5, dims: int = 64, scale: float = 256.0,
    label: str = "2:", pivots: int = 40,
) -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256.

    ``df`` has vec_id and embedding. Kept are vectors of exactly ``dims`` components, none null or
    non-finite; each component x becomes floor(scale * x). The first centroids are the kept vectors with
    the smallest sha256 of ``label`` and the vec_id, numbered in that order. Each round assigns every
    vector to its nearest centroid (squared distance; ties to the smaller number) and moves every
    centroid that has vectors to their mean, rounded down; a last assignment follows. Distances are
    squared, inertia is their sum over a cluster or all; centroid_sha256 is that of the final centroid's
    comma-joined components.

    Squared distances of every vector to ``pivots`` of the first centroids are computed once and stored
    as apex coordinates; in every round they bound the distances to the centroids' apexes, and only the
    centroids that the bounds leave are compared, in whole numbers. Tasks add up their vectors before a
    shuffle, and only centroids come to the driver.

    Vectors without an id take part but start no cluster. Rows of one id are ordered by their components,
    and each may start a cluster. With fewer kept vectors there are fewer clusters; without any, or if none
    has an id, there are no rows. Extra columns are ignored. Components of 2**26 or more after scaling fail.
    """
    spark = df.sparkSession
    kept = pick(df, "vec_id", "embedding").where(F.size("embedding") == dims)
    kept = kept.select("vec_id", whole(F.col("embedding"), scale).alias("v")).where("v is not null")
    order = F.sha2(F.concat(F.lit(label), F.col("vec_id").cast("string")), 256)
    starts = kept.where("vec_id is not null").orderBy(order, "v").limit(centroids).collect()
    if not starts:
        return spark.createDataFrame([], f"{_FOUND}, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    places = np.array([row["v"] for row in starts], "i8")
    simplex = Simplex(places, pivots)
    rows = stored(kept.mapInArrow(_projected(simplex, dims), "vec_id bigint, v array<bigint>, apex array<double>"), "apexes")
    for _ in range(rounds):
        partial = rows.select("v", "apex").mapInArrow(_summed(simplex, places), "group_no int, sums array<bigint>")
        places = floor_means(partial, places)
    found = stored(rows.mapInArrow(_assigned(simplex, places), _FOUND), "clusters")
    # One row a centroid.
    inertia = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    about = [
        (number, total, sum(inertia.values()), hashlib.sha256(",".join(map(str, places[number].tolist())).encode()).hexdigest())
        for number, total in inertia.items()
    ]
    facts = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return found.join(F.broadcast(facts), "cluster").select(*columns)


_Each = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _projected(simplex: Simplex, dims: int) -> _Each:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apexes = simplex.project(matrix(batch.column("v"), dims))
            offsets = pa.array(np.arange(len(apexes) + 1) * apexes.shape[1], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(apexes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["vec_id", "v", "apex"])

    return each


def _found(batch: pa.RecordBatch, places: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vectors = matrix(batch.column("v"), places.shape[1])
    clusters, distances, _ = nearest(vectors, matrix(batch.column("apex"), tops.shape[1]), places, tops)
    return vectors, clusters, distances


def _summed(simplex: Simplex, places: np.ndarray) -> _Each:
    tops = simplex.project(places)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((places.shape[0], 1 + places.shape[1]), "i8")
        for batch in batches:
            vectors, clusters, _ = _found(batch, places, tops)
            sums += totals(clusters, vectors, len(places))
        yield totals_batch(sums)

    return each


def _assigned(simplex: Simplex, places: np.ndarray) -> _Each:
    tops = simplex.project(places)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, clusters, distances = _found(batch, places, tops)
            columns = [batch.column("vec_id"), pa.array(clusters), pa.array(distances)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return each
