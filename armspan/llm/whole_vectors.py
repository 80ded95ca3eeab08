"""Vectors of whole numbers: quantised rows, exact distances in Arrow batches, floor means."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armspan.llm.norm_buckets import quantised

# Pairs of vectors whose difference is held at once.
_PAIRS = 65_536
# Up to this size of a component, squared distances of 512 components fit in 63 bits.
LIMIT = 2**26


def whole(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component; null for a vector that is null or holds null or non-finite ones.

    Fails on a component of ``LIMIT`` or more, whose squares would not fit in a long.
    """
    numbers = quantised(vector, scale)
    fits = F.forall(numbers, lambda x: (x > -LIMIT) & (x < LIMIT))
    problem = F.raise_error(F.lit(f"a component times {scale} is not below {LIMIT}")).cast("array<bigint>")
    return F.when(numbers.isNull() | fits, numbers).otherwise(problem)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow list column whose lists all have ``width`` numbers, as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def squared(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact squared distances of the pairs (a[left], b[right])."""
    out = np.empty(len(left), "i8")
    for at in range(0, len(left), _PAIRS):
        difference = a[left[at : at + _PAIRS]] - b[right[at : at + _PAIRS]]
        out[at : at + _PAIRS] = np.einsum("ij,ij->i", difference, difference)
    return out


def totals(groups: np.ndarray, vectors: np.ndarray, n: int) -> np.ndarray:
    """Per group the number of its vectors, and their componentwise sums."""
    out = np.zeros((n, 1 + vectors.shape[1]), "i8")
    np.add.at(out[:, 0], groups, 1)
    order = np.argsort(groups, kind="stable")
    found, starts = np.unique(groups[order], return_index=True)
    if len(found):
        out[found, 1:] = np.add.reduceat(vectors[order], starts, axis=0)
    return out


def floor_means(partial: DataFrame, before: np.ndarray) -> np.ndarray:
    """Means rounded down of all tasks' ``totals``; a group without vectors stays as it was.

    ``partial`` has group_no and sums (count first), some rows a group; Spark adds them up, and what
    comes to the driver has the size of ``before``.
    """
    cells = partial.select("group_no", F.posexplode("sums").alias("at", "value"))
    added = np.zeros((before.shape[0], 1 + before.shape[1]), "i8")
    for row in cells.groupBy("group_no", "at").agg(F.sum("value").alias("value")).collect():
        added[row["group_no"], row["at"]] = row["value"]
    counts = added[:, :1]
    return np.where(counts > 0, added[:, 1:] // np.maximum(counts, 1), before)


def totals_batch(sums: np.ndarray, first: int = 0) -> pa.RecordBatch:
    """Groups that have vectors as rows group_no, sums; groups are numbered from ``first``."""
    used = np.flatnonzero(sums[:, 0])
    flat = pa.array(sums[used].ravel(), pa.int64())
    offsets = pa.array(np.arange(len(used) + 1) * sums.shape[1], pa.int32())
    rows = [pa.array(used + first, pa.int32()), pa.ListArray.from_arrays(offsets, flat)]
    return pa.RecordBatch.from_arrays(rows, names=["group_no", "sums"])
