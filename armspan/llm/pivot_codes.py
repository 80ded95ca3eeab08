"""Vector codes from per-part codebooks, learned exactly with LAESA pivots."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armspan.llm.common import pick, stored
from armspan.llm.whole_vectors import floor_means, matrix, squared, totals, totals_batch, whole

# Room for rounding in differences of distances, as a share of the largest distance.
_ROOM = 1e-9
# Rows whose bounds are held at once.
_ROWS = 2048
# Entries that a row compares one by one, lowest bound first, before all that are left at once.
_WAVES = 6
_TABLE = "vec_id bigint, label string, v array<bigint>, pivoted array<double>"
_FOUND = "vec_id bigint, label string, code string, error bigint"


def pivots_of(entries: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` different entries, each the farthest from those before; the first entry first."""
    chosen = [0]
    every = np.arange(len(entries))
    least = squared(entries, entries, every, np.zeros(len(entries), int))
    while len(chosen) < n and least.max() > 0:
        chosen.append(int(np.argmax(least)))
        least = np.minimum(least, squared(entries, entries, every, np.full(len(entries), chosen[-1])))
    return entries[chosen]


def to_pivots(parts: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of every part to every pivot."""
    every = np.arange(len(parts))
    columns = [squared(parts, pivots, every, np.full(len(parts), i)) for i in range(len(pivots))]
    return np.sqrt(np.stack(columns, axis=1).astype("f8"))


def nearest(
    parts: np.ndarray, pivoted: np.ndarray, entries: np.ndarray, entry_pivoted: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry of each part (ties: the lowest), its squared distance, and pairs evaluated.

    A pivot's distances to a part and to an entry differ by no more than these two are apart. Entries
    are evaluated in the order of the largest such difference, until it exceeds the best distance.
    """
    codes, errors, evaluated = np.empty(len(parts), "i4"), np.empty(len(parts), "i8"), 0
    for at in range(0, len(parts), _ROWS):
        rows, own = parts[at : at + _ROWS], pivoted[at : at + _ROWS]
        low = np.zeros((len(rows), len(entries)))
        for i in range(own.shape[1]):
            np.maximum(low, np.abs(own[:, i, None] - entry_pivoted[None, :, i]), out=low)
        room = _ROOM * (1 + own.max() + entry_pivoted.max())
        best, index = np.full(len(rows), np.iinfo("i8").max), np.zeros(len(rows), "i8")
        live = np.arange(len(rows))
        for _ in range(min(_WAVES, len(entries))):
            place = np.argmin(low[live], axis=1)
            open_ = low[live, place] <= np.sqrt(best[live]) + room
            live, place = live[open_], place[open_]
            if not len(live):
                break
            found = squared(rows, entries, live, place)
            low[live, place] = np.inf
            evaluated += len(live)
            _keep(best, index, live, place, found)
        i, j = np.nonzero(low[live] <= np.sqrt(best[live])[:, None] + room)
        i = live[i]
        found = squared(rows, entries, i, j)
        evaluated += len(i)
        # The last of several writes to a row stays: worst first, and of equal ones the highest index first.
        order = np.lexsort((-j, -found))
        _keep(best, index, i[order], j[order], found[order])
        codes[at : at + _ROWS], errors[at : at + _ROWS] = index, best
    return codes, errors, evaluated


def _keep(best: np.ndarray, index: np.ndarray, rows: np.ndarray, places: np.ndarray, found: np.ndarray) -> None:
    better = (found < best[rows]) | ((found == best[rows]) & (places < index[rows]))
    best[rows[better]], index[rows[better]] = found[better], places[better]


def compress(
    df: DataFrame, entries: int = 256, rounds: int = 4, parts: int = 4, scale: float = 1024.0, pivots: int = 16
) -> DataFrame:
    """One row per vector: vec_id, label, code, error, label_error and codebooks_sha256.

    ``df`` has vec_id, embedding and label. Vectors that are null or hold null or non-finite components
    are left out; each component x becomes floor(scale * x), and vectors are cut into ``parts`` equal
    consecutive parts. The codebook of a part starts as that part of the ``entries`` smallest vec_ids,
    ascending. Each round assigns every part to the nearest entry (squared distance; ties to the lower
    index) and moves every entry that has parts to their mean, rounded down; a last assignment follows.
    ``code`` holds the indexes, two hex digits each (more if there are over 256 entries); ``error`` is the
    sum of the squared distances of the parts; ``label_error`` the sum of errors of all rows with that
    label, nulls together; codebooks_sha256 that of all final components by part, entry and place.

    Distances of all parts to ``pivots`` fixed entries of the first codebooks are computed once and stored
    beside the vectors. In a round only the distances between pivots and entries are new: they bound from
    below how far a part is from an entry, so entries are evaluated in the order of their bounds, in whole
    numbers, and those beyond the best are not. Tasks add up their parts before a shuffle, and only
    codebooks come to the driver.

    Shorter vectors count as filled up with zeros to the longest, and all to a multiple of ``parts``.
    Null ids come last among the first entries, and rows of one id are ordered by their components. With
    fewer vectors the codebooks are shorter; without any there are no rows. Labels are compared as text.
    Extra columns are ignored. Components of 2**26 or more after scaling fail.
    """
    spark = df.sparkSession
    kept = pick(df, "vec_id", "embedding", "label")
    kept = kept.select("vec_id", F.col("label").cast("string").alias("label"), whole(F.col("embedding"), scale).alias("v"))
    kept = kept.where("v is not null")
    width = kept.agg(F.max(F.size("v"))).first()[0]
    about = "label_error bigint, codebooks_sha256 string"
    if width is None:
        return spark.createDataFrame([], f"{_FOUND}, {about}")
    width = max(1, -(-width // parts)) * parts
    filled = F.concat("v", F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("v")))
    kept = kept.withColumn("v", filled)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.array([row["v"] for row in first], "i8").reshape(len(first), parts, -1).swapaxes(0, 1)
    fixed = [pivots_of(book, pivots) for book in books]
    rows = stored(kept.mapInArrow(_pivoted(fixed, width), _TABLE), "pivoted-vectors")
    for _ in range(rounds):
        partial = rows.select("v", "pivoted").mapInArrow(_summed(fixed, books), "group_no int, sums array<bigint>")
        books = floor_means(partial, books.reshape(-1, width // parts)).reshape(books.shape)
    found = stored(rows.mapInArrow(_coded(fixed, books), _FOUND), "vector-codes")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    # Stored, so that its size is known: small totals reach all tasks, others are joined with large labels split.
    sums = stored(found.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    sums = sums.withColumnRenamed("label", "_label")
    joined = found.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


_Each = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _cut(vectors: np.ndarray, fixed: list[np.ndarray]) -> list[np.ndarray]:
    return [np.ascontiguousarray(part) for part in np.split(vectors, len(fixed), axis=1)]


def _pivoted(fixed: list[np.ndarray], width: int) -> _Each:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = _cut(matrix(batch.column("v"), width), fixed)
            found = np.hstack([to_pivots(part, own) for part, own in zip(cut, fixed, strict=True)])
            offsets = pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))
            columns = [*(batch.column(name) for name in ("vec_id", "label", "v")), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "v", "pivoted"])

    return each


class _Books:
    """Codebooks with the distances between their entries and the fixed pivots."""

    def __init__(self, fixed: list[np.ndarray], books: np.ndarray):
        self.books, self._fixed = books, fixed
        self._pivoted = [to_pivots(book, own) for book, own in zip(books, fixed, strict=True)]
        self._ends = np.cumsum([len(own) for own in fixed])

    def nearest(self, batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Parts, codes and errors of each part position."""
        vectors = matrix(batch.column("v"), self.books.shape[0] * self.books.shape[2])
        known = np.split(matrix(batch.column("pivoted"), self._ends[-1]), self._ends[:-1], axis=1)
        found = []
        for part, own, book, distances in zip(_cut(vectors, self._fixed), known, self.books, self._pivoted, strict=True):
            found.append((part, *nearest(part, own, book, distances)[:2]))
        return found


def _summed(fixed: list[np.ndarray], books: np.ndarray) -> _Each:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Books(fixed, books)
        sums = np.zeros((*books.shape[:2], 1 + books.shape[2]), "i8")
        for batch in batches:
            for position, (part, codes, _) in enumerate(known.nearest(batch)):
                sums[position] += totals(codes, part, books.shape[1])
        for position in range(len(books)):
            yield totals_batch(sums[position], position * books.shape[1])

    return each


def _coded(fixed: list[np.ndarray], books: np.ndarray) -> _Each:
    digits = max(2, len(f"{books.shape[1] - 1:x}"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Books(fixed, books)
        hexes = np.array([f"{i:0{digits}x}" for i in range(books.shape[1])])
        for batch in batches:
            found = known.nearest(batch)
            codes = ["".join(row) for row in np.stack([hexes[codes] for _, codes, _ in found], axis=1).tolist()]
            errors = sum(errors for _, _, errors in found)
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(errors)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    return each
