"""Shards of equal bytes by histogram sort: probe, count, refine, exchange once.

Only DataFrame functions run on rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from armspan.llm.common import nested, numbered, stored, unnested

_LEAST = -(2**63)
# Each round splits the interval of an open splitter into 2**_PROBE_BITS cells.
_PROBE_BITS = 8


def shard_by_bytes(df: DataFrame, key: str, size: str, shards: int = 24, tolerance: float = 0.0) -> DataFrame:
    """Adds ``shard`` (0 to shards - 1, ascending in ``key``) and ``slot`` (gapless from 0 in it).

    ``key`` is a whole number, ``size`` the bytes of a row (null: 0). Row r belongs to shard
    floor(shards * bytes before r / all bytes): splitter j is the first key with at least
    j / shards of all bytes below it. Splitters are found without sorting: in each round the
    exact bytes below the probes, 256 for every open splitter, are counted over all
    partitions, and the cell that holds the splitter is probed next. A splitter is done when
    its cell holds one row, or ends within ``tolerance`` of an ideal shard from its target; at
    the default 0 the result depends on the rows alone. A round collects at most
    256 * shards counts. Then the rows are exchanged once, by range.

    Equal keys are split like any other rows: ties go by a row number that is stored with the
    rows, so a key with a third of all rows spreads over a third of the shards. Null keys come
    first. A table whose sizes are all zero goes to shard 0; an empty table gives no rows.
    Input columns named shard or slot are replaced, others are kept. Give the operator the
    columns to be exchanged: rows are stored in the scratch folder before the rounds.
    """
    rows, col = nested(df)
    keyed = rows.select(
        "row",
        F.coalesce(col(key).cast("bigint"), F.lit(_LEAST)).alias("k"),
        F.coalesce(col(size).cast("bigint"), F.lit(0)).alias("s"),
        F.monotonically_increasing_id().alias("t"),
    )
    base = stored(keyed, "shard-input")
    bounds = base.agg(F.min("k").alias("least"), F.max("k").alias("most"), F.sum("s").alias("total")).first()
    splitters = _splitters(base, bounds, shards, tolerance)
    reached = [(F.col("k") > k) | ((F.col("k") == k) & (F.col("t") >= t)) for k, t in splitters]
    shard = reduce(lambda total, test: total + test.cast("int"), reached, F.lit(0))
    order = [F.col("k"), F.col("t")]
    placed = numbered(base.withColumn("shard", shard), order, "shard", "shards", "slot")
    return unnested(placed.withColumn("slot", F.col("slot").cast("bigint")), df.columns, "shard", "slot")


def _splitters(base: DataFrame, bounds: Row, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """For each shard but the first, the least (k, t) that belongs to it."""
    total = bounds["total"] or 0
    if not total:
        return []
    slack = tolerance * total / shards
    span = int(bounds["least"]) ^ int(bounds["most"])
    # All keys share the bits above ``top``: probing starts below them.
    top = -(-max(1, span.bit_length() if span >= 0 else 64) // _PROBE_BITS) * _PROBE_BITS
    start = (int(bounds["least"]) >> top) if top < 64 else 0
    found: dict[int, tuple[int, int]] = {}
    tied: dict[int, tuple[int, int]] = {}
    # Open splitters: the cell that holds them, and the bytes below that cell.
    opened = {j: (start, 0) for j in range(1, shards)}
    while opened and top > 0:
        cells = _cells(base, "k", top, {cell for cell, _ in opened.values()} if top < 64 else None)
        top -= _PROBE_BITS
        for j, (cell, below) in list(opened.items()):
            inside = cells if top + _PROBE_BITS >= 64 else [c for c in cells if c["c"] >> _PROBE_BITS == cell]
            hit, before = _crossing(inside, below, j * total, shards)
            end = hit["c"] + 1 << top
            if hit["n"] == 1 or shards * (before + hit["s"]) - j * total <= shards * slack:
                found[j] = _bound(end)
            elif top == 0:
                tied[j] = (hit["c"], before)
            else:
                opened[j] = (hit["c"], before)
                continue
            del opened[j]
    for key in {key for key, _ in tied.values()}:
        mine = {j: (0, before) for j, (k, before) in tied.items() if k == key}
        found |= _tied(base.where(F.col("k") == key), key, mine, total, shards)
    return [found[j] for j in sorted(found)]


def _tied(rows: DataFrame, key: int, opened: dict, total: int, shards: int) -> dict[int, tuple[int, int]]:
    """The same search among the rows of one key, along their stored row numbers."""
    found = {}
    for top in range(64 - _PROBE_BITS, -1, -_PROBE_BITS):
        held = top + _PROBE_BITS
        cells = _cells(rows, "t", held, {cell for cell, _ in opened.values()} if held < 64 else None)
        for j, (cell, below) in list(opened.items()):
            inside = [c for c in cells if held >= 64 or c["c"] >> _PROBE_BITS == cell]
            hit, before = _crossing(inside, below, j * total, shards)
            if hit["n"] == 1:
                found[j] = (key, hit["c"] + 1 << top)
                del opened[j]
            else:
                opened[j] = (hit["c"], before)
        if not opened:
            break
    return found


def _cells(rows: DataFrame, axis: str, top: int, open_cells: set[int] | None) -> list[Row]:
    """Bytes and rows of each probed cell, in order."""
    if open_cells is not None:
        rows = rows.where(F.shiftright(axis, top).isin(sorted(open_cells)))
    cell = F.shiftright(axis, top - _PROBE_BITS).alias("c")
    return sorted(rows.groupBy(cell).agg(F.sum("s").alias("s"), F.count("*").alias("n")).collect())


def _crossing(cells: list[Row], below: int, wanted: int, shards: int) -> tuple[Row, int]:
    """The first cell at whose end the target is reached, and the bytes below that cell."""
    for cell in cells:
        if shards * (below + cell["s"]) >= wanted:
            return cell, below
        below += cell["s"]
    raise AssertionError("the counts of a round do not cover the target")


def _bound(key: int) -> tuple[int, int]:
    """A splitter below which all rows with a smaller key stay."""
    return (key, 0) if key < 2**63 else (2**63 - 1, 2**63 - 1)
