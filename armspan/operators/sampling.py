"""Row samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armspan.functions.identity import hash_below


def sample_rows(rows: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Bernoulli sample; which rows it takes depends on how the input is partitioned."""
    return rows.sample(fraction=fraction, seed=seed)


def _decision(rows: DataFrame, key: str, fraction: float, seed: int, instead: Sequence[str] | None) -> Column:
    others = [name for name in rows.columns if name != key] if instead is None else instead
    return hash_below(F.col(key), fraction, seed, F.to_json(F.struct(*others)) if others else F.lit(""))


def sample_by_hash(
    rows: DataFrame, key: str, fraction: float, seed: int = 42, instead: Sequence[str] | None = None
) -> DataFrame:
    """Sample decided by a hash of ``key``: the same rows for every layout and rerun.

    Rows without a key are decided by the columns ``instead``, by default all others (name
    few to read few); those that agree in them, equal rows at least, stay together.
    """
    return rows.filter(_decision(rows, key, fraction, seed, instead))


def split_by_hash(
    rows: DataFrame, key: str, fraction: float, seed: int = 42, instead: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Two complementary parts, the first holding about ``fraction`` of the rows."""
    first = _decision(rows, key, fraction, seed, instead)
    return rows.filter(first), rows.filter(~first)
