"""Names of arms and runs, and stable decisions by hashed ids."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Arm names and dataset modes that occur in run names.
ARMS = ("aws", "gcp")
MODES = ("sample", "large", "full")

_PARTS = ("type", "arm", "mode", "run", "time")


def normalise_arm(name: Column, arms: Sequence[str] = ARMS) -> Column:
    """Lower-case arm name; a name outside ``arms`` fails the query."""
    lowered = F.lower(name)
    problem = F.concat(F.lit("unknown arm: "), F.coalesce(name, F.lit("null")))
    return F.when(lowered.isin(*arms), lowered).otherwise(F.raise_error(problem))


def run_name(
    kind: Column, run: Column, stamp: Column, arm: Column | None = None, mode: Column | None = None
) -> Column:
    """``kind[_arm][_mode]_runNN_stamp``; null arms and modes are left out."""
    number = F.when(run < 10, F.lpad(run.cast("string"), 2, "0")).otherwise(run.cast("string"))
    pieces = [kind]
    if arm is not None:
        pieces.append(arm)
    if mode is not None:
        pieces.append(mode)
    return F.concat_ws("_", *pieces, F.concat(F.lit("run"), number), stamp)


def parse_run_name(
    name: Column,
    record_arm: Column | None = None,
    arms: Sequence[str] = ARMS,
    modes: Sequence[str] = MODES,
) -> Column:
    """Struct (type, arm, mode, run, time) read from a run name or a file path.

    An arm that the name lacks comes from ``record_arm``; parts that stay unknown
    are null.
    """
    known_arms, known_modes = ("|".join(map(re.escape, names)) for names in (arms, modes))
    pattern = (
        rf"^(?:.*/)?([a-z]+?)_(?:({known_arms})_)?(?:({known_modes})_)?"
        r"run(\d+)_(\d{8}_\d{6})(?:\.json)?$"
    )
    # One match yields all parts. A match drops the word run, so it always alters the name.
    found = F.regexp_replace(name, pattern, "$1/$2/$3/$4/$5")
    parts = F.when(found != name, F.split(found, "/"))
    values = {part: F.nullif(F.get(parts, F.lit(i)), F.lit("")) for i, part in enumerate(_PARTS)}
    if record_arm is not None:
        values["arm"] = F.coalesce(values["arm"], record_arm)
    values["run"] = values["run"].cast("int")
    return F.struct(*[column.alias(part) for part, column in values.items()])


def hash_below(key: Column, fraction: float, seed: int, instead: Column | None = None) -> Column:
    """True for about ``fraction`` of all keys, decided by key and seed alone.

    Where the key is null the text ``instead`` decides; without it a null key fails the
    query, as one decision for all such rows would keep or lose them together. Hex digits
    of equal length compare like the numbers they stand for.
    """
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("fraction must lie between 0 and 1")
    limit = math.ceil(fraction * 2**32)
    if limit == 2**32:
        return F.lit(True)
    missing = F.raise_error(F.lit("a null key decides no sample")).cast("string") if instead is None else instead
    digest = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), missing), F.lit(str(seed))))
    return F.substring(digest, 1, 8) < f"{limit:08x}"
