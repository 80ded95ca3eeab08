"""Row-level measures: throughput, time units, differences and winners."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from armspan.functions.rounding import fixed_text, round_exact

BYTES_PER_MB = 1024.0 * 1024.0
SECONDS_PER_HOUR = 3600.0
HOURS_PER_MONTH = 730.0


def megabytes(size_bytes: Column) -> Column:
    return size_bytes / F.lit(BYTES_PER_MB)


def throughput(size_mb: Column, seconds: Column) -> Column:
    """MB per second, 0 where no time has passed."""
    return F.when(seconds > 0, size_mb / seconds).otherwise(F.lit(0.0))


def transfer_record(size_mb: Column, seconds: Column) -> list[Column]:
    """Size, duration and rate with the decimals that transfer records carry."""
    return [
        round_exact(size_mb, 2).alias("file_size_mb"),
        round_exact(seconds, 3).alias("duration_seconds"),
        round_exact(throughput(size_mb, seconds), 2).alias("throughput_mbps"),
    ]


def hours(seconds: Column) -> Column:
    return seconds / F.lit(SECONDS_PER_HOUR)


def minutes(seconds: Column) -> Column:
    return seconds / F.lit(60.0)


def months(duration_hours: Column) -> Column:
    return duration_hours / F.lit(HOURS_PER_MONTH)


def duration_unit(seconds: Column) -> Column:
    return F.when(seconds < 60, "seconds").when(seconds < 3600, "minutes").otherwise("hours")


def duration_value(seconds: Column) -> Column:
    """The duration expressed in ``duration_unit``."""
    return (
        F.when(seconds < 60, seconds).when(seconds < 3600, minutes(seconds)).otherwise(hours(seconds))
    )


def duration_text(seconds: Column) -> Column:
    return F.concat_ws(" ", fixed_text(duration_value(seconds), 2), duration_unit(seconds))


def pct_difference(base: Column, candidate: Column, guard: bool = True) -> Column:
    """Percent by which ``candidate`` lies above ``base``.

    Guarded, a zero base gives 0 against zero and 100 against anything else;
    unguarded it gives null.
    """
    relative = F.try_divide(candidate - base, base) * 100.0
    if not guard:
        return relative
    return F.when((base == 0) & (candidate == 0), 0.0).when(base == 0, 100.0).otherwise(relative)


def winner(difference_pct: Column, base_name: str, candidate_name: str) -> Column:
    """The arm with the lower value: time and cost are better when lower."""
    return (
        F.when(difference_pct > 0, base_name)
        .when(difference_pct < 0, candidate_name)
        .when(difference_pct.isNotNull(), "Tie")
    )
