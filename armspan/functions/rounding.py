"""Decimal rounding of doubles on their exact binary value, and exact sums.

Spark's ``round`` and ``format_string`` round the shortest decimal text half up
(-82.55 gives -82.6), while the recorded reports round the stored binary value
half to even (-82.5). These expressions give the latter.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Splits a 53-bit significand into two halves (2**27 + 1).
_SPLITTER = 134217729.0
# From here on a double has no fractional part left to round.
_NO_FRACTION = 4503599627370496.0
# Up to here every whole number is a double of its own (2**53).
_WHOLE_LIMIT = 9007199254740992.0
# Width of the bins of exact_sum, and the size from which on values are not binned.
_BIN_BITS = 24
_BINNED = 2.0**62
# Width of the part of a whole number that exact_sum adds apart.
_LOW_BITS = 20


def round_exact(value: Column, digits: int) -> Column:
    """``value`` rounded to ``digits`` (0 to 4) decimals, exact ties to even."""
    if not 0 <= digits <= 4:
        raise ValueError("digits must be between 0 and 4")
    scale = float(10**digits)
    x = value.cast("double")
    scaled = x * scale
    # x * scale equals scaled + err exactly: each partial product fits in 53 bits.
    carry = x * _SPLITTER
    high = carry - (carry - x)
    err = (high * scale - scaled) + (x - high) * scale
    # Half a unit away from the even neighbour, err tells whether that was a tie.
    even = F.rint(scaled)
    off = scaled - even
    nearest = F.when((F.abs(off) == 0.5) & (off * err > 0), even + off * 2.0).otherwise(even)
    return F.when(F.abs(x) < _NO_FRACTION / scale, nearest / scale).otherwise(x)


def fixed_text(value: Column, digits: int, signed: bool = False) -> Column:
    """Text with a fixed number of decimals, and a leading + when ``signed``."""
    sign = "+" if signed else ""
    return F.format_string(f"%{sign}.{digits}f", round_exact(value, digits))


def exact_sum(amount: Column, digits: int | None = 2) -> Column:
    """Sum of doubles that does not depend on the order in which partial results meet.

    Values of at most ``digits`` decimals are added as whole units (cents), so a group of such values has
    the sum of its decimals, rounded once. Other values below 2**62 are cut by the place of their bits
    into whole numbers (``_bins``), down to 2**-72; bits below are left out. Whole numbers add without
    rounding, in parts small enough for some 10**11 rows a group (an overflow would raise), and they are
    put together at the end in one order, so the result has the same bits for any partitioning.
    NaN and infinity give what doubles give in any order: infinity, or NaN with NaN or both infinities.
    Finite values from 2**62 (4.6 * 10**18) on are added as doubles: only in groups with such a value the
    last bits depend on the order. Nulls are left out; the sum of nothing is null. With ``digits`` None
    it is the plain sum of doubles.
    """
    if digits is None:
        return F.sum(amount)
    value = amount.cast("double")
    scale = float(10**digits)
    scaled = F.rint(value * scale)
    # False for NaN and infinity: these compare as larger.
    whole = (F.abs(scaled) < _WHOLE_LIMIT) & (scaled / scale == value)
    units = F.when(whole, scaled).cast("bigint")
    high = F.sum(F.shiftright(units, _LOW_BITS)).cast("decimal(20,0)")
    low = F.sum(units.bitwiseAND(2**_LOW_BITS - 1)).cast("decimal(20,0)")
    unit = F.lit(Decimal(1).scaleb(-digits))
    exact = ((high * F.lit(Decimal(2**_LOW_BITS)) + low) * unit).cast("double")
    binned = F.abs(value) < _BINNED
    bins = _put_together([F.sum(F.when(~whole & binned, b)) for b in _bins(value)])
    other = F.sum(F.when(~(whole | binned), value))
    parts = [exact, bins, other]
    present = exact.isNotNull() | bins.isNotNull() | other.isNotNull()
    return F.when(present, reduce(lambda a, b: a + b, [F.coalesce(part, F.lit(0.0)) for part in parts]))


def _bins(value: Column) -> list[Column]:
    """Whole numbers in units of 2**24, 1, 2**-24, 2**-48 and 2**-72 that add up to ``value``.

    Each step takes the whole part off and keeps a rest that a double holds exactly.
    """
    whole = value.cast("bigint")
    bins = [F.shiftright(whole, _BIN_BITS), whole.bitwiseAND(2**_BIN_BITS - 1)]
    rest = value - whole.cast("double")
    for _ in range(3):
        rest = rest * float(2**_BIN_BITS)
        bins.append(rest.cast("bigint"))
        rest = rest % 1.0
    return bins


def _put_together(sums: list[Column]) -> Column:
    """The double that sums of bins come to, within the last bits of the largest of them.

    The two parts of whole numbers meet first, as their signs may differ; then the lowest come first.
    """
    doubles = [total.cast("double") for total in sums]
    below = doubles[-1] * 2.0**-_BIN_BITS
    for total in reversed(doubles[3:-1]):
        below = (below + total) * 2.0**-_BIN_BITS
    below = (below + doubles[2]) * 2.0**-_BIN_BITS
    return (doubles[0] * 2.0**_BIN_BITS + doubles[1]) + below
