"""Sums, means and deviations of doubles that are the same in whatever order values are added.

A sum of doubles rounds at every step, so its last bits follow the layout of the data. Here
each value is split by powers of two into whole numbers whose sums are exact, and the exact
total is rounded once: the result is the double nearest to the true sum under any partitioning.

Values are taken in units of 2**-65; bits below that are rounded away value by value, half to
even. A part has 26 bits, so its sum fits a long for 2**37 (137 billion) values, and a total below 2**61
fits 38 digits; beyond either, under ANSI mode, the job stops with an overflow. So it does on NaN and infinity.
"""

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

UNIT_BITS, PART_BITS, PARTS = 65, 26, 5
UNITS = "decimal(38,0)"


def _parts(value: Column) -> list[Column]:
    """Whole numbers, highest first; each step takes what the ones before left over, without rounding."""
    rest, parts = value, []
    for k in range(PARTS - 1, -1, -1):
        unit = F.lit(2.0 ** (PART_BITS * k - UNIT_BITS))
        part = F.rint(rest / unit)
        parts.append(part.cast("long"))
        rest = rest - part * unit
    return parts


def total_units(value: Column, over: WindowSpec | None = None) -> Column:
    """The exact sum in units, as 38-digit whole number; NULL without a value. An aggregate, or a window if ``over`` is given."""
    total = None
    for part in _parts(value):
        summed = F.sum(part) if over is None else F.sum(part).over(over)
        # Widened step by step: the product of two long decimals would lose precision.
        summed = summed.cast(UNITS)
        total = summed if total is None else (total * F.lit(1 << PART_BITS)).cast(UNITS) + summed
        total = total.cast(UNITS)
    return total


def from_units(units: Column) -> Column:
    """The nearest double of an exact total."""
    return units.cast("double") * F.lit(2.0**-UNIT_BITS)


def exact_sum(value: Column, over: WindowSpec | None = None) -> Column:
    return from_units(total_units(value, over))


def exact_avg(value: Column, over: WindowSpec | None = None) -> Column:
    count = F.count(value) if over is None else F.count(value).over(over)
    return F.try_divide(exact_sum(value, over), count)


def deviation(value: Column, mean: Column, sample: bool = True) -> Column:
    """Standard deviation of ``value`` around its known ``mean``; NULL for a sample of one."""
    distance = value - mean
    freedom = F.count(value) - (1 if sample else 0)
    return F.sqrt(F.try_divide(exact_sum(distance * distance), freedom))
