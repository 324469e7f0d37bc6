"""Arithmetic on rainfall amounts."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(value: Column) -> Column:
    """Spark orders NaN above every number, so a missing reading must be NULL."""
    return F.when(~F.isnan(value), value)


def clip_negative(value: Column) -> Column:
    """Negative -> 0, NULL stays NULL (``greatest`` would turn NULL into 0)."""
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def round_even(value: Column, digits: int) -> Column:
    """Scale, round half to even, unscale."""
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def round_exact(value: Column) -> Column:
    """One decimal place, decided on the exact binary value.

    ``value * 10`` rounds, which can push 0.35 (stored just below) onto the tie 3.5.
    8x and 2x are exact, so the rounding error of their sum says which side of an
    apparent tie the true product lies.
    """
    eight, two = value * 8, value * 2
    scaled = eight + two
    carried = scaled - eight
    error = (eight - (scaled - carried)) + (two - carried)
    on_tie = (scaled - F.floor(scaled)) == 0.5
    return (
        F.when(on_tie & (error > 0), F.ceil(scaled).cast("double"))
        .when(on_tie & (error < 0), F.floor(scaled).cast("double"))
        .otherwise(F.rint(scaled))
        / 10
    )


def format_fixed(value: Column, digits: int, plus: bool = False, suffix: str = "") -> Column:
    """Fixed-point text with 0 or 1 decimals, e.g. ``+12.5%``."""
    if digits not in (0, 1):
        raise ValueError("only 0 or 1 decimal places")
    rounded = F.rint(value) if digits == 0 else round_exact(value)
    pattern = f"%{'+' if plus else ''}.{digits}f{suffix.replace('%', '%%')}"
    return F.when(value.isNotNull(), F.format_string(pattern, rounded))


def departure_pct(total: Column, lpa: Column) -> Column:
    """Percent above or below the long period average; 0 where that is not positive."""
    return F.when(lpa > 0, (total - lpa) / lpa * 100).otherwise(F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole)
