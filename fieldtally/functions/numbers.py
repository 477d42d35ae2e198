"""Numeric expressions and null-strict aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict(aggregate: Column, value: Column) -> Column:
    """The aggregate, or null as soon as one input value is null."""
    return F.when(~F.bool_or(value.isNull()), aggregate)


def strict_avg(value: Column) -> Column:
    return strict(F.avg(value), value)


def strict_sum(value: Column) -> Column:
    return strict(F.sum(value), value)


def half_even(value: Column, digits: int) -> Column:
    """The nearest multiple of a power of ten to the double as it is stored, a tie going
    to the even one. F.bround rounds the shortest decimal text instead, which calls
    1/40 a tie. Whether the scaled value is a tie is decided by its rounding error."""
    value = value.cast("double")
    scale = float(10**digits)
    scaled = value * F.lit(scale)
    whole = F.floor(scaled)
    part = scaled - whole
    error = _product_error(value, scale, scaled)
    above = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 != 0))))
    rounded = (whole + above.cast("long")).cast("double") / F.lit(scale)
    # Doubles of this size are whole numbers already.
    return F.when(F.abs(scaled) < 2.0**52, rounded).otherwise(value)


def _product_error(value: Column, factor: float, product: Column) -> Column:
    """What a product of doubles lacks to be exact: the value is split into two halves of
    26 bits, whose products with a factor of as few bits are exact."""
    shifted = value * F.lit(134217729.0)
    high = shifted - (shifted - value)
    low = value - high
    return (high * F.lit(factor) - product) + low * F.lit(factor)


def log_scale(value: Column) -> Column:
    return F.log1p(value.cast("double"))


def unlog_scale(value: Column) -> Column:
    return F.bround(F.expm1(value), 0)


def round_ticks(low: Column, high: Column, intervals: int) -> Column:
    """Multiples of 1, 2, 5 or 10 times a power of ten inside the range, whose step
    is near an ``intervals``-th of it. A range of one value has that value; a null
    one has none.

    The fixed numbers say how much a larger step is preferred: 1.5 for twice and
    ten times the power, 2.75 for five times it."""
    cell = (high - low) / F.lit(float(intervals))
    power = F.pow(F.lit(10.0), F.floor(F.log10(cell)))
    step = (
        F.when(10 * power - cell < 1.5 * (cell - 5 * power), 10 * power)
        .when(5 * power - cell < 2.75 * (cell - 2 * power), 5 * power)
        .when(2 * power - cell < 1.5 * (cell - power), 2 * power)
        .otherwise(power)
    )
    first = F.ceil(low / step - 1e-7).cast("long")
    last = F.floor(high / step + 1e-7).cast("long")
    ticks = F.when(
        last >= first, F.transform(F.sequence(first, last), lambda n: n.cast("double") * step)
    ).otherwise(F.array(low))
    return F.when(high > low, ticks).when(low.isNotNull(), F.array(low))


def any_positive(columns: list[str]) -> Column:
    """At least one of the columns is above zero."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c) > 0, F.lit(False)) for c in columns])


def sexagesimal(degrees: Column, minutes: Column, seconds: Column) -> Column:
    return degrees + minutes / F.lit(60.0) + seconds / F.lit(3600.0)
