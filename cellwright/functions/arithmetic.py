"""Arithmetic of evidence: half units, changes and ratios that give null where they are not defined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLACK = 1e-9


def half_unit(scale: Column, decimals: Column) -> Column:
    """Half of the last printed digit, in base units."""
    return F.pow(F.lit(10.0), (scale - decimals).cast("double")) / 2


def matches(printed: Column, value: Column, tolerance: Column) -> Column:
    return F.abs(printed.cast("double") - value.cast("double")) <= tolerance + SLACK


def growth(current: Column, previous: Column) -> Column:
    """Percent change on the absolute previous value."""
    return F.try_divide((current - previous).cast("double") * 100, F.abs(previous).cast("double"))


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double") * 100, whole.cast("double"))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def printed(x: Column, places: int) -> Column:
    """A number with so many decimals, by its exact binary value, exact halves to the even digit, as ``f"{x:.3f}"`` has it.

    Spark's own formats go by the shortest digits that name a double, which are its exact value in few cases. Here a double is
    parted in two of 26 bits each, whose products with a small power of ten are exact, and held against the half between
    the two neighbours. For numbers under 2^53 in the last printed place.
    """
    x = x.cast("double")
    n = F.floor(x * 10**places)
    wide = x * 134217729.0  # 2^27 + 1
    high = wide - (wide - x)
    beyond = (high * (2.0 * 10**places) - (2 * n + 1)) + (x - high) * (2.0 * 10**places)
    up = (beyond > 0) | ((beyond == 0) & (n % 2 != 0))
    return ((n + up.cast("long")).cast("decimal(20,0)") / F.lit(10**places).cast("decimal(20,0)")).cast(f"decimal(38,{places})").cast("string")
