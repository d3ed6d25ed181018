"""Column expressions on points with coordinates x0, x1, ... or an array ``coords``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def dist2(a: list[Column], b: list[Column]) -> Column:
    """Squared Euclidean distance, summed in ascending dimension, so that results agree to the last bit."""
    return reduce(lambda s, t: s + t, ((p - q) * (p - q) for p, q in zip(a, b)))


def within(a: list[Column], b: list[Column], eps: float) -> Column:
    """Radius predicate, inclusive, on squares: no root."""
    return dist2(a, b) <= F.lit(eps * eps)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def in_box(x: list[Column], low: list[Column], high: list[Column]) -> Column:
    """Closed box: every coordinate between its bounds."""
    return reduce(lambda s, t: s & t, (v.between(lo, hi) for v, lo, hi in zip(x, low, high)))


def boxes_overlap(low_a: list[Column], high_a: list[Column], low_b: list[Column], high_b: list[Column]) -> Column:
    return reduce(lambda s, t: s & t, ((p <= s) & (r <= q) for p, q, r, s in zip(low_a, high_a, low_b, high_b)))


def widest(low: list[Column], high: list[Column]) -> Column:
    """Index of the widest dimension, of equal ones the lowest."""
    width = F.array(*(h - lo for lo, h in zip(low, high)))
    return (F.array_position(width, F.array_max(width)) - 1).cast("int")


def choose2(n: Column) -> Column:
    """n (n - 1) / 2 as a double."""
    x = n.cast("double")
    return x * (x - 1) / 2


def is_power_of_two(n: Column) -> Column:
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)
