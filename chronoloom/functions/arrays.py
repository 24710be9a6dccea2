"""Column expressions on arrays and scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def projection(angles: Column) -> Column:
    """sqrt(sum sin^2) of principal angles."""
    return F.sqrt(F.aggregate(angles, F.lit(0.0), lambda a, x: a + F.pow(F.sin(x), 2)))


def binet_cauchy(angles: Column) -> Column:
    """sqrt(1 - product of cos^2)."""
    return F.sqrt(1 - F.aggregate(angles, F.lit(1.0), lambda a, x: a * F.pow(F.cos(x), 2)))


def procrustes(angles: Column) -> Column:
    """2 sqrt(sum sin^2(x / 2))."""
    return 2 * F.sqrt(F.aggregate(angles, F.lit(0.0), lambda a, x: a + F.pow(F.sin(x / 2), 2)))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def unit(v: Column) -> Column:
    """v of length 1; zeros where its length is 0 or not finite."""
    n = norm(v)
    usable = (n > 0) & ~F.isnan(n) & (n < float("inf"))
    return F.transform(v, lambda x: F.when(usable, x / n).otherwise(0.0))


def misalignment(a: Column, b: Column) -> Column:
    """1 - |<a, b>|."""
    return 1 - F.abs(F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def second_window(width: Column, scale: float) -> Column:
    """max(w + 1, scale w rounded half to even)."""
    return F.greatest(width + 1, F.bround(width * F.lit(scale)).cast("long"))


def clock(hours: Column) -> Column:
    """HH:MM of a number of hours."""
    minutes = F.round(hours * 60).cast("long")
    return F.format_string("%02d:%02d", (minutes / 60).cast("long"), minutes % 60)
