"""Vector expressions over ARRAY<DOUBLE> columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(values) -> Column:
    """A literal vector."""
    return F.array(*[F.lit(float(v)) for v in values])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def centre(a: Column) -> Column:
    """Average reference: each channel less the mean of all."""
    m = mean(a)
    return F.transform(a, lambda x: x - m)


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def unit(a: Column, eps: float = 1e-12) -> Column:
    n = norm(a) + F.lit(eps)
    return F.transform(a, lambda x: x / n)


def gfp(a: Column) -> Column:
    """Global field power: population standard deviation over channels."""
    return norm(centre(a)) / F.sqrt(F.size(a).cast("double"))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two vectors; null where one has no variance."""
    return F.try_divide(dot(centre(a), centre(b)), norm(centre(a)) * norm(centre(b)))


def similarity(a: Column, b: Column) -> Column:
    """Correlation whatever the polarity, within [0, 1]."""
    return F.least(F.lit(1.0), F.abs(pearson(a, b)))


def softmax(a: Column, times: float = 100.0) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    s = total(e)
    return F.transform(e, lambda x: x / s * F.lit(times))


def min_max(a: Column) -> Column:
    low, high = F.array_min(a), F.array_max(a)
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0)))


def first_max(a: Column) -> Column:
    """Index from 0 of the first greatest element."""
    return F.array_position(a, F.array_max(a)).cast("int") - 1
