"""Column expressions on vectors held as ARRAY<DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms and denominators up to this count as zero.
TOLERANCE = 1e-12


def as_doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def safe_cosine(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Cosine similarity; null for empty, unequally long, non-finite or (nearly) zero vectors."""
    odd = lambda v: F.exists(v, lambda x: ~is_finite(x))
    wrong = a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(a) != F.size(b)) | odd(a) | odd(b)
    na, nb = norm(a), norm(b)
    return F.when(wrong, F.lit(None).cast("double")).when((na > tolerance) & (nb > tolerance), dot(a, b) / (na * nb))


def mean_of(vectors: Column) -> Column:
    """Elementwise mean of an array of vectors; NaN elements stay NaN, and no vector gives null."""
    total = F.aggregate(F.slice(vectors, 2, F.greatest(F.size(vectors) - 1, F.lit(0))), vectors[0], plus)
    n = F.size(vectors)
    return F.when(n > 0, F.transform(total, lambda x: x / n))


def divided(sums: Column, count: Column, tolerance: float = TOLERANCE) -> Column:
    """sums / count; a vector of NaN where the count is (nearly) zero."""
    return F.when(count > tolerance, F.transform(sums, lambda x: x / count)).otherwise(F.transform(sums, lambda x: F.lit(float("nan"))))


def without_missing(v: Column) -> Column:
    """The elements that are there and are numbers."""
    return F.filter(v, lambda x: x.isNotNull() & ~F.isnan(x))
