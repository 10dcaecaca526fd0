"""Vector columns (ARRAY<DOUBLE>) with higher-order functions, inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def l2(a: Column, b: Column) -> Column:
    """Squared distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def normalized(v: Column, eps: float = 1e-12) -> Column:
    return scaled(v, lambda n2: F.greatest(F.sqrt(n2), F.lit(eps)))


def scaled(v: Column, length: Callable[[Column], Column]) -> Column:
    """``v`` divided by a function of its squared length, which is computed once."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x, lambda s: F.transform(v, lambda x: x / length(s)))


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def subspace(v: Column, s: Column | int, width: int) -> Column:
    return F.slice(v, F.lit(s) * width + 1 if isinstance(s, int) else s * width + 1, F.lit(width))


def rotated(v: Column, rotation: list[list[float]]) -> Column:
    """v @ R for a small literal R (rows: input dimensions)."""
    cols = list(zip(*rotation, strict=True))
    return F.array(*[dot(v, F.array(*[F.lit(float(x)) for x in c])) for c in cols])


def maxsim(query: Column, doc: Column) -> Column:
    """Sum over query vectors of the largest inner product with a document vector."""
    best = F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: dot(q, d))))
    return F.aggregate(best, F.lit(0.0), lambda s, v: s + v)


def hash48(s: Column) -> Column:
    """48 bits of SHA-256 of a string, as a long."""
    return F.conv(F.substring(F.sha2(s.cast("binary"), 256), 1, 12), 16, 10).cast("long")


def r6(c: Column) -> Column:
    return F.round(c, 6)
