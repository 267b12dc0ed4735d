"""Dense-vector column functions (arrays of float, accumulated in double)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0).cast("double"),
                              lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine(a, b) -> Column:
    """Cosine similarity; a zero vector (or null) gives 0.0."""
    den = norm(a) * norm(b)
    return F.coalesce(F.when(den > 0, dot(a, b) / den), F.lit(0.0))


def l2_normalize(a, eps: float = 0.0) -> Column:
    """``v / (||v|| + eps)``; zero vectors stay zero."""
    n = norm(a) + F.lit(eps)
    return F.transform(_c(a), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))
