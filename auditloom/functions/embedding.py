"""Embeddings as arrays: norms and cosines in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: str) -> Column:
    """E5: the length of a vector."""
    return F.sqrt(dot(a, a))


def normalised(a: str) -> Column:
    """The vector over its length; a vector of zeros stays."""
    n = F.when(norm(a) > 0, norm(a)).otherwise(F.lit(1.0))
    return F.transform(a, lambda x: x / n)


def cosine(a: str, b: str) -> Column:
    """The cosine of two vectors; null if either is all zeros."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))
