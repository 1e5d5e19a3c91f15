"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """a scaled to length one, so that a cosine is one dot product; null where a is null, empty or zero."""
    n = norm(a)
    return F.when((F.size(a) > 0) & (n > 0), F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a missing vector, different lengths or a zero norm."""
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.try_divide(dot(a, b), norm(a) * norm(b))), F.lit(0.0))
