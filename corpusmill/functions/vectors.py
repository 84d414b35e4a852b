"""Column functions over vectors held as arrays; all arithmetic is DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    norm = F.greatest(l2_norm(v), F.lit(1e-12))
    # The norm enters as a one-element array so that it is computed once per row,
    # not once per component.
    return F.flatten(F.transform(
        F.array(norm), lambda n: F.transform(v, lambda x: x.cast("double") / n)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity rounded to 6 digits; 0 when a side has no length."""
    score = F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))
    return F.coalesce(F.round(score, 6), F.lit(0.0))


def has_dim(v: Column, dim: int) -> Column:
    """Data-quality predicate standing in for a fixed-size vector type."""
    return F.size(v) == dim
