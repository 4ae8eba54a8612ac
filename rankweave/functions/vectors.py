"""Column expressions on embedding arrays. Sums run in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector is returned unchanged."""
    # The norm is repeated into an array, so that it is computed once per row: inside a lambda
    # it would be computed again for every element.
    norms = F.array_repeat(norm(v), F.size(v))
    return F.zip_with(v, norms, lambda x, n: F.when(n == 0, x.cast("double"))
                      .otherwise(F.try_divide(x.cast("double"), n)))


def truncate_dims(v: Column, dims: int) -> Column:
    """The leading `dims` values, scaled to unit length again."""
    return l2_normalize(F.slice(v, 1, dims))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when a vector is null, empty or zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))
