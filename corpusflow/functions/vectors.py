"""Vector arithmetic on array columns, and the distance-to-similarity conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda total, x: total + x * x))


def l2_normalize(v: Column | str) -> Column:
    """Unit vector; a zero vector stays as it is."""
    vector = as_double(v)
    length = norm(v)
    # the length is an argument, evaluated once, and not part of the lambda
    lengths = F.array_repeat(F.nullif(length, F.lit(0.0)), F.size(vector))
    return F.zip_with(vector, lengths, lambda x, n: F.when(n.isNull(), x).otherwise(x / n))


def distance(a: Column | str, b: Column | str, space: str) -> Column:
    """The index distance of two vectors in one metric space; unknown spaces use squared L2."""
    if space == "cosine":
        return 1.0 - dot(a, b) / (norm(a) * norm(b))
    if space == "ip":
        return -dot(a, b)
    gaps = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x)


def similarity(dist: Column, space: Column | str) -> Column:
    """Similarity in [0, 1] of an index distance; any space but cosine and ip reads as squared L2."""
    space = F.lit(space) if isinstance(space, str) else space
    raw = (
        F.when(space == "cosine", 1.0 - dist)
        .when(space == "ip", -dist)
        .otherwise(1.0 - dist / 2.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def resolve_space(configured: Column, metadata: Column) -> Column:
    """Metric of a collection: configured value, else its metadata, else l2; lower-cased."""
    return F.lower(F.coalesce(F.nullif(configured, F.lit("")), metadata, F.lit("l2")))
