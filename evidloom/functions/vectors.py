"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_add = lambda a, x: a + x


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), _add)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), _add))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, differing lengths and zero norms."""
    lengths = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (lengths == 0), 0.0).otherwise(dot(a, b) / lengths)


def hashed_embedding(tokens: Column, size: int = 64) -> Column:
    """Signed hashing: each token adds 1 or -1 at a place; the sum has unit length."""
    place = F.transform(tokens, lambda t: F.struct((F.conv(F.substring(F.sha2(t, 256), 1, 8), 16, 10).cast("long") % size).cast("int").alias("i"), F.when(F.conv(F.substring(F.sha2(t, 256), 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0).alias("s")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.filter(place, lambda p: p["i"] == i), F.lit(0.0), lambda a, p: a + p["s"]))
    return F.transform(raw, lambda x: F.round(x / F.greatest(norm(raw), F.lit(1e-12)), 8))
