"""Vector and probability expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import text as T

EPSILON = 1e-6


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector, an error for unequal lengths."""
    same = F.assert_true(F.size(a) == F.size(b), F.lit("vectors differ in length"))
    norms = l2_norm(a) * l2_norm(b)
    return F.when(same.isNull(), F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0)))


def logit(p: Column, limit: float = 12.0) -> Column:
    inside = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1.0 - EPSILON))
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), F.log(inside / (F.lit(1.0) - inside))))


def sigmoid(x: Column, limit: float = 12.0) -> Column:
    inside = F.greatest(F.lit(-limit), F.least(F.lit(limit), x))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-inside))


def hash_bucket(token: Column, dim: int) -> Column:
    """A token's dimension: the first 64 bits of its SHA-256 modulo ``dim``."""
    head = F.substring(F.sha2(token, 256), 1, 16)
    return (F.conv(head, 16, 10).cast("decimal(20,0)") % F.lit(dim).cast("decimal(20,0)")).cast("int")


def hashed_embedding(text: Column, dim: int = 8) -> Column:
    """L2-normalised token counts per hash bucket, rounded to six places."""
    buckets = F.transform(T.tokens(text), lambda t: hash_bucket(t, dim))

    def counts(found: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda i: F.size(F.filter(found, lambda b: b == i)).cast("double"),
        )

    def scaled(values: Column) -> Column:
        return T.let(
            l2_norm(values),
            lambda n: F.transform(values, lambda c: F.round(c / F.when(n > 0, n).otherwise(F.lit(1.0)), 6)),
        )

    return T.let(buckets, lambda found: T.let(counts(found), scaled))
