"""Vector arithmetic over arrays, on the JVM."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

TINY = 1e-10


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Scaled to length 1; a zero vector stays zero."""
    def scaled(v: Column) -> Column:
        return F.transform(F.array(F.greatest(norm(v), F.lit(TINY))), lambda n: F.transform(v, lambda x: x / n))[0]

    return F.transform(F.array(a.cast("array<double>")), scaled)[0]  # arrays of one bind the vector, so that it is computed once


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(TINY)) * F.greatest(norm(b), F.lit(TINY)))


def similarity(distance: Column) -> Column:
    """Ranking scale of a cosine distance."""
    return 1 / (1 + distance)


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def hashed_embedding(tokens: Column, size: int = 64) -> Column:
    """Feature hashing: signed counts of MD5 buckets, scaled to length 1."""
    def place(h: Column) -> Column:
        return F.struct(F.pmod(F.conv(F.substring(h, 1, 7), 16, 10).cast("long"), F.lit(size)).alias("bucket"), F.when(F.conv(F.substring(h, 8, 1), 16, 10).cast("int") < 8, 1.0).otherwise(-1.0).alias("sign"))

    def sums(places: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.filter(places, lambda p: p["bucket"] == i), F.lit(0.0), lambda s, p: s + p["sign"]))

    places = F.transform(F.transform(tokens, F.md5), place)
    return unit(F.transform(F.array(places), sums)[0])  # an array of one binds the places: a token is hashed once, not once for each bucket
