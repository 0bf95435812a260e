"""Vectors as arrays of numbers, summed in order and in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero or missing."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(a: Column) -> Column:
    """Length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(doubles(a), lambda x: x / n)).otherwise(doubles(a))


def mean_vectors(df, keys: list[str], vector: str, weight: Column | None = None, name: str = "centroid"):
    """Unit mean vector of each key: sums by component, so no group is gathered in one task."""
    w = F.lit(1.0) if weight is None else weight
    parts = df.select(*keys, w.alias("__w"), F.posexplode(doubles(F.col(vector))).alias("__i", "__x"))
    sums = parts.groupBy(*keys, "__i").agg((F.sum(F.col("__x") * F.col("__w")) / F.sum("__w")).alias("__m"))
    out = sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"]).alias(name))
    return out.withColumn(name, unit(F.col(name)))
