"""Exact vector search for a query vector. Distances: ``l2`` (the squared
Euclidean norm), ``ip`` (one minus the inner product) and ``cosine`` (one minus
the cosine). Vectors that are null, of another length or hold null or NaN are
no candidates. One scan with JVM expressions; the top k is taken per partition
before anything moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance(vector: Column, query: list[float], kind: str) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    pairs = F.zip_with(vector, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b) if kind == "l2" else a.cast("double") * b)
    total = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
    if kind == "l2":
        return total
    if kind == "ip":
        return 1 - total
    if kind == "cosine":
        norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) * F.lit(sum(x * x for x in query) ** 0.5)
        return F.when(norm > 0, 1 - total / norm)
    raise ValueError(f"no distance {kind}")


def _scored(df: DataFrame, key: str, vector: str, query: list[float], kind: str) -> DataFrame:
    v = F.col(f"`{vector}`")
    d = df.filter(F.size(v) == len(query)).select(F.col(f"`{key}`").alias(key), distance(v, query, kind).alias("distance"))
    return d.filter(F.col("distance").isNotNull() & ~F.isnan("distance"))


def knn_search(df: DataFrame, key: str, vector: str, query: list[float], k: int, kind: str = "l2") -> DataFrame:
    """``key, distance`` of the k nearest, the smaller key first at ties."""
    return _scored(df, key, vector, query, kind).orderBy("distance", key).limit(k)


def range_search(df: DataFrame, key: str, vector: str, query: list[float], radius: float, kind: str = "l2") -> DataFrame:
    """``key, distance`` of all within the radius."""
    return _scored(df, key, vector, query, kind).filter(F.col("distance") <= radius)
