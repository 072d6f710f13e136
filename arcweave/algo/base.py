"""Steps shared by the algorithms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.runtime import cut


def ends(edges: DataFrame) -> DataFrame:
    """The vertices of the edges."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse; parallel edges kept."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *rest).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def simple(edges: DataFrame) -> DataFrame:
    """Each undirected edge once as a < b, loops and parallels dropped."""
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    """``src, dst`` of distinct neighbours, both ways, without loops."""
    e = simple(edges).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return both_ways(e)


def by_degree(edges: DataFrame) -> DataFrame:
    """Undirected edges as ``a, b`` from the end of smaller (degree, id) to the
    other: no vertex has more than sqrt(2 * edges) of them."""
    e = cut(simple(edges))
    deg = e.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").count()
    e = e.join(deg.select(F.col("id").alias("a"), F.col("count").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("count").alias("db")), "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    return cut(e.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("b")))


def number(df: DataFrame, column) -> float:
    """A single aggregate; 0 for an empty table."""
    return df.agg(column.alias("x")).first()["x"] or 0
