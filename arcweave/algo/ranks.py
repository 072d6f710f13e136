"""Ranks that flow along edges. The damping factor is 0.85."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.algo.base import ends, number
from arcweave.runtime import cut

DAMPING = 0.85


def _links(edges: DataFrame, weighted: bool = False) -> DataFrame:
    """``src, dst, share``: what part of its rank a vertex passes to another."""
    w = F.col("weight") if weighted else F.lit(1.0)
    e = edges.groupBy("src", "dst").agg(F.sum(w).alias("w"))
    total = e.groupBy("src").agg(F.sum("w").alias("total"))
    return cut(e.join(total, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))


def _flow(links: DataFrame, state: DataFrame) -> DataFrame:
    """``id, got``: what arrives at each vertex."""
    return state.join(links, state["id"] == links["src"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))


def _iterate(links: DataFrame, start: DataFrame, iterations: int, step: Column, lost: bool = False) -> DataFrame:
    """Repeat ``rank = step(got, base, lost)``. ``start``: ``id, rank, base``
    and ``open`` (whether the vertex has no out-edge)."""
    state = cut(start)
    for _ in range(iterations):
        new = state.join(_flow(links, state), "id", "left").withColumn("got", F.coalesce("got", F.lit(0.0)))
        if lost:  # one row, whatever the size of the graph
            new = new.crossJoin(F.broadcast(state.agg(F.coalesce(F.sum(F.when(F.col("open"), F.col("rank"))), F.lit(0.0)).alias("lost"))))
        state = cut(new.select("id", step.alias("rank"), "base", "open"), replaces=state)
    return state.select("id", "rank")


def _start(links: DataFrame, vertices: DataFrame, rank: Column, base: Column) -> DataFrame:
    out = links.select(F.col("src").alias("id")).distinct().withColumn("has", F.lit(True))
    return vertices.select("id").join(out, "id", "left").select("id", rank.cast("double").alias("rank"), base.cast("double").alias("base"), F.col("has").isNull().alias("open"))


def pagerank(edges: DataFrame, vertices: DataFrame | None = None, iterations: int = 20) -> DataFrame:
    """``id, rank``; ranks sum to 1, those of vertices without out-edges are
    handed out evenly."""
    vertices = ends(edges) if vertices is None else vertices
    n = vertices.count()
    if not n:
        return vertices.select("id", F.lit(0.0).alias("rank"))
    links = _links(edges)
    step = F.lit((1 - DAMPING) / n) + DAMPING * (F.col("got") + F.col("lost") / n)
    return _iterate(links, _start(links, vertices, F.lit(1.0 / n), F.lit(0.0)), iterations, step, lost=True)


def weighted_pagerank(edges: DataFrame, vertices: DataFrame | None = None, iterations: int = 20) -> DataFrame:
    """As ``pagerank`` by weights, without dangling ranks."""
    vertices = ends(edges) if vertices is None else vertices
    n = max(1, vertices.count())
    links = _links(edges, weighted=True)
    return _iterate(links, _start(links, vertices, F.lit(1.0 / n), F.lit(0.0)), iterations, F.lit((1 - DAMPING) / n) + DAMPING * F.col("got"))


def personalized_pagerank(edges: DataFrame, root: int, vertices: DataFrame | None = None, iterations: int = 20) -> DataFrame:
    """Ranks of walks that start again at ``root``; without dangling ranks."""
    vertices = ends(edges) if vertices is None else vertices
    links = _links(edges)
    own = (F.col("id") == root).cast("double")
    if links.filter(F.col("src") == root).isEmpty():
        return vertices.select("id", own.alias("rank"))
    return _iterate(links, _start(links, vertices, own, own), iterations, (1 - DAMPING) * F.col("base") + DAMPING * F.col("got"))


def trustrank(edges: DataFrame, trusted: DataFrame, vertices: DataFrame | None = None, iterations: int = 20) -> DataFrame:
    """Ranks of walks that start again at the trusted vertices (``id``)."""
    vertices = ends(edges) if vertices is None else vertices
    n = max(1, trusted.select("id").distinct().count())
    known = trusted.select("id").distinct().withColumn("trusted", F.lit(1.0 / n))
    links = _links(edges)
    start = _start(links, vertices, F.lit(0.0), F.lit(0.0)).join(known, "id", "left")
    start = start.select("id", F.coalesce("trusted", F.lit(0.0)).alias("rank"), F.coalesce("trusted", F.lit(0.0)).alias("base"), "open")
    return _iterate(links, start, iterations, (1 - DAMPING) * F.col("base") + DAMPING * F.col("got"))


def sybilrank(edges: DataFrame, seeds: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """Trust of 1 per seed, spread ceil(ln n) times by out-degree."""
    vertices = ends(edges) if vertices is None else vertices
    n = max(2, vertices.count())
    links = _links(edges)
    known = seeds.select("id").distinct().withColumn("seed", F.lit(1.0))
    start = _start(links, vertices, F.lit(0.0), F.lit(0.0)).join(known, "id", "left").select("id", F.coalesce("seed", F.lit(0.0)).alias("rank"), "base", "open")
    return _iterate(links, start, math.ceil(math.log(n)), F.col("got"))


def hits(edges: DataFrame, vertices: DataFrame | None = None, iterations: int = 100, delta: float = 1e-6) -> DataFrame:
    """``id, authority, hub``, each of length 1; stops early once both change
    by less than ``delta`` in sum."""
    vertices = ends(edges) if vertices is None else vertices
    e = cut(edges.groupBy("src", "dst").agg(F.count("*").alias("k")))
    state = cut(vertices.select("id", F.lit(1.0).alias("authority"), F.lit(1.0).alias("hub")))

    def half(frm: str, to: str, score: str) -> DataFrame:
        s = state.select(F.col("id").alias(frm), F.col(score).alias("x"))
        got = s.join(e, frm).groupBy(F.col(to).alias("id")).agg(F.sum(F.col("x") * F.col("k")).alias("y"))
        size = got.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("size"))
        return got.crossJoin(F.broadcast(size)).select("id", (F.col("y") / F.col("size")).alias("y"))

    for _ in range(iterations):
        moved = 0.0
        for frm, to, score, other in (("src", "dst", "hub", "authority"), ("dst", "src", "authority", "hub")):
            new = state.join(half(frm, to, score), "id", "left").select("id", F.coalesce("y", F.lit(0.0)).alias(other), score, F.abs(F.coalesce("y", F.lit(0.0)) - F.col(other)).alias("moved"))
            new = cut(new)
            moved += number(new, F.sum("moved"))
            state = new.drop("moved")
        if moved < delta:
            break
    return state.select("id", "authority", "hub")
