"""Triangles, cores, cliques, cycles, motifs and similarity of vertices."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.algo.base import both_ways, by_degree, ends, neighbours, number, simple
from arcweave.runtime import cut, union_all


def triangle_list(edges: DataFrame) -> DataFrame:
    """``a, b, c`` of every triangle once. Wedges start at the end of smallest
    degree, so their number is bounded by edges ** 1.5 however skewed it is."""
    e = by_degree(edges)
    x, y = e.select("a", F.col("b").alias("p")), e.select("a", F.col("b").alias("q"))
    wedge = x.join(y, "a").filter("p < q")
    close = e.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"))
    return wedge.join(close, ["p", "q"]).select("a", F.col("p").alias("b"), F.col("q").alias("c"))


def triangles(edges: DataFrame) -> DataFrame:
    """``id, triangles`` of the vertices in at least one."""
    return triangle_list(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))


def clustering(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``id, lcc``: closed pairs of distinct neighbours over all pairs, 0 below two."""
    vertices = ends(edges) if vertices is None else vertices
    deg = neighbours(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    out = vertices.join(deg, "id", "left").join(triangles(edges), "id", "left")
    return out.select("id", F.when(F.col("d") > 1, F.coalesce("triangles", F.lit(0)) * 2 / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("lcc"))


def kcore(edges: DataFrame, k: int) -> DataFrame:
    """``id`` of the vertices left after peeling off, again and again, those of
    undirected degree (parallel edges counted) below k."""
    e = cut(both_ways(edges.select("src", "dst")))
    while True:
        keep = e.groupBy("src").count().filter(F.col("count") >= k).select("src")
        new = cut(e.join(keep, "src", "left_semi").join(keep.withColumnRenamed("src", "dst"), "dst", "left_semi"))
        same = new.count() == e.count()
        e = new
        if same:
            return e.select(F.col("src").alias("id")).distinct()


def ktruss(edges: DataFrame, k: int) -> DataFrame:
    """``a, b``: the undirected edges left when all edges in fewer than k - 2
    triangles are dropped, round by round."""
    e = cut(simple(edges))
    while True:
        t = triangle_list(e.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        s = F.sort_array(F.array("a", "b", "c"))
        sides = t.select(s.alias("s")).select(F.explode(F.array(F.struct(F.col("s")[0].alias("a"), F.col("s")[1].alias("b")), F.struct(F.col("s")[0].alias("a"), F.col("s")[2].alias("b")), F.struct(F.col("s")[1].alias("a"), F.col("s")[2].alias("b")))).alias("e"))
        support = sides.groupBy("e.a", "e.b").count()
        new = cut(e.join(support, ["a", "b"], "left").filter(F.coalesce("count", F.lit(0)) >= k - 2).select("a", "b"))
        same = new.count() == e.count()
        e = new
        if same:
            return e


def cliques(edges: DataFrame, k: int) -> DataFrame:
    """``members``: every clique of k vertices once."""
    if k < 2:
        return ends(edges).select(F.array("id").alias("members"))
    e = by_degree(edges)
    found = cut(e.select(F.array("a", "b").alias("members")))
    for size in range(3, k + 1):
        grown = found.join(e, F.element_at("members", -1) == e["a"]).select("members", e["b"].alias("w"))
        for i in range(size - 2):
            grown = grown.withColumn("x", F.col("members")[i]).join(e.select(F.col("a").alias("x"), F.col("b").alias("w")), ["x", "w"], "left_semi").drop("x")
        found = cut(grown.select(F.concat("members", F.array("w")).alias("members")))
    return found


def clique_counts(edges: DataFrame, k: int) -> DataFrame:
    """``id, cliques`` of k vertices through each vertex."""
    return cliques(edges, k).select(F.explode("members").alias("id")).groupBy("id").agg(F.count("*").alias("cliques"))


def independent_set(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``id`` of a maximal independent set: a vertex joins once its id is the
    smallest among its remaining neighbours."""
    vertices = ends(edges) if vertices is None else vertices
    e = cut(neighbours(edges))
    left = cut(vertices.select("id").distinct())
    chosen = None
    while not left.isEmpty():
        low = e.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("id"), "m")
        new = cut(left.join(low, "id", "left").filter(F.col("m").isNull() | (F.col("id") < F.col("m"))).select("id"))
        chosen = new if chosen is None else chosen.unionByName(new)
        gone = cut(new.unionByName(e.join(new.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))).distinct())
        left = cut(left.join(gone, "id", "left_anti"), replaces=left)
        e = cut(e.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"), replaces=e)
    return chosen if chosen is not None else vertices.select("id").limit(0)


def cycles(edges: DataFrame, k: int) -> DataFrame:
    """``nodes``: directed cycles of k different vertices, each once, from its
    smallest vertex on; parallel edges make cycles of their own."""
    e = edges.filter("src <> dst").select("src", "dst")
    e = cut(e)
    walk = e.filter("src < dst").select(F.array("src", "dst").alias("nodes"))
    for _ in range(k - 2):
        step = walk.join(e, F.element_at("nodes", -1) == e["src"])
        walk = step.filter((F.col("dst") > F.col("nodes")[0]) & ~F.array_contains("nodes", F.col("dst"))).select(F.concat("nodes", F.array("dst")).alias("nodes"))
    return walk.join(e, (F.element_at("nodes", -1) == e["src"]) & (F.col("nodes")[0] == e["dst"])).select("nodes")


def subgraphs(edges: DataFrame, query: list[tuple[int, int]]) -> DataFrame:
    """``nodes``: ordered, injective images of a query graph (directed edges
    between 0..k-1, connected) that keep its edges; other edges may exist."""
    e = cut(edges.filter("src <> dst").select("src", "dst").distinct())
    k = 1 + max(max(q) for q in query)
    todo, placed = list(dict.fromkeys(query)), set()
    state = None
    while todo:
        at = next((i for i, (a, b) in enumerate(todo) if a in placed or b in placed), 0)
        a, b = todo.pop(at)
        one = e.select(F.col("src").alias(f"n{a}"), F.col("dst").alias(f"n{b}"))
        on = [f"n{x}" for x in (a, b) if x in placed]
        state = one if state is None else state.join(one, on) if on else state.crossJoin(one)
        for x in (a, b):
            if x not in placed:
                for y in placed:
                    state = state.filter(F.col(f"n{x}") != F.col(f"n{y}"))
                placed.add(x)
    return state.select(F.array(*[F.col(f"n{i}") for i in range(k)]).alias("nodes"))


def subgraph_counts(edges: DataFrame, query: list[tuple[int, int]]) -> DataFrame:
    """``id, matches``: in how many images each vertex takes part."""
    return subgraphs(edges, query).select(F.explode("nodes").alias("id")).groupBy("id").agg(F.count("*").alias("matches"))


@lru_cache(maxsize=1 << 16)
def canonical(mask: int, k: int) -> int:
    """The smallest adjacency mask (bit i * k + j for i -> j) over all orders."""
    bits = [divmod(b, k) for b in range(k * k) if mask >> b & 1]
    return min(sum(1 << (p[i] * k + p[j]) for i, j in bits) for p in permutations(range(k)))


def motifs(edges: DataFrame, roots: DataFrame, k: int) -> DataFrame:
    """``root, mask, n``: per root, the connected induced subgraphs of k
    vertices around it by canonical adjacency mask."""
    e = cut(edges.filter("src <> dst").select("src", "dst").distinct())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(mask=[canonical(int(m), k) for m in b["mask"]])

    masks = _masks_of_three(e, roots) if k == 3 else _masks(e, roots, k)
    out = masks.mapInPandas(run, "root long, mask long, n long").groupBy("root", "mask").agg(F.sum("n").alias("n"))
    return out.filter("n > 0")


def _masks(e: DataFrame, roots: DataFrame, k: int) -> DataFrame:
    """``root, mask, n`` by listing every set of k vertices."""
    both = cut(both_ways(e).distinct())
    sets = cut(roots.select(F.col("id").alias("root"), F.array("id").alias("members")))
    for _ in range(k - 1):
        grown = sets.select("root", "members", F.explode("members").alias("m")).join(both, F.col("m") == both["src"])
        grown = grown.filter(~F.array_contains("members", F.col("dst"))).select("root", F.sort_array(F.concat("members", F.array("dst"))).alias("members"))
        sets = cut(grown.distinct(), replaces=sets)
    pairs = sets.select("root", "members", F.posexplode("members").alias("i", "src")).join(e, "src").withColumn("j", F.array_position("members", F.col("dst")) - 1).filter("j >= 0")
    bit = F.pow(F.lit(2.0), F.col("i") * k + F.col("j")).cast("long")
    return pairs.groupBy("root", "members").agg(F.sum(bit).alias("mask")).groupBy("root", "mask").agg(F.count("*").alias("n"))


def _masks_of_three(e: DataFrame, roots: DataFrame) -> DataFrame:
    """``root, mask, n`` of three vertices without listing those that aren't
    triangles: two neighbours of the root, and a neighbour with one of its own,
    are counted from how many links of each kind a vertex has; triangles, which
    are in both counts, are listed and taken off. The root is vertex 0."""
    # kind, seen from src: 1 an edge to dst, 2 one from it, 3 both
    links = cut(both_ways(e).distinct().join(e.withColumn("to", F.lit(1)), ["src", "dst"], "left").join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(2).alias("of")), ["src", "dst"], "left").select("src", "dst", (F.coalesce("to", F.lit(0)) + F.coalesce("of", F.lit(0))).alias("kind")))
    turned = lambda kind: F.when(kind == 3, 3).otherwise(3 - kind)
    mask = lambda i, j, kind: F.when(kind % 2 == 1, 1 << (i * 3 + j)).otherwise(0) + F.when(kind >= 2, 1 << (j * 3 + i)).otherwise(0)
    has = links.groupBy("src").agg(*[F.count_if(F.col("kind") == t).alias(f"n{t}") for t in (1, 2, 3)])
    mine = cut(links.join(roots.select(F.col("id").alias("src")).distinct(), "src", "left_semi"))
    one = F.col("kind")

    own = F.array(*[F.struct((mask(0, 1, F.lit(t)) + mask(0, 2, F.lit(u))).alias("mask"), (F.col(f"n{t}") * F.col(f"n{u}") if t != u else F.expr(f"n{t} * (n{t} - 1) div 2")).alias("n")) for t in (1, 2, 3) for u in (1, 2, 3) if t <= u])
    beside = has.join(roots.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("root"), F.explode(own).alias("x"))
    next_ = F.array(*[F.struct((mask(0, 1, one) + mask(1, 2, F.lit(t))).alias("mask"), (F.col(f"n{t}") - F.when(turned(one) == t, 1).otherwise(0)).alias("n")) for t in (1, 2, 3)])
    beyond = mine.join(has.withColumnRenamed("src", "dst"), "dst").select(F.col("src").alias("root"), F.explode(next_).alias("x"))

    corners = triangle_list(e).select(F.explode(F.array(F.struct(F.col("a").alias("root"), F.col("b").alias("p"), F.col("c").alias("q")), F.struct(F.col("b").alias("root"), F.col("a").alias("p"), F.col("c").alias("q")), F.struct(F.col("c").alias("root"), F.col("a").alias("p"), F.col("b").alias("q")))).alias("t")).select("t.*")
    corners = corners.join(roots.select(F.col("id").alias("root")).distinct(), "root", "left_semi")
    for a, b, name in (("root", "p", "rp"), ("root", "q", "rq"), ("p", "q", "pq")):
        corners = corners.join((mine if a == "root" else links).select(F.col("src").alias(a), F.col("dst").alias(b), F.col("kind").alias(name)), [a, b])
    rp, rq, pq = F.col("rp"), F.col("rq"), F.col("pq")
    both = F.when(rp <= rq, mask(0, 1, rp) + mask(0, 2, rq)).otherwise(mask(0, 1, rq) + mask(0, 2, rp))
    parts = [(mask(0, 1, rp) + mask(0, 2, rq) + mask(1, 2, pq), 1), (both, -1), (mask(0, 1, rp) + mask(1, 2, pq), -1), (mask(0, 1, rq) + mask(1, 2, turned(pq)), -1)]
    closed = corners.select("root", F.explode(F.array(*[F.struct(m.alias("mask"), F.lit(n).cast("long").alias("n")) for m, n in parts])).alias("x"))
    return union_all([x.select("root", F.col("x.mask").cast("long").alias("mask"), F.col("x.n").alias("n")) for x in (beside, beyond, closed)]).groupBy("root", "mask").agg(F.sum("n").alias("n")).filter("n <> 0")


def _shared(n: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, k, k2`` of each neighbour that the ends of a pair share; ``n``:
    ``src, dst, k``. The neighbours of the end that has fewer are looked up
    among those of the other, so that a hub's are listed for no pair."""
    deg = cut(n.groupBy("src").agg(F.count("*").alias("d")))
    x = pairs.join(deg.select(F.col("src").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("src").alias("b"), F.col("d").alias("db")), "b")
    less = F.col("da") <= F.col("db")
    x = x.select("a", "b", F.when(less, F.col("a")).otherwise(F.col("b")).alias("few"), F.when(less, F.col("b")).otherwise(F.col("a")).alias("many"))
    x = x.join(n.select(F.col("src").alias("few"), F.col("dst").alias("w"), "k"), "few")
    return x.join(n.select(F.col("src").alias("many"), F.col("dst").alias("w"), F.col("k").alias("k2")), ["many", "w"]).select("a", "b", "k", "k2")


def common_neighbours(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, common`` of the pairs, undirected; a neighbour over parallel
    edges counts as often as it has edges to both."""
    n = cut(both_ways(edges.select("src", "dst")).groupBy("src", "dst").agg(F.count("*").alias("k")))
    hits = _shared(n, pairs).groupBy("a", "b").agg(F.sum(F.least("k", "k2")).alias("common"))
    return pairs.join(hits, ["a", "b"], "left").select("a", "b", F.coalesce("common", F.lit(0)).alias("common"))


def jaccard(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, jaccard`` over distinct neighbours: 1 if neither has any, 0 if
    only one has."""
    n = cut(neighbours(edges))
    deg = n.groupBy("src").agg(F.count("*").alias("d"))
    hits = _shared(n.withColumn("k", F.lit(1)), pairs).groupBy("a", "b").agg(F.count("*").alias("c"))
    out = pairs.join(deg.select(F.col("src").alias("a"), F.col("d").alias("da")), "a", "left").join(deg.select(F.col("src").alias("b"), F.col("d").alias("db")), "b", "left").join(hits, ["a", "b"], "left")
    da, db, c = (F.coalesce(x, F.lit(0)) for x in ("da", "db", "c"))
    return out.select("a", "b", F.when((da == 0) & (db == 0), 1.0).otherwise(c / (da + db - c)).alias("jaccard"))


def degree_correlation(edges: DataFrame) -> float:
    """The correlation of out-degrees at the two ends of edges: joint minus
    independent means over degrees that occur at targets, by their variance."""
    deg = edges.groupBy("src").agg(F.count("*").cast("double").alias("d"))
    zero: Column = F.lit(0.0)
    x = edges.join(deg.select("src", F.col("d").alias("s")), "src").join(deg.select(F.col("src").alias("dst"), F.col("d").alias("t")), "dst", "left").select("s", F.coalesce("t", zero).alias("t"))
    x = cut(x.groupBy("s", "t").agg(F.count("*").cast("double").alias("n")))
    at = x.select("t").distinct()
    r = x.agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("t")).alias("mean"), F.sum(F.col("n") * F.col("t") * F.col("t")).alias("sq")).first()
    if not r["m"]:
        return 0.0
    joint = number(x.join(at.withColumnRenamed("t", "s"), "s", "left_semi"), F.sum(F.col("n") * F.col("s") * F.col("t"))) / r["m"]
    mean, sq = r["mean"] / r["m"], r["sq"] / r["m"]
    variance = sq - mean * mean
    return (joint - mean * mean) / variance if variance else 0.0
