"""Traversal and distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.algo import local
from arcweave.algo.base import both_ways, number
from arcweave.runtime import cut, union_all


def levels(edges: DataFrame, roots: DataFrame, hops: int | None = None) -> DataFrame:
    """``root, id, level`` of what each root reaches, itself at level 0.
    ``roots``: ``root, id``."""
    step = edges.select(F.col("src").alias("id"), F.col("dst").alias("next")).distinct()
    front = cut(roots.select("root", "id").distinct())
    seen, parts, level = front, [front.withColumn("level", F.lit(0))], 0
    while hops is None or level < hops:
        level += 1
        reached = front.join(step, "id").select("root", F.col("next").alias("id")).distinct()
        front = cut(reached.join(seen, ["root", "id"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        parts.append(front.withColumn("level", F.lit(level)))
    return union_all(parts)


def bfs(edges: DataFrame, root: int) -> DataFrame:
    """``id, level, parent`` of the vertices reached from ``root``; the parent
    is the smallest possible one, the root's own is itself."""
    spark = edges.sparkSession
    lv = cut(levels(edges, spark.createDataFrame([(root, root)], "root long, id long")).select("id", "level"))
    above = lv.select(F.col("id").alias("src"), (F.col("level") + 1).alias("level"))
    parent = edges.select("src", F.col("dst").alias("id")).join(above, "src").groupBy("id", "level").agg(F.min("src").alias("parent"))
    return lv.join(parent, ["id", "level"], "left").select("id", "level", F.coalesce("parent", F.lit(root)).alias("parent"))


def khop(edges: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """Per root, the vertices at exactly each hop and within: ``root, level,
    n, within``."""
    lv = levels(edges, roots.select(F.col("id").alias("root"), "id"), hops).groupBy("root", "level").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    return lv.withColumn("within", F.sum("n").over(Window.partitionBy("root").orderBy("level")))


def ego_size(edges: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """``root, n``: vertices at most ``hops`` out-edges away, the root included."""
    return levels(edges, roots.select(F.col("id").alias("root"), "id"), hops).groupBy("root").agg(F.count("*").alias("n"))


def eccentricity(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``root, ecc``: the farthest undirected hop; the greatest of some roots
    estimates the diameter."""
    edges = cut(both_ways(edges.select("src", "dst").distinct()).distinct())
    if held := local.hold(edges, roots):
        return local.spread_out(edges, held, local.farthest, "root long, ecc int")
    return levels(edges, roots.select(F.col("id").alias("root"), "id")).groupBy("root").agg(F.max("level").alias("ecc"))


def lightest(edges: DataFrame) -> DataFrame:
    """``src, dst, weight`` of the lightest of parallel edges, without loops."""
    return edges.filter("src <> dst").groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def relax(edges: DataFrame, start: DataFrame, rounds: int | None = None) -> DataFrame:
    """Least ``dist`` per ``root, id`` over weighted edges, by relaxation.
    ``start``: ``root, id, dist``. Weights are not negative."""
    step = cut(lightest(edges).select(F.col("src").alias("id"), F.col("dst").alias("next"), "weight"))
    state = front = cut(start)
    done = 0
    while rounds is None or done < rounds:
        done += 1
        offer = front.join(step, "id").groupBy("root", F.col("next").alias("id")).agg(F.min(F.col("dist") + F.col("weight")).alias("offer"))
        both = state.join(offer, ["root", "id"], "full")
        better = F.col("offer").isNotNull() & (F.col("dist").isNull() | (F.col("offer") < F.col("dist")))
        new = cut(both.select("root", "id", F.when(better, F.col("offer")).otherwise(F.col("dist")).alias("dist"), better.alias("changed")))
        state, front = new.drop("changed"), new.filter("changed").drop("changed")
        if front.isEmpty():
            break
    return state


def sssp(edges: DataFrame, root: int) -> DataFrame:
    """``id, dist`` from one root."""
    return relax(edges, edges.sparkSession.createDataFrame([(root, root, 0.0)], "root long, id long, dist double")).select("id", "dist")


def mssp(edges: DataFrame, roots: list[int]) -> DataFrame:
    """``id, dist`` to the nearest of several roots."""
    return relax(edges, edges.sparkSession.createDataFrame([(0, r, 0.0) for r in roots], "root long, id long, dist double")).select("id", "dist")


def apsp(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``src, dst, dist`` of all reachable pairs of different vertices from
    ``sources`` (``id``; by default every vertex with an out-edge)."""
    s = sources if sources is not None else edges.select(F.col("src").alias("id")).distinct()
    edges = cut(lightest(edges))
    if held := local.hold(edges, s):
        return local.spread_out(edges, held, local.pairs, "src long, dst long, dist double")
    start = s.select(F.col("id").alias("root"), "id", F.lit(0.0).alias("dist"))
    return relax(edges, start).filter("root <> id").select(F.col("root").alias("src"), F.col("id").alias("dst"), "dist")


def closeness(edges: DataFrame, samples: DataFrame) -> DataFrame:
    """``id, score``: the number of sampled vertices that a vertex reaches,
    over the sum of its distances to them (0 where there is none)."""
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    turned = cut(lightest(turned))
    if held := local.hold(turned, samples):
        d = local.spread_out(turned, held, local.reached, "id long, n long, total double").groupBy("id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    else:
        d = apsp(turned, samples).select(F.col("dst").alias("id"), "dist").groupBy("id").agg(F.count("*").alias("n"), F.sum("dist").alias("total"))
    return d.select("id", F.when(F.col("total") != 0, F.col("n") / F.col("total")).otherwise(0.0).alias("score"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, hops: int = 20, direction: str = "BOTH", every: bool = False) -> DataFrame:
    """``src, dst, hops, nodes`` of the shortest paths of ``pairs`` (``src,
    dst``): the one of smallest vertex ids, or all. Pairs without a path of at
    most ``hops`` edges are left out."""
    d = direction.upper()
    if d in ("BOTH", "ANY"):
        edges = both_ways(edges)
    elif d in ("INCOMING", "IN", "PATHINCOMING"):
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    step = edges.select(F.col("src").alias("at"), F.col("dst").alias("next")).distinct()
    pairs = cut(pairs.select("src", "dst").distinct())
    # the distance of what lies before each end, searched once for all pairs that share it, until they all are met
    back = step.select(F.col("next").alias("id"), F.col("at").alias("next"))
    front = cut(pairs.select(F.col("dst").alias("root"), F.col("dst").alias("id")).distinct())
    seen, parts, level = front, [front.withColumn("level", F.lit(0))], 0
    todo = cut(pairs.filter("src <> dst"))
    while level < hops and not todo.isEmpty():
        level += 1
        near = front.join(todo.select(F.col("dst").alias("root")).distinct(), "root", "left_semi").join(back, "id").select("root", F.col("next").alias("id")).distinct()
        front = cut(near.join(seen, ["root", "id"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        parts.append(front.withColumn("level", F.lit(level)))
        todo = cut(todo.join(front.select(F.col("root").alias("dst"), F.col("id").alias("src")), ["src", "dst"], "left_anti"), replaces=todo)
    before = union_all(parts).withColumnRenamed("root", "dst")
    front = cut(pairs.join(before.withColumnRenamed("id", "src"), ["src", "dst"]).select("src", "dst", F.col("level").alias("hops"), F.col("src").alias("at"), F.array("src").alias("nodes")))
    found, walked = [front.filter("hops = 0")], 0
    while walked < level:
        left = level - walked  # a path of fewer hops starts later, so that all share one level
        now = front.filter(F.col("hops") >= left)
        ways = now.select("dst", "at").distinct().join(step, "at").join(parts[left - 1].select(F.col("root").alias("dst"), F.col("id").alias("next")), ["dst", "next"])
        if not every:
            ways = ways.groupBy("dst", "at").agg(F.min("next").alias("next"))
        grown = now.join(ways, ["dst", "at"]).select("src", "dst", "hops", F.col("next").alias("at"), F.concat("nodes", F.array("next")).alias("nodes"))
        front = cut(grown.unionByName(front.filter(F.col("hops") < left)), replaces=front if walked else None)
        walked += 1
    found.append(front.filter("hops > 0"))
    return union_all([f.select("src", "dst", "hops", "nodes") for f in found])


def single_pair(edges: DataFrame, a: int, b: int, directed: bool = True) -> int | None:
    """The number of edges between two vertices, from both ends at once; None
    if there is no path."""
    if a == b:
        return 0
    if not directed:
        edges = both_ways(edges)
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("next")).distinct()
    back = out.select(F.col("next").alias("id"), F.col("id").alias("next"))
    spark = edges.sparkSession
    side = [spark.createDataFrame([(x,)], "id long") for x in (a, b)]
    seen, steps, walked = list(side), (out, back), 0
    sizes = [1, 1]
    while True:
        k = 0 if sizes[0] <= sizes[1] else 1  # the smaller frontier grows
        new = cut(side[k].join(steps[k], "id").select(F.col("next").alias("id")).distinct().join(seen[k], "id", "left_anti"))
        sizes[k] = new.count()
        if not sizes[k]:
            return None
        walked += 1
        if not new.join(seen[1 - k], "id", "left_semi").isEmpty():
            return walked
        side[k], seen[k] = new, cut(seen[k].unionByName(new))


def betweenness(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``id, score``: dependencies summed over the given roots (``id``), scaled
    to lie between 0 and 1; parallel edges count as paths of their own."""
    edges = cut(edges.select("src", "dst"))
    held = local.hold(edges, roots)
    parts = local.spread_out(edges, held, local.dependencies, "id long, score double") if held else _dependencies(edges, roots)
    total = cut(parts.groupBy("id").agg(F.sum("score").alias("score")))
    low, high = number(total, F.min("score")), number(total, F.max("score"))
    return total.select("id", ((F.col("score") - low) / (high - low) if high > low else F.lit(0.0)).alias("score"))


def _dependencies(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``id, score`` of every root and vertex, by joins."""
    step = edges.select(F.col("src").alias("id"), F.col("dst").alias("next"))
    front = cut(roots.select(F.col("id").alias("root"), "id", F.lit(1.0).alias("paths")).distinct())
    all_levels, seen = [front], front.select("root", "id")
    while True:
        new = front.join(step, "id").groupBy("root", F.col("next").alias("id")).agg(F.sum("paths").alias("paths"))
        front = cut(new.join(seen, ["root", "id"], "left_anti"))
        if front.isEmpty():
            break
        all_levels.append(front)
        seen = seen.unionByName(front.select("root", "id"))
    below = cut(all_levels[-1].withColumn("dep", F.lit(0.0)))
    parts = [below]
    for lv in reversed(all_levels[:-1]):
        share = below.select("root", F.col("id").alias("next"), ((1 + F.col("dep")) / F.col("paths")).alias("share"))
        dep = lv.join(step, "id").join(share, ["root", "next"]).groupBy("root", "id").agg(F.sum(F.col("paths") * F.col("share")).alias("dep"))
        below = cut(lv.join(dep, ["root", "id"], "left").select("root", "id", "paths", F.coalesce("dep", F.lit(0.0)).alias("dep")))
        parts.append(below)
    return union_all(parts).select("id", F.when(F.col("id") != F.col("root"), F.col("dep")).otherwise(0.0).alias("score"))
