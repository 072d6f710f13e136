"""Graph sampling, repeatable by seeded hashes instead of random numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcweave.algo.base import both_ways
from arcweave.runtime import cut


def _coin(seed: int, *cols: Column | str) -> Column:
    """A number in (0, 1) per row."""
    return (F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))


def neighbor_sample(edges: DataFrame, seeds: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``src, dst``: at most n distinct out-neighbours of each seed (``id``)."""
    e = edges.select("src", "dst").distinct().join(seeds.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    w = Window.partitionBy("src").orderBy(F.xxhash64("src", "dst", F.lit(seed)), "dst")
    return e.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= n).drop("at")


def edge_sample(edges: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Each edge (``eid`` tells parallel ones apart) with chance ``rate``."""
    keys = ["src", "dst"] + (["eid"] if "eid" in edges.columns else [])
    return edges.filter(_coin(seed, *keys) < rate)


#: Parts in which vertices are numbered (their sizes reach the driver).
PARTS = 1024


def _numbered(ids: DataFrame) -> tuple[DataFrame, int]:
    """``no, id``: the vertices numbered from 0 on, and how many there are."""
    parts = ids.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int"))
    sizes = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row per part
    start, at = {}, 0
    for p in sorted(sizes):
        start[p] = at
        at += sizes[p]
    base = F.create_map(*[F.lit(x) for kv in (start or {0: 0}).items() for x in kv])
    w = Window.partitionBy("part").orderBy("id")
    return cut(parts.select((base[F.col("part")] + F.row_number().over(w) - 1).cast("long").alias("no"), "id")), at


def negative_sample(edges: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``src, dst``: n ordered pairs of different vertices without an edge
    between them, all of them if the graph has no more.

    Pairs of hashed vertices are drawn and edges taken away until there are
    enough. Where edges leave little room, or most of it is asked for, drawing
    would hardly end: there all pairs are gone through, which are no more than
    a fixed multiple of the edges or of the answer.
    """
    spark = edges.sparkSession
    e = edges.select("src", "dst").filter("src is not null and dst is not null")
    dense, size = _numbered(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    real = cut(e.filter("src <> dst").distinct())
    room = size * (size - 1) - real.count()
    n = min(n, room)
    if n <= 0:
        return e.limit(0)
    src, dst = dense.select(F.col("no").alias("a"), F.col("id").alias("src")), dense.select(F.col("no").alias("b"), F.col("id").alias("dst"))
    named = lambda pairs: pairs.filter("a <> b").join(src, "a").join(dst, "b").select("src", "dst").join(real, ["src", "dst"], "left_anti")
    if 4 * room < size * size or 2 * n > room:
        found = named(spark.range(size * size).select(F.expr(f"id div {size}").alias("a"), (F.col("id") % size).alias("b")))
    else:
        found, drawn = None, 0
        while True:  # at least every eighth draw is a new pair
            take = 2 * n + 16
            draw = spark.range(drawn, drawn + take).select((_coin(seed, "id") * size).cast("long").alias("a"), (_coin(seed + 1, "id") * size).cast("long").alias("b"))
            drawn += take
            pairs = named(draw)
            found = cut((pairs if found is None else found.unionByName(pairs)).distinct(), replaces=found)
            if found.count() >= n:
                break
    return found.orderBy(F.xxhash64("src", "dst", F.lit(seed)), "src", "dst").limit(n)


def random_walk(edges: DataFrame, seeds: DataFrame, steps: int, seed: int = 0) -> DataFrame:
    """``walk_id, nodes``: one walk of at most ``steps`` out-edges per seed; it
    ends early where there is none. Parallel edges raise the chance."""
    return node2vec(edges, seeds, steps, 1.0, 1.0, seed, directed=True)


#: Parts over which a vertex's edges are numbered, so that no hub is one task.
HUB_PARTS = 64
#: Proposals that a walk draws at once where it may reject some.
PROPOSALS = 8


def _ranked(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``src, no, dst``: the edges of each vertex numbered from 0 on (parallel
    ones each), and ``src, degree``."""
    e = edges.withColumn("part", F.pmod(F.xxhash64("src", "dst"), F.lit(HUB_PARTS)).cast("int"))
    sizes = cut(e.groupBy("src", "part").agg(F.count("*").alias("n")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.select("src", "part", before.alias("first"))
    inside = e.withColumn("at", F.row_number().over(Window.partitionBy("src", "part").orderBy("dst")) - 1)
    return cut(inside.join(first, ["src", "part"]).select("src", (F.col("first") + F.col("at")).cast("long").alias("no"), "dst")), cut(sizes.groupBy("src").agg(F.sum("n").alias("degree")))


def node2vec(edges: DataFrame, seeds: DataFrame, steps: int, p: float, q: float, seed: int = 0, directed: bool = False) -> DataFrame:
    """``walk_id, nodes``: walks biased by weights 1/p back to the last vertex,
    1 to neighbours of the last vertex, 1/q elsewhere.

    Edges are numbered per vertex once. A step draws a number below the degree
    and joins the one edge of that number, so it costs a row per walk however
    many edges a vertex has. A biased walk draws several edges and takes the
    first that passes a coin of its weight over the greatest one; walks that
    reject them all draw again.
    """
    e = edges.select("src", "dst").filter("src is not null and dst is not null")
    e = e if directed else both_ways(e)
    ranked, degrees = _ranked(e)
    real = cut(ranked.select(F.col("src").alias("prev"), "dst", F.lit(True).alias("near")).distinct()) if p != 1.0 or q != 1.0 else None
    alive = cut(seeds.filter("id is not null").select(F.col("id").alias("walk_id"), F.array("id").alias("nodes")).distinct())
    ended = []
    for i in range(steps):
        here = alive.withColumn("src", F.element_at("nodes", -1)).join(degrees, "src", "left")
        ended.append(here.filter("degree is null").select("walk_id", "nodes"))
        here = cut(here.filter("degree is not null"))
        biased, moved, again = bool(i) and real is not None, None, 0
        while True:
            tries = here.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(PROPOSALS - 1)))) if biased else here.withColumn("try", F.lit(0))
            tries = tries.withColumn("no", (_coin(seed, "walk_id", F.lit(i), F.lit(again), "try") * F.col("degree")).cast("long")).join(ranked, ["src", "no"])
            if biased:
                tries = tries.withColumn("prev", F.element_at("nodes", -2)).join(real, ["prev", "dst"], "left")
                weight = F.when(F.col("dst") == F.col("prev"), 1.0 / p).when(F.col("near"), 1.0).otherwise(1.0 / q)
                tries = tries.filter(_coin(seed + 1, "walk_id", F.lit(i), F.lit(again), "try") * max(1.0 / p, 1.0, 1.0 / q) < weight)
            best = tries.groupBy("walk_id").agg(F.min(F.struct("try", "dst", "nodes")).alias("b")).select("walk_id", F.concat("b.nodes", F.array("b.dst")).alias("nodes"))
            new = cut(best)
            moved = new if moved is None else moved.unionByName(new)
            if not biased:
                break
            here = cut(here.join(new, "walk_id", "left_anti"), replaces=here)
            if here.isEmpty():
                break
            again += 1
        alive = moved
        if alive.isEmpty():
            break
    out = alive
    for x in ended:
        out = out.unionByName(x)
    return out
