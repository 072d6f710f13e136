"""Components and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.algo.base import both_ways, ends, number
from arcweave.runtime import cut


def wcc(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``id, component``: the smallest id of the weakly connected component.

    Large-star and small-star steps by turns: every step links neighbours to
    the smallest vertex known around them, so the number of rounds grows with
    the logarithm of the size, not with the diameter.
    """
    vertices = ends(edges) if vertices is None else vertices
    e = cut(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    while True:
        # large star: greater neighbours to the smallest of the neighbourhood
        around = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        # small star: smaller neighbours, and the vertex itself, to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u")
        small = linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = cut(small.filter("u <> v"))
        same = new.count() == e.count() and new.join(e, ["u", "v"], "left_anti").isEmpty()
        e = new
        if same:
            break
    return vertices.join(e.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def scc(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``id, component``: the smallest id of the strongly connected component.

    Vertices without in- or out-edges among the rest are components by
    themselves; the rest is coloured by the smallest id that reaches a vertex,
    and what reaches a colour's origin inside its colour is its component.
    """
    vertices = ends(edges) if vertices is None else vertices
    left = cut(vertices.select("id").distinct())
    e = cut(edges.filter("src <> dst").select("src", "dst").distinct())
    done = None

    def finish(x: DataFrame) -> None:
        nonlocal done, left, e
        x = cut(x)
        done = x if done is None else done.unionByName(x)
        left = cut(left.join(x, "id", "left_anti"))
        keep = left.select("id")
        e = cut(e.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi"))

    first = True
    while not left.isEmpty():
        size = e.count()
        while size:  # trim: keep edges between vertices that have both in- and out-edges
            keep = e.select(F.col("src").alias("id")).distinct().join(e.select(F.col("dst").alias("id")).distinct(), "id")
            new = cut(e.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi"))
            before, size, e = size, new.count(), new
            if size == before:
                break
        finish(left.join(ends(e), "id", "left_anti").select("id", F.col("id").alias("component")))
        if left.isEmpty():
            break
        if first:  # most vertices lie in one component: that of the vertex of most edges in and out
            first = False
            outs, ins = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o")), e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i"))
            pivot = outs.join(ins, "id").orderBy(F.desc(F.col("o") * F.col("i")), "id").select("id").limit(1)
            down, up = _reach(e, pivot), _reach(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), pivot)
            giant = cut(down.join(up, "id"))
            finish(giant.crossJoin(F.broadcast(giant.agg(F.min("id").alias("component")))))  # one row
            continue
        colour = _spread(e, left.select("id", F.col("id").alias("c")))
        inner = e.join(colour.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst").filter("a = b").select("src", "dst")
        inner = cut(inner)
        reach = front = cut(colour.filter("id = c").select("id", "c"))
        while True:
            front = cut(front.join(inner, front["id"] == inner["dst"]).select(F.col("src").alias("id"), "c").distinct().join(reach, "id", "left_anti"))
            if front.isEmpty():
                break
            reach = cut(reach.unionByName(front))
        finish(reach.select("id", F.col("c").alias("component")))
    empty = vertices.select("id", F.col("id").alias("component")).limit(0)
    return done if done is not None else empty


def _reach(e: DataFrame, start: DataFrame) -> DataFrame:
    """The vertices reached from ``start`` (``id``), itself included."""
    seen = front = cut(start)
    while True:
        front = cut(front.join(e, front["id"] == e["src"]).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))


def _spread(e: DataFrame, start: DataFrame) -> DataFrame:
    """The smallest ``c`` that reaches each vertex."""
    state = cut(start)
    while True:
        got = state.join(e, state["id"] == e["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("g"))
        new = cut(state.join(got, "id", "left").select("id", F.least("c", "g").alias("c"), (F.col("g") < F.col("c")).alias("moved")))
        state = new.select("id", "c")
        if new.filter("moved").isEmpty():
            return state


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Of ``id, label`` over undirected edges (``weight`` if there is one)."""
    w = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    e = both_ways(edges.select("src", "dst", w.alias("weight")))
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("a")), labels.select(F.col("id").alias("dst"), F.col("label").alias("b"))
    per = e.join(a, "src").join(b, "dst").groupBy("a").agg(F.sum("weight").alias("deg"), F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("inside"))
    r = per.agg(F.sum("deg").alias("m2"), F.sum("inside").alias("inside"), F.sum(F.col("deg") * F.col("deg")).alias("sq")).first()
    return r["inside"] / r["m2"] - r["sq"] / r["m2"] ** 2 if r["m2"] else 0.0


def label_propagation(edges: DataFrame, iterations: int = 20, weighted: bool = False, vertices: DataFrame | None = None) -> DataFrame:
    """``id, label``: all vertices at once take the label that most of their
    undirected neighbours (parallel edges counted, or weights summed) have, the
    smallest at ties; the own label counts once (unweighted)."""
    vertices = ends(edges) if vertices is None else vertices
    w = F.col("weight") if weighted else F.lit(1.0)
    e = cut(both_ways(edges.select("src", "dst", w.alias("w"))).groupBy("src", "dst").agg(F.sum("w").alias("w")))
    state = cut(vertices.select("id", F.col("id").alias("label")))
    for _ in range(iterations):
        votes = e.join(state.select(F.col("id").alias("dst"), "label"), "dst").select(F.col("src").alias("id"), "label", "w")
        if not weighted:
            has = e.select(F.col("src").alias("id")).distinct()
            votes = votes.unionByName(state.join(has, "id", "left_semi").select("id", "label", F.lit(1.0).alias("w")))
        tally = votes.groupBy("id", "label").agg(F.sum("w").alias("w"))
        best = tally.groupBy("id").agg(F.max(F.struct("w", (-F.col("label")).alias("l"))).alias("x")).select("id", (-F.col("x.l")).alias("new"))
        new = cut(state.join(best, "id", "left").select("id", F.coalesce("new", "label").alias("label"), (F.col("new") != F.col("label")).alias("moved")))
        state = new.select("id", "label")
        if new.filter("moved").isEmpty():
            break
    return state


def speaker_listener(edges: DataFrame, iterations: int = 20, threshold: float = 0.1, seed: int = 0) -> DataFrame:
    """``id, label, share``: overlapping communities. In a round every vertex
    speaks one label of its memory, chosen by a seeded hash in proportion to
    its count; every listener remembers what it hears most."""
    e = cut(both_ways(edges.filter("src <> dst").select("src", "dst")))
    memory = cut(ends(edges).select("id", F.col("id").alias("label"), F.lit(1).cast("long").alias("n")))
    for i in range(iterations):
        u = (F.pmod(F.xxhash64("id", "label", F.lit(seed), F.lit(i)), F.lit(1 << 30)) + 0.5) / F.lit(float(1 << 30))
        spoken = memory.groupBy("id").agg(F.max(F.struct((F.log(u) / F.col("n")).alias("key"), F.col("label"))).alias("x")).select(F.col("id").alias("dst"), F.col("x.label").alias("label"))
        heard = e.join(spoken, "dst").groupBy(F.col("src").alias("id"), "label").count()
        kept = heard.groupBy("id").agg(F.max(F.struct("count", (-F.col("label")).alias("l"))).alias("x")).select("id", (-F.col("x.l")).alias("label"), F.lit(1).cast("long").alias("n"))
        memory = cut(memory.unionByName(kept).groupBy("id", "label").agg(F.sum("n").alias("n")), replaces=memory)
    total = memory.groupBy("id").agg(F.sum("n").alias("all"))
    return memory.join(total, "id").select("id", "label", (F.col("n") / F.col("all")).alias("share")).filter(F.col("share") >= threshold)


def _move(e: DataFrame, state: DataFrame, m2: float, gamma: float, rounds: int, inside: DataFrame | None, seed: int) -> DataFrame:
    """Local moves. ``e``: ``src, dst, w`` both ways; ``state``: ``id, label,
    k`` (weighted degree). In a round a hashed half of the vertices takes the
    neighbouring label of greatest gain, the smallest at ties, if that beats
    staying. ``inside``: ``id, outer``; labels are taken within it only."""
    links = e.filter("src <> dst")
    if inside is not None:
        a, b = inside.select(F.col("id").alias("src"), F.col("outer").alias("oa")), inside.select(F.col("id").alias("dst"), F.col("outer").alias("ob"))
        links = cut(links.join(a, "src").join(b, "dst").filter("oa = ob").select("src", "dst", "w"))
    still = 0
    for r in range(rounds):
        total = state.groupBy("label").agg(F.sum("k").alias("tot"), F.count("*").alias("members"))
        turn = F.pmod(F.xxhash64("id", F.lit(r), F.lit(seed)), F.lit(2)) == 0
        near = links.join(state.select(F.col("id").alias("dst"), F.col("label").alias("cand")), "dst").groupBy(F.col("src").alias("id"), "cand").agg(F.sum("w").alias("win"))
        own = state.select("id", F.col("label").alias("cand"), F.lit(0.0).alias("win"))
        options = near.unionByName(own).groupBy("id", "cand").agg(F.sum("win").alias("win"))
        scored = options.join(state.filter(turn), "id").join(total.select(F.col("label").alias("cand"), "tot", "members"), "cand", "left")
        others = F.col("tot") - F.when(F.col("cand") == F.col("label"), F.col("k")).otherwise(0.0)
        scored = scored.withColumn("gain", F.round(F.col("win") - gamma * F.col("k") * others / m2, 9))
        best = scored.groupBy("id").agg(F.max(F.struct("gain", (-F.col("cand")).alias("c"))).alias("x"), F.max(F.when(F.col("cand") == F.col("label"), F.col("gain"))).alias("stay"))
        best = best.filter(F.col("x.gain") > F.col("stay")).select("id", (-F.col("x.c")).alias("new"))
        new = cut(state.join(best, "id", "left").select("id", F.coalesce("new", "label").alias("label"), "k", F.col("new").isNotNull().alias("moved")))
        state = new.drop("moved")
        still = 0 if not new.filter("moved").isEmpty() else still + 1
        if still == 2:  # neither half wants to move
            break
    return state


def _levels(edges: DataFrame, gamma: float, rounds: int, levels: int, refine: bool, seed: int) -> DataFrame:
    w = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    e = cut(both_ways(edges.select("src", "dst", w.cast("double").alias("w"))).groupBy("src", "dst").agg(F.sum("w").alias("w")))
    m2 = number(e, F.sum("w"))
    place = cut(ends(edges).select("id", F.col("id").alias("at")))  # where each vertex is in the contracted graph
    labels = place.select("id", F.col("at").alias("label"))
    if not m2:
        return labels
    start = None
    best = -1.0
    for level in range(levels):
        k = e.groupBy("src").agg(F.sum("w").alias("k")).select(F.col("src").alias("id"), "k")
        state = k.select("id", F.col("id").alias("label"), "k") if start is None else k.join(start, "id").select("id", "label", "k")
        moved = _move(e, cut(state), m2, gamma, rounds, None, seed + level)
        q = modularity(e.select("src", "dst", (F.col("w") / 2).alias("weight")), moved.select("id", "label"))
        if q <= best + 1e-7:
            break
        best = q
        labels = cut(place.join(moved.select(F.col("id").alias("at"), "label"), "at").select("id", "label"))
        if refine:
            single = cut(moved.select("id", F.col("id").alias("label"), "k"))
            parts = _move(e, single, m2, gamma, max(2, rounds // 2), moved.select("id", F.col("label").alias("outer")), seed + 100 + level).select("id", F.col("label").alias("part"))
            parts = cut(parts)
            start = cut(parts.join(moved.select("id", "label"), "id").groupBy("part").agg(F.min("label").alias("label")).select(F.col("part").alias("id"), "label"))
            # a label is named by one of its parts
            name = start.groupBy("label").agg(F.min("id").alias("name"))
            start = cut(start.join(name, "label").select("id", F.col("name").alias("label")))
        else:
            parts = moved.select("id", F.col("label").alias("part"))
        a, b = parts.select(F.col("id").alias("src"), F.col("part").alias("a")), parts.select(F.col("id").alias("dst"), F.col("part").alias("b"))
        e = cut(e.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
        place = cut(place.join(parts.select(F.col("id").alias("at"), "part"), "at").select("id", F.col("part").alias("at")))
    return labels


def louvain(edges: DataFrame, rounds: int = 12, levels: int = 6, seed: int = 0) -> DataFrame:
    """``id, label`` by local moves and contraction, level by level."""
    return _levels(edges, 1.0, rounds, levels, False, seed)


def leiden(edges: DataFrame, gamma: float = 1.0, rounds: int = 12, levels: int = 6, seed: int = 0) -> DataFrame:
    """As ``louvain``, but the contracted graph is made of parts that local
    moves form inside each community, so communities can be taken apart again."""
    return _levels(edges, gamma, rounds, levels, True, seed)


