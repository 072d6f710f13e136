"""Procedures for CALL: catalog, paths, vectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.plans.graph import GraphError, PropertyGraph


@dataclass(frozen=True)
class Procedure:
    name: str
    call: Callable[[PropertyGraph, list], DataFrame] | None = None
    rows: Callable | None = None  # (compiler, scope, arguments) -> (frame, join columns, results)

    @property
    def by_row(self) -> bool:
        return self.rows is not None


PROCEDURES: dict[str, Procedure] = {}


def procedure(name: str) -> Callable:
    def add(f: Callable[[PropertyGraph, list], DataFrame]) -> Callable:
        PROCEDURES[name.lower()] = Procedure(name, call=f)
        return f

    return add


def register(name: str, f: Callable[[PropertyGraph, list], DataFrame]) -> None:
    """Add a procedure of one's own: arguments in, DataFrame out."""
    PROCEDURES[name.lower()] = Procedure(name, call=f)


def _frame(g: PropertyGraph, rows: list[tuple], schema: str) -> DataFrame:
    return g.spark.createDataFrame(rows, schema)


@procedure("db.vertexLabels")
def vertex_labels(g: PropertyGraph, args: list) -> DataFrame:
    return _frame(g, [(x,) for x in sorted(g.vertices)], "label string")


@procedure("db.edgeLabels")
def edge_labels(g: PropertyGraph, args: list) -> DataFrame:
    return _frame(g, [(x,) for x in g.edge_labels()], "label string")


@procedure("db.indexes")
def indexes(g: PropertyGraph, args: list) -> DataFrame:
    rows = [(v.label, v.primary, "vertex", True) for v in g.vertices.values() if v.primary] + [(v.label, f, "vertex", u) for v in g.vertices.values() for f, u in v.indexes]
    return _frame(g, rows, "label string, field string, label_type string, unique boolean")


@procedure("db.listLabelIndexes")
def label_indexes(g: PropertyGraph, args: list) -> DataFrame:
    return indexes(g, []).filter(F.col("label") == args[0])


@procedure("db.getLabelSchema")
def label_schema(g: PropertyGraph, args: list) -> DataFrame:
    kind, label = (args[0], args[1]) if len(args) > 1 else ("vertex", args[0])
    if str(kind).lower().startswith("v"):
        df, meta = g.vertices[label].df, ("_id",)
    else:
        df, meta = next(e for e in g.edges if e.label == label).df, ("_eid", "_src", "_dst")
    return _frame(g, [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema if f.name not in meta], "name string, type string, optional boolean")


@procedure("db.getEdgeConstraints")
def edge_constraints(g: PropertyGraph, args: list) -> DataFrame:
    return _frame(g, [(e.label, e.src_label, e.dst_label) for e in g.edges if not args or e.label == args[0]], "label string, src string, dst string")


@procedure("dbms.procedures")
def procedures(g: PropertyGraph, args: list) -> DataFrame:
    return _frame(g, [(p.name,) for p in sorted(PROCEDURES.values(), key=lambda p: p.name)], "name string")


@procedure("dbms.meta.count")
def meta_count(g: PropertyGraph, args: list) -> DataFrame:
    d = count_detail(g, [])
    return d.groupBy(F.when(F.col("isVertex"), "vertex").otherwise("edge").alias("type")).agg(F.sum("count").alias("number"))


@procedure("dbms.meta.countDetail")
def count_detail(g: PropertyGraph, args: list) -> DataFrame:
    parts = [(True, v.label, v.df) for v in g.vertices.values()] + [(False, e.label, e.df) for e in g.edges]
    out = None
    for is_vertex, label, df in parts:
        one = df.groupBy().agg(F.count(F.lit(1)).alias("count")).select(F.lit(is_vertex).alias("isVertex"), F.lit(label).alias("label"), "count")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("isVertex", "label").agg(F.sum("count").alias("count"))


@procedure("db.subgraph")
def subgraph(g: PropertyGraph, args: list) -> DataFrame:
    """The edges between the given vertices."""
    ids = [int(x) for x in args[0]]
    out = None
    for e in g.edges:
        one = e.df.filter(F.col("_src").isin(*ids) & F.col("_dst").isin(*ids)).select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), F.lit(e.label).alias("label"), F.col("_eid").alias("eid"))
        out = one if out is None else out.unionByName(one)
    return out


def _path_rows(every: bool) -> Callable:
    def rows(compiler: Any, s: Any, args: list) -> tuple[DataFrame, list[str], list[str]]:
        from arcweave.algo.paths import shortest_paths
        from arcweave.plans.compiler import Node, c

        a, b = (s.names.get(getattr(x, "name", None)) for x in args[:2])
        if not isinstance(a, Node) or not isinstance(b, Node):
            raise GraphError("shortest paths lead from a vertex to a vertex")
        options = compiler.constant(args[2]) if len(args) > 2 else {}
        labels = options.get("relationshipQuery") or options.get("relationship_filter")
        labels = [labels] if isinstance(labels, str) and labels else labels or None
        pairs = s.df.select(c(a.id).alias("src"), c(b.id).alias("dst")).distinct()
        found = shortest_paths(g_edges(compiler.g, labels), pairs, int(options.get("maxHops", 20)), options.get("direction", "BOTH"), every)
        found = found.select(F.col("src").alias(a.id), F.col("dst").alias(b.id), F.col("hops").cast("long").alias("length@y"), F.col("hops").cast("double").alias("totalCost@y"), (F.col("hops") + 1).cast("long").alias("nodeCount@y"), F.col("nodes").alias("nodeIds@y"), F.col("nodes").alias("path@y"))
        return found, [a.id, b.id], ["length", "totalCost", "nodeCount", "nodeIds", "path"]

    return rows


def g_edges(g: PropertyGraph, labels: list[str] | None) -> DataFrame:
    return g.all_edges(labels)


PROCEDURES["algo.shortestpath"] = Procedure("algo.shortestPath", rows=_path_rows(False))
PROCEDURES["algo.allshortestpaths"] = Procedure("algo.allShortestPaths", rows=_path_rows(True))


@procedure("algo.pagerank")
def pagerank(g: PropertyGraph, args: list) -> DataFrame:
    from arcweave.algo import ranks

    return ranks.pagerank(g.all_edges(), g.all_vertices().select(F.col("_id").alias("id")), int(args[0]) if args else 20).select(F.col("id").alias("node"), F.col("rank").alias("pr"))


@procedure("algo.jaccard")
def jaccard(g: PropertyGraph, args: list) -> DataFrame:
    a, b = set(args[0]), set(args[1])
    return _frame(g, [(len(a & b) / len(a | b) if a | b else 1.0,)], "similarity double")


@procedure("db.showVertexVectorIndex")
def vector_indexes(g: PropertyGraph, args: list) -> DataFrame:
    """A row per vector index; ``elements_num`` counts the vectors of its dimension."""
    schema = "label_name string, field_name string, dimension long, distance_type string, elements_num long"
    rows = [(v.label, f, d, kind, v.df.filter(F.size(f"`{f}`") == d).count()) for v in g.vertices.values() for f, d, kind in v.vectors]
    return _frame(g, rows, schema)


def _extract(compiler: Any, s: Any, args: list) -> tuple[DataFrame, list[str], list[str]]:
    """``value``: one property of the vertex or edge whose id is given."""
    from arcweave.plans.compiler import Node, Value, c

    g, options = compiler.g, compiler.constant(args[1])
    field = options["field"]
    if options.get("isNode", True):
        ids = g.all_vertices().select(F.col("_id").alias("key"), (F.col(f"`{field}`") if field in g.vertex_props(set(g.vertices)) else F.lit(None)).alias("value@y"))
    else:
        tables = [e for e in g.edges if field in e.props]
        if not tables:
            raise GraphError(f"no edge has {field}")
        ids = None
        for e in tables:
            one = e.df.select(F.concat_ws("_", "_src", "_dst", F.lit(e.label), F.lit("0"), "_eid").alias("key"), F.col(f"`{field}`").alias("value@y"))
            ids = one if ids is None else ids.unionByName(one)
    b = s.names.get(getattr(args[0], "name", None))
    if isinstance(b, (Node, Value)):
        on = b.id if isinstance(b, Node) else b.col
        return ids.withColumnRenamed("key", on), [on], ["value"]
    return ids.filter(F.col("key") == compiler.constant(args[0])).drop("key"), [], ["value"]


PROCEDURES["algo.native.extract"] = Procedure("algo.native.extract", rows=_extract)


def _vector_args(g: PropertyGraph, args: list) -> tuple[DataFrame, str, list[float], dict]:
    label, prop, query, options = args[0], args[1], args[2], args[3] if len(args) > 3 else {}
    v = g.vertices[label]
    for f, dimension, kind in v.vectors:
        if f == prop:
            options = {"distance_type": kind, **options}
            if len(query) != dimension:
                raise GraphError(f"{label}.{prop} has {dimension} dimensions, not {len(query)}")
    return v.df, prop, [float(x) for x in query], options


def _with_nodes(g: PropertyGraph, label: str, found: DataFrame) -> DataFrame:
    """``vid, distance, node`` in the order of distance."""
    v = g.vertices[label]
    node = v.df.select(F.col("_id").alias("vid"), F.struct(F.col("_id").alias("identity"), F.lit(label).alias("label"), F.struct(*[F.col(f"`{p}`") for p in v.props]).alias("properties")).alias("node"))
    return found.join(node, "vid").select("vid", "distance", "node").orderBy("distance", "vid")


@procedure("db.vertexVectorKnnSearch")
def knn(g: PropertyGraph, args: list) -> DataFrame:
    from arcweave.operators.vectors import knn_search

    df, prop, query, options = _vector_args(g, args)
    return knn_search(df, "_id", prop, query, int(options.get("top_k", 10)), options.get("distance_type", "l2")).select(F.col("_id").alias("vid"), "distance").transform(lambda x: _with_nodes(g, args[0], x))


@procedure("db.vertexVectorRangeSearch")
def range_search(g: PropertyGraph, args: list) -> DataFrame:
    from arcweave.operators.vectors import range_search as search

    df, prop, query, options = _vector_args(g, args)
    out = search(df, "_id", prop, query, float(options["radius"]), options.get("distance_type", "l2"))
    out = out.orderBy("distance", "_id").limit(int(options["limit"])) if options.get("limit") else out
    return _with_nodes(g, args[0], out.select(F.col("_id").alias("vid"), "distance"))
