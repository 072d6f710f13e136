"""Schema changes as functions from a graph to a new graph, and the checks
that stand for indexes: Spark keeps none, so an index is a promise that
``violations`` tests."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.plans.graph import EdgeTable, GraphError, PropertyGraph
from arcweave.sources.importer import TYPES

#: fixed values: names a property may not have
RESERVED = {"SRC_ID", "DST_ID", "SKIP"}


def _schema(fields: list[tuple[str, str]], meta: str) -> str:
    for name, kind in fields:
        if name in RESERVED or kind not in TYPES:
            raise GraphError(f"bad property {name} {kind}")
    return ", ".join([meta, *(f"`{n}` {TYPES[k]}" for n, k in fields)])


def create_vertex_label(g: PropertyGraph, label: str, primary: str, fields: list[tuple[str, str]]) -> PropertyGraph:
    """An empty label; ``fields`` are (name, type) with the types of imports."""
    if label in g.vertices:
        raise GraphError(f"{label} exists")
    if primary not in dict(fields):
        raise GraphError(f"no property {primary}")
    return g.with_vertices(label, g.spark.createDataFrame([], _schema(fields, "_id long")), primary)


def create_edge_label(g: PropertyGraph, label: str, pairs: list[tuple[str, str]], fields: list[tuple[str, str]], temporal: str | None = None) -> PropertyGraph:
    """An empty edge label between the given pairs of vertex labels; none
    means all pairs."""
    if label in g.edge_labels():
        raise GraphError(f"{label} exists")
    empty = g.spark.createDataFrame([], _schema(fields, "_eid long, _src long, _dst long"))
    for a, b in pairs or [(a, b) for a in g.vertices for b in g.vertices]:
        g = g.with_edges(label, a, b, empty, temporal)
    return g


def _frames(g: PropertyGraph, label: str) -> list:
    out = [g.vertices[label]] if label in g.vertices else [e for e in g.edges if e.label == label]
    if not out:
        raise GraphError(f"no label {label}")
    return out


def _put(g: PropertyGraph, table, df: DataFrame) -> PropertyGraph:
    if isinstance(table, EdgeTable):
        return replace(g, edges=tuple(replace(e, source=df) if e is table else e for e in g.edges))
    return replace(g, vertices={**g.vertices, table.label: replace(table, source=df)})


def add_fields(g: PropertyGraph, label: str, fields: list[tuple[str, str, object]]) -> PropertyGraph:
    """Add (name, type, value for the rows that exist)."""
    _schema([f[:2] for f in fields], "")
    for t in _frames(g, label):
        df = t.df
        for name, kind, value in fields:
            if name in df.columns:
                raise GraphError(f"{label} has {name}")
            df = df.withColumn(name, F.lit(value).cast(TYPES[kind]))
        g = _put(g, t, df)
    return g


def modify_fields(g: PropertyGraph, label: str, fields: list[tuple[str, str]]) -> PropertyGraph:
    """Give properties another type; values that don't fit become null."""
    for t in _frames(g, label):
        df = t.df
        for name, kind in fields:
            if name not in t.props:
                raise GraphError(f"{label} has no {name}")
            df = df.withColumn(name, F.col(f"`{name}`").try_cast(TYPES[kind]))
        g = _put(g, t, df)
    return g


def delete_fields(g: PropertyGraph, label: str, names: list[str]) -> PropertyGraph:
    for t in _frames(g, label):
        if getattr(t, "primary", None) in names or not set(names) <= set(t.props):
            raise GraphError(f"{names} can't be deleted from {label}")
        g = _put(g, t, t.df.drop(*names))
    return g


def delete_label(g: PropertyGraph, label: str) -> PropertyGraph:
    """Drop a label; with a vertex label the edges at it go too."""
    _frames(g, label)
    if label in g.vertices:
        return replace(g, vertices={k: v for k, v in g.vertices.items() if k != label}, edges=tuple(e for e in g.edges if label not in (e.src_label, e.dst_label)))
    return replace(g, edges=tuple(e for e in g.edges if e.label != label))


def add_index(g: PropertyGraph, label: str, fields: str | tuple[str, ...], unique: bool) -> PropertyGraph:
    """Promise an index on one or several fields (joined by commas in the catalog)."""
    names = (fields,) if isinstance(fields, str) else tuple(fields)
    v = g.vertices[label]
    if not set(names) <= set(v.props):
        raise GraphError(f"{label} has no {names}")
    if unique and not violations(g, label, names).isEmpty():
        raise GraphError(f"{names} is not unique in {label}")
    return replace(g, vertices={**g.vertices, label: replace(v, indexes=(*v.indexes, (",".join(names), unique)))})


def delete_index(g: PropertyGraph, label: str, fields: str) -> PropertyGraph:
    v = g.vertices[label]
    return replace(g, vertices={**g.vertices, label: replace(v, indexes=tuple(i for i in v.indexes if i[0] != fields))})


def violations(g: PropertyGraph, label: str, fields: tuple[str, ...]) -> DataFrame:
    """Values of the fields that several rows share; nulls don't count."""
    df = _frames(g, label)[0].df.dropna(subset=list(fields))
    return df.groupBy(*fields).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def index_range(g: PropertyGraph, label: str, field: str, low, high) -> DataFrame:
    """``value, vid`` in the order of a field, between two bounds."""
    col = F.col(f"`{field}`")
    return g.vertices[label].df.filter(col.between(low, high)).select(col.alias("value"), F.col("_id").alias("vid")).orderBy("value", "vid")
