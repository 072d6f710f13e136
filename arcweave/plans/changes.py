"""Procedures of CALL that change the graph: labels, fields, indexes, upserts.
They are functions from a graph to a new one, so they run in ``graph.update``;
``(g, arguments) -> (g, counts)``."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from arcweave.plans import ddl
from arcweave.plans.graph import GraphError, PropertyGraph
from arcweave.plans.updates import upsert_edges, upsert_vertices

Change = Callable[[PropertyGraph, list], tuple[PropertyGraph, dict[str, int]]]
CHANGES: dict[str, Change] = {}
#: fixed value: the dimension of a vector index that names none
DIMENSION = 128


def change(*names: str) -> Callable[[Change], Change]:
    def add(f: Change) -> Change:
        CHANGES.update({n.lower(): f for n in names})
        return f

    return add


def _fields(flat: list) -> list[tuple[str, str]]:
    """Names and types out of ``name, type, optional, name, type, ...``."""
    if len(flat) % 3:
        raise GraphError("fields are given as name, type and whether they may be null")
    return [(flat[i], str(flat[i + 1]).upper()) for i in range(0, len(flat), 3)]


@change("db.createVertexLabel")
def create_vertex_label(g: PropertyGraph, args: list) -> tuple[PropertyGraph, dict[str, int]]:
    return ddl.create_vertex_label(g, args[0], args[1], _fields(args[2:])), {}


@change("db.createVertexLabelByJson")
def create_vertex_label_json(g: PropertyGraph, args: list) -> tuple[PropertyGraph, dict[str, int]]:
    s = json.loads(args[0])
    return ddl.create_vertex_label(g, s["label"], s["primary"], [(p["name"], p["type"].upper()) for p in s["properties"]]), {}


@change("db.createEdgeLabel")
def create_edge_label(g: PropertyGraph, args: list) -> tuple[PropertyGraph, dict[str, int]]:
    pairs = json.loads(args[1]) if isinstance(args[1], str) else args[1]
    return ddl.create_edge_label(g, args[0], [tuple(p) for p in pairs], _fields(args[2:])), {}


@change("db.createEdgeLabelByJson")
def create_edge_label_json(g: PropertyGraph, args: list) -> tuple[PropertyGraph, dict[str, int]]:
    s = json.loads(args[0])
    return ddl.create_edge_label(g, s["label"], [tuple(p) for p in s.get("constraints", [])], [(p["name"], p["type"].upper()) for p in s.get("properties", [])], s.get("temporal")), {}


def _rows_of(g: PropertyGraph, label: str) -> int:
    return sum(t.df.count() for t in [*(v for v in g.vertices.values() if v.label == label), *(e for e in g.edges if e.label == label)])


@change("db.deleteLabel")
def delete_label(g: PropertyGraph, args: list) -> tuple[PropertyGraph, dict[str, int]]:
    return ddl.delete_label(g, args[1]), {"record_affected": _rows_of(g, args[1])}


@change("db.alterLabelAddFields")
def add_fields(g: PropertyGraph, args: list) -> tuple[PropertyGraph, dict[str, int]]:
    """Each further argument: name, type, value for the rows there are, and whether null is allowed."""
    return ddl.add_fields(g, args[1], [(f[0], str(f[1]).upper(), f[2]) for f in args[2:]]), {"record_affected": _rows_of(g, args[1])}


@change("db.alterLabelModFields")
def modify_fields(g: PropertyGraph, args: list) -> tuple[PropertyGraph, dict[str, int]]:
    return ddl.modify_fields(g, args[1], [(f[0], str(f[1]).upper()) for f in args[2:]]), {"record_affected": _rows_of(g, args[1])}


@change("db.alterLabelDelFields")
def delete_fields(g: PropertyGraph, args: list) -> tuple[PropertyGraph, dict[str, int]]:
    g2 = ddl.delete_fields(g, args[1], args[2])
    if args[1] in g2.vertices:
        v = g2.vertices[args[1]]
        v = replace(v, indexes=tuple(i for i in v.indexes if not set(i[0].split(",")) & set(args[2])), vectors=tuple(x for x in v.vectors if x[0] not in args[2]))
        g2 = replace(g2, vertices={**g2.vertices, v.label: v})
    return g2, {"record_affected": _rows_of(g, args[1])}


@change("db.addIndex")
def add_index(g: PropertyGraph, args: list) -> tuple[PropertyGraph, dict[str, int]]:
    return ddl.add_index(g, args[0], args[1], bool(args[2])), {}


@change("db.addVertexCompositeIndex")
def add_composite_index(g: PropertyGraph, args: list) -> tuple[PropertyGraph, dict[str, int]]:
    return ddl.add_index(g, args[0], tuple(args[1]), bool(args[2])), {}


@change("db.deleteIndex", "db.deleteCompositeIndex")
def delete_index(g: PropertyGraph, args: list) -> tuple[PropertyGraph, dict[str, int]]:
    return ddl.delete_index(g, args[0], args[1] if isinstance(args[1], str) else ",".join(args[1])), {}


@change("db.addVertexVectorIndex")
def add_vector_index(g: PropertyGraph, args: list) -> tuple[PropertyGraph, dict[str, int]]:
    """Searches stay exact scans; the index gives its field's dimension and distance."""
    label, field, options = args[0], args[1], args[2] if len(args) > 2 else {}
    v = g.vertices[label]
    if not isinstance(v.props.get(field), T.ArrayType):
        raise GraphError("only FLOAT_VECTOR fields take a vector index")
    if any(x[0] == field for x in v.vectors):
        raise GraphError(f"{label}.{field} has a vector index")
    v = replace(v, vectors=(*v.vectors, (field, int(options.get("dimension", DIMENSION)), str(options.get("distance_type", "l2")).lower())))
    return replace(g, vertices={**g.vertices, label: v}), {}


@change("db.deleteVertexVectorIndex")
def delete_vector_index(g: PropertyGraph, args: list) -> tuple[PropertyGraph, dict[str, int]]:
    v = g.vertices[args[0]]
    return replace(g, vertices={**g.vertices, v.label: replace(v, vectors=tuple(x for x in v.vectors if x[0] != args[1]))}), {}


def _value(v: Any, t: T.DataType) -> Any:
    if v is None:
        return None
    if isinstance(t, T.ArrayType):
        return [_value(x, t.elementType) for x in v]
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return float(v)
    return v


def _frames(g: PropertyGraph, rows: list[dict], types: dict[str, T.DataType]) -> list[DataFrame]:
    """The literal rows of a call, one frame per set of given fields, so that
    what a row doesn't name stays as it is."""
    groups: dict[tuple, list[dict]] = {}
    for r in rows:
        groups.setdefault(tuple(p for p in types if p in r), []).append(r)
    simple = {p: t if isinstance(t, (T.ArrayType, T.StringType, T.BooleanType, T.FloatType, T.DoubleType, T.IntegralType)) else T.StringType() for p, t in types.items()}
    return [g.spark.createDataFrame([tuple(_value(r[p], simple[p]) for p in given) for r in mine], T.StructType([T.StructField(p, simple[p]) for p in given])) for given, mine in groups.items() if given]


def _sum(all_counts: list[dict[str, int]]) -> dict[str, int]:
    return {k: sum(c[k] for c in all_counts) for k in ("total", "insert", "update", "data_error", "index_conflict")} if all_counts else {}


@change("db.upsertVertex", "db.upsertVertexByJson")
def upsert_vertex(g: PropertyGraph, args: list) -> tuple[PropertyGraph, dict[str, int]]:
    rows = json.loads(args[1]) if isinstance(args[1], str) else args[1]
    done = []
    for df in _frames(g, [r for r in rows if r.get(g.vertices[args[0]].primary) is not None], g.vertices[args[0]].props):
        g, counts = upsert_vertices(g, args[0], df)
        done.append(counts)
    bad = sum(r.get(g.vertices[args[0]].primary) is None for r in rows)
    return g, _sum([*done, {"total": bad, "insert": 0, "update": 0, "data_error": bad, "index_conflict": 0}])


@change("db.upsertEdge", "db.upsertEdgeByJson")
def upsert_edge(g: PropertyGraph, args: list) -> tuple[PropertyGraph, dict[str, int]]:
    label, src, dst, rows = args
    src, dst, rows = (json.loads(x) if isinstance(x, str) else x for x in (src, dst, rows))
    types = {src["key"]: g.vertices[src["type"]].props[g.vertices[src["type"]].primary], dst["key"]: g.vertices[dst["type"]].props[g.vertices[dst["type"]].primary]}
    types |= next((e.props for e in g.edges if (e.label, e.src_label, e.dst_label) == (label, src["type"], dst["type"])), {})
    done = []
    for df in _frames(g, rows, types):
        g, counts = upsert_edges(g, label, src["type"], dst["type"], df.withColumnsRenamed({src["key"]: "SRC_ID", dst["key"]: "DST_ID"}))
        done.append(counts)
    return g, _sum(done)
