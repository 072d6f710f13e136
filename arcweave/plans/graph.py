"""A property graph as a catalog of DataFrames.

One vertex frame per label, with a graph-wide ``_id``; one edge frame per edge
label and pair of vertex labels, with ``_eid`` (unique within the edge label),
``_src`` and ``_dst``. Parallel edges are rows of their own. Nothing is copied
or indexed: scans reach the sources with their filters and columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, IntegralType, LongType, MapType, NumericType, StringType

VERTEX_META = ("_id",)
EDGE_META = ("_eid", "_src", "_dst")


class GraphError(ValueError):
    """A query or an update that doesn't fit the graph's schema."""


class _Lazy:
    """A frame that may be given as a function, called when it is first used."""

    @cached_property
    def df(self) -> DataFrame:
        return self.source() if callable(self.source) and not isinstance(self.source, DataFrame) else self.source

    @cached_property
    def rows(self) -> int:
        return self.df.count()


@dataclass(frozen=True, eq=False)
class VertexTable(_Lazy):
    label: str
    source: DataFrame | Callable[[], DataFrame]
    primary: str | None = None
    indexes: tuple[tuple[str, bool], ...] = ()  # field, unique
    number: int | None = None  # ids are those of ``namespaced_id(number, primary)``
    vectors: tuple[tuple[str, int, str], ...] = ()  # vector indexes: field, dimension, distance

    @cached_property
    def props(self) -> dict[str, DataType]:
        return {f.name: f.dataType for f in self.df.schema if f.name not in VERTEX_META}


@dataclass(frozen=True, eq=False)
class EdgeTable(_Lazy):
    label: str
    src_label: str
    dst_label: str
    source: DataFrame | Callable[[], DataFrame]
    temporal: str | None = None

    @cached_property
    def props(self) -> dict[str, DataType]:
        return {f.name: f.dataType for f in self.df.schema if f.name not in EDGE_META}


def common_type(types: list[DataType]) -> DataType:
    """The type in which a property of several tables is read."""
    first = types[0]
    if all(t == first for t in types):
        return first
    if all(isinstance(t, IntegralType) for t in types):
        return LongType()
    if all(isinstance(t, NumericType) for t in types):
        return DoubleType()
    return StringType()


@dataclass(frozen=True)
class PropertyGraph:
    spark: SparkSession
    vertices: dict[str, VertexTable] = field(default_factory=dict)
    edges: tuple[EdgeTable, ...] = ()

    # --- building -------------------------------------------------------
    def with_vertices(self, label: str, df: DataFrame | Callable[[], DataFrame], primary: str | None = None, id_col: str | None = None, number: int | None = None) -> PropertyGraph:
        """Add or replace a label. Without ``_id`` in ``df``, ``id_col`` (or the
        primary key) gives it; integer keys only, and only if they are unique
        over all labels; see ``namespaced_id`` otherwise. A function that gives
        the complete frame may stand for it and is called on first use.
        ``number``: promises ids of ``namespaced_id(number, primary)``, so that
        conditions on ids reach the scan as conditions on keys."""
        if isinstance(df, DataFrame) and "_id" not in df.columns:
            df = df.withColumn("_id", F.col(f"`{id_col or primary}`").cast("long"))
        return replace(self, vertices={**self.vertices, label: VertexTable(label, df, primary, number=number)})

    def with_edges(self, label: str, src_label: str, dst_label: str, df: DataFrame | Callable[[], DataFrame], temporal: str | None = None) -> PropertyGraph:
        """Add an edge frame. Without ``_eid`` every row gets a surrogate (see
        ``stable_ids``), so that parallel edges stay apart."""
        for side in (src_label, dst_label):
            if side not in self.vertices:
                raise GraphError(f"no vertex label {side}")
        if isinstance(df, DataFrame) and "_eid" not in df.columns:
            df = stable_ids(df)
        kept = tuple(e for e in self.edges if (e.label, e.src_label, e.dst_label) != (label, src_label, dst_label))
        return replace(self, edges=(*kept, EdgeTable(label, src_label, dst_label, df, temporal)))

    # --- catalog --------------------------------------------------------
    def edge_labels(self) -> list[str]:
        return sorted({e.label for e in self.edges})

    def vertex_props(self, labels: set[str]) -> dict[str, DataType]:
        out: dict[str, list[DataType]] = {}
        for name in sorted(labels):
            for p, t in self.vertices[name].props.items():
                out.setdefault(p, []).append(t)
        return {p: common_type(t) for p, t in out.items()}

    def all_vertices(self, labels: set[str] | None = None) -> DataFrame:
        """Every vertex as ``_id, _label`` and the union of the properties."""
        names = sorted(labels if labels is not None else self.vertices)
        props = self.vertex_props(set(names))
        parts = [self.vertices[n].df.select("_id", F.lit(n).alias("_label"), *[(F.col(f"`{p}`") if p in self.vertices[n].props else F.lit(None)).cast(t).alias(p) for p, t in props.items()]) for n in names]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def all_edges(self, labels: list[str] | None = None, weight: str | None = None) -> DataFrame:
        """``src, dst`` (and ``weight`` as double) of the edges, parallel ones kept."""
        parts = []
        for e in self.edges:
            if labels is None or e.label in labels:
                w = [F.coalesce((F.col(f"`{weight}`") if weight in e.props else F.lit(None)).cast("double"), F.lit(1.0)).alias("weight")] if weight else []
                parts.append(e.df.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), *w))
        if not parts:
            raise GraphError(f"no edges of {labels}")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def cypher(self, text: str, params: dict | None = None, compat: str = "reference", union_dedup: bool = False) -> DataFrame:
        from arcweave.plans.compiler import run

        return run(self, text, params or {}, compat, union_dedup)

    gql = cypher

    def update(self, text: str, params: dict | None = None) -> tuple[PropertyGraph, dict[str, int]]:
        from arcweave.plans.updates import run_update

        return run_update(self, text, params or {})


#: Bits of a key inside a graph-wide id.
KEY_BITS = 48


def is_key(key: str) -> Column:
    """Whether ``namespaced_id`` takes it."""
    return F.col(key).cast("long").between(0, (1 << KEY_BITS) - 1)


def namespaced_id(number: int, key: str) -> Column:
    """A graph-wide id of an integer key of the ``number``-th label; ids of one
    label stay in the order of their keys. Keys outside 0 to 2**48 - 1 would be
    ids of another label: an error. A null key has a null id."""
    k = F.col(key).cast("long")
    bad = F.raise_error(F.concat(F.lit(f"{key} lies outside 0..2^{KEY_BITS}-1: "), k.cast("string"))).cast("long")
    return F.when(is_key(key) | k.isNull(), F.lit(number << KEY_BITS) + k).otherwise(bad)


def stable_ids(df: DataFrame) -> DataFrame:
    """``df`` with ``_eid``: a hash of the row and of its number among equal
    rows. The same in every scan, however the files are split and whatever is
    filtered; where nothing reads it, Catalyst drops it with its shuffle."""
    cols = [F.to_json(f"`{f.name}`") if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`") for f in df.schema]
    again = F.row_number().over(Window.partitionBy(*cols).orderBy(F.lit(0)))
    return df.withColumn("_copy", again).withColumn("_eid", F.xxhash64(*cols, "_copy")).drop("_copy")


def file_row_id() -> Column:
    """A stable id of a row of a parquet table: a hash of its file and place."""
    return F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
