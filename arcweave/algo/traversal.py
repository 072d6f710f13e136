"""Traversals under the caller's control, a step at a time.

``FrontierTraversal`` holds a set of vertices and replaces it, step by step, by
the neighbours that pass the conditions; each vertex is visited once unless
revisits are allowed. ``PathTraversal`` does the same with whole paths.

Conditions are SQL texts over the edge's properties and ``_label, _eid, _src,
_dst``, over the neighbour's properties and ``_label, _id``, and for paths over
``nodes`` and ``edges``. They reach the scans; what has no such property sees
null. A step is one join with the edges it may use and is written to the shared
folder, so traversals may be as deep as they like.

Defined cases: an empty frontier stays empty; with revisits a vertex stands in
the frontier once per way to it; without, once in the whole traversal, its
roots included; a self-loop is met once in both directions together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.plans.graph import GraphError, PropertyGraph, common_type
from arcweave.runtime import cut


class _Steps:
    def __init__(self, graph: PropertyGraph):
        self.graph = graph
        self.frontier: DataFrame | None = None

    def _edges(self, labels: list[str] | None, condition: str | None, back: bool, loops: bool = True) -> DataFrame:
        """``from, to, edge`` of the edges in one direction."""
        tables = [e for e in self.graph.edges if labels is None or e.label in labels]
        if not tables:
            raise GraphError(f"no edges of {labels}")
        types: dict[str, list] = {}
        for e in tables:
            for p, t in e.props.items():
                types.setdefault(p, []).append(t)
        out = None
        for e in tables:
            props = [(F.col(f"`{p}`") if p in e.props else F.lit(None)).cast(common_type(t)).alias(p) for p, t in types.items()]
            one = e.df.select(F.lit(e.label).alias("_label"), "_eid", "_src", "_dst", *props)
            out = one if out is None else out.unionByName(one)
        if condition is not None:
            out = out.filter(condition)
        if not loops:
            out = out.filter("_src <> _dst")
        a, b = ("_dst", "_src") if back else ("_src", "_dst")
        return out.select(F.col(a).alias("from"), F.col(b).alias("to"), F.struct(F.col("_label").alias("label"), F.col("_eid").alias("eid"), F.col("_src").alias("src"), F.col("_dst").alias("dst")).alias("edge"))

    def _both(self, labels: list[str] | None, out_edges: str | None, in_edges: str | None) -> DataFrame:
        return self._edges(labels, out_edges, False).unionByName(self._edges(labels, in_edges, True, loops=False))

    def _passing(self, condition: str | None) -> DataFrame | None:
        return None if condition is None else self.graph.all_vertices().filter(condition).select(F.col("_id").alias("to"))

    def _start(self, roots: DataFrame | list[int] | str) -> DataFrame:
        """``id`` of the roots: a frame, ids, or a condition on vertices."""
        if isinstance(roots, str):
            return self.graph.all_vertices().filter(roots).select(F.col("_id").alias("id"))
        if not isinstance(roots, DataFrame):
            roots = self.graph.spark.createDataFrame([(r,) for r in roots], "id long")
        return roots.select("id").filter("id is not null").distinct()


class FrontierTraversal(_Steps):
    def __init__(self, graph: PropertyGraph, allow_revisits: bool = False):
        super().__init__(graph)
        self.allow_revisits, self.visited = allow_revisits, None

    def set_frontier(self, roots: DataFrame | list[int] | str) -> FrontierTraversal:
        self.frontier = cut(self._start(roots))
        if not self.allow_revisits:
            self.visited = self.frontier if self.visited is None else cut(self.visited.unionByName(self.frontier).distinct())
        return self

    def expand_out(self, labels: list[str] | None = None, edges: str | None = None, vertices: str | None = None) -> FrontierTraversal:
        return self._expand(self._edges(labels, edges, False), vertices)

    def expand_in(self, labels: list[str] | None = None, edges: str | None = None, vertices: str | None = None) -> FrontierTraversal:
        return self._expand(self._edges(labels, edges, True), vertices)

    def expand(self, labels: list[str] | None = None, out_edges: str | None = None, in_edges: str | None = None, vertices: str | None = None) -> FrontierTraversal:
        """Both ways."""
        return self._expand(self._both(labels, out_edges, in_edges), vertices)

    def _expand(self, step: DataFrame, vertices: str | None) -> FrontierTraversal:
        got = self.frontier.select(F.col("id").alias("from")).join(step.select("from", "to"), "from").select("to")
        got = got if self.allow_revisits else got.distinct()
        keep = self._passing(vertices)
        got = (got if keep is None else got.join(keep, "to", "left_semi")).withColumnRenamed("to", "id")
        if not self.allow_revisits:
            got = got.join(self.visited, "id", "left_anti")
        self.frontier = cut(got)
        if not self.allow_revisits:
            self.visited = self.visited.unionByName(self.frontier)
        return self

    def reset_visited(self) -> FrontierTraversal:
        """Forget what was visited, but for the frontier."""
        self.visited = None if self.allow_revisits else self.frontier
        return self

    def reset(self) -> FrontierTraversal:
        self.frontier = self.visited = None
        return self


class PathTraversal(_Steps):
    """The frontier is ``id`` (where a path ends), ``nodes`` and ``edges``."""

    def set_frontier(self, roots: DataFrame | list[int] | str) -> PathTraversal:
        none = F.array().cast("array<struct<label:string,eid:bigint,src:bigint,dst:bigint>>")
        self.frontier = cut(self._start(roots).select("id", F.array("id").alias("nodes"), none.alias("edges")))
        return self

    def expand_out(self, labels: list[str] | None = None, edges: str | None = None, vertices: str | None = None, paths: str | None = None) -> PathTraversal:
        return self._expand(self._edges(labels, edges, False), vertices, paths)

    def expand_in(self, labels: list[str] | None = None, edges: str | None = None, vertices: str | None = None, paths: str | None = None) -> PathTraversal:
        return self._expand(self._edges(labels, edges, True), vertices, paths)

    def expand(self, labels: list[str] | None = None, out_edges: str | None = None, in_edges: str | None = None, vertices: str | None = None, paths: str | None = None) -> PathTraversal:
        """Both ways."""
        return self._expand(self._both(labels, out_edges, in_edges), vertices, paths)

    def _expand(self, step: DataFrame, vertices: str | None, paths: str | None) -> PathTraversal:
        keep = self._passing(vertices)
        step = step if keep is None else step.join(keep, "to", "left_semi")
        got = self.frontier.withColumnRenamed("id", "from").join(step, "from")
        got = got.select(F.col("to").alias("id"), F.concat("nodes", F.array("to")).alias("nodes"), F.concat("edges", F.array("edge")).alias("edges"))
        self.frontier = cut(got if paths is None else got.filter(paths))
        return self

    def reset(self) -> PathTraversal:
        self.frontier = None
        return self
