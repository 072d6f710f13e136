"""Updates as functions from a graph to a new graph.

CREATE, MERGE, SET, REMOVE and DELETE are read-modify-write over frames: rows
to add are unions, rows to drop anti-joins, rows to change left joins with the
new values. The old graph stays as it was. The matched rows of an update are
written to the shared folder first, so all parts of it see the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.plans import parser as P
from arcweave.plans.compiler import Compiler, Node, Rel, Scope, c
from arcweave.plans.graph import EdgeTable, GraphError, PropertyGraph
from arcweave.runtime import cut


@dataclass
class Counts:
    created_vertices: int = 0
    created_edges: int = 0
    deleted_vertices: int = 0
    deleted_edges: int = 0
    set_properties: int = 0

    def as_dict(self) -> dict[str, int]:
        return dict(self.__dict__)


@dataclass
class Session:
    graph: PropertyGraph
    params: dict
    counts: Counts = field(default_factory=Counts)

    def compiler(self) -> Compiler:
        return Compiler(self.graph, self.params, "reference")


def run_update(graph: PropertyGraph, text: str, params: dict) -> tuple[PropertyGraph, dict[str, int]]:
    """The graph after the query's updates, and what they did."""
    query = P.parse(text)
    if len(query.parts) > 1:
        raise GraphError("an update has no UNION")
    from arcweave.plans import changes

    s, scope, called = Session(graph, params), Scope(None), {}
    for x in query.parts[0]:
        if isinstance(x, (P.Create, P.Merge, P.SetItems, P.Remove, P.Delete)):
            if scope.df is not None:
                scope = Scope(cut(scope.df), scope.names)
            scope = {P.Create: create, P.Merge: merge, P.SetItems: set_items, P.Remove: remove, P.Delete: delete}[type(x)](s, scope, x)
        elif isinstance(x, P.Project) and x.final:
            break
        elif isinstance(x, P.Call) and x.name.lower() in changes.CHANGES:
            comp = s.compiler()
            s.graph, counts = changes.CHANGES[x.name.lower()](s.graph, [comp.constant(a) for a in x.args])
            called |= counts
        else:
            scope = s.compiler().clause(scope, x)
    return s.graph, {**s.counts.as_dict(), **called}


def _replace_vertices(g: PropertyGraph, label: str, df: DataFrame) -> PropertyGraph:
    return replace(g, vertices={**g.vertices, label: replace(g.vertices[label], source=df, number=None)})


def _replace_edges(g: PropertyGraph, old: EdgeTable, df: DataFrame) -> PropertyGraph:
    return g.with_edges(old.label, old.src_label, old.dst_label, df, old.temporal)


def _next_id(g: PropertyGraph) -> int:
    top = [v.df.agg(F.max("_id").alias("m")).first()["m"] for v in g.vertices.values()]
    return 1 + max([-1, *[t for t in top if t is not None]])


def _next_eid(g: PropertyGraph, label: str) -> int:
    top = [e.df.agg(F.max("_eid").alias("m")).first()["m"] for e in g.edges if e.label == label]
    return 1 + max([-1, *[t for t in top if t is not None]])


def _numbered(df: DataFrame, name: str, first: int) -> DataFrame:
    """``df`` with distinct ids from ``first`` on: dense over partitions' rows."""
    return df.withColumn(name, F.lit(first) + F.monotonically_increasing_id())


def _values(s: Session, scope: Scope, label: str, props: dict, known: dict) -> tuple[Scope, dict[str, Column]]:
    unknown = set(props) - set(known)
    if unknown:
        raise GraphError(f"{label} has no property {sorted(unknown)}")
    comp = s.compiler()
    for v in props.values():
        scope = comp.load(scope, comp.needs(scope, v))
    return scope, {p: comp.expr(scope, props[p]).cast(t) if p in props else F.lit(None).cast(t) for p, t in known.items()}


def _edge_table(g: PropertyGraph, kind: str, a: str, b: str) -> EdgeTable:
    for e in g.edges:
        if (e.label, e.src_label, e.dst_label) == (kind, a, b):
            return e
    like = next((e for e in g.edges if e.label == kind), None)
    if like is None:
        raise GraphError(f"no edge label {kind}")
    raise GraphError(f"{kind} doesn't lead from {a} to {b}")


def create(s: Session, scope: Scope, x: P.Create) -> Scope:
    spark = s.graph.spark
    if scope.df is None:
        scope = Scope(spark.range(1).select(F.lit(1).alias("@unit")), {})
    for path in x.paths:
        for n in path.nodes:
            n.var = n.var or f"_new{id(n)}"
            if n.var in scope.names:
                continue
            if len(n.labels) != 1 or n.labels[0] not in s.graph.vertices:
                raise GraphError(f"CREATE takes one known label, not {n.labels}")
            label = n.labels[0]
            known = s.graph.vertices[label].props
            scope, values = _values(s, scope, label, n.props, known)
            df = scope.df
            for p, v in values.items():
                df = df.withColumn(f"{n.var}@p@{p}", v)
            df = cut(_numbered(df, f"{n.var}@id", _next_id(s.graph)))
            added = df.select(c(f"{n.var}@id").alias("_id"), *[c(f"{n.var}@p@{p}").alias(p) for p in known])
            s.counts.created_vertices += added.count()
            s.graph = _replace_vertices(s.graph, label, s.graph.vertices[label].df.unionByName(added))
            scope = Scope(df, {**scope.names, n.var: Node(n.var, {label}, loaded=True)})
        for i, r in enumerate(path.rels):
            if len(r.types) != 1 or r.direction == "-":
                raise GraphError("CREATE takes one edge label and a direction")
            a, b = path.nodes[i].var, path.nodes[i + 1].var
            if r.direction == "<":
                a, b = b, a
            scope = _create_edges(s, scope, r, a, b)
    return scope


def _create_edges(s: Session, scope: Scope, r: P.RelPat, a: str, b: str) -> Scope:
    r.var = r.var or f"_rel{id(r)}"
    na, nb = scope.names[a], scope.names[b]
    comp, made, tables = s.compiler(), None, []
    for la in sorted(na.labels):
        for lb in sorted(nb.labels):
            try:
                t = _edge_table(s.graph, r.types[0], la, lb)
            except GraphError:
                if len(na.labels) == len(nb.labels) == 1:
                    raise
                continue
            scope, values = _values(s, scope, t.label, r.props, t.props)
            df = scope.df.filter((comp.label_col(na) == la) & (comp.label_col(nb) == lb))
            df = df.withColumn(f"{r.var}@src", c(na.id)).withColumn(f"{r.var}@dst", c(nb.id)).withColumn(f"{r.var}@type", F.lit(t.label))
            for p, v in values.items():
                df = df.withColumn(f"{r.var}@p@{p}", v)
            df = cut(_numbered(df, f"{r.var}@eid", _next_eid(s.graph, t.label)))
            added = df.select(c(f"{r.var}@eid").alias("_eid"), c(f"{r.var}@src").alias("_src"), c(f"{r.var}@dst").alias("_dst"), *[c(f"{r.var}@p@{p}").alias(p) for p in t.props])
            s.counts.created_edges += added.count()
            s.graph = _replace_edges(s.graph, t, t.df.unionByName(added))
            tables.append(t)
            made = df if made is None else made.unionByName(df, allowMissingColumns=True)
    if made is None:
        raise GraphError(f"{r.types[0]} doesn't lead from {sorted(na.labels)} to {sorted(nb.labels)}")
    return Scope(made, {**scope.names, r.var: Rel(r.var, tables)})


def merge(s: Session, scope: Scope, x: P.Merge) -> Scope:
    """Match the path, or create it where it has no match."""
    path = x.path
    for n in path.nodes:
        n.var = n.var or f"_m{id(n)}"
    if len(path.nodes) > 2:
        raise GraphError("MERGE takes a vertex or one edge")
    if scope.df is None:
        scope = Scope(s.graph.spark.range(1).select(F.lit(1).alias("@unit")), {})
    for n in path.nodes:
        if n.var not in scope.names:
            scope = _merge_node(s, scope, n, x)
    if path.rels:
        r = path.rels[0]
        r.var = r.var or f"_m{id(r)}"
        a, b = (path.nodes[1], path.nodes[0]) if r.direction == "<" else path.nodes
        rowed = cut(scope.df.withColumn("@row", F.monotonically_increasing_id()))
        base = Scope(rowed, scope.names)
        found = s.compiler().match(base, [P.PathPat(None, [P.NodePat(a.var, [], {}), P.NodePat(b.var, [], {})], [P.RelPat(r.var, r.types, ">", r.props)])], None)
        found = Scope(cut(found.df), found.names)
        missing = Scope(cut(rowed.join(found.df.select("@row").distinct(), "@row", "left_anti")), scope.names)
        if not found.df.isEmpty() and x.on_match:
            set_items(s, found, P.SetItems([i for i in x.on_match if i[0] == r.var or len(path.nodes) == 2]))
        if not missing.df.isEmpty():
            made = _create_edges(s, Scope(missing.df.drop("@row"), missing.names), P.RelPat(r.var, r.types, ">", r.props), a.var, b.var)
            if x.on_create:
                set_items(s, made, P.SetItems(x.on_create))
    return scope


def _merge_node(s: Session, scope: Scope, n: P.NodePat, x: P.Merge) -> Scope:
    if len(n.labels) != 1:
        raise GraphError("MERGE takes one label")
    label = n.labels[0]
    known = s.graph.vertices[label].props
    scope, values = _values(s, scope, label, n.props, known)
    keys = [p for p in known if p in n.props]
    asked = scope.df
    for p in keys:
        asked = asked.withColumn(f"{n.var}@k@{p}", values[p])
    asked = cut(asked)
    wanted = asked.select(*[c(f"{n.var}@k@{p}").alias(p) for p in keys]).distinct()
    have = s.graph.vertices[label].df
    fresh = cut(wanted.join(have, keys, "left_anti"))
    matched_ids = cut(have.join(wanted, keys, "left_semi").select(F.col("_id").alias(f"{n.var}@id")))
    k = fresh.count()
    if k:
        added = _numbered(fresh, "_id", _next_id(s.graph)).select("_id", *[(F.col(f"`{p}`") if p in keys else F.lit(None)).cast(t).alias(p) for p, t in known.items()])
        added = cut(added)
        s.counts.created_vertices += k
        s.graph = _replace_vertices(s.graph, label, have.unionByName(added))
        if x.on_create and not x.path.rels:
            set_items(s, Scope(added.select(F.col("_id").alias(f"{n.var}@id")), {n.var: Node(n.var, {label})}), P.SetItems(x.on_create))
    if x.on_match and not x.path.rels and not matched_ids.isEmpty():
        set_items(s, Scope(matched_ids, {n.var: Node(n.var, {label})}), P.SetItems(x.on_match))
    now = s.graph.vertices[label].df.select(F.col("_id").alias(f"{n.var}@id"), *[F.col(f"`{p}`").alias(f"{n.var}@k@{p}") for p in keys])
    df = asked.join(now, [f"{n.var}@k@{p}" for p in keys]).drop(*[f"{n.var}@k@{p}" for p in keys])
    return Scope(cut(df), {**scope.names, n.var: Node(n.var, {label})})


def set_items(s: Session, scope: Scope, x: P.SetItems) -> Scope:
    """Overwrite properties; ``= {map}`` and ``+= {map}`` set the listed ones,
    ``n = null`` deletes the vertex. Of several values for one row the
    greatest wins."""
    comp = s.compiler()
    for var, prop, op, e in x.items:
        b = comp.binding(scope, var)
        if isinstance(e, P.Lit) and e.value is None and prop is None:
            scope = delete(s, scope, P.Delete([var]))
            continue
        if prop is not None:
            changes = {prop: e}
        elif isinstance(e, P.MapLit):
            changes = e.items
        elif isinstance(e, P.Var) and isinstance(scope.names.get(e.name), Node) and isinstance(b, Node):
            changes = {p: P.Prop(e, p) for p in s.graph.vertex_props(scope.names[e.name].labels)}
        else:
            raise GraphError("SET takes a value, a map or a vertex")
        for v in changes.values():
            scope = comp.load(scope, comp.needs(scope, v))
        tables = [(label, s.graph.vertices[label]) for label in sorted(b.labels)] if isinstance(b, Node) else [(None, t) for t in s.graph.edges if t.label in b.types]
        key = "_id" if isinstance(b, Node) else "_eid"
        for label, t in tables:
            mine = {p: v for p, v in changes.items() if p in t.props}
            if not mine:
                if len(tables) == 1:
                    raise GraphError(f"{label or t.label} has no property {sorted(changes)}")
                continue
            rows = scope.df.filter(c(b.id if isinstance(b, Node) else b.col("eid")).isNotNull())
            if isinstance(b, Rel):
                rows = rows.filter(c(b.col("type")) == t.label)
            new = rows.select(c(b.id if isinstance(b, Node) else b.col("eid")).alias(key), F.struct(*[comp.expr(scope, v).cast(t.props[p]).alias(p) for p, v in mine.items()]).alias("@new")).groupBy(key).agg(F.max("@new").alias("@new"))
            df = t.df.join(new, key, "left").select(*[F.when(F.col("`@new`").isNotNull(), F.col("`@new`")[p]).otherwise(F.col(f"`{p}`")).alias(p) if p in mine else F.col(f"`{p}`") for p in t.df.columns])
            df = cut(df)
            s.counts.set_properties += len(mine) * new.join(t.df.select(key), key, "left_semi").count()
            s.graph = _replace_vertices(s.graph, label, df) if label else _replace_edges(s.graph, t, df)
        if isinstance(b, Node):
            drop = [k for k in scope.df.columns if k.startswith(f"{var}@p@")]
            scope = Scope(scope.df.drop(*drop), {**scope.names, var: Node(b.name, b.labels, b.marked, False, b.nullable)})
        comp = s.compiler()
    return scope


def remove(s: Session, scope: Scope, x: P.Remove) -> Scope:
    return set_items(s, scope, P.SetItems([(v, p, "=", P.Lit(None)) for v, p in x.items]))


def delete(s: Session, scope: Scope, x: P.Delete) -> Scope:
    """Drop edges, or vertices with all their edges."""
    comp = s.compiler()
    for name in x.names:
        b = comp.binding(scope, name)
        if isinstance(b, Rel):
            gone = cut(scope.df.select(c(b.col("type")).alias("@t"), c(b.col("eid")).alias("_eid")).filter("_eid is not null").distinct())
            for t in [t for t in s.graph.edges if t.label in b.types]:
                left = cut(t.df.join(gone.filter(F.col("`@t`") == t.label).select("_eid"), "_eid", "left_anti"))
                s.counts.deleted_edges += t.df.count() - left.count()
                s.graph = _replace_edges(s.graph, t, left)
        elif isinstance(b, Node):
            gone = cut(scope.df.select(c(b.id).alias("_id")).filter("_id is not null").distinct())
            for label in sorted(b.labels):
                v = s.graph.vertices[label]
                left = cut(v.df.join(gone, "_id", "left_anti"))
                s.counts.deleted_vertices += v.df.count() - left.count()
                s.graph = _replace_vertices(s.graph, label, left)
            for t in s.graph.edges:
                if {t.src_label, t.dst_label} & b.labels:
                    left = cut(t.df.join(gone.withColumnRenamed("_id", "_src"), "_src", "left_anti").join(gone.withColumnRenamed("_id", "_dst"), "_dst", "left_anti"))
                    s.counts.deleted_edges += t.df.count() - left.count()
                    s.graph = _replace_edges(s.graph, t, left)
        else:
            raise GraphError(f"{name} is neither a vertex nor an edge")
    return scope


# --- bulk upserts -------------------------------------------------------------

def upsert_vertices(g: PropertyGraph, label: str, rows: DataFrame) -> tuple[PropertyGraph, dict[str, int]]:
    """Insert rows or overwrite the given properties of those whose primary key
    exists. Rows without a key are counted as ``data_error``; of several rows
    of one key the greatest wins. Rows whose value of a unique index belongs
    to another key, of the graph or (then a smaller one) of the rows, are left
    out and counted as ``index_conflict``."""
    v = g.vertices[label]
    if v.primary is None:
        raise GraphError(f"{label} has no primary key")
    total = rows.count()
    props = [p for p in v.props if p in rows.columns]
    good = rows.filter(F.col(f"`{v.primary}`").isNotNull()).select(*[F.col(f"`{p}`").cast(v.props[p]).alias(p) for p in props])
    errors = total - good.count()
    for f, unique in v.indexes:
        if unique and set(fs := f.split(",")) <= set(props):
            good = cut(good)
            taken = v.df.select(F.col(f"`{v.primary}`").alias("@k"), *fs).unionByName(good.select(F.col(f"`{v.primary}`").alias("@k"), *fs)).dropna(subset=fs)
            mine = v.df.select(F.col(f"`{v.primary}`").alias("@k"), *fs).dropna(subset=fs).groupBy(*fs).agg(F.min("@k").alias("@old"))
            owner = taken.groupBy(*fs).agg(F.min("@k").alias("@first")).join(mine, fs, "left").select(*fs, F.coalesce("@old", "@first").alias("@owner"))
            good = good.join(owner, fs, "left").filter(F.col("`@owner`").isNull() | (F.col("`@owner`") == F.col(f"`{v.primary}`"))).drop("@owner")
    n_good = good.count()
    conflicts = total - errors - n_good
    rest = [p for p in props if p != v.primary]
    once = cut(good.groupBy(v.primary).agg(F.max(F.struct(*([F.col(f"`{p}`") for p in rest] or [F.lit(0).alias("_")]))).alias("@new")))
    old = v.df.join(once, v.primary, "left").select(*[F.when(F.col("`@new`").isNotNull(), F.col("`@new`")[p]).otherwise(F.col(f"`{p}`")).alias(p) if p in rest else F.col(f"`{p}`") for p in v.df.columns])
    fresh = cut(once.join(v.df.select(v.primary), v.primary, "left_anti"))
    n_new = fresh.count()
    added = _numbered(fresh, "_id", _next_id(g)).select("_id", *[(F.col(f"`{p}`") if p == v.primary else F.col("`@new`")[p] if p in rest else F.lit(None)).cast(t).alias(p) for p, t in v.props.items()])
    return _replace_vertices(g, label, cut(old.unionByName(cut(added)))), {"total": total, "insert": n_new, "update": n_good - n_new, "data_error": errors, "index_conflict": conflicts}


def upsert_edges(g: PropertyGraph, label: str, src_label: str, dst_label: str, rows: DataFrame) -> tuple[PropertyGraph, dict[str, int]]:
    """Insert edges by their ends' primary keys (columns SRC_ID and DST_ID), or
    overwrite the properties of the edges between them. Rows whose ends don't
    exist are ``data_error``."""
    t = _edge_table(g, label, src_label, dst_label)
    total = rows.count()
    solved = cut(resolve_ends(g, rows, src_label, dst_label).groupBy("_src", "_dst").agg(F.max(F.struct(*[F.col(f"`{p}`").cast(k).alias(p) if p in rows.columns else F.lit(None).cast(k).alias(p) for p, k in t.props.items()], F.lit(0).alias("@z"))).alias("@new"), F.count("*").alias("@n")))
    given = [p for p in t.props if p in rows.columns]
    old = t.df.join(solved, ["_src", "_dst"], "left").select(*[F.when(F.col("`@new`").isNotNull(), F.col("`@new`")[p]).otherwise(F.col(f"`{p}`")).alias(p) if p in given else F.col(f"`{p}`") for p in t.df.columns])
    fresh = cut(solved.join(t.df.select("_src", "_dst").distinct(), ["_src", "_dst"], "left_anti"))
    added = _numbered(fresh, "_eid", _next_eid(g, label)).select("_eid", "_src", "_dst", *[F.col("`@new`")[p].alias(p) for p in t.props])
    n_new, n_good = fresh.count(), solved.agg(F.coalesce(F.sum("`@n`"), F.lit(0)).alias("n")).first()["n"]
    return _replace_edges(g, t, cut(old.unionByName(cut(added)))), {"total": total, "insert": n_new, "update": n_good - n_new, "data_error": total - n_good, "index_conflict": 0}


def resolve_ends(g: PropertyGraph, rows: DataFrame, src_label: str, dst_label: str) -> DataFrame:
    """Rows with SRC_ID and DST_ID as ``_src`` and ``_dst``; rows whose keys
    don't exist are left out."""
    for col, key, label in (("_src", "SRC_ID", src_label), ("_dst", "DST_ID", dst_label)):
        v = g.vertices[label]
        ids = v.df.select(F.col(f"`{v.primary}`").alias(key), F.col("_id").alias(col))
        rows = rows.withColumn(key, F.col(key).cast(v.props[v.primary])).join(ids, key)
    return rows.drop("SRC_ID", "DST_ID")
