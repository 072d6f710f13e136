"""Syntax tree to DataFrame plan.

A MATCH is a chain of equi-joins over edge frames. Vertex frames are joined
only where a property of the vertex is used: labels are known from the edge
frames, of which only those that fit the pattern's types, directions and end
labels take part. Conditions on one variable are applied where the variable
comes up, so that they reach the scan. Relationship uniqueness compares edge
ids within one MATCH; OPTIONAL becomes a left join with the whole pattern,
``exists(pattern)`` a semi, anti or marked join on its bound variables.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from itertools import combinations, count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweave.functions import aggregates, scalars
from arcweave.plans import parser as P
from arcweave.plans.graph import KEY_BITS, EdgeTable, GraphError, PropertyGraph, common_type
from arcweave.runtime import cut

#: Hops up to which a variable-length pattern is one plan; longer ones are cut off after so many, or after each that may end.
UNROLLED = 4
#: Hops at which an open-ended pattern stops (fixed value of the query language).
MAX_HOPS = 128


def c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Node:
    name: str
    labels: set[str]
    marked: bool = False  # whether a column holds the label
    loaded: bool = False  # whether property columns are there
    nullable: bool = False

    @property
    def id(self) -> str:
        return f"{self.name}@id"

    @property
    def label(self) -> str:
        return f"{self.name}@label"


@dataclass
class Rel:
    name: str
    tables: list[EdgeTable]
    nullable: bool = False

    def col(self, what: str) -> str:
        return f"{self.name}@{what}"

    @property
    def types(self) -> set[str]:
        return {t.label for t in self.tables}


@dataclass
class RelList:
    name: str
    tables: list[EdgeTable]
    back: bool = False
    nullable: bool = False

    @property
    def list(self) -> str:
        return f"{self.name}@list"

    @property
    def nodes(self) -> str:
        return f"{self.name}@nodes"


@dataclass
class Path:
    name: str

    @property
    def nodes(self) -> str:
        return f"{self.name}@pathnodes"

    @property
    def rels(self) -> str:
        return f"{self.name}@pathrels"


@dataclass
class Value:
    name: str

    @property
    def col(self) -> str:
        return f"{self.name}@v"


@dataclass
class Scope:
    df: DataFrame | None
    names: dict[str, Any] = field(default_factory=dict)


def edge_props(tables: list[EdgeTable]) -> dict[str, T.DataType]:
    out: dict[str, list] = {}
    for t in tables:
        for p, k in t.props.items():
            out.setdefault(p, []).append(k)
    return {p: common_type(k) for p, k in out.items()}


def conjuncts(e: Any) -> list:
    if e is None:
        return []
    return [*conjuncts(e.a), *conjuncts(e.b)] if isinstance(e, P.Bin) and e.op == "AND" else [e]


def has_aggregate(e: Any) -> bool:
    if isinstance(e, P.Fn) and e.name in aggregates.AGGREGATES:
        return True
    return any(has_aggregate(x) for x in P.children(e))


def has_exists(e: Any) -> bool:
    return isinstance(e, (P.Exists, P.PatComp)) or any(has_exists(x) for x in P.children(e))


class Compiler:
    def __init__(self, graph: PropertyGraph, params: dict, compat: str):
        self.g, self.params, self.compat, self.fresh = graph, params, compat, count()
        self.local: dict[str, Column] = {}  # variables of list expressions
        self.told: set[str] = set()  # edge variables that the value of a path shows
        self._probes: dict[int, tuple] = {}

    def new(self, hint: str = "_") -> str:
        return f"{hint}#{next(self.fresh)}"

    # --- expressions ------------------------------------------------------
    def type_of(self, s: Scope, col: Column) -> T.DataType | None:
        """The type of a column, found on an empty frame of the scope's schema."""
        if self.local:
            return None
        df = s.df if s.df is not None else self.g.spark.range(0)
        probe = self._probes.get(id(df))
        if probe is None or probe[0] is not df:
            probe = self._probes[id(df)] = (df, self.g.spark.createDataFrame([], df.schema))
        return probe[1].select(col.alias("x")).schema["x"].dataType

    def binding(self, s: Scope, name: str) -> Any:
        if name not in s.names:
            raise GraphError(f"variable {name} is not defined")
        return s.names[name]

    def rel_struct(self, r: Rel, props: dict[str, T.DataType] | None = None) -> Column:
        own = edge_props(r.tables)
        props = own if props is None else props
        return F.struct(c(r.col("eid")).alias("_eid"), c(r.col("type")).alias("_type"), c(r.col("src")).alias("_src"), c(r.col("dst")).alias("_dst"), *[(c(r.col(f"p@{p}")) if p in own else F.lit(None)).cast(t).alias(p) for p, t in props.items()])

    def label_col(self, b: Node) -> Column:
        if b.marked:
            return c(b.label)
        return F.when(c(b.id).isNotNull(), F.lit(next(iter(b.labels)))) if b.nullable else F.lit(next(iter(b.labels)))

    def whole(self, s: Scope, b: Any) -> Column:
        """A variable as a result value."""
        match b:
            case Value():
                return c(b.col)
            case Node():
                props = self.g.vertex_props(b.labels)
                v = F.struct(c(b.id).alias("identity"), self.label_col(b).alias("label"), F.struct(*[c(f"{b.name}@p@{p}").alias(p) for p in props]).alias("properties"))
                return F.when(c(b.id).isNotNull(), v) if b.nullable else v
            case Rel():
                v = self.rel_struct(b)
                return F.when(c(b.col("eid")).isNotNull(), v) if b.nullable else v
            case RelList():
                return c(b.list)
            case Path():
                return F.struct(c(b.nodes).alias("nodes"), c(b.rels).alias("relationships"))
        raise GraphError("not a value")

    def prop(self, s: Scope, e: P.Prop) -> Column:
        if isinstance(e.of, P.Var) and e.of.name not in self.local:
            b = self.binding(s, e.of.name)
            if isinstance(b, Node):
                return c(f"{b.name}@p@{e.name}") if e.name in self.g.vertex_props(b.labels) else F.lit(None)
            if isinstance(b, Rel):
                return c(b.col(f"p@{e.name}")) if e.name in edge_props(b.tables) else F.lit(None)
        of = self.expr(s, e.of)
        t = self.type_of(s, of)
        if isinstance(t, T.StructType) and e.name not in t.names:
            return of["properties"][e.name] if "properties" in t.names and e.name in t["properties"].dataType.names else F.lit(None)
        return of[e.name]

    def expr(self, s: Scope, e: Any) -> Column:
        match e:
            case P.Lit(value):
                return F.lit(value).cast("long") if isinstance(value, int) and not isinstance(value, bool) else F.lit(value)
            case P.Param(name):
                if name not in self.params:
                    raise GraphError(f"no parameter {name}")
                return self.literal(self.params[name])
            case P.Var(name):
                return self.local[name] if name in self.local else self.whole(s, self.binding(s, name))
            case P.Prop():
                return self.prop(s, e)
            case P.HasLabel(var, labels):
                b = self.binding(s, var)
                unknown = set(labels) - set(self.g.vertices) - set(self.g.edge_labels())
                if unknown:
                    raise GraphError(f"no label {sorted(unknown)}")
                if isinstance(b, Rel):
                    return c(b.col("type")).isin(*labels)
                return self.label_col(b).isin(*labels)
            case P.ListLit(items):
                return self.list_of([self.expr(s, x) for x in items], s)
            case P.MapLit(items):
                return F.struct(*[self.expr(s, v).alias(k) for k, v in items.items()])
            case P.Index(of, at):
                x, i = self.expr(s, of), self.expr(s, at)
                if isinstance(self.type_of(s, x), (T.StructType, T.MapType)):
                    return x[at.value]
                return F.try_element_at(x, F.when(i >= 0, i + 1).otherwise(i).cast("int"))
            case P.Slice(of, low, high):
                x = self.expr(s, of)
                n = F.size(x)
                fix = lambda v: F.greatest(F.lit(0), F.least(n, F.when(v < 0, n + v).otherwise(v).cast("int")))
                a = fix(self.expr(s, low)) if low is not None else F.lit(0)
                b = fix(self.expr(s, high)) if high is not None else n
                return F.slice(x, a + 1, F.greatest(F.lit(0), b - a))
            case P.Case(test, whens, other):
                return self.case(s, test, whens, other)
            case P.Comp():
                return self.comprehension(s, e)
            case P.Un(op, a):
                if op in ("NULL", "NOT NULL"):
                    x = self.null_test(s, a)
                    return x.isNull() if op == "NULL" else x.isNotNull()
                x = self.expr(s, a)
                return ~x if op == "NOT" else -x
            case P.Bin():
                return self.binary(s, e)
            case P.Fn():
                return self.function(s, e)
            case P.Exists():
                raise GraphError("exists(pattern) can't be used here")
        raise GraphError(f"can't compile {e}")

    def null_test(self, s: Scope, a: Any) -> Column:
        if isinstance(a, P.Var) and a.name not in self.local:
            b = self.binding(s, a.name)
            if isinstance(b, Node):
                return c(b.id)
            if isinstance(b, Rel):
                return c(b.col("eid"))
        return self.expr(s, a)

    def literal(self, v: Any) -> Column:
        if isinstance(v, (list, tuple)):
            return F.array(*[self.literal(x) for x in v])
        if isinstance(v, dict):
            return F.struct(*[self.literal(x).alias(k) for k, x in v.items()])
        return F.lit(v).cast("long") if isinstance(v, int) and not isinstance(v, bool) else F.lit(v)

    def list_of(self, items: list[Column], s: Scope) -> Column:
        if not items:
            return F.array().cast("array<string>")
        types = [self.type_of(s, x) for x in items]
        mixed = len({type(t) for t in types if t is not None and not isinstance(t, (T.NumericType, T.NullType))}) + any(isinstance(t, T.NumericType) for t in types) > 1
        return F.array(*[x.cast("string") for x in items]) if mixed else F.array(*items)

    def case(self, s: Scope, test: Any, whens: list, other: Any) -> Column:
        out = None
        x = self.null_test(s, test) if test is not None else None
        for w, then in whens:
            if x is None:
                hit = self.expr(s, w)
            elif isinstance(w, P.Lit) and w.value is None:
                hit = x.isNull()
            else:
                hit = x == self.expr(s, w)
            v = self.expr(s, then)
            out = F.when(hit, v) if out is None else out.when(hit, v)
        return out.otherwise(self.expr(s, other)) if other is not None else out

    def comprehension(self, s: Scope, e: P.Comp) -> Column:
        of = self.expr(s, e.of)

        def inside(body: Any):
            def go(x: Column) -> Column:
                before = dict(self.local)
                self.local[e.var] = x
                try:
                    return self.expr(s, body)
                finally:
                    self.local = before

            return go

        where = inside(e.where) if e.where is not None else (lambda x: x)
        if e.kind == "list":
            kept = F.filter(of, where) if e.where is not None else of
            return F.transform(kept, inside(e.out)) if e.out is not None else kept
        if e.kind == "all":
            return F.forall(of, where)
        if e.kind == "any":
            return F.exists(of, where)
        if e.kind == "none":
            return ~F.exists(of, where)
        return F.size(F.filter(of, where)) == 1

    def binary(self, s: Scope, e: P.Bin) -> Column:
        op = e.op
        if op in ("=", "<>") and all(isinstance(x, P.Var) and x.name in s.names and isinstance(s.names[x.name], (Node, Rel)) for x in (e.a, e.b)):
            same = self.null_test(s, e.a) == self.null_test(s, e.b)
            return same if op == "=" else ~same
        a, b = self.expr(s, e.a), self.expr(s, e.b)
        match op:
            case "AND":
                return a & b
            case "OR":
                return a | b
            case "XOR":
                return a != b
            case "=":
                return a == b
            case "<>":
                return a != b
            case "<":
                return a < b
            case "<=":
                return a <= b
            case ">":
                return a > b
            case ">=":
                return a >= b
            case "STARTS":
                return F.startswith(a, b)
            case "ENDS":
                return F.endswith(a, b)
            case "CONTAINS":
                return F.contains(a, b)
            case "REGEXP":
                return F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$")))
            case "IN":
                if isinstance(e.b, P.ListLit) and all(isinstance(x, (P.Lit, P.Param)) for x in e.b.items):
                    return a.isin(*[self.expr(s, x) for x in e.b.items]) if e.b.items else F.lit(False)
                return F.array_contains(b, a)
        ta, tb = self.type_of(s, a), self.type_of(s, b)
        if op == "+":
            if isinstance(ta, T.ArrayType) or isinstance(tb, T.ArrayType):
                a, ta = (a, ta.elementType) if isinstance(ta, T.ArrayType) else (F.array(a), ta)
                b, tb = (b, tb.elementType) if isinstance(tb, T.ArrayType) else (F.array(b), tb)
                if ta != tb and not (scalars.is_number(ta) and scalars.is_number(tb)) and not isinstance(ta, T.NullType) and not isinstance(tb, T.NullType):
                    a, b = a.cast("array<string>"), b.cast("array<string>")  # lists of several types hold texts
                return F.concat(a, b)
            if isinstance(ta, T.StringType) or isinstance(tb, T.StringType):
                text = lambda x, t: scalars.apply("tostring", [x], [t])
                return F.concat(text(a, ta), text(b, tb))
        whole = scalars.is_whole(ta) and scalars.is_whole(tb)
        if whole:
            a, b = a.cast("long"), b.cast("long")
        match op:
            case "+":
                return a + b
            case "-":
                return a - b
            case "*":
                return a * b
            case "/":
                return F.call_function("div", a, b) if whole else a.cast("double") / b.cast("double")
            case "%":
                return a % b
            case "^":
                return F.pow(a.cast("double"), b.cast("double"))
        raise GraphError(f"no operator {op}")

    def function(self, s: Scope, e: P.Fn) -> Column:
        name, args = e.name, e.args
        if name in aggregates.AGGREGATES:
            raise GraphError(f"{name} can't be used here")
        b = s.names.get(args[0].name) if len(args) >= 1 and isinstance(args[0], P.Var) and args[0].name not in self.local else None
        match b:
            case Node():
                props = self.g.vertex_props(b.labels)
                match name:
                    case "id":
                        return c(b.id)
                    case "label":
                        return self.label_col(b)
                    case "labels":
                        return F.array(self.label_col(b))
                    case "keys":
                        return self.keys_of_node(b)
                    case "properties":
                        return F.struct(self.label_col(b).alias("_LABEL_"), c(b.id).alias("_VID_"), *[c(f"{b.name}@p@{p}").alias(p) for p in sorted(props)])
                    case "exists":
                        return c(b.id).isNotNull()
            case Rel():
                match name:
                    case "id":
                        return c(b.col("eid"))
                    case "euid":
                        return F.concat_ws("_", c(b.col("src")), c(b.col("dst")), c(b.col("type")), F.lit("0"), c(b.col("eid")))
                    case "type" | "label":
                        return c(b.col("type"))
                    case "startnode":
                        return c(b.col("src"))
                    case "endnode":
                        return c(b.col("dst"))
                    case "keys":
                        return F.array(*[F.lit(p) for p in sorted(edge_props(b.tables))]).cast("array<string>")
                    case "properties":
                        return self.rel_struct(b)
            case Path():
                match name:
                    case "length":
                        return F.size(c(b.rels)).cast("long")
                    case "nodes":
                        return c(b.nodes)
                    case "relationships":
                        return c(b.rels)
                    case "properties":
                        return self.whole(s, b)
            case RelList():
                if name in ("length", "size"):
                    return F.size(c(b.list)).cast("long")
        if name == "native.getedgefield":
            return self.prop(s, P.Prop(args[0], args[1].value))
        if name == "exists":
            return self.null_test(s, args[0]).isNotNull()
        cols = [self.expr(s, a) for a in args]
        if name == "getmemberprop":
            return F.transform(cols[0], lambda x: x[args[1].value])
        if name in ("type", "id", "startnode", "endnode") and len(cols) == 1:
            return cols[0][{"type": "_type", "id": "_eid", "startnode": "_src", "endnode": "_dst"}[name]]
        return scalars.apply(name, cols, [self.type_of(s, x) for x in cols])

    def keys_of_node(self, b: Node) -> Column:
        out = F.array().cast("array<string>")
        for name in sorted(b.labels):
            mine = F.array(*[F.lit(p) for p in sorted(self.g.vertices[name].props)]).cast("array<string>")
            out = mine if len(b.labels) == 1 else F.when(self.label_col(b) == name, mine).otherwise(out)
        return out

    # --- vertices on demand -------------------------------------------------
    def needs(self, s: Scope, e: Any, whole: bool = True) -> set[str]:
        """The vertex variables whose properties an expression uses."""
        match e:
            case P.Prop(P.Var(name), prop) if isinstance(s.names.get(name), Node):
                return {name}
            case P.Fn(fn, [P.Var(name), *_]) if isinstance(s.names.get(name), Node):
                rest = set().union(*[self.needs(s, x) for x in e.args[1:]] or [set()])
                return rest | ({name} if fn not in ("id", "label", "labels", "exists", "count", "keys") else set())
            case P.Un("NULL" | "NOT NULL", P.Var(_)):
                return set()
            case P.Case(P.Var(name), whens, other) if isinstance(s.names.get(name), Node):
                return set().union(*[self.needs(s, x) for x in P.children(e)[1:]] or [set()])
            case P.Bin("=" | "<>", P.Var(x), P.Var(y)) if isinstance(s.names.get(x), Node) and isinstance(s.names.get(y), Node):
                return set()
            case P.Var(name) if whole and isinstance(s.names.get(name), Node):
                return {name}
            case P.Exists(path):
                return set().union(*[self.needs(s, x) for x in P.children(e)] or [set()])
        return set().union(*[self.needs(s, x) for x in P.children(e)] or [set()])

    def load(self, s: Scope, names: set[str]) -> Scope:
        """The scope with the properties of these vertices."""
        for name in sorted(names):
            b = s.names[name]
            if b.loaded:
                continue
            props = self.g.vertex_props(b.labels)
            frame = self.g.all_vertices(b.labels).select(F.col("_id").alias(b.id), *[F.col(f"`{p}`").alias(f"{b.name}@p@{p}") for p in props])
            s = Scope(s.df.join(frame, [b.id], "left" if b.nullable else "inner"), {**s.names, name: replace(b, loaded=True)})
        return s

    def scan(self, var: str, labels: set[str]) -> Scope:
        frame = self.g.all_vertices(labels)
        b = Node(var, labels, marked=len(labels) > 1, loaded=True)
        props = self.g.vertex_props(labels)
        cols = [F.col("_id").alias(b.id), *([F.col("_label").alias(b.label)] if b.marked else []), *[F.col(f"`{p}`").alias(f"{var}@p@{p}") for p in props]]
        return Scope(frame.select(*cols), {var: b})

    def where(self, s: Scope, e: Any) -> Scope:
        """Filter by a condition, patterns in it as joins."""
        for part in conjuncts(e):
            if isinstance(part, P.Exists):
                s = self.semi(s, part.path, "left_semi")
            elif isinstance(part, P.Un) and part.op == "NOT" and isinstance(part.a, P.Exists):
                s = self.semi(s, part.a.path, "left_anti")
            else:
                s, part = self.marks(s, part)
                s = self.load(s, self.needs(s, part))
                keys = self.key_condition(s, part)
                s = Scope(s.df.filter(self.expr(s, part) if keys is None else keys & self.expr(s, part)), s.names)
        return s

    def key_condition(self, s: Scope, part: Any) -> Column | None:
        """What ``id(n) = x`` and ``id(n) IN [...]`` say about the primary key,
        which the scan can use; None if nothing."""
        match part:
            case P.Bin("=", P.Fn("id", [P.Var(name)]), value) | P.Bin("=", value, P.Fn("id", [P.Var(name)])):
                values = [value]
            case P.Bin("IN", P.Fn("id", [P.Var(name)]), P.ListLit(values)):
                pass
            case P.Bin("IN", P.Fn("id", [P.Var(name)]), P.Param() as given):
                values = [P.Lit(v) for v in self.params.get(given.name) or []]
            case _:
                return None
        b = s.names.get(name)
        if not isinstance(b, Node) or not b.loaded or not all(isinstance(v, (P.Lit, P.Param)) for v in values):
            return None
        ids = [self.constant(v) for v in values]
        out = F.lit(False)
        for label in sorted(b.labels):
            v = self.g.vertices[label]
            if v.number is None or not all(isinstance(i, int) for i in ids):
                return None
            keys = [i - (v.number << KEY_BITS) for i in ids if i >> KEY_BITS == v.number]
            if keys:
                out = out | ((self.label_col(b) == label) & c(f"{b.name}@p@{v.primary}").isin(*keys) if b.marked else c(f"{b.name}@p@{v.primary}").isin(*keys))
        return out

    def matched_keys(self, s: Scope, path: P.PathPat) -> tuple[DataFrame, list[str]]:
        """The distinct bound ends for which the pattern has a match."""
        start, keys = self.bound_start(s, P.variables(P.Exists(path)))
        got = self.match(start, [path], None)
        return got.df.select(*[c(k) for k in keys]).distinct(), keys

    def bound_start(self, s: Scope, used: set[str]) -> tuple[Scope, list[str]]:
        """The distinct values of the bound variables among ``used``, and their columns."""
        shared = [n for n in sorted(used) if n in s.names]
        nodes = [n for n in shared if isinstance(s.names[n], Node)]
        others = [s.names[n].col for n in shared if isinstance(s.names[n], Value)]
        keys = [s.names[n].id for n in nodes] + others
        marks = [s.names[n].label for n in nodes if s.names[n].marked]
        start = Scope(s.df.select(*[c(k) for k in (*keys, *marks)]).distinct() if keys else None, {n: replace(s.names[n], loaded=False) if n in nodes else s.names[n] for n in shared})
        for n in nodes:
            if s.names[n].nullable:
                start = Scope(start.df.filter(c(s.names[n].id).isNotNull()), {**start.names, n: replace(start.names[n], nullable=False)})
        return start, keys

    def gathered(self, s: Scope, e: P.PatComp) -> tuple[Scope, Any]:
        """A pattern comprehension as a column: the matches from the distinct
        bound ends, their values gathered and joined back."""
        start, keys = self.bound_start(s, P.variables(e))
        got = self.match(start, [e.path], e.where)
        got, out = self.marks(got, e.out)
        got = self.load(got, self.needs(got, out))
        name = self.new("gathered")
        mark, v = Value(name), F.struct(self.expr(got, out).alias("v"))  # a struct, so that nulls stay
        lists = got.df.groupBy(*[c(k) for k in keys]).agg(F.collect_list(v).alias(mark.col))
        df = s.df.join(lists, keys, "left") if keys else s.df.crossJoin(F.broadcast(lists))  # one row
        empty = F.array().cast(lists.schema[mark.col].dataType)
        df = df.withColumn(mark.col, F.transform(F.coalesce(c(mark.col), empty), lambda x: x["v"]))
        return Scope(df, {**s.names, name: mark}), P.Var(name)

    def semi(self, s: Scope, path: P.PathPat, how: str) -> Scope:
        keys_df, keys = self.matched_keys(s, path)
        if not keys:
            some = not keys_df.isEmpty()
            return Scope(s.df.filter(F.lit(some == (how == "left_semi"))), s.names)
        return Scope(s.df.join(keys_df, keys, how), s.names)

    def marks(self, s: Scope, e: Any) -> tuple[Scope, Any]:
        """Patterns inside an expression become columns of truth values."""
        if isinstance(e, P.Exists):
            keys_df, keys = self.matched_keys(s, e.path)
            name = self.new("exists")
            mark = Value(name)
            if not keys:
                return Scope(s.df.withColumn(mark.col, F.lit(not keys_df.isEmpty())), {**s.names, name: mark}), P.Var(name)
            df = s.df.join(keys_df.withColumn(mark.col, F.lit(True)), keys, "left").withColumn(mark.col, F.coalesce(c(mark.col), F.lit(False)))
            return Scope(df, {**s.names, name: mark}), P.Var(name)
        if isinstance(e, P.PatComp):
            return self.gathered(s, e)
        if not has_exists(e):
            return s, e
        match e:
            case P.Index(of, at):
                s, of = self.marks(s, of)
                s, at = self.marks(s, at)
                return s, P.Index(of, at)
            case P.Slice(of, low, high):
                s, of = self.marks(s, of)
                return s, P.Slice(of, low, high)
            case P.Comp():
                s, of = self.marks(s, e.of)
                return s, replace(e, of=of)
            case P.ListLit(items):
                done = []
                for x in items:
                    s, x = self.marks(s, x)
                    done.append(x)
                return s, P.ListLit(done)
            case P.MapLit(items):
                fields = {}
                for k, x in items.items():
                    s, fields[k] = self.marks(s, x)
                return s, P.MapLit(fields)
            case P.Un(op, a):
                s, a = self.marks(s, a)
                return s, P.Un(op, a)
            case P.Bin(op, a, b):
                s, a = self.marks(s, a)
                s, b = self.marks(s, b)
                return s, P.Bin(op, a, b)
            case P.Fn():
                args = []
                for x in e.args:
                    s, x = self.marks(s, x)
                    args.append(x)
                return s, replace(e, args=args)
            case P.Case(test, whens, other):
                if test is not None:
                    s, test = self.marks(s, test)
                done = []
                for w, t in whens:
                    s, w = self.marks(s, w)
                    s, t = self.marks(s, t)
                    done.append((w, t))
                if other is not None:
                    s, other = self.marks(s, other)
                return s, P.Case(test, done, other)
        raise GraphError("exists(pattern) can't be used here")

    # --- patterns -----------------------------------------------------------
    def check(self, path: P.PathPat) -> None:
        for n in path.nodes:
            for name in n.labels:
                if name not in self.g.vertices:
                    raise GraphError(f"no vertex label {name}")
            if n.labels:
                known = self.g.vertex_props(set(n.labels))
                for p in n.props:
                    if p not in known:
                        raise GraphError(f"{n.labels} has no property {p}")

    def match(self, s: Scope, paths: list[P.PathPat], where: Any) -> Scope:
        """Inner match of all paths, which share one rule of unique edges."""
        outer = set(s.names)
        paths = [replace(p, nodes=[replace(n, var=n.var or self.new()) for n in p.nodes], rels=[replace(r, var=r.var or self.new()) for r in p.rels]) for p in paths]
        paths = self.hop_by_hop(outer, paths)
        # inline conditions on other variables join the paths they come from
        foreign: list = []
        for path in paths:
            for n in (*path.nodes, *(r for r in path.rels if r.span is None)):
                for k, v in list(n.props.items()):
                    if P.variables(v) and n.var not in s.names:
                        foreign.append(P.Bin("=", P.Prop(P.Var(n.var), k), v))
                        n.props = {a: b for a, b in n.props.items() if a != k}
                if n.where is not None and P.variables(n.where) - {n.var}:
                    foreign.append(n.where)
                    n.where = None
        local: dict[str, list] = {}
        inline = {n.var for p in paths for n in p.nodes} - outer
        rest = []
        for part in foreign + conjuncts(where):
            used = P.variables(part)
            if len(used) == 1 and used <= inline and not has_exists(part):
                local.setdefault(next(iter(used)), []).append(part)
            else:
                rest.append(part)
        slots: list[Any] = []
        todo = list(paths)
        while todo:  # connected paths first
            at = next((i for i, p in enumerate(todo) if any(n.var in s.names for n in p.nodes)), 0)
            p = todo.pop(at)
            self.check(p)
            if s.df is not None and not any(n.var in s.names for n in p.nodes):
                other = self.path(Scope(None), p, local, slots)
                used = set().union(*[P.variables(x) for x in rest] or [set()])
                other = self.load(other, {n for n in used & set(other.names) if isinstance(other.names[n], Node) and any(self.needs(other, x) & {n} for x in rest)})
                s = self.load(s, {n for n in used & set(s.names) if isinstance(s.names[n], Node) and any(n in self.needs(s, x) for x in rest)})
                s = Scope(s.df.crossJoin(other.df), {**s.names, **other.names})
            else:
                s = self.path(s, p, local, slots)
        for a, b in combinations(slots, 2):
            if a.tables is b.tables or {t.label for t in a.tables} & {t.label for t in b.tables}:
                s = Scope(s.df.filter(~self.same_edge(a, b)), s.names)
        for part in rest:
            s = self.where(s, part)
        return s

    def hop_by_hop(self, outer: set[str], paths: list[P.PathPat]) -> list[P.PathPat]:
        """Paths that close a circle, cut into their hops: whatever closes it as
        soon as both ends are there, else the hop of fewest edges per vertex it
        starts from. In the order given, two ends with a common neighbour of
        many edges would be paired before anything else links them."""
        hops = [(a, r, b) for p in paths for a, r, b in zip(p.nodes, p.rels, p.nodes[1:])]
        every = [n for p in paths for n in p.nodes]
        if len(paths) < 2 or len(hops) < len({n.var for n in every}) or any(p.var or p.shortest or not p.rels for p in paths) or any(r.span is not None for _, r, _ in hops):
            return paths
        labels: dict[str, list[str]] = {}
        for n in every:
            if n.labels:
                labels.setdefault(n.var, n.labels)
        picky = {n.var for n in every if n.props or n.where is not None}
        bound, met, out = set(outer), set(), []

        def cost(hop: tuple) -> float:
            a, r, b = hop
            if a.var in bound and b.var in bound:
                return -1
            tables = self.oriented(r, False, set(labels.get(a.var, [])) or None, set(labels.get(b.var, [])) or None)
            rows = sum(t.rows for t, _ in tables)
            if not bound & {a.var, b.var}:
                return rows * (0.01 if picky & {a.var, b.var} else 1)
            own = {t.src_label if rev != (a.var in bound) else t.dst_label for t, rev in tables}
            return rows / max(1, sum(self.g.vertices[x].rows for x in own))

        while hops:
            hop = min([h for h in hops if bound & {h[0].var, h[2].var}] or hops, key=cost)
            hops.remove(hop)
            ends = []
            for n in (hop[0], hop[2]):
                n = replace(n, labels=n.labels or labels.get(n.var, []))
                ends.append(replace(n, props={}, where=None) if id(n.props) in met else n)
                met.add(id(n.props))
            bound |= {hop[0].var, hop[2].var}
            out.append(P.PathPat(None, ends, [hop[1]]))
        return out

    def same_edge(self, a: Any, b: Any) -> Column:
        def one(r: Rel, x: Column | None = None) -> tuple[Column, Column]:
            return (c(r.col("eid")), c(r.col("type"))) if x is None else (x["_eid"], x["_type"])

        if isinstance(a, Rel) and isinstance(b, Rel):
            same = c(a.col("eid")) == c(b.col("eid"))
            return same if len(a.types | b.types) == 1 else same & (c(a.col("type")) == c(b.col("type")))
        if isinstance(a, RelList) and isinstance(b, RelList):
            return F.exists(c(a.list), lambda x: F.exists(c(b.list), lambda y: (x["_eid"] == y["_eid"]) & (x["_type"] == y["_type"])))
        if isinstance(a, Rel):
            a, b = b, a
        return F.exists(c(a.list), lambda x: (x["_eid"] == c(b.col("eid"))) & (x["_type"] == c(b.col("type"))))

    def path(self, s: Scope, p: P.PathPat, local: dict[str, list], slots: list) -> Scope:
        if p.shortest:
            raise GraphError("use CALL algo.shortestPath or algo.allShortestPaths")
        if p.var:
            self.told |= {r.var for r in p.rels}
        bound = [i for i, n in enumerate(p.nodes) if n.var in s.names]
        picky = [i for i, n in enumerate(p.nodes) if n.props or n.where is not None or local.get(n.var)]
        start = bound[0] if bound else picky[0] if picky else 0
        mine: dict[int, Any] = {}
        if bound:
            s = self.node_filters(s, p.nodes[start], local)
        elif not p.rels or start in picky or p.rels[min(start, len(p.rels) - 1)].span is not None:
            n = p.nodes[start]
            got = self.scan(n.var, set(n.labels) or set(self.g.vertices))
            s = Scope(got.df if s.df is None else s.df.crossJoin(got.df), {**s.names, **got.names})
            s = self.node_filters(s, n, local)
        for i in range(start, len(p.rels)):
            s = self.expand(s, p.nodes[i], p.rels[i], p.nodes[i + 1], False, local, mine, i)
        for i in range(start - 1, -1, -1):
            s = self.expand(s, p.nodes[i + 1], p.rels[i], p.nodes[i], True, local, mine, i)
        slots += [mine[i] for i in sorted(mine)]
        if p.var:
            s = self.path_value(s, p, [mine[i] for i in sorted(mine)])
        return s

    def node_filters(self, s: Scope, n: P.NodePat, local: dict[str, list]) -> Scope:
        b = s.names[n.var]
        if not isinstance(b, Node):
            raise GraphError(f"{n.var} is no vertex")
        if n.labels and not b.labels <= set(n.labels):
            keep = b.labels & set(n.labels)
            df = s.df.filter(self.label_col(b).isin(*n.labels)) if keep else s.df.filter(F.lit(False))
            s = Scope(df, {**s.names, n.var: replace(b, labels=keep or b.labels)})
        parts = [P.Bin("=", P.Prop(P.Var(n.var), k), v) for k, v in n.props.items()] + conjuncts(n.where) + local.pop(n.var, [])
        for part in parts:
            s = self.where(s, part)
        return s

    def edge_frame(self, name: str, tables: list[tuple[EdgeTable, bool]], structs: bool = False) -> DataFrame:
        """The edges of the given tables in the given orientation: ``from``,
        ``to``, their labels, and the edge's own columns."""
        own = [t for t, _ in tables]
        props = edge_props(own)
        parts = []
        for t, reverse in tables:
            src, dst = (F.col("_dst"), F.col("_src")) if reverse else (F.col("_src"), F.col("_dst"))
            a, b = (t.dst_label, t.src_label) if reverse else (t.src_label, t.dst_label)
            df = t.df
            if reverse and any(u is t and not r for u, r in tables):
                df = df.filter("_src <> _dst")  # a self-loop is met once
            parts.append(df.select(src.alias(f"{name}@from"), dst.alias(f"{name}@to"), F.lit(a).alias(f"{name}@fl"), F.lit(b).alias(f"{name}@tl"), F.col("_eid").cast("long").alias(f"{name}@eid"), F.lit(t.label).alias(f"{name}@type"), F.col("_src").alias(f"{name}@src"), F.col("_dst").alias(f"{name}@dst"), *[(F.col(f"`{p}`") if p in t.props else F.lit(None)).cast(k).alias(f"{name}@p@{p}") for p, k in props.items()]))
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    def oriented(self, r: P.RelPat, backwards: bool, a: set[str] | None, b: set[str] | None) -> list[tuple[EdgeTable, bool]]:
        """The edge tables, with orientation, that lead from labels a to labels b."""
        direction = r.direction
        if backwards:
            direction = {">": "<", "<": ">", "-": "-"}[direction]
        out = []
        for t in self.g.edges:
            if r.types and t.label not in r.types:
                continue
            if direction in ">-" and (a is None or t.src_label in a) and (b is None or t.dst_label in b):
                out.append((t, False))
            if direction in "<-" and (a is None or t.dst_label in a) and (b is None or t.src_label in b):
                out.append((t, True))
        return out

    def expand(self, s: Scope, a: P.NodePat, r: P.RelPat, b: P.NodePat, backwards: bool, local: dict, mine: dict, i: int) -> Scope:
        if r.var in s.names:
            raise GraphError(f"{r.var} is already bound")
        bound = b.var in s.names
        start = s.names.get(a.var)
        from_labels = start.labels if start else set(a.labels) or None
        to_labels = s.names[b.var].labels if bound else set(b.labels) or None
        if bound and b.labels:
            to_labels = to_labels & set(b.labels)
        if r.span is not None:
            return self.expand_many(s, a, r, b, backwards, local, mine, i, to_labels)
        tables = self.oriented(r, backwards, from_labels, to_labels)
        rel = Rel(r.var, [t for t, _ in tables])
        if not tables:
            return self.nothing(s, a, rel, b, mine, i)
        e = self.edge_frame(r.var, tables)
        names = dict(s.names)
        f, t = f"{r.var}@from", f"{r.var}@to"
        from_set = {(x.dst_label if rev else x.src_label) for x, rev in tables}
        to_set = {(x.src_label if rev else x.dst_label) for x, rev in tables}
        names[r.var] = rel
        if start is None:
            node = Node(a.var, from_set, marked=len(from_set) > 1)
            e = e.withColumnRenamed(f, node.id)
            e = e.withColumnRenamed(f"{r.var}@fl", node.label) if node.marked else e.drop(f"{r.var}@fl")
            names[a.var] = node
            df = e if s.df is None else s.df.crossJoin(e)
            on = None
        else:
            e = e.drop(f"{r.var}@fl").withColumnRenamed(f, start.id)
            names[a.var] = replace(start, labels=from_set & start.labels or start.labels, marked=start.marked, nullable=False)
            on = [start.id]
            df = None
        again = bound or b.var == a.var
        if again:
            node = names[b.var]
            e = e.drop(f"{r.var}@tl")
            if b.var == a.var:  # a self-loop in the pattern
                e = e.filter(c(t) == c(names[a.var].id)).drop(t)
                df = (e if s.df is None else s.df.crossJoin(e)) if on is None else s.df.join(e, on)
            elif on is None:
                df = df.filter(c(t) == c(node.id)).drop(t, f"{r.var}@tl")
            else:
                df = s.df.join(e.withColumnRenamed(t, node.id), [*on, node.id])
        else:
            node = Node(b.var, to_set, marked=len(to_set) > 1)
            rename = lambda x: (x.withColumnRenamed(f"{r.var}@tl", node.label) if node.marked else x.drop(f"{r.var}@tl")).withColumnRenamed(t, node.id)
            df = rename(df) if on is None else s.df.join(rename(e), on)
            names[b.var] = node
        s = Scope(df, names)
        mine[i] = rel
        for part in [P.Bin("=", P.Prop(P.Var(r.var), k), v) for k, v in r.props.items()] + conjuncts(r.where):
            s = self.where(s, part)
        if start is None:
            s = self.node_filters(s, a, local)
        return self.node_filters(s, b, local)

    def nothing(self, s: Scope, a: P.NodePat, rel: Any, b: P.NodePat, mine: dict, i: int) -> Scope:
        """No edge table fits: an empty frame with the columns of a match."""
        df = s.df if s.df is not None else self.g.spark.range(0)
        names = dict(s.names)
        for n in (a, b):
            if n.var not in names:
                labels = set(n.labels) or set(self.g.vertices)
                node = Node(n.var, labels, marked=len(labels) > 1)
                df = df.withColumn(node.id, F.lit(None).cast("long"))
                if node.marked:
                    df = df.withColumn(node.label, F.lit(None).cast("string"))
                names[n.var] = node
        if isinstance(rel, Rel):
            for k, kind in (("eid", "long"), ("type", "string"), ("src", "long"), ("dst", "long")):
                df = df.withColumn(rel.col(k), F.lit(None).cast(kind))
        else:
            df = df.withColumn(rel.list, F.array().cast("array<struct<_eid:bigint,_type:string,_src:bigint,_dst:bigint>>")).withColumn(rel.nodes, F.array().cast("array<struct<_id:bigint,_label:string>>"))
        names[rel.name] = rel
        mine[i] = rel
        return Scope(df.filter(F.lit(False)), names)

    def expand_many(self, s: Scope, a: P.NodePat, r: P.RelPat, b: P.NodePat, backwards: bool, local: dict, mine: dict, i: int, to_labels: set[str] | None) -> Scope:
        """Edge-distinct paths of low to high hops."""
        low, high = r.span
        start, bound = s.names[a.var], b.var in s.names
        # the labels a hop can start from, and those from which the end can be reached: only edge tables between them are scanned
        useful = to_labels
        while useful is not None:
            more = useful | {x.dst_label if rev else x.src_label for x, rev in self.oriented(r, backwards, None, useful)}
            if more == useful:
                break
            useful = more
        reached, tables = set(start.labels), []
        for _ in range(len(self.g.vertices) if high is None else min(high, len(self.g.vertices))):
            tables = self.oriented(r, backwards, reached, useful)
            more = reached | {x.src_label if rev else x.dst_label for x, rev in tables}
            if more == reached:
                break
            reached = more
        rel = RelList(r.var, list(dict.fromkeys(t for t, _ in tables)), backwards)
        name = r.var
        cur, cur_label = f"{name}@cur", f"{name}@curlabel"
        props = edge_props(rel.tables)
        lean = "#" in name and name not in self.told  # nobody asks for the edges: just which they are, so that none is used twice
        kind = "array<struct<_eid:bigint,_type:string" + ("" if lean else ",_src:bigint,_dst:bigint" + "".join(f",`{p}`:{t.simpleString()}" for p, t in props.items())) + ">>"
        df = s.df.withColumn(rel.list, F.array().cast(kind)).withColumn(rel.nodes, F.array().cast("array<struct<_id:bigint,_label:string>>")).withColumn(cur, c(start.id)).withColumn(cur_label, self.label_col(start))

        def steps(labels: set[str], last: set[str] | None) -> tuple[DataFrame | None, set[str]]:
            """The edges that lead on from ``labels`` (to ``last``, if given), and where to."""
            fit = self.oriented(r, backwards, labels, last)
            if not fit:
                return None, set()
            here = Rel(name, [t for t, _ in fit])
            probe = Scope(self.edge_frame(name, fit), {name: here})
            for part in [P.Bin("=", P.Prop(P.Var(name), k), v) for k, v in r.props.items()] + conjuncts(r.where):
                probe = self.where(probe, part)
            one = F.struct(c(here.col("eid")).alias("_eid"), c(here.col("type")).alias("_type")) if lean else self.rel_struct(here, props)
            step = probe.df.select(c(f"{name}@from").alias(cur), c(f"{name}@to").alias(f"{name}@next"), c(f"{name}@tl").alias(f"{name}@nextlabel"), one.alias(f"{name}@edge"))
            return step, {x.src_label if rev else x.dst_label for x, rev in fit}

        def ended(x: DataFrame) -> DataFrame:
            if to_labels is not None:
                x = x.filter(c(cur_label).isin(*to_labels))
            return x.filter(c(cur) == c(s.names[b.var].id)) if bound else x

        def hop(x: DataFrame, step: DataFrame) -> DataFrame:
            edge = c(f"{name}@edge")
            x = x.join(step, [cur]).filter(~F.exists(c(rel.list), lambda y: (y["_eid"] == edge["_eid"]) & (y["_type"] == edge["_type"])))
            x = x.withColumn(rel.list, F.concat(c(rel.list), F.array(edge).cast(kind)))
            x = x if lean else x.withColumn(rel.nodes, F.concat(c(rel.nodes), F.array(F.struct(c(f"{name}@next").alias("_id"), c(f"{name}@nextlabel").alias("_label")))))
            return x.drop(cur, cur_label, f"{name}@edge").withColumnRenamed(f"{name}@next", cur).withColumnRenamed(f"{name}@nextlabel", cur_label)

        found = [ended(df)] if low == 0 else []
        most = MAX_HOPS if high is None else high
        at, last = set(start.labels), None
        for n in range(1, most + 1):
            step, at = steps(at, to_labels if n == most else useful)
            if step is None:
                break
            df = hop(df, step)
            if most > UNROLLED and (n >= low or n % UNROLLED == 0):
                df = cut(df, replaces=last)
                last = df if n < low else None  # once it is grown, nothing reads it
                if df.isEmpty():
                    break
            if n >= low:
                found.append(ended(df))
        if not found:
            found = [df.filter(F.lit(False))]
        out = found[0]
        for x in found[1:]:
            out = out.unionByName(x)
        names = {**s.names, name: rel}
        if bound:
            out = out.drop(cur, cur_label)
        else:
            labels = to_labels or set(self.g.vertices)
            node = Node(b.var, labels, marked=len(labels) > 1)
            out = out.withColumnRenamed(cur, node.id)
            out = out.withColumnRenamed(cur_label, node.label) if node.marked else out.drop(cur_label)
            names[b.var] = node
        if backwards:  # the pattern reads from b to a
            out = out.withColumn(rel.list, F.reverse(c(rel.list)))
        mine[i] = rel
        return self.node_filters(Scope(out, names), b, local)

    def path_value(self, s: Scope, p: P.PathPat, rels: list) -> Scope:
        props = edge_props([t for r in rels for t in r.tables])
        kinds = {k: t for k, t in props.items()}

        def wide(x: Column, own: dict) -> Column:
            return F.struct(x["_eid"].alias("_eid"), x["_type"].alias("_type"), x["_src"].alias("_src"), x["_dst"].alias("_dst"), *[(x[k] if k in own else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])

        def node(i: int) -> Column:
            b = s.names[p.nodes[i].var]
            return F.array(F.struct(c(b.id).alias("_id"), self.label_col(b).alias("_label")))

        parts, edges = [node(0)], []
        for i, r in enumerate(rels):
            if isinstance(r, Rel):
                parts.append(node(i + 1))
                edges.append(F.array(self.rel_struct(r, kinds)))
                continue
            own, walked = edge_props(r.tables), c(r.nodes)
            edges.append(self.widened(c(r.list), own, wide))
            if r.back:  # walked from the far end: the inner vertices in reverse, then that end
                none = F.array().cast("array<struct<_id:bigint,_label:string>>")
                walked = F.when(F.size(walked) == 0, none).otherwise(F.concat(F.reverse(F.slice(walked, F.lit(1), F.greatest(F.size(walked) - 1, F.lit(0)))), node(i + 1)))
            parts.append(walked)
        path = Path(p.var)
        empty = F.array().cast("array<struct<_eid:bigint,_type:string,_src:bigint,_dst:bigint>>")
        df = s.df.withColumn(path.nodes, F.concat(*parts)).withColumn(path.rels, F.concat(*edges) if edges else empty)
        return Scope(df, {**s.names, p.var: path})

    @staticmethod
    def widened(items: Column, own: dict, wide: Any) -> Column:
        return F.transform(items, lambda x: wide(x, own))

    # --- clauses --------------------------------------------------------------
    def clause(self, s: Scope, x: Any) -> Scope:
        match x:
            case P.Match(paths, where, optional):
                return self.optional(s, paths, where) if optional else self.match(s, paths, where)
            case P.Unwind(of, var):
                s = self.load(s, self.needs(s, of))
                base = s.df if s.df is not None else self.g.spark.range(1).select()
                col = self.expr(s, of)
                t = self.type_of(s, col)
                if t is not None and not isinstance(t, (T.ArrayType, T.NullType)):
                    raise GraphError("UNWIND needs a list")
                v = Value(var)
                return Scope(base.select("*", F.explode(col).alias(v.col)) if not isinstance(t, T.NullType) else base.withColumn(v.col, F.lit(None)).filter(F.lit(False)), {**s.names, var: v})
            case P.Project():
                return self.project(s, x)
            case P.Call():
                return self.call(s, x)
        raise GraphError(f"{type(x).__name__} is an update: use graph.update")

    def optional(self, s: Scope, paths: list[P.PathPat], where: Any) -> Scope:
        if s.df is None:
            got = self.match(Scope(None), paths, where)
            one = self.g.spark.range(1).withColumnRenamed("id", "@one")
            df = one.join(got.df.withColumn("@one", F.lit(0).cast("long")), ["@one"], "left").drop("@one")
            return Scope(df, {n: self.nullable(b) for n, b in got.names.items()})
        used = {n.var for p in paths for n in p.nodes if n.var} | (P.variables(where) if where is not None else set())
        for p in paths:
            used |= {v for x in P.children(P.Exists(p)) for v in P.variables(x)}
        shared = {n: b for n, b in s.names.items() if n in used}
        s = self.load(s, set().union(*[self.needs(s, x) for x in conjuncts(where)] or [set()]) & set(shared))
        shared = {n: s.names[n] for n in shared}
        cols = [k for k in s.df.columns if any(k.startswith(f"{n}@") for n in shared)]
        if not cols:
            got = self.match(Scope(None), paths, where)
            df = s.df.withColumn("@one", F.lit(1)).join(got.df.withColumn("@one", F.lit(1)), ["@one"], "left").drop("@one")
            return Scope(df, {**s.names, **{n: self.nullable(b) for n, b in got.names.items()}})
        keys = [k for n, b in shared.items() for k in ([b.id] if isinstance(b, Node) else [b.col("type"), b.col("eid")] if isinstance(b, Rel) else [b.col] if isinstance(b, Value) else [])]
        start = Scope(s.df.select(*[c(k) for k in cols]).dropDuplicates(keys), {n: replace(b, nullable=False) if isinstance(b, (Node, Rel)) else b for n, b in shared.items()})
        for n, b in shared.items():
            if isinstance(b, Node) and b.nullable:
                start = Scope(start.df.filter(c(b.id).isNotNull()), start.names)
        got = self.match(start, paths, where)
        fresh = {n: self.nullable(b) for n, b in got.names.items() if n not in s.names}
        new_cols = [k for k in got.df.columns if k not in s.df.columns]
        right = got.df.select(*[c(k).alias(f"{k}@r") for k in keys], *[c(k) for k in new_cols])
        cond = None
        for k in keys:
            one = s.df[f"`{k}`"].eqNullSafe(right[f"`{k}@r`"]) if any(isinstance(b, Value) and b.col == k for b in shared.values()) else s.df[f"`{k}`"] == right[f"`{k}@r`"]
            cond = one if cond is None else cond & one
        df = s.df.join(right, cond, "left").drop(*[f"{k}@r" for k in keys])
        return Scope(df, {**s.names, **fresh})

    @staticmethod
    def nullable(b: Any) -> Any:
        return replace(b, nullable=True) if isinstance(b, (Node, Rel, RelList)) else b

    def carried(self, s: Scope, b: Any, alias: str) -> tuple[Any, list[tuple[str, str]], list[str]]:
        """A variable under another name: its binding, its columns as (old,
        new), and those of them that identify it."""
        old = f"{b.name}@"
        cols = [(k, f"{alias}@{k[len(old):]}") for k in s.df.columns if k.startswith(old)]
        ids = {Node: ["id", "label"], Rel: ["eid", "type", "src", "dst"], RelList: ["list", "nodes"], Path: ["pathnodes", "pathrels"], Value: ["v"]}[type(b)]
        return replace(b, name=alias), cols, [f"{alias}@{k}" for k in ids if f"{old}{k}" in s.df.columns]

    def project(self, s: Scope, p: P.Project) -> Scope:
        items = list(p.items)
        if p.star:
            items = [P.Item(P.Var(n), n) for n in s.names if "#" not in n] + items
        if s.df is None:
            s = Scope(self.g.spark.range(1).select(F.lit(1).alias("@unit")), s.names)
        marked = []
        for it in items:
            s, e = self.marks(s, it.expr)
            marked.append(P.Item(e, it.name))
        items = marked
        needed: set[str] = set()
        for it in items:
            carried = isinstance(it.expr, P.Var) and not p.final
            needed |= self.needs(s, it.expr) if not carried else set()
        outputs = {it.name for it in items}
        extra_order = [e for e, _ in p.order if not (isinstance(e, P.Var) and e.name in outputs) and not any(e == it.expr for it in items)]
        grouped = any(has_aggregate(it.expr) for it in items)
        for e in extra_order:
            if not grouped and not p.distinct:
                needed |= self.needs(s, self.rename(e, items))
        s = self.load(s, needed)
        names: dict[str, Any] = {}
        keys: list[tuple[str, Column]] = []  # columns that rows are grouped or told apart by
        extra: list[tuple[str, Column]] = []  # columns that depend on these
        for it in items:
            if has_aggregate(it.expr):
                continue
            b = s.names.get(it.expr.name) if isinstance(it.expr, P.Var) else None
            if b is not None and not p.final:
                b2, cols, ids = self.carried(s, b, it.name)
                names[it.name] = b2
                for old, new in cols:
                    (keys if new in ids else extra).append((new, c(old)))
            else:
                names[it.name] = Value(it.name)
                keys.append((f"{it.name}@v", self.expr(s, it.expr)))
        hidden: list[tuple[str, Column]] = []
        order: list[Column] = []
        for e, up in p.order:
            same = next((it for it in items if (isinstance(e, P.Var) and e.name == it.name) or e == it.expr), None)
            if same is not None:
                b = names.get(same.name)
                col = f"{same.name}@v" if b is None or isinstance(b, Value) else b.id if isinstance(b, Node) else f"{same.name}@{'eid' if isinstance(b, Rel) else 'list'}"
            else:
                e = self.rename(e, items)
                if grouped or p.distinct:
                    raise GraphError("ORDER BY after aggregation or DISTINCT takes results only")
                col = f"@order{len(hidden)}"
                hidden.append((col, self.expr(s, e)))
            order.append(c(col).asc_nulls_first() if up else c(col).desc_nulls_last())
        if grouped:
            df, names = self.aggregate(s, items, names, keys, extra)
        else:
            df = s.df.select(*[x.alias(k) for k, x in (*keys, *extra, *hidden)])
            if p.distinct:
                df = df.dropDuplicates([k for k, _ in keys]) if extra else df.distinct()
        if order:
            df = df.orderBy(*order)
        if p.skip is not None:
            df = df.offset(self.whole_number(p.skip))
        if p.limit is not None:
            df = df.limit(self.whole_number(p.limit))
        if hidden:
            df = df.drop(*[k for k, _ in hidden])
        names = {it.name: names[it.name] for it in items}
        out = Scope(df, names)
        return self.where(out, p.where) if p.where is not None else out

    def rename(self, e: Any, items: list[P.Item]) -> Any:
        """An ORDER BY expression over result names, in terms of the input."""
        match e:
            case P.Var(name):
                return next((it.expr for it in items if it.name == name), e)
            case P.Prop(of, name):
                return P.Prop(self.rename(of, items), name)
            case P.Fn():
                return replace(e, args=[self.rename(x, items) for x in e.args])
            case P.Bin(op, a, b):
                return P.Bin(op, self.rename(a, items), self.rename(b, items))
            case P.Un(op, a):
                return P.Un(op, self.rename(a, items))
        return e

    def whole_number(self, e: Any) -> int:
        v = self.params.get(e.name) if isinstance(e, P.Param) else getattr(e, "value", None)
        if not isinstance(v, int) or v < 0:
            raise GraphError("SKIP and LIMIT take whole numbers")
        return v

    def aggregate(self, s: Scope, items: list[P.Item], names: dict, keys: list, extra: list) -> tuple[DataFrame, dict]:
        aggs: list[Column] = []
        ready: dict[str, Column] = {}
        later: list[tuple[str, Any]] = []
        inner: dict[str, Any] = {}

        def pull(e: Any) -> Any:
            if isinstance(e, P.Fn) and e.name in aggregates.AGGREGATES:
                v = Value(self.new("agg"))
                aggs.append(self.one_aggregate(s, e, ready).alias(v.col))
                inner[v.name] = v
                return P.Var(v.name)
            match e:
                case P.Bin(op, a, b):
                    return P.Bin(op, pull(a), pull(b))
                case P.Un(op, a):
                    return P.Un(op, pull(a))
                case P.Fn():
                    return replace(e, args=[pull(x) for x in e.args])
                case P.Index(of, at):
                    return P.Index(pull(of), at)
                case P.Slice(of, low, high):
                    return P.Slice(pull(of), low, high)
                case P.Case(test, whens, other):
                    return P.Case(test and pull(test), [(pull(w), pull(t)) for w, t in whens], other and pull(other))
                case P.Comp():
                    return replace(e, of=pull(e.of))
                case P.ListLit(xs):
                    return P.ListLit([pull(x) for x in xs])
                case P.MapLit(xs):
                    return P.MapLit({k: pull(x) for k, x in xs.items()})
            # a grouped expression used beside an aggregate
            for it in items:
                if e == it.expr and it.name in names:
                    return P.Var(it.name)
            return e

        for it in items:
            if has_aggregate(it.expr):
                later.append((it.name, pull(it.expr)))
        source = s.df.select("*", *[x.alias(k) for k, x in ready.items()]) if ready else s.df
        group = source.groupBy(*[x.alias(k) for k, x in keys]) if keys else source.groupBy()
        df = group.agg(*aggs, *[F.first(x).alias(k) for k, x in extra])
        after = Scope(df, {**names, **inner})
        for name, e in later:
            df = df.withColumn(f"{name}@v", self.expr(after, e))
            names[name] = Value(name)
        return df.drop(*[v.col for v in inner.values()]), names

    def one_aggregate(self, s: Scope, e: P.Fn, ready: dict[str, Column]) -> Column:
        """The aggregate; ``ready`` takes columns that it needs by name."""
        if e.star:
            bound = [b for b in s.names.values() if isinstance(b, (Node, Rel))]
            if self.compat == "reference" and bound and all(b.nullable for b in bound):
                return F.count(F.coalesce(*[c(b.id if isinstance(b, Node) else b.col("eid")) for b in bound]))
            return F.count(F.lit(1))
        if e.name == "count" and isinstance(e.args[0], P.Var):
            cols = [self.null_test(s, e.args[0])]
            b = s.names.get(e.args[0].name)
            if isinstance(b, Rel) and e.distinct and len(b.types) > 1:
                return F.count_distinct(F.when(cols[0].isNotNull(), F.struct(cols[0], c(b.col("type")))))
        else:
            cols = [self.expr(s, x) for x in e.args]
        if e.name == "percentiledisc":
            name = self.new("disc")
            ready[name] = aggregates.number(cols[0], self.type_of(s, cols[0]))
            return aggregates.percentile_disc(name, self.constant(e.args[1]) if len(e.args) == 2 else None)
        return aggregates.build(e.name, cols, [self.type_of(s, x) for x in cols], e.distinct, self.compat)

    def call(self, s: Scope, x: P.Call) -> Scope:
        from arcweave.plans import procedures
        from arcweave.plans.changes import CHANGES

        proc = procedures.PROCEDURES.get(x.name.lower())
        if proc is None and x.name.lower() in CHANGES:
            raise GraphError(f"{x.name} changes the graph: use graph.update")
        if proc is None:
            raise GraphError(f"no procedure {x.name}")
        if proc.by_row:
            frame, on, names = proc.rows(self, s, x.args)
            df = s.df.join(frame, on) if on else frame if s.df is None else s.df.crossJoin(frame)
        else:
            frame = proc.call(self.g, [self.constant(a) for a in x.args])
            names = frame.columns
            frame = frame.select(*[c(n).alias(f"{n}@y") for n in names])
            df = frame if s.df is None else s.df.crossJoin(frame)
        yields = x.yields or [(n, n) for n in names]
        bound = {}
        for n, alias in yields:
            if n not in names:
                raise GraphError(f"{x.name} has no result {n}")
            df = df.withColumn(f"{alias}@v", c(f"{n}@y"))
            bound[alias] = Value(alias)
        out = Scope(df.drop(*[f"{n}@y" for n in names]), {**s.names, **bound})
        return self.where(out, x.where) if x.where is not None else out

    def constant(self, e: Any) -> Any:
        match e:
            case P.Lit(v):
                return v
            case P.Param(n):
                return self.params[n]
            case P.ListLit(items):
                return [self.constant(i) for i in items]
            case P.MapLit(items):
                return {k: self.constant(v) for k, v in items.items()}
            case P.Un("-", a):
                return -self.constant(a)
        raise GraphError("this procedure takes constants")

    def apart(self, clauses: list) -> DataFrame | None:
        """A match whose aggregates don't count how often a value comes, each
        taken over the part of the pattern that joins its variables to the keys;
        the other parts only have to exist. None where that isn't so: beside
        trees of hops of different types, keys, and min, max or DISTINCT."""
        if len(clauses) != 2 or not isinstance(clauses[0], P.Match) or not isinstance(clauses[1], P.Project):
            return None
        m, p = clauses
        if m.optional or m.where is not None or p.star or p.distinct or p.order or p.skip is not None or p.limit is not None or p.where is not None:
            return None
        nodes: dict[str, P.NodePat] = {}
        hops: list[tuple[str, P.RelPat, str]] = []
        for path in m.paths:
            names = []
            for n in path.nodes:
                v = n.var or self.new("_n")
                if n.where is not None or any(P.variables(x) for x in n.props.values()) or v in nodes and (n.labels or n.props):
                    return None
                nodes.setdefault(v, replace(n, var=v))
                names.append(v)
            hops += zip(names, path.rels, names[1:])
            if path.var or path.shortest:
                return None
        types = [x for _, r, _ in hops for x in r.types]
        if any(not r.types or r.span is not None or r.props or r.where is not None for _, r, _ in hops) or len(types) != len(set(types)) or len(nodes) != len(hops) + 1:
            return None
        keys = [it for it in p.items if not has_aggregate(it.expr)]
        rest = [it for it in p.items if has_aggregate(it.expr)]
        known = set().union(*[P.variables(it.expr) for it in keys] or [set()])
        if not known or any(has_exists(it.expr) for it in p.items) or any(not isinstance(it.expr, P.Fn) or it.expr.star or any(has_aggregate(x) for x in it.expr.args) or not (it.expr.name in ("min", "max") or it.expr.name in ("count", "collect") and it.expr.distinct) for it in rest):
            return None
        groups: dict[frozenset, list[P.Item]] = {}
        for it in rest:
            groups.setdefault(frozenset(P.variables(it.expr) | known), []).append(it)
        if len(groups) < 2 or not set().union(*groups) <= set(nodes):
            return None
        # a vertex whose properties are taken has to be one of its frame, also where only the other aggregates ask for it
        at_all = Scope(None, {v: Node(v, set()) for v in nodes})
        taken: dict[str, str] = {}

        def props(e: Any) -> None:
            if isinstance(e, P.Prop) and isinstance(e.of, P.Var):
                taken[e.of.name] = e.name
            for x in P.children(e):
                props(x)

        for it in p.items:
            props(it.expr)
        if set().union(*[self.needs(at_all, it.expr) for it in p.items]) - set(taken):
            return None
        there = {v: P.Bin("OR", P.Un("NULL", P.Prop(P.Var(v), x)), P.Un("NOT NULL", P.Prop(P.Var(v), x))) for v, x in taken.items()}

        frames = []
        for need, items in groups.items():
            kept, ends = list(hops), []
            while leaf := next((v for v in nodes if v not in need and sum(v in (a, b) for a, _, b in kept) == 1), None):
                hop = next(h for h in kept if leaf in (h[0], h[2]))
                kept.remove(hop)
                inner = hop[2] if hop[0] == leaf else hop[0]
                at = [e for e in ends if e.nodes[-1].var == leaf]
                if len(at) > 1:
                    return None  # what must exist branches
                way = hop[1] if hop[0] == leaf else replace(hop[1], direction={">": "<", "<": ">", "-": "-"}[hop[1].direction])
                path = at[0] if at else P.PathPat(None, [replace(nodes[leaf], where=there.get(leaf))], [])
                inside = nodes[inner] if inner in need else replace(nodes[inner], where=there.get(inner))
                ends = [e for e in ends if e is not path] + [P.PathPat(None, [*path.nodes, inside], [*path.rels, way])]
            if len({v for a, _, b in kept for v in (a, b)}) != len(kept) + 1:  # not connected, or nothing left
                return None
            seen: set[str] = set()
            paths = []
            for a, r, b in kept:
                paths.append(P.PathPat(None, [replace(nodes[v], props={}) if v in seen else nodes[v] for v in (a, b)], [r]))
                seen |= {a, b}
            where = None
            for e in ends:
                x = P.Exists(replace(e, nodes=[*e.nodes[:-1], P.NodePat(e.nodes[-1].var, [], {})]))
                where = x if where is None else P.Bin("AND", where, x)
            frames.append((Compiler(self.g, self.params, self.compat).part([P.Match(paths, where), replace(p, items=[*keys, *items])]), items))
        out = None
        for i, (df, items) in enumerate(frames):
            df = df.toDF(*[f"@k{i}_{j}" for j in range(len(keys))], *[f"@a{it.name}" for it in items])
            on = [c(f"@k0_{j}").eqNullSafe(c(f"@k{i}_{j}")) for j in range(len(keys))]
            out = df if out is None else out.join(df, on)
        place = {it.name: f"@k0_{j}" for j, it in enumerate(keys)}
        return out.select(*[c(place.get(it.name, f"@a{it.name}")).alias(it.name) for it in p.items])

    def part(self, clauses: list) -> DataFrame:
        if (df := self.apart(clauses)) is not None:
            return df
        s = Scope(None)
        for x in clauses:
            s = self.clause(s, x)
        last = clauses[-1]
        if not isinstance(last, P.Project) and not isinstance(last, P.Call):
            raise GraphError("a query ends with RETURN or CALL")
        if isinstance(last, P.Call):
            s = self.project(s, P.Project([], star=True, final=True))
        return s.df.select(*[c(b.col).alias(n) for n, b in s.names.items()])


def run(graph: PropertyGraph, text: str, params: dict, compat: str = "reference", union_dedup: bool = False) -> DataFrame:
    """The result of a query as a (lazy) DataFrame."""
    query = P.parse(text)
    parts = [Compiler(graph, params, compat).part(p) for p in query.parts]
    out = parts[0]
    for df, keep_all in zip(parts[1:], query.all_flags):
        if df.columns != out.columns:
            raise GraphError(f"UNION of different results: {out.columns} and {df.columns}")
        out = out.unionByName(df)
        if union_dedup and not keep_all:
            out = out.distinct()
    return out
