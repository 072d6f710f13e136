"""Scalar functions of the query language as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweave.plans.graph import GraphError

#: name -> (fewest arguments, most arguments, builder of (columns, types))
FUNCTIONS: dict[str, tuple[int, int, Callable]] = {}


def function(name: str, least: int, most: int | None = None) -> Callable:
    def add(build: Callable) -> Callable:
        FUNCTIONS[name.lower()] = (least, least if most is None else most, build)
        return build

    return add


def apply(name: str, args: list[Column], types: list[T.DataType | None]) -> Column:
    if name not in FUNCTIONS:
        raise GraphError(f"no function {name}")
    least, most, build = FUNCTIONS[name]
    if not least <= len(args) <= most:
        raise GraphError(f"{name} takes {least} to {most} arguments, not {len(args)}")
    return build(args, types)


def is_number(t: T.DataType | None) -> bool:
    return isinstance(t, T.NumericType)


def is_whole(t: T.DataType | None) -> bool:
    return isinstance(t, T.IntegralType)


def _numeric(name: str, t: T.DataType | None) -> None:
    if t is not None and not isinstance(t, (T.NumericType, T.NullType)):
        raise GraphError(f"{name} needs a number")


def _math(name: str, build: Callable[[Column, T.DataType | None], Column]) -> None:
    def go(a, t):
        _numeric(name, t[0])
        return build(a[0], t[0])

    FUNCTIONS[name] = (1, 1, go)


_math("abs", lambda x, t: F.abs(x))
_math("ceil", lambda x, t: F.ceil(x).cast("double"))
_math("floor", lambda x, t: F.floor(x).cast("double"))
_math("sign", lambda x, t: F.signum(x.cast("double")).cast("long"))


@function("round", 1, 2)
def _round(a, t):
    _numeric("round", t[0])
    if len(a) == 1:
        return F.round(a[0].cast("double"))
    return F.round(a[0].cast("double"), a[1].cast("int"))


@function("rand", 0)
def _rand(a, t):
    return F.rand()


def _plain(name: str, least: int, build: Callable, most: int | None = None) -> None:
    FUNCTIONS[name.lower()] = (least, least if most is None else most, lambda a, t: build(*a))


_plain("toLower", 1, F.lower)
_plain("toUpper", 1, F.upper)
_plain("trim", 1, F.trim)
_plain("ltrim", 1, F.ltrim)
_plain("rtrim", 1, F.rtrim)
_plain("replace", 3, F.replace)
_plain("left", 2, lambda s, n: F.left(s, n))
_plain("right", 2, lambda s, n: F.right(s, n))
_plain("substring", 2, lambda s, at, n=None: F.substring(s, at.cast("int") + 1, F.lit(1 << 30) if n is None else n.cast("int")), 3)
_plain("startsWith", 2, lambda s, x: F.startswith(s, x))
_plain("endsWith", 2, lambda s, x: F.endswith(s, x))
_plain("contains", 2, lambda s, x: F.contains(s, x))
_plain("regexp", 2, lambda s, x: F.regexp_like(s, F.concat(F.lit("^(?:"), x, F.lit(")$"))))
_plain("head", 1, lambda x: F.get(x, F.lit(0)))
_plain("last", 1, lambda x: F.try_element_at(x, F.lit(-1)))
_plain("maxInList", 1, F.array_max)
_plain("minInList", 1, F.array_min)
_plain("range", 2, lambda a, b, s=None: F.when((F.signum(b - a) * F.signum(F.lit(1) if s is None else s)) >= 0, F.sequence(a, b, F.lit(1) if s is None else s)).otherwise(F.array().cast("array<bigint>")), 3)
_plain("isAsc", 1, lambda x: F.forall(F.sequence(F.lit(1), F.greatest(F.size(x) - 1, F.lit(1))), lambda i: F.coalesce(F.get(x, i - 1) <= F.get(x, i), F.lit(True))))
_plain("isDesc", 1, lambda x: F.forall(F.sequence(F.lit(1), F.greatest(F.size(x) - 1, F.lit(1))), lambda i: F.coalesce(F.get(x, i - 1) >= F.get(x, i), F.lit(True))))
_plain("hasDuplicates", 1, lambda x: F.size(F.array_distinct(x)) < F.size(x))
_plain("date", 0, lambda x=None: F.current_date() if x is None else x.cast("date"), 1)
_plain("datetime", 0, lambda x=None: F.current_timestamp().cast("timestamp_ntz") if x is None else x.cast("timestamp_ntz"), 1)
_plain("bin", 1, F.unbase64)
_plain("mask", 1, lambda s, a=None, b=None: F.when(F.length(s) > (F.lit(0) if b is None else b), F.concat(F.left(s, (F.lit(1) if a is None else a) - 1), F.repeat(F.lit("*"), (F.greatest(F.lit(0), F.least(F.length(s), F.length(s) if b is None else b) - (F.lit(1) if a is None else a) + 1)).cast("int")), F.substring(s, (F.length(s) if b is None else b) + 1, F.length(s)))).otherwise(F.repeat(F.lit("*"), F.length(s))), 3)


@function("coalesce", 1, 64)
def _coalesce(a, t):
    """Values of several types are given as texts."""
    kinds = {"number" if is_number(k) else str(k) for k in t if k is not None and not isinstance(k, T.NullType)}
    return F.coalesce(*([x.cast("string") for x in a] if len(kinds) > 1 else a))


@function("split", 2)
def _split(a, t):
    return F.split(a[0], F.concat(F.lit("\\Q"), a[1], F.lit("\\E")))


@function("reverse", 1)
def _reverse(a, t):
    return F.reverse(a[0])


@function("size", 1)
def _size(a, t):
    n = F.size(a[0]) if isinstance(t[0], (T.ArrayType, T.MapType)) or t[0] is None else F.length(a[0])
    return F.when(a[0].isNotNull(), n.cast("long"))


@function("length", 1)
def _length(a, t):
    return _size(a, t)


@function("concat", 2, 64)
def _concat(a, t):
    return F.concat(*[x if isinstance(k, T.ArrayType) else x.cast("string") for x, k in zip(a, t)])


@function("toBoolean", 1)
def _boolean(a, t):
    return a[0].cast("boolean") if not isinstance(t[0], T.StringType) else F.when(F.lower(a[0]) == "true", True).when(F.lower(a[0]) == "false", False).otherwise(F.when(a[0].isNotNull(), F.raise_error(F.lit("toBoolean: not a boolean"))).cast("boolean"))


@function("toFloat", 1)
def _float(a, t):
    return a[0].cast("double")


@function("toInteger", 1)
def _integer(a, t):
    return a[0].cast("long")


@function("toString", 1)
def _string(a, t):
    return F.format_string("%f", a[0].cast("double")) if isinstance(t[0], (T.FractionalType,)) else a[0].cast("string")


_PARTS = {"year": "YEAR", "month": "MONTH", "day": "DAY", "hour": "HOUR", "minute": "MINUTE", "second": "SECOND", "microsecond": "MICROSECOND"}


def _component(x: Column, part: Column, stamp: Column) -> Column:
    """A part of a date or time; the last six digits of the second are the microsecond."""
    out = F.lit(None).cast("long")
    for name, unit in _PARTS.items():
        if unit == "SECOND":
            v = F.floor(F.date_part(F.lit("SECOND"), stamp).cast("decimal(20,6)")).cast("long")
        elif unit == "MICROSECOND":
            v = (F.unix_micros(stamp.cast("timestamp")) % 1_000_000).cast("long")
        else:
            v = F.date_part(F.lit(unit), stamp).cast("long")
        out = F.when(F.lower(part) == name, v).otherwise(out)
    return out


@function("dateComponent", 2)
def _date_component(a, t):
    d = F.date_add(F.lit("1970-01-01").cast("date"), a[0].cast("int")) if is_whole(t[0]) else a[0].cast("date")
    return _component(a[0], a[1], d.cast("timestamp"))


@function("datetimeComponent", 2)
def _datetime_component(a, t):
    """Whole numbers are microseconds since 1970."""
    ts = F.timestamp_micros(a[0].cast("long")) if is_whole(t[0]) else a[0].cast("timestamp")
    return _component(a[0], a[1], ts)


# --- spatial values: struct<srid int, kind string, wkt string> -------------
WGS84, CARTESIAN = 4326, 7203


def _geometry(kind: str, wkt: Column, srid: Column | None) -> Column:
    return F.struct(F.coalesce(srid.cast("int") if srid is not None else F.lit(None).cast("int"), F.lit(WGS84)).alias("srid"), F.lit(kind).alias("kind"), wkt.alias("wkt"))


def _number(x: Column) -> Column:
    return F.regexp_replace(x.cast("double").cast("string"), r"\.0$", "")


_plain("point", 2, lambda x, y, s=None: _geometry("POINT", F.concat(F.lit("POINT("), _number(x), F.lit(" "), _number(y), F.lit(")")), s), 3)
for _kind in ("POINT", "LINESTRING", "POLYGON"):
    _plain(f"{_kind}WKT", 1, lambda w, s=None, k=_kind: _geometry(k, F.regexp_replace(F.upper(F.trim(w)), r"\s*\(\s*", "("), s), 2)
    if _kind != "POINT":
        _plain(_kind, 1, lambda w, s=None, k=_kind: _geometry(k, F.regexp_replace(F.upper(F.trim(w)), r"\s*\(\s*", "("), s), 2)


def _hex_double(h: Column, at: Column, little: Column) -> Column:
    """The double in 16 hex digits at a place of a WKB text (0-based)."""
    raw = F.substring(h, at + 1, F.lit(16))
    swapped = F.concat_ws("", *[F.substring(raw, i, 2) for i in range(15, 0, -2)])
    big = F.when(little, swapped).otherwise(raw)
    # sign, exponent and mantissa of IEEE 754
    head = F.conv(F.substring(big, F.lit(1), F.lit(3)), 16, 10).cast("long")
    mantissa = F.conv(F.substring(big, F.lit(4), F.lit(13)), 16, 10).cast("long").cast("double")
    exponent = head % 2048
    size = F.when(exponent == 0, mantissa * F.lit(2.0**-1074)).otherwise((1 + mantissa / F.lit(2.0**52)) * F.pow(F.lit(2.0), exponent - 1023))
    return F.when(head >= 2048, -size).otherwise(size)


def _little_uint(h: Column, at: Column, little: Column) -> Column:
    raw = F.substring(h, at + 1, F.lit(8))
    return F.conv(F.when(little, F.concat_ws("", *[F.substring(raw, i, 2) for i in (7, 5, 3, 1)])).otherwise(raw), 16, 10).cast("long")


def _coords(h: Column, at: Column, n: Column, little: Column) -> Column:
    each = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.concat(_number(_hex_double(h, at + i * 32, little)), F.lit(" "), _number(_hex_double(h, at + i * 32 + 16, little))))
    return F.array_join(each, ",")


def _from_wkb(kind: str, h: Column) -> Column:
    """WKT of a hex (E)WKB value; polygons with all their rings."""
    h = F.upper(h)
    little = F.substring(h, 1, 2) == "01"
    at = F.when(_little_uint(h, F.lit(2), little) >= 0x20000000, F.lit(18)).otherwise(F.lit(10))
    if kind == "POINT":
        return F.concat(F.lit("POINT("), _coords(h, at, F.lit(1), little), F.lit(")"))
    if kind == "LINESTRING":
        return F.concat(F.lit("LINESTRING("), _coords(h, at + 8, _little_uint(h, at, little), little), F.lit(")"))

    def ring(state: Column, _: Column) -> Column:
        n = _little_uint(h, state["at"], little)
        text = F.concat(F.lit("("), _coords(h, state["at"] + 8, n, little), F.lit(")"))
        return F.struct((state["at"] + 8 + n * 32).cast("long").alias("at"), F.concat(state["rings"], F.array(text)).alias("rings"))

    n_rings = _little_uint(h, at, little).cast("int")
    start = F.struct((at + 8).cast("long").alias("at"), F.array().cast("array<string>").alias("rings"))
    rings = F.aggregate(F.sequence(F.lit(1), n_rings), start, ring, lambda state: F.array_join(state["rings"], ","))
    return F.when(n_rings > 0, F.concat(F.lit("POLYGON("), rings, F.lit(")"))).otherwise("POLYGON EMPTY")


for _kind in ("POINT", "LINESTRING", "POLYGON"):
    _plain(f"{_kind}WKB", 1, lambda w, s=None, k=_kind: _geometry(k, _from_wkb(k, w), s), 2)

_EARTH_M = 6371008.8


def _xy(g: Column) -> tuple[Column, Column]:
    pair = F.split(F.regexp_extract(g["wkt"], r"\(([^()]*)\)", 1), r"\s+")
    return F.get(pair, F.lit(0)).cast("double"), F.get(pair, F.lit(1)).cast("double")


@function("distance", 2)
def _distance(a, t):
    """Of two points: great-circle metres (x is the longitude), or plane units
    for Cartesian ones; null between different systems."""
    (x1, y1), (x2, y2) = _xy(a[0]), _xy(a[1])
    h = F.pow(F.sin(F.radians(y2 - y1) / 2), 2) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.pow(F.sin(F.radians(x2 - x1) / 2), 2)
    sphere = 2 * _EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
    plane = F.sqrt(F.pow(x2 - x1, 2) + F.pow(y2 - y1, 2))
    return F.when(a[0]["srid"] != a[1]["srid"], F.lit(None).cast("double")).when(a[0]["srid"] == CARTESIAN, plane).otherwise(sphere)
