"""Loading delimited text rows whose every column arrives as nullable text.

Each row is checked by vectorised rules (JVM expressions only). A rule that
fails adds its reason to an error array; rows with an empty array are the
valid ones, the others are set aside with their reasons. Nothing is shuffled,
and valid and rejected rows come from one scan.

Row format: fields separated by ``,``; a field whose first character is ``"``
is quoted, ends at the next ``"`` that is not doubled, and may hold commas,
line breaks and ``""`` for ``"``; any other field runs to the next comma.

Defined cases
* a null row has no field at all: ``column_count``; an empty row has one empty field: ``column_count`` too unless one column is declared
* the reasons are in the order quoting, column_count, invalid_value; a row with broken quoting has only that reason
* very long rows need no recursion (possessive quantifiers only); repeated rows are judged one by one; other columns pass through, and a clash with a result column is resolved by the prefix ``in_``
"""

from __future__ import annotations

from dataclasses import dataclass, field

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_FIELD = rf'(?:{_QUOTED}|(?!")[^",]*+)'
#: A row in which every field is either fully quoted or free of quotes.
WELL_QUOTED = rf"\A{_FIELD}(?:,{_FIELD})*+\z"
#: One field with the comma before it; applied to ``',' || row``.
NEXT_FIELD = rf",({_QUOTED}|[^\",]*+)"


@dataclass(frozen=True)
class TextColumn:
    """A declared column: type to cast to, a pattern that allows a value, a
    pattern that forbids one, and the texts that stand for null."""

    name: str
    kind: str = "string"
    allow: str | None = None
    forbid: str | None = None
    nulls: tuple[str, ...] = field(default=())


def _typed(x: Column, c: TextColumn) -> Column:
    x = F.when(~x.isin(*c.nulls), x) if c.nulls else x
    return x if c.kind == "string" else x.try_cast(c.kind)


def check_rows(df: DataFrame, raw: str, columns: list[TextColumn]) -> DataFrame:
    """``df`` with ``fields`` (array of texts, null where quoting is broken)
    and ``errors``: empty for a valid row, else ``quoting``, ``column_count`` or
    one ``invalid_value:<column>`` per column whose text breaks a pattern or
    can't be cast."""
    keep = [F.col(f"`{c}`").alias(f"in_{c}" if c in {"fields", "errors"} else c) for c in df.columns]
    text = F.col(f"`{raw}`")
    whole = F.coalesce(text.rlike(WELL_QUOTED), F.lit(True))

    def unquote(x: Column) -> Column:
        return F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)

    cells = F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(NEXT_FIELD), 1)
    out = df.select(*keep, whole.alias("__whole"), F.when(whole, F.transform(cells, unquote)).alias("fields"))
    cell = [F.get(F.col("fields"), i) for i in range(len(columns))]
    bad = []
    for c, x in zip(columns, cell):
        fails = []
        if c.allow:
            fails.append(~x.rlike(c.allow))
        if c.forbid:
            fails.append(x.rlike(c.forbid))
        if c.kind != "string":  # the cast rule: a text that is no null and no value of the type
            fails.append(_typed(x, c).isNull() & ~x.isin(*c.nulls) if c.nulls else _typed(x, c).isNull())
        if fails:
            bad.append(F.when(reduce(or_, fails), F.lit(f"invalid_value:{c.name}")))
    count_ok = F.coalesce(F.size("fields") == len(columns), F.lit(False))
    values = F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")
    errors = F.when(~F.col("__whole"), F.array(F.lit("quoting"))).when(~count_ok, F.array(F.lit("column_count"))).otherwise(values)
    return out.withColumn("errors", errors).drop("__whole")


def rejected(checked: DataFrame) -> DataFrame:
    """The rows that failed, with their first ``reason`` and all ``errors``."""
    return checked.filter(F.size("errors") > 0).withColumn("reason", F.substring_index(F.get("errors", F.lit(0)), ":", 1)).drop("fields")


def valid(checked: DataFrame, columns: list[TextColumn]) -> DataFrame:
    """The valid rows as typed columns (``try_cast``), after the columns the
    input had; input columns that clash get the prefix ``in_``."""
    names = {c.name for c in columns}
    keep = [F.col(f"`{c}`").alias(f"in_{c}" if c in names else c) for c in checked.columns if c not in ("fields", "errors")]
    typed = []
    for i, c in enumerate(columns):
        typed.append(_typed(F.get(F.col("fields"), i), c).alias(c.name))
    return checked.filter(F.size("errors") == 0).select(*keep, *typed)


_CONTROL = r"[\x{FFFD}\x7F\x00-\x08\x0B-\x1F]"
#: The seven columns of the movie feed's text files.
MOVIE_COLUMNS = [
    TextColumn("id", "bigint", allow=r"\A[0-9]{1,18}\z"),
    TextColumn("duration", "int", allow=r"\A(?:[0-9]{1,4}|\\N)?\z", nulls=("", r"\N")),
    *[TextColumn(c, forbid=_CONTROL) for c in ("title", "tagline", "summary", "poster_image", "rated")],
]
