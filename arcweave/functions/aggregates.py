"""Aggregate functions of the query language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweave.plans.graph import GraphError

AGGREGATES = {"count", "sum", "avg", "min", "max", "collect", "percentilecont", "percentiledisc", "stdev", "stdevp", "variance", "variancep"}


def build(name: str, args: list[Column], types: list[T.DataType | None], distinct: bool, compat: str) -> Column:
    """The aggregate as a column. In ``compat="reference"`` sums, minima and
    maxima of numbers are doubles, an empty sum is 0.0, and a spread of fewer
    than two values is 0.0."""
    x, t = args[0], types[0]
    if name == "count":
        return F.count_distinct(x) if distinct else F.count(x)
    if name == "collect":
        return F.array_sort(F.collect_set(x)) if distinct else F.collect_list(x)
    if name in ("min", "max"):
        y = x.cast("double") if compat == "reference" and isinstance(t, T.NumericType) else x
        return F.min(y) if name == "min" else F.max(y)
    as_number = number(x, t)
    if name == "sum":
        if compat == "reference":
            return F.coalesce(F.sum_distinct(as_number) if distinct else F.sum(as_number), F.lit(0.0))
        return F.sum_distinct(x) if distinct else F.sum(x)
    if name == "avg":
        return F.avg(as_number) if not distinct else F.sum_distinct(as_number) / F.count_distinct(as_number)
    if name == "percentilecont":
        if len(args) != 2:
            raise GraphError(f"{name} takes a value and a share")
        return F.percentile(as_number, args[1].cast("double"))
    spread = {"stdev": F.stddev_samp, "stdevp": F.stddev_pop, "variance": F.var_samp, "variancep": F.var_pop}[name](as_number)
    return F.when(F.count(as_number) < 2, F.lit(0.0)).otherwise(spread)


def number(x: Column, t: T.DataType | None) -> Column:
    return x.cast("double") if not isinstance(t, T.StringType) else x.try_cast("double")


def percentile_disc(column: str, share: float | None) -> Column:
    """The value at place ceil(share * n), at least the first, of a named
    column: Spark's own aggregate, which counts values on the map side."""
    if not isinstance(share, (int, float)) or not 0 <= share <= 1:
        raise GraphError("percentileDisc takes a value and a share between 0 and 1")
    return F.expr(f"percentile_disc({float(share)!r}D) WITHIN GROUP (ORDER BY `{column}`)")
