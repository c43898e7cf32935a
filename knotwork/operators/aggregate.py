"""Aggregation of MATCH results, with explicit or implied grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.errors import QueryError
from knotwork.functions.expressions import Compiler, Typed, is_aggregate
from knotwork.plans import syntax as s


def aggregate_column(compiler: Compiler, e: s.Call) -> Column:
    """COUNT, SUM, AVG, MIN or MAX; SUM of nothing is 0, AVG of nothing is null, an infinite mean is an error."""
    name = e.name.lower()
    if e.star:
        if name != "count":
            raise QueryError(f"{e.name} takes an expression")
        return F.count(F.lit(1))
    if len(e.args) != 1:
        raise QueryError(f"{e.name} takes one argument")
    arg: Typed = compiler(e.args[0])
    if name == "count":
        return F.count(arg.col)
    if name == "sum":
        if arg.kind == "int":
            # exact beyond 64 bits, and an error only where the result itself does not fit
            return F.coalesce(F.sum(arg.col.cast("decimal(38,0)")).cast("long"), F.lit(0).cast("long"))
        return F.coalesce(F.sum(arg.col), F.lit(0.0)) if arg.kind == "float" else F.coalesce(F.sum(F.lit(None).cast("long")), F.lit(0).cast("long"))
    if name == "avg":
        mean = F.avg(arg.col.cast("double")) if arg.kind in ("int", "float") else F.avg(F.lit(None).cast("double"))
        bad = F.isnan(mean) | (F.abs(mean) == float("inf"))
        return F.when(bad, F.raise_error(F.lit("AVG is not finite")).cast("double")).otherwise(mean)
    return (F.min if name == "min" else F.max)(arg.col)


def finite(key: Typed) -> Column:
    """A grouping key; numbers that are not finite are an error, as they equal nothing in a group."""
    if key.kind != "float":
        return key.col
    bad = F.isnan(key.col) | (F.abs(key.col) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("a grouping key is not finite")).cast("double")).otherwise(key.col)


def aggregate(frame: DataFrame, compiler: Compiler, query: s.Match, name_of, identity) -> DataFrame:
    """Groups by GROUP BY or, without it, by the columns that are no aggregates.

    A column that is neither a key nor an aggregate has the value of some row of its group.
    """
    plain = [i for i in query.items if not is_aggregate(i.expr)]
    keys = list(query.group) if query.group is not None else [i.expr for i in plain]
    key_columns, shown = [], {}
    for n, e in enumerate(keys):
        own = identity(e)
        key_columns.append((own if own is not None else finite(compiler(e))).alias(f"__key{n}"))
        shown[e] = (f"__key{n}", own is None)
    columns, result = [], []
    for n, i in enumerate(query.items):
        alias = i.alias or name_of(i.expr)
        if is_aggregate(i.expr):
            columns.append(aggregate_column(compiler, i.expr).alias(f"__value{n}"))
            result.append(F.col(f"__value{n}").alias(alias))
        elif i.expr in shown and shown[i.expr][1]:
            result.append(F.col(shown[i.expr][0]).alias(alias))
        else:
            columns.append(F.first(compiler(i.expr).col).alias(f"__value{n}"))
            result.append(F.col(f"__value{n}").alias(alias))
    if not columns:
        columns = [F.count(F.lit(1)).alias("__rows")]
    grouped = frame.groupBy(*key_columns).agg(*columns) if key_columns else frame.agg(*columns)
    return grouped.select(*result)
