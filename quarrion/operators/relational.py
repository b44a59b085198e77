"""The functional query API: each operator checks its arguments and adds one step to a DataFrame plan.

Steps compose freely; chained ``where`` calls become one pushed-down filter, columns that no later step reads never leave
the scan, and ``order_by`` followed by ``limit`` becomes a bounded top-k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrion.errors import PlanError
from quarrion.functions.aggregates import Aggregate, quoted
from quarrion.functions.predicates import compare


def _column(df: DataFrame, name: str, use: str) -> Column:
    if name not in df.columns:
        raise PlanError(f"{use} references unknown column {name!r}")
    return F.col(quoted(name))


def _several(names: Sequence[str], what: str) -> list[str]:
    if isinstance(names, str):
        raise PlanError(f"{what} takes a list of columns, not one string")
    if not names:
        raise PlanError(f"{what} needs at least one column")
    return list(names)


def scan(source: DataFrame | str, columns: Sequence[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    """A frame or Parquet path, with the named columns in their order; a name may come twice."""
    if isinstance(source, str):
        if spark is None:
            raise PlanError("a path needs a session")
        source = spark.read.parquet(source)
    if source is None:
        raise PlanError("scan needs a table")
    return source if columns is None else project(source, columns)


def where(df: DataFrame, column: str, op: str, value: object) -> DataFrame:
    """Rows whose column compares as asked; nulls never do."""
    _column(df, column, "WHERE")
    if value is None:
        raise PlanError("a comparison with null holds for no row; use an expression to test for nulls")
    try:
        return df.where(compare(quoted(column), op, value))
    except ValueError as e:
        raise PlanError(str(e)) from None


def project(df: DataFrame, columns: Sequence[str | tuple[str, str]]) -> DataFrame:
    """Columns in order, repeated or renamed: each is a name or a (name, new name) pair."""
    out = []
    for c in _several(columns, "project"):
        name, alias = (c, c) if isinstance(c, str) else c
        out.append(_column(df, name, "SELECT").alias(alias))
    return df.select(*out)


def aggregate(df: DataFrame, aggregates: Sequence[Aggregate]) -> DataFrame:
    """One row, also for no rows."""
    if not aggregates:
        raise PlanError("aggregate needs at least one aggregate")
    return df.agg(*(a.expression(df.schema) for a in aggregates))


def group_by(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Aggregate] = (), select: Sequence[str] | None = None) -> DataFrame:
    """A row for each distinct key, nulls being keys like others; no rows for none.

    Without aggregates it gives the distinct keys.  ``select`` names and orders what comes out.
    """
    keys = _several(keys, "group_by")
    columns = [_column(df, k, "GROUP BY") for k in keys]
    out = df.groupBy(*columns).agg(*(a.expression(df.schema) for a in aggregates)) if aggregates else df.select(*columns).distinct()
    return out if select is None else project(out, select)


def order_by(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Sorted by one column, nulls last both ways; NaN counts as the largest number."""
    c = _column(df, column, "ORDER BY")
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last())


def limit(df: DataFrame, n: int) -> DataFrame:
    """At most n rows: the first ones of a sorted frame, any of another."""
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise PlanError(f"LIMIT must be a non-negative integer, got {n!r}")
    return df.limit(n)
