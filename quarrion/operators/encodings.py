"""What the encodings do to a column, as DataFrame operations over an ordering column with unique values.

Without ``within`` the whole column is encoded: rows are split into ranges of the order, and each range gets the last value or
the total of those before it, so that all tasks share the work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrion.operators.ranges import PART, numbered, ranged, with_earlier
from quarrion.operators.relational import _column


def _columns(df: DataFrame, order: str, column: str, within: str | None = None) -> DataFrame:
    keep = {"within": _column(df, within, "PARTITION BY")} if within else {}
    return df.select(*(c.alias(k) for k, c in keep.items()), _column(df, order, "ORDER BY").alias("pos"), _column(df, column, "encoding").alias("value"))


def _with_previous(rows: DataFrame, group: str) -> DataFrame:
    """The rows with ``_prev``, the value before as a struct, null where there is none; ``group`` is ``within`` or a range."""
    before = F.lag(F.struct("value")).over(Window.partitionBy(group).orderBy("pos"))
    if group != PART:
        return rows.withColumn("_prev", before)
    ends = rows.groupBy(PART).agg(F.max(F.struct("pos", "value")).alias("_end"))
    carried = ends.select(PART, F.lag(F.struct("_end.value")).over(Window.orderBy(PART)).alias("_carried"))
    # one row for each range: as many as the session has shuffle partitions
    return rows.join(F.broadcast(carried), PART).withColumn("_prev", F.coalesce(before, F.col("_carried"))).drop("_carried")


def deltas(df: DataFrame, order: str, column: str, within: str | None = None) -> DataFrame:
    """(pos, value, delta), for values without nulls: each value's difference from the one before, from 0 for the first.

    ``within`` encodes each of its values apart (a file, a block).
    """
    rows = _columns(df, order, column, within)
    rows = _with_previous(rows, "within") if within else _with_previous(ranged(rows, "pos"), PART)
    return rows.withColumn("delta", F.col("value") - F.coalesce(F.col("_prev.value"), F.lit(0))).drop("_prev", PART)


def runs(df: DataFrame, order: str, column: str, within: str | None = None) -> DataFrame:
    """(run, value, start, length): maximal runs of equal values, nulls included, numbered from 1."""
    rows, group = _columns(df, order, column, within), "within" if within else PART
    rows = _with_previous(rows if within else ranged(rows, "pos"), group)
    fresh = F.col("_prev").isNull() | ~F.col("value").eqNullSafe(F.col("_prev.value"))
    rows = rows.withColumn("_new", fresh.cast("bigint"))
    run = F.sum("_new").over(Window.partitionBy(group).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    if not within:
        rows = with_earlier(rows, F.sum("_new"), "_before")
        run = run + F.col("_before")
    keys = ["within"] if within else []
    return rows.withColumn("run", run).groupBy(*keys, "run").agg(F.first("value").alias("value"), F.min("pos").alias("start"), F.count(F.lit(1)).alias("length"))


def codes(df: DataFrame, order: str, column: str) -> DataFrame:
    """(value, first, uses, code): the dictionary, entries numbered from 0 in the order of their first place."""
    rows = _columns(df, order, column)
    entries = rows.groupBy("value").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("uses"))
    return numbered(entries, "first", "code")
