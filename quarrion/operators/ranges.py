"""Rows split into ranges of an ordering column, so that numbering rows and looking back need no task that holds all of them."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "_part"
#: Keys that a range's bound is chosen from, for types that have no approximate percentiles.
SAMPLED = 64
_MEASURED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _bounds(df: DataFrame, key: str, n: int) -> list:
    """At most n - 1 different values of a column, in order, that cut its rows into ranges of about one size."""
    if n < 2:
        return []
    if isinstance(df.schema[key].dataType, _MEASURED):
        found = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10_000)).first()[0]
        return list(dict.fromkeys(found or []))
    # chosen by a hash of the key: their number does not grow with the rows, nor with how often a key is repeated
    rows = max(1, df.count())
    some = df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)).cast("double") * rows < float(SAMPLED * n) * (1 << 30))
    keys = some.agg(F.sort_array(F.collect_set(key)).alias("k"))
    cuts = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.get("k", F.floor(i * F.size("k") / n).cast("int")))
    return [b for b in keys.select(F.array_distinct(cuts)).first()[0] if b is not None]


def _above(bounds: list, key: Column, kind: T.DataType) -> Column:
    """How many of the sorted bounds are not above the key, in about 2 sqrt(n) comparisons."""
    if not bounds:
        return F.lit(0)
    step = isqrt(len(bounds)) + 1
    blocks = [F.array(*(F.lit(b).cast(kind) for b in bounds[i : i + step])) for i in range(0, len(bounds), step)]
    heads = F.size(F.filter(F.array(*(F.lit(b).cast(kind) for b in bounds[::step])), lambda b: b <= key))
    inside = F.size(F.filter(F.get(F.array(*blocks), heads - 1), lambda b: b <= key))
    return F.when(heads == 0, 0).otherwise((heads - 1) * step + inside)


def ranged(df: DataFrame, key: str, nulls_last: bool = False) -> DataFrame:
    """The rows with ``_part``, the number of their range: at most as many as the session has shuffle partitions, and one for
    rows without a key.  Ranges follow the order of the keys; equal keys share one."""
    bounds = _bounds(df, key, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = _above(bounds, F.col(key), df.schema[key].dataType)
    return df.withColumn(PART, F.when(F.col(key).isNull(), len(bounds) + 1 if nulls_last else -1).otherwise(at))


def with_earlier(parted: DataFrame, amount: Column, name: str) -> DataFrame:
    """The rows with the total of ``amount`` (an aggregate) over the ranges before their own."""
    totals = parted.groupBy(PART).agg(amount.alias("_amount"))
    before = F.sum("_amount").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    # one row for each range: as many as the session has shuffle partitions
    return parted.join(F.broadcast(totals.select(PART, F.coalesce(before, F.lit(0)).alias(name))), PART)


def numbered(df: DataFrame, key: str, name: str, nulls_last: bool = False) -> DataFrame:
    """The rows with their number in the order of a unique key, from 0."""
    order = F.col(key).asc_nulls_last() if nulls_last else F.col(key).asc_nulls_first()
    parted = ranged(df, key, nulls_last)
    placed = with_earlier(parted, F.count(F.lit(1)), "_before")
    at = F.row_number().over(Window.partitionBy(PART).orderBy(order)) - 1 + F.col("_before")
    return placed.withColumn(name, at.cast("bigint")).drop(PART, "_before")
