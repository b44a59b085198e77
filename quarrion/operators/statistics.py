"""Column statistics (zone maps) of tables and of blocks of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.functions.aggregates import quoted
from quarrion.functions.kinds import Kind, kind_of
from quarrion.operators.ranges import numbered
from quarrion.operators.relational import _column, _several


def _measures(df: DataFrame, column: str, prefix: str = "") -> list:
    c = _column(df, column, "statistics")
    real = F.when(~F.isnan(c), c) if kind_of(df.schema[column].dataType) is Kind.FLOAT and "decimal" not in dict(df.dtypes)[column] else c
    low, high = F.min(real), F.max(real)
    if real is not c:  # a column of nothing but NaN has NaN bounds
        low, high = F.coalesce(low, F.min(c)), F.coalesce(high, F.max(c))
    return [low.alias(f"{prefix}min"), high.alias(f"{prefix}max"), F.count_if(c.isNull()).alias(f"{prefix}nulls"), F.count(F.lit(1)).alias(f"{prefix}rows")]


def zone_map(df: DataFrame, column: str) -> DataFrame:
    """min, max, nulls, rows of a column: one row, with null bounds if there is no value."""
    return df.agg(*_measures(df, column))


def zone_maps(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with NAME_min, NAME_max, NAME_nulls and NAME_rows for each column, in one pass."""
    return df.agg(*(m for c in _several(columns, "zone_maps") for m in _measures(df, c, f"{c}_")))


def total_nulls(df: DataFrame) -> DataFrame:
    """nulls: the number of null values in all columns."""
    return df.agg(sum((F.count_if(F.col(quoted(c)).isNull()) for c in df.columns), F.lit(0)).cast("bigint").alias("nulls"))


def block_zone_maps(df: DataFrame, order: str, column: str, rows: int = 65536) -> DataFrame:
    """(block, min, max, nulls, rows) for blocks of so many rows in the order of a unique column.

    Rows are numbered within ranges of the order column and by the rows of the ranges before, so no task holds more than a
    range.
    """
    rows_of = df.select(_column(df, order, "ORDER BY").alias("_k"), _column(df, column, "statistics").alias(column))
    placed = numbered(rows_of, "_k", "_i", nulls_last=True).withColumn("block", F.floor(F.col("_i") / rows))
    return placed.groupBy("block").agg(*_measures(placed, column))
