"""Comparisons of a column with a literal.  A null never satisfies one, ``!=`` included."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARISONS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def compare(column: str | Column, op: str, value: object) -> Column:
    """``column op value`` as a column expression; the value becomes a literal, so that scans can use it."""
    if op not in COMPARISONS:
        raise ValueError(f"unknown comparison {op!r}; known are {', '.join(COMPARISONS)}")
    c = F.col(column) if isinstance(column, str) else column
    return COMPARISONS[op](c, F.lit(value))
