"""The aggregates: COUNT, SUM, MIN, MAX and AVG, checked against a schema before Spark sees them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrion.errors import PlanError
from quarrion.functions.kinds import Kind, kind_of

#: Each aggregate's Spark function, and whether it takes numbers only.
FUNCTIONS = {"COUNT": (F.count, False), "SUM": (F.sum, True), "MIN": (F.min, True), "MAX": (F.max, True), "AVG": (F.avg, True)}


@dataclass(frozen=True)
class Aggregate:
    """``function(column)``; the column ``*`` is for COUNT alone.

    Nulls are skipped; without a value COUNT is 0 and the others are null.  SUM keeps integers integral and raises on
    overflow, AVG is a double.  A NaN makes SUM, AVG and MAX NaN, while MIN passes over it unless there is nothing else;
    ``skip_nan`` takes NaNs as nulls in MIN and MAX.
    """

    function: str
    column: str = "*"
    name: str | None = None
    skip_nan: bool = False

    @property
    def label(self) -> str:
        return self.name or f"{self.function.upper()}({self.column})"

    def check(self, schema: T.StructType) -> None:
        """Raise a PlanError if the aggregate does not fit; Spark itself would fail at run time, or coerce strings."""
        function = self.function.upper()
        if function not in FUNCTIONS:
            raise PlanError(f"unknown aggregate function {self.function!r}")
        if self.column == "*":
            if function != "COUNT":
                raise PlanError(f"{function}(*) is not defined; only COUNT takes *")
            return
        if self.column not in schema.names:
            raise PlanError(f"no such column for {function}: {self.column!r}")
        kind = kind_of(schema[self.column].dataType)
        if FUNCTIONS[function][1] and not kind.numeric:
            raise PlanError(f"{function} is not defined for the {kind.value} values of {self.column!r}")

    def expression(self, schema: T.StructType) -> Column:
        self.check(schema)
        function = self.function.upper()
        if self.column == "*":
            return F.count(F.lit(1)).alias(self.label)
        c = F.col(quoted(self.column))
        if self.skip_nan and function in ("MIN", "MAX") and kind_of(schema[self.column].dataType) is Kind.FLOAT:
            c = F.when(~F.isnan(c), c)
        return FUNCTIONS[function][0](c).alias(self.label)


def quoted(name: str) -> str:
    """A column name as Spark takes it literally, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def count(column: str = "*", name: str | None = None) -> Aggregate:
    return Aggregate("COUNT", column, name)


def total(column: str, name: str | None = None) -> Aggregate:
    return Aggregate("SUM", column, name)


def least(column: str, name: str | None = None, skip_nan: bool = False) -> Aggregate:
    return Aggregate("MIN", column, name, skip_nan)


def greatest(column: str, name: str | None = None, skip_nan: bool = False) -> Aggregate:
    return Aggregate("MAX", column, name, skip_nan)


def mean(column: str, name: str | None = None) -> Aggregate:
    return Aggregate("AVG", column, name)
