"""Kinds of columns, and what each may be used for.

The four kinds of the file format map to one Spark type each.  Queries work on any Spark type: narrower integers count as
integers, float and decimal as floating point.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T


class Kind(Enum):
    INT = "int64"
    FLOAT = "float64"
    STRING = "string"
    BOOL = "bool"
    OTHER = "other"

    @property
    def numeric(self) -> bool:
        return self in (Kind.INT, Kind.FLOAT)


def kind_of(dtype: T.DataType) -> Kind:
    if isinstance(dtype, T.IntegralType):
        return Kind.INT
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return Kind.FLOAT
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return Kind.STRING
    if isinstance(dtype, T.BooleanType):
        return Kind.BOOL
    return Kind.OTHER


#: Kinds that have a place in the file format, with their Spark type.
STORED = {Kind.INT: T.LongType(), Kind.FLOAT: T.DoubleType(), Kind.STRING: T.StringType(), Kind.BOOL: T.BooleanType()}
