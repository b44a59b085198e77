"""Relational operators, statistics and encodings over DataFrames."""

from quarrion.operators.relational import aggregate, group_by, limit, order_by, project, scan, where

__all__ = ["aggregate", "group_by", "limit", "order_by", "project", "scan", "where"]
