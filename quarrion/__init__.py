"""A Spark-native analytics engine for single-table queries, with a file format, encodings and statistics around it."""

from quarrion.plans.engine import Engine

__all__ = ["Engine"]
