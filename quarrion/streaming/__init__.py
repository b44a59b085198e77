"""Queries over streams."""

from quarrion.streaming.continuous import continuous

__all__ = ["continuous"]
