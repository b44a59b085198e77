"""Predicates and aggregates over columns."""
