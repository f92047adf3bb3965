"""Operators of a training-data pipeline. Nothing outside this package and its pipeline imports them."""

from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
