"""The registered queries, each with its SQL for DuckDB where SQL can express it."""

from . import dedup, flows, io, rows, streams, text
from .catalog import oracle_sql, queries

__all__ = ["dedup", "flows", "io", "oracle_sql", "queries", "rows", "streams", "text"]
