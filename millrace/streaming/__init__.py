"""Streams. Projections, filters and text operators work on a stream unchanged."""

from .streams import dedup_stream, first_stream, read_batches, run_available, write_batches, write_stream

__all__ = ["dedup_stream", "first_stream", "read_batches", "run_available", "write_batches", "write_stream"]
