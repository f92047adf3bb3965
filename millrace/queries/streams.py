"""Streams over the events, run until their source is exhausted."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from .. import operators as ops
from .. import sources
from ..scratch import scratch_path
from ..streaming import dedup_stream, first_stream, read_batches, run_available, write_batches
from .catalog import query, table


def _events(spark, sf_dir):
    """The events as a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    return sources.read_stream(spark, sf_dir, "parquet", schema, pathGlobFilter="events*.parquet")


def _drained(spark, stream, name):
    """Writes the stream to the shared folder and reads the result."""
    path = scratch_path(spark, name)
    run_available(stream, f"{path}/rows", f"{path}/progress")
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


@query("s10_read_stream", "SELECT event_id, user_id, event_type, value, props FROM events")
def s10(spark, sf_dir):
    return _drained(spark, _events(spark, sf_dir).drop("ts"), "s10")


@query(
    "x1_stream_stateless",
    "SELECT event_id, upper(event_type) AS event_type, props || '#' AS props FROM events WHERE value >= 20",
)
def x1(spark, sf_dir):
    events = ops.filter_rows(_events(spark, sf_dir), "value", ">=", 20)
    events = ops.append_suffix(ops.uppercase(events, "event_type"), "#", "props")
    return _drained(spark, ops.select_columns(events, "event_id,event_type,props"), "x1")


@query("x2_stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def x2(spark, sf_dir):
    # The watermark spans all events, so the keys are those of a batch run.
    kept = dedup_stream(_events(spark, sf_dir), ["user_id", "event_type"], "ts", "3650 days")
    return _drained(spark, kept.select("user_id", "event_type"), "x2")


@query(
    "x2_stream_first",
    "SELECT user_id, event_type, min(ts) AS ts, CAST(arg_min(event_id, (ts, CAST(event_id AS VARCHAR))) AS BIGINT) AS event_id FROM events GROUP BY user_id, event_type",
)
def x2_first(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    # A row of its own, with a time that the watermark of all others has passed, closes the stream.
    closing = scratch_path(spark, "x2_closing")
    late = F.max("ts") + F.expr("interval '7400' day")
    events.agg(F.lit(-1).cast("bigint").alias("event_id"), F.lit(-1).cast("bigint").alias("user_id"), F.lit("closing").alias("event_type"), late.alias("ts")).write.parquet(closing)
    stream = _events(spark, sf_dir).select(*events.columns)
    stream = stream.unionByName(sources.read_stream(spark, closing, "parquet", events.schema))
    kept = first_stream(stream, ["user_id", "event_type"], "ts", "3650 days")
    return _drained(spark, kept, "x2_first")


@query("x3_stream_sink", "SELECT event_id, event_type, value FROM events")
def x3(spark, sf_dir):
    path = scratch_path(spark, "x3")
    events = _events(spark, sf_dir).select("event_id", "event_type", "value")
    write_batches(events, f"{path}/rows", f"{path}/progress", sources.write_jsonl).awaitTermination()
    return read_batches(spark, f"{path}/rows", "event_id bigint, event_type string, value double", "json").drop("batch_id")


@query("x3_failed_batch", "SELECT event_id, event_type, value FROM events")
def x3_failed(spark, sf_dir):
    """A stream that fails in the middle of a batch and is started again."""
    path, calls = scratch_path(spark, "x3_failed"), []

    def save(batch, folder):
        calls.append(folder)
        sources.write_parquet(batch.where("event_id % 2 = 0") if len(calls) == 1 else batch, folder)
        if len(calls) == 1:
            raise OSError("the sink is gone")

    for _ in range(2):
        run = write_batches(_events(spark, sf_dir).select("event_id", "event_type", "value"), f"{path}/rows", f"{path}/progress", save)
        try:
            run.awaitTermination()
        except StreamingQueryException:
            pass
    return read_batches(spark, f"{path}/rows", "event_id bigint, event_type string, value double").drop("batch_id")
