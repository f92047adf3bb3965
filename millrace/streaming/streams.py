"""Deduplication and sinks for Structured Streaming."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..checks import as_list, col, require_column, require_columns
from ..sources import writers

#: Groups of keys that ``first_stream`` keeps as one state each; a stream that goes on from a checkpoint needs the same number.
BUCKETS = 1 << 13


def dedup_stream(
    df: DataFrame, keys: str | list[str], time_column: str, watermark: str = "1 hour", combine: bool = True
) -> DataFrame:
    """One row per key within the watermark; later copies and rows behind it are dropped.

    State is kept only as long as the watermark asks, so a copy that arrives after that
    is a new row. Which of the copies stays is not defined: rows come out at once, before an
    earlier one may arrive; ``first_stream`` waits for it. The time column becomes
    ``timestamp``, which watermarks need. ``combine`` drops copies inside each Arrow
    batch before the shuffle, so that a frequent key does not send all its rows to one task.
    """
    names = as_list(keys)
    require_columns(df, names)
    require_column(df, time_column)
    timed = df.withColumn(time_column, col(time_column).cast("timestamp"))
    if combine:
        timed = timed.mapInArrow(_latest_per_key(names, time_column), timed.schema)
    return timed.withWatermark(time_column, watermark).dropDuplicatesWithinWatermark(names)


def _latest_per_key(keys: list[str], time_column: str) -> Callable:
    def plain(column: pa.Array) -> pa.Array:
        # Arrow groups by plain values; nested ones are written out, which tells nulls and types apart.
        return pa.array([repr(v) for v in column.to_pylist()]) if pa.types.is_nested(column.type) else column

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # The latest copy stays, so that none is lost to the watermark that another would pass.
            times = batch.column(time_column).cast(pa.int64()).fill_null(-(2**63))
            order = pc.sort_indices(times)
            sorted_keys = [plain(batch.column(k)).take(order) for k in keys]
            places = pa.table([*sorted_keys, pa.array(np.arange(len(order)))], names=[f"k{i}" for i in range(len(keys))] + ["place"])
            last = places.group_by([f"k{i}" for i in range(len(keys))], use_threads=False).aggregate([("place", "max")])
            kept = order.to_numpy()[last["place_max"].to_numpy()]
            yield batch.take(pa.array(np.sort(kept).astype(np.int64)))

    return combine


def first_stream(df: DataFrame, keys: str | list[str], time_column: str, watermark: str = "1 hour") -> DataFrame:
    """The first row of each key by event time, of equal times the one that is least as JSON text.

    The earliest row of a key is held until the watermark passes its time: from then on no earlier one can
    come, and it is given out. The key stays in the state until the watermark is ``watermark`` past that time;
    copies that come by then are dropped, and a later one begins anew. So state lasts as long as the watermark
    asks, and holds one row a key, in buckets of keys: a call for each key would cost far more than its rows. Rows without a time are left out. A stream that ends gives out what its watermark has passed; a row with a
    late time, of a key of its own, closes it.
    """
    names = as_list(keys)
    require_columns(df, names)
    require_column(df, time_column)
    exact = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}
    schema = df.schema
    rows = df.select(
        F.to_json(F.struct(*[col(c) for c in names]), exact).alias("key"),
        col(time_column).cast("timestamp").alias("at"),
        F.to_json(F.struct(*[col(c) for c in df.columns]), exact).alias("row"),
    )
    timed = rows.where("at is not null").withWatermark("at", watermark).withColumn("micros", F.unix_micros("at"))
    delay = pd.Timedelta(watermark) // pd.Timedelta("1ms")

    def step(bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """The state has each key of the bucket: its earliest row while that is held; once it is out, its time alone."""
        passed = state.getCurrentWatermarkMs()
        known = json.loads(state.get[0]) if state.exists else {}
        out = [row for micros, row in known.values() if row is not None and micros // 1000 < passed]
        # A batch with new rows comes before the timer, so both look at the watermark.
        known = {key: (micros, row if micros // 1000 >= passed else None) for key, (micros, row) in known.items()}
        known = {key: held for key, held in known.items() if held[1] is not None or held[0] // 1000 + delay >= passed}
        if not state.hasTimedOut:
            for batch in batches:
                for key, *new in zip(batch["key"], batch["micros"].tolist(), batch["row"], strict=True):
                    held = known.get(key)
                    if held is None or (held[1] is not None and tuple(new) < tuple(held)):
                        known[key] = new
        if out:
            yield pd.DataFrame({"row": out})
        if not known:
            state.remove()
            return
        state.update((json.dumps(known),))
        state.setTimeoutTimestamp(min(max(micros // 1000 + (delay if row is None else 0), passed) for micros, row in known.values()) + 1)

    timed = timed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    first = timed.groupBy("bucket").applyInPandasWithState(step, "row string", "known string", "append", GroupStateTimeout.EventTimeTimeout)
    return first.select(F.from_json("row", schema, exact).alias("row")).select("row.*")


def write_stream(
    df: DataFrame,
    path: str,
    checkpoint: str,
    format: str = "parquet",
    available_now: bool = True,
    partition_by: list[str] | None = None,
    **options,
) -> StreamingQuery:
    """Appends a stream to files. ``checkpoint`` is the folder of its progress and state."""
    writer = df.writeStream.format(format).outputMode("append").options(path=path, checkpointLocation=checkpoint, **options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_available(df: DataFrame, path: str, checkpoint: str, format: str = "parquet", **options) -> None:
    """Writes all that the sources hold now and returns when it is done."""
    write_stream(df, path, checkpoint, format, available_now=True, **options).awaitTermination()


class _Log:
    """The batches of a folder that are whole: one small file each, which appears by a rename."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.path, self.log = jvm.org.apache.hadoop.fs.Path, f"{path}/_batches"
        self.files = self.path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def folders(self) -> dict[int, str]:
        """The folder of each batch, by its number."""
        if not self.files.exists(self.path(self.log)):
            return {}
        names = [status.getPath().getName() for status in self.files.listStatus(self.path(self.log))]
        return {int(number): attempt for number, attempt in (n.split("-") for n in names if not n.startswith((".", "_")))}

    def commit(self, number: int, attempt: str) -> None:
        draft = self.path(f"{self.log}/.{attempt}")
        self.files.create(draft, True).close()
        self.files.rename(draft, self.path(f"{self.log}/{number}-{attempt}"))


def write_batches(df: DataFrame, path: str, checkpoint: str, save: Callable = writers.write_parquet) -> StreamingQuery:
    """Writes each micro-batch with a batch sink, to a folder of its own, and then lists it.

    A batch that is repeated after a failure gets a new folder, unless it is listed already. ``read_batches`` reads
    listed folders only, so no row is seen twice and no batch half.
    """

    def one(batch: DataFrame, number: int) -> None:
        log = _Log(batch.sparkSession, path)
        if number not in log.folders():
            attempt = uuid.uuid4().hex
            save(batch, f"{path}/batch_id={number}/attempt={attempt}")
            log.commit(number, attempt)

    writer = df.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def read_batches(spark: SparkSession, path: str, schema, format: str = "parquet") -> DataFrame:
    """The rows of the batches of ``write_batches`` that are whole, with their ``batch_id``."""
    folders = _Log(spark, path).folders()
    found = spark.read.schema(schema).format(format).option("basePath", path)
    if not folders:
        return spark.createDataFrame([], schema).withColumn("batch_id", F.lit(None).cast("int"))
    return found.load([f"{path}/batch_id={n}/attempt={a}" for n, a in folders.items()]).drop("attempt")
