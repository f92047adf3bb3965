"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that a step in Python holds as arrays at one time.
BLOCK_BYTES = 1 << 21
#: Rows of a batch that a step in Python works on at one time.
SLICE_ROWS = 1024


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def text_strings(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def blocks(texts: list[bytes] | list[str], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Slices [start, end) of ``texts`` of about ``limit`` bytes or characters; a longer text is a slice of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, so that a task holds few texts as strings and returns small batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def arrow_map(df: DataFrame, function: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` without barriers; ``function`` gets the batches of one partition."""
    return df.mapInArrow(function, schema)


def extended(schema: StructType, ddl: str) -> StructType:
    """``schema`` with the fields of ``ddl`` after its own."""
    return StructType(schema.fields + StructType.fromDDL(ddl).fields)


class Remembered:
    """Values by key that a task keeps: all of the last ``limit`` keys, up to twice as many in all."""

    def __init__(self, limit: int):
        self.now, self.before, self.limit = {}, {}, limit

    def missing(self, keys: set) -> set:
        """Those of ``keys`` without a value; the values of the others stay in ``now`` until the next call."""
        if len(self.now) > self.limit:
            self.now, self.before = {}, self.now
        absent = keys - self.now.keys()
        old = absent & self.before.keys()
        self.now.update((k, self.before[k]) for k in old)
        return absent - old


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made of ``names`` that ``df`` does not have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """True for the documents of one fold by the CRC32 of the id as text; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
