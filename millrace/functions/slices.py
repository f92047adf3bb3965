"""Arrow UDFs over texts that hold few of them at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most rows and, but for a longer text, most bytes of text that a task holds as Python strings.
SLICE_ROWS, SLICE_BYTES = 512, 1 << 19


def text_slices(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` cut into slices of few rows and bytes; a text that is longer is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        end = max(at + 1, min(at + SLICE_ROWS, int(np.searchsorted(ends, before + SLICE_BYTES, "right"))))
        yield texts.slice(at, end - at)
        at = end


def sliced_udf(text: Column, kind: str, start: Callable[[], Callable[[list[str | None]], pa.Array]]) -> Column:
    """A value of type ``kind`` for each text. ``start`` is called once a task; what it gives turns a slice into values."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        convert = start()
        for batch in batches:
            for part in text_slices(batch):
                yield convert(part.to_pylist())

    return run(text)
