"""CSV with line breaks in cells, read by many tasks a file.

A line break stands inside a cell iff an odd number of quote marks comes before it. Each split of a file counts its
marks; a prefix sum over the splits of a file tells whether a split begins inside a cell. A second pass cuts each split
into records. What it cannot close, at its two ends, are fragments, which are put together by themselves: a few rows for
each split, however large the file.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import written

QUOTE = '"'
#: Stands behind the last cell of a record. A cell that is just this would be taken for the end.
END = "\x01\x7f\x01"
_PIECE = "split bigint, seq bigint, first boolean, opens boolean, whole boolean, value string"


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in the order of their splits to records (whole) and fragments.

    ``first`` marks the first record of a file, its header. A fragment that ``opens`` begins a record; one that does not
    goes on with a record from a split before.
    """
    names = ["split", "seq", "first", "opens", "whole", "value"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
    split, seq, held, opens, first = None, 0, [], True, False

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    def fragment() -> list[tuple]:
        return [(split, seq, first, opens, False, "\n".join(held))] if held else []

    for batch in batches:
        rows: list[tuple] = []
        splits = batch.column("split").to_numpy()
        marks = pc.count_substring(batch.column("value"), QUOTE).to_numpy()
        cuts = [0, *(np.flatnonzero(splits[1:] != splits[:-1]) + 1).tolist(), len(splits)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if begin == end:
                continue
            part = batch.slice(begin, end - begin)
            if splits[begin] != split:
                rows += fragment()
                split, seq, held = int(splits[begin]), 0, []
                # A split that begins inside a cell goes on with a record of the one before.
                opens, first = not part.column("inside")[0].as_py(), part.column("start")[0].as_py() == 0
            within = bool(held) or not opens
            inside = (np.cumsum(marks[begin:end]) + within) % 2 == 1
            before = np.concatenate([[within], inside[:-1]])
            lines, alone = part.column("value"), ~inside & ~before
            if first and alone[0]:
                rows.append((split, seq, True, True, True, lines[0].as_py()))
                alone[0], first, seq = False, False, seq + 1
            plain = pc.filter(lines, pa.array(alone))
            if len(plain):
                flags = [pa.array([v] * len(plain), pa.bool_()) for v in (False, True, True)]
                numbers = pa.array([split] * len(plain), pa.int64())
                yield pa.RecordBatch.from_arrays([numbers, numbers, *flags, plain], names=names)
            for i in np.flatnonzero(inside | before).tolist():
                held.append(lines[i].as_py())
                if not inside[i]:
                    rows += [(split, seq, first, True, True, "\n".join(held))] if opens else fragment()
                    held, opens, first, seq = [], True, False, seq + 1
        if rows:
            yield packed(rows)
    if rest := fragment():
        yield packed(rest)


def read_csv_split(
    spark: SparkSession, path: str, delimiter: str = ",", schema: T.StructType | None = None
) -> DataFrame:
    """Header CSV in UTF-8, every column a string; large files are read by many tasks, line breaks in cells included.

    An empty cell is "", and a cell that a short row lacks is null. Cells with quote marks are quoted and their marks
    doubled, and records end with a line feed or with both line-break characters, as CSV writers have it. The columns
    are those of the first record, or of ``schema``; every file begins with its header.
    """
    names = schema.names if schema is not None else _header(spark, path, delimiter)
    place = ["file_path", "file_block_start"]
    lines = spark.read.text(path, lineSep="\n").select("value", *[F.col(f"_metadata.{c}").alias(c) for c in place])
    marks = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    sums = written(lines.groupBy(*place).agg(F.sum(marks).alias("marks")), "marks")
    order = Window.partitionBy("file_path").orderBy("file_block_start")
    before = F.coalesce(F.sum("marks").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = sums.select(*place, before.alias("before")).withColumn("split", F.monotonically_increasing_id())
    splits = written(numbered.select(*place, "split", (F.col("before") % 2 == 1).alias("inside")), "splits")
    # One short row for each split that the session's own split size makes; the lines keep their order beside it.
    given = lines.join(F.broadcast(splits), place).select("split", F.col("file_block_start").alias("start"), "inside", "value")
    pieces = given.mapInArrow(_records, _PIECE)
    whole = pieces.where("whole and not first").select("value")
    # Fragments of one record have the number of openings before them in common.
    parts = written(pieces.where("not whole"), "fragments").join(splits, "split")
    line = Window.partitionBy("file_path").orderBy("file_block_start", "seq")
    grouped = parts.withColumn("record", F.sum(F.col("opens").cast("int")).over(line))
    joined = grouped.groupBy("file_path", "record").agg(
        F.sort_array(F.collect_list(F.struct("file_block_start", "seq", "value"))).alias("parts"), F.max("first").alias("first")
    )
    stitched = joined.where("not first").select(F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value"))
    records = whole.unionByName(stitched)
    value = F.regexp_replace("value", "\r$", "")
    ended = records.select(value.alias("value")).where("value <> ''").select(F.concat("value", F.lit(delimiter + END)).alias("value"))
    fields = [f"c{i}" for i in range(len(names) + 1)]
    options = {"sep": delimiter, "quote": QUOTE, "escape": QUOTE, "multiLine": "true", "maxCharsPerColumn": "-1", "mode": "PERMISSIVE"}
    parsed = ended.select(F.from_csv("value", ", ".join(f"{c} string" for c in fields), options).alias("r")).select("r.*")
    # Cells behind the end mark are lacking; the others are empty where they are null.
    size = F.array_position(F.array(*fields), END)
    cells = [F.when((size == 0) | (size > i + 1), F.coalesce(c, F.lit(""))).alias(n) for i, (c, n) in enumerate(zip(fields, names, strict=False))]
    return parsed.select(*cells)


def _header(spark: SparkSession, path: str, delimiter: str) -> list[str]:
    """The columns by the first record of a file; no more than its start is read."""
    reader = spark.read.options(
        header=True, inferSchema=False, sep=delimiter, quote=QUOTE, escape=QUOTE, multiLine=True, maxCharsPerColumn=-1
    )
    return reader.csv(path).columns
