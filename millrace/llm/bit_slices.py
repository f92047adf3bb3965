"""Exact top-k inner products by bit-sliced sums."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .common import arrow_map, parallelism

#: Rows of an index block and of a query block.
INDEX_ROWS, QUERY_ROWS = 8192, 64


def quantise(vector: str, scale: float) -> F.Column:
    """floor(scale * x) of each component, or null where the vector is null or holds null or non-finite components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return F.when(F.col(vector).isNotNull() & (F.size(vector) > 0) & good, whole)


class Slices:
    """Rows of whole numbers as bitmaps: one for each component and binary digit above the component's minimum."""

    def __init__(self, values: np.ndarray):
        self.rows, self.low = len(values), values.min(axis=0)
        above = values - self.low
        self.bits = max(1, int(above.max()).bit_length())
        words = -(-self.rows // 64)
        padded = np.zeros((words * 64, values.shape[1]), np.int64)
        padded[: self.rows] = above
        planes = [np.packbits((padded >> b & 1).astype(np.uint8), axis=0, bitorder="little") for b in range(self.bits)]
        self.planes = np.ascontiguousarray(np.stack(planes, axis=1).transpose(2, 1, 0)).view(np.uint64)
        live = np.zeros(words * 64, np.uint8)
        live[: self.rows] = 1
        self.live = np.packbits(live, bitorder="little").view(np.uint64)

    def product(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bitmaps of the sum over components of query * value, least significant first, and a number to add to it.

        Each binary digit of a factor adds a component's slices at its weight. For negative factors the slices are
        complemented, which keeps the sum free of signs. Bitmaps of equal weight meet in full adders, three at a time.
        """
        size, top = np.abs(query), (1 << self.bits) - 1
        planes = np.where((query < 0)[:, None, None], ~self.planes, self.planes)
        constant = int(query @ self.low) - int(size[query < 0].sum()) * top
        digits = [np.flatnonzero(size >> a & 1) for a in range(int(size.max()).bit_length())]
        carried: list[np.ndarray] = []
        total, weight = [], 0
        while weight < len(digits) + self.bits - 1 or carried:
            column = [planes[d, weight - a] for a, d in enumerate(digits) if len(d) and 0 <= weight - a < self.bits] + carried
            carried = []
            bitmaps = np.concatenate(column) if column else np.zeros((0, len(self.live)), np.uint64)
            while len(bitmaps) > 1:
                k = max(1, len(bitmaps) // 3)
                a, b = bitmaps[:k], bitmaps[k : 2 * k]
                half = a ^ b
                if len(bitmaps) == 2:
                    bitmaps, carry = half, a & b
                else:
                    c = bitmaps[2 * k : 3 * k]
                    bitmaps, carry = np.concatenate([half ^ c, bitmaps[3 * k :]]), (a & b) | (half & c)
                carried.append(carry)
            total.append(bitmaps[0] if len(bitmaps) else np.zeros(len(self.live), np.uint64))
            weight += 1
        return total, constant

    def top(self, query: np.ndarray, k: int, but: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the k highest products among the rows outside ``but``; ties go to lower rows.

        From the most significant slice down, rows with the digit set are certain as long as no more than k are; else
        only they stay open. Rows open after the last slice have the score of the boundary, and the first of them fill up.
        """
        total, constant = self.product(query)
        certain, still = np.zeros_like(self.live), self.live & ~but
        for plane in reversed(total):
            more = certain | still & plane
            count = int(np.bitwise_count(more).sum())
            if count > k:
                still = still & plane
            else:
                certain, still = more, still & ~plane
                if count == k:
                    still = np.zeros_like(still)
                    break
        rows = np.flatnonzero(np.unpackbits(certain.view(np.uint8), bitorder="little"))
        edge = np.flatnonzero(np.unpackbits(still.view(np.uint8), bitorder="little"))[: k - len(rows)]
        rows = np.concatenate([rows, edge])
        scores = np.full(len(rows), constant, np.int64)
        for weight, plane in enumerate(total):
            scores += (plane[rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << weight
        return rows, scores


def _search(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[int, np.ndarray, Slices] | None = None
        for batch in batches:
            for row in range(batch.num_rows):
                block, ids, values, query_ids, queries = (batch.column(i)[row].as_py() for i in range(5))
                if kept is None or kept[0] != block:
                    ids = np.array(ids, np.int64)
                    order = np.argsort(ids, kind="stable")
                    kept = (block, ids[order], Slices(np.array(values, np.int64)[order]))
                _, ids, slices = kept
                found: list[list] = [[], [], []]
                for query_id, query in zip(query_ids, queries, strict=True):
                    own = np.zeros(len(slices.live) * 64, np.uint8)
                    own[: len(ids)] = ids == query_id
                    rows, scores = slices.top(np.array(query, np.int64), k, np.packbits(own, bitorder="little").view(np.uint64))
                    found[0] += [query_id] * len(rows)
                    found[1] += ids[rows].tolist()
                    found[2] += scores.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    return run


def top_products(
    vectors: DataFrame, queries: F.Column, k: int = 10, item: str = "vec_id", vector: str = "embedding", scale: float = 1024.0,
    index_rows: int = INDEX_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that meets ``queries`` its k highest whole inner products.

    Components are floor(scale * x). Candidates are all rows of other ids; ties go to the smaller id, and fewer
    candidates give fewer rows. Vectors that are null, empty or hold null or non-finite components and rows without an
    id take no part. Repeated rows are candidates each and one query. Vectors are compared with those of their own
    length. Products must fit 63 bits. An empty table gives no rows; other columns are ignored.

    Rows lie in blocks of about ``index_rows``, queries in blocks of about ``query_rows``; each pair of blocks is one
    row of the join, and returns k rows per query at most.
    """
    spark = vectors.sparkSession
    whole = vectors.select(F.col(item).cast("bigint").alias("id"), quantise(vector, scale).alias("x"), queries.alias("q"))
    rows = written(whole.where("x is not null and id is not null").withColumns({"n": F.size("x"), "row": F.monotonically_increasing_id()}), "quantised")
    counts = rows.agg(F.count("*"), F.count_if("q")).first()
    blocks, asks = -(-counts[0] // index_rows) or 1, -(-counts[1] // query_rows) or 1
    index = rows.groupBy("n", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")).agg(
        F.collect_list("id").alias("ids"), F.collect_list("x").alias("values")
    )
    ask = rows.where("q").groupBy("id").agg(F.min_by(F.struct("n", "x"), "row").alias("s")).select("id", "s.n", "s.x")
    asked = (
        ask.groupBy("n", F.pmod(F.xxhash64("id"), F.lit(asks)).alias("ask"))
        .agg(F.collect_list("id").alias("query_ids"), F.collect_list("x").alias("queries"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    )
    pairs = index.join(asked.withColumn("block", F.col("block").cast("bigint")), ["n", "block"])
    spread = pairs.select("block", "ids", "values", "query_ids", "queries", "ask").repartition(min(parallelism(spark), blocks * asks), "block", "ask")
    found = arrow_map(spread.sortWithinPartitions("block").drop("ask"), _search(k), "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
