"""Sorted shards of equal weight by histogram sort, in DataFrame operations only."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

KEY_BITS = 60
#: Key bits that the first histogram and each later one resolve.
FIRST_BITS, NEXT_BITS = 12, 6
#: Sorted runs to a shard. A run is one task of the last exchange.
RUNS = 8
#: Part of a run's weight by which a splitter may miss its place.
TOLERANCE = 0.01


def text_key(text: str, item: str) -> Column:
    """A sort key of 60 bits that keeps equal texts together and still tells their rows apart by ``item``."""
    group = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 28)
    own = F.shiftrightunsigned(F.xxhash64(F.col(item).cast("string"), F.lit(7)), 40)
    return F.shiftleft(group, 24).bitwiseOR(own)


def splitters(keyed: DataFrame, parts: int, tolerance: float = TOLERANCE) -> list[int]:
    """``parts - 1`` ascending keys that cut ``keyed`` (``key`` bigint below 2**60, ``weight`` bigint) evenly by weight.

    Every round counts the exact weight between candidate boundaries over all partitions: at first the multiples of
    2**48, then finer ones inside the intervals that hold a splitter which has not met the tolerance yet. A round
    returns at most 64 sums for each such splitter (4,096 in the first), whatever the number of rows.
    """
    shift = KEY_BITS - FIRST_BITS
    rows = keyed.groupBy(F.shiftright("key", shift).alias("bin")).agg(F.sum("weight").alias("w")).collect()
    counts = {r["bin"]: r["w"] for r in rows}
    total = sum(counts.values())
    allowed = tolerance * total / parts
    found: dict[int, int] = {}
    below = {None: 0}
    open_bins: dict[int | None, list[int]] = {None: list(range(1, parts))}
    while True:
        split: dict[int, list[int]] = {}
        starts: dict[int, int] = {}
        for parent, wanted in open_bins.items():
            bins = sorted(b for b in counts if parent is None or b >> NEXT_BITS == parent)
            edges, sums = [b << shift for b in bins], [below[parent]]
            for b in bins:
                sums.append(sums[-1] + counts[b])
            edges.append(((bins[-1] + 1) << shift) if bins else 0)
            for k in wanted:
                target = k * total / parts
                at = max(1, min(bisect_left(sums, target), len(sums) - 1)) if bins else 0
                near = min((at - 1, at), key=lambda x: abs(sums[x] - target)) if bins else 0
                if not bins or abs(sums[near] - target) <= allowed or shift == 0:
                    found[k] = edges[near]
                else:
                    split.setdefault(bins[at - 1], []).append(k)
                    starts[bins[at - 1]] = sums[at - 1]
        if not split:
            return sorted(found.values())
        finer = shift - NEXT_BITS
        parents = keyed.where(F.shiftright("key", shift).isin(list(split)))
        rows = parents.groupBy(F.shiftright("key", finer).alias("bin")).agg(F.sum("weight").alias("w")).collect()
        counts, below, open_bins, shift = {r["bin"]: r["w"] for r in rows}, starts, split, finer


def place(key: str, cuts: list[int], low: int = 0) -> Column:
    """The number of ``cuts`` at or below the key, as a balanced tree of comparisons."""
    if not cuts:
        return F.lit(low)
    mid = len(cuts) // 2
    return F.when(F.col(key) < F.lit(cuts[mid]), place(key, cuts[:mid], low)).otherwise(place(key, cuts[mid + 1 :], low + mid + 1))


def histogram_sort(
    rows: DataFrame, key: Column, weight: Column, shards: int = 8, order: tuple[str, ...] = (), runs: int = RUNS, tolerance: float = TOLERANCE
) -> DataFrame:
    """``rows`` with ``shard`` (int) and ``slot`` (bigint): shards of near equal weight, sorted by ``key`` within and across.

    ``key`` is a bigint from 0 to 2**60 - 1 and ``weight`` a bigint of 0 or more. Each shard is cut into ``runs``
    sorted runs, so no task sorts more than one run; slots count on through the runs of a shard without a gap. Rows
    move once, after the splitters are known. Rows of one key value are never split: give a key that tells rows
    apart. Ties are ordered by ``order``, then arbitrarily. An empty table gives no rows.
    """
    keyed = written(rows.withColumns({"_key": key, "_weight": weight}), "keyed")
    cuts = splitters(keyed.select(F.col("_key").alias("key"), F.col("_weight").alias("weight")), shards * runs, tolerance)
    cells = keyed.withColumn("_cell", place("_key", cuts))
    sizes = cells.groupBy("_cell").count()
    shard = Window.partitionBy(F.floor(F.col("_cell") / runs)).orderBy("_cell")
    starts = sizes.select("_cell", (F.sum("count").over(shard) - F.col("count")).alias("_start"))
    run = Window.partitionBy("_cell").orderBy("_key", *order)
    placed = cells.withColumn("_number", F.row_number().over(run)).join(F.broadcast(starts), "_cell")  # at most shards * runs rows
    return placed.select(
        *rows.columns,
        F.floor(F.col("_cell") / runs).cast("int").alias("shard"),
        (F.col("_start") + F.col("_number") - 1).cast("bigint").alias("slot"),
    )


def shard_documents(docs: DataFrame, item: str = "doc_id", text: str = "text", shards: int = 8) -> DataFrame:
    """(item, size, text_crc32, shard, slot) of documents in shards of near equal bytes, equal texts side by side.

    The law is that of sizes: a group of equal texts that lies across a splitter is cut there. The size is the UTF-8
    bytes of the text plus 1. A null text is an empty one, with the CRC32 of no bytes. Rows that
    agree in item and text share a shard. Other columns are ignored, so none can clash.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    digest = docs.select(
        F.col(item).alias("_item"),
        (F.octet_length(whole).cast("bigint") + 1).alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        text_key(text, item).alias("_place"),
    )
    placed = histogram_sort(digest, F.col("_place"), F.col("size"), shards, ("_item", "text_crc32"))
    return placed.select(F.col("_item").alias(item), "size", "text_crc32", "shard", "slot")
