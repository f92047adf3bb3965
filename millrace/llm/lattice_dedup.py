"""Near-duplicate vectors by lattice hashing: E8 cells of random projections, verified by cosine."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .common import arrow_map, extended, parallelism
from ..operators.components import components
from .simhash_tiles import Forest

#: Hash tables, neighbouring cells probed in each, and the length that one lattice unit stands for.
TABLES, PROBES, CELL = 8, 3, 1.4
SEED = 20_240_607
#: Rows of a bucket or component that meet in one tile.
TILE_ROWS = 4096


def _minimal() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


MINIMAL = _minimal()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest point of D8, whole coordinates with an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(axis=1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: that of D8 or of D8 shifted by one half in all coordinates."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def cells(vectors: np.ndarray, tables: int, probes: int, cell: float) -> np.ndarray:
    """(rows, tables, 1 + probes) cell keys of unit vectors: the own cell first, then its nearest neighbours."""
    rng = np.random.default_rng([SEED, vectors.shape[1]])
    mix = rng.integers(1, 2**62, size=(tables, 9), dtype=np.int64) | 1
    out = np.empty((len(vectors), tables, 1 + probes), np.int64)
    for t in range(tables):
        points = vectors @ rng.standard_normal((vectors.shape[1], 8)) / cell
        own = decode(points)
        nearest = np.argsort(-(points - own) @ MINIMAL.T, axis=1, kind="stable")[:, :probes]
        all_ = np.concatenate([own[:, None], own[:, None] + MINIMAL[nearest]], axis=1)
        with np.errstate(over="ignore"):
            out[:, t] = (np.rint(all_ * 2).astype(np.int64) * mix[t, :8]).sum(axis=2) + mix[t, 8]
    return out


def _unit(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows hold usable vectors, and these in double precision at length one."""
    good, out = [], []
    for value in column.to_pylist():
        ok = value is not None and len(value) > 0 and None not in value
        x = np.array(value, np.float64) if ok else None
        if ok and np.isfinite(x).all() and (size := np.abs(x).max()) > 0:
            x = x / size
            out.append(x / np.sqrt(x @ x))
            good.append(True)
        else:
            good.append(False)
    return np.array(good, bool), out


def _usable(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good, units = _unit(batch.column("x"))
        filled = iter(units)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([next(filled).tobytes() if g else None for g in good], pa.binary())], names=["id", "unit"]
        )


def _hashed(tables: int, probes: int, cell: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            units = batch.column("unit").to_pylist()
            lengths = np.array(list(map(len, units)))
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                keys = cells(np.frombuffer(b"".join([units[r] for r in rows])).reshape(len(rows), -1), tables, probes, cell)
                shape = keys.shape
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.ravel()),
                        pa.array(np.repeat(nodes[rows], shape[1] * shape[2])),
                        pa.array(np.tile(np.arange(shape[2]) == 0, shape[0] * shape[1])),
                        pa.array(np.full(keys.size, length // 8, np.int32)),
                    ],
                    names=["key", "node", "own", "dim"],
                )

    return run


def _groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in their first ``keys`` columns, which are sorted."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(keys)], axis=1)
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), len(values)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            key = values[start].tobytes()
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _tile(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """The unit vectors of a tile, the rows of its first and second block, and whether these are the same."""
    data = group["unit"].combine_chunks()
    units = np.frombuffer(b"".join(data.to_pylist())).reshape(group.num_rows, -1)
    block, first, second = (group[c].to_numpy() for c in ("block", "b1", "b2"))
    return units, np.flatnonzero(block == first), np.flatnonzero(block == second), bool(first[0] == second[0])


def _verify(threshold: float):
    """Forests of the links in tiles of a bucket; of a pair at least one row must be in the cell itself."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 4):
            units, left, right, same = _tile(group)
            if not len(left) or not len(right):
                continue
            own, nodes = group["own"].to_numpy(zero_copy_only=False), group["node"].to_numpy()
            forest = Forest(group.num_rows)
            for at in range(0, len(left), 512):
                rows = left[at : at + 512]
                near = (units[rows] @ units[right].T >= threshold) & (own[rows][:, None] | own[right])
                i, j = np.nonzero(near)
                forest.link(rows[i], right[j])
            moved = np.flatnonzero(forest.label != np.arange(group.num_rows))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[forest.label[moved]])], names=["a", "b"])

    return run


def _count(threshold: float):
    """Links of each row of a component's tile to the rows of the other block, copies counted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 4):
            units, left, right, same = _tile(group)
            copies, nodes = group["copies"].to_numpy(), group["node"].to_numpy()
            links = np.zeros(group.num_rows, np.int64)
            for at in range(0, len(left), 512):
                rows = left[at : at + 512]
                near = units[rows] @ units[right].T >= threshold
                if same:
                    near &= rows[:, None] != right
                links[rows] += near @ copies[right]
                if not same:
                    links[right] += copies[rows] @ near
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links)], names=["node", "links"])

    return run


def _tiles(members: DataFrame, sizes: DataFrame, vectors: DataFrame, key: str, extra: list[str], tile_rows: int) -> DataFrame:
    """Rows of a group once for each pair of blocks that they take part in, sorted by tile."""
    blocks = sizes.select(key, F.ceil(F.col("n") / tile_rows).cast("int").alias("blocks"))
    placed = members.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = other.select(
        key, "dim", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "node", *extra
    )
    full = paired.join(vectors.select("node", "unit", "copies"), "node")
    spread = full.select(key, "dim", "b1", "b2", "block", "node", *extra, "unit", "copies")
    return spread.repartition(parallelism(members.sparkSession), key, "dim", "b1", "b2").sortWithinPartitions(key, "dim", "b1", "b2")


def link_vectors(
    vectors: DataFrame, item: str = "vec_id", vector: str = "embedding", threshold: float = 0.95,
    tables: int = TABLES, probes: int = PROBES, cell: float = CELL, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(item, n_links, component_id, kept) of each row: links are pairs with a cosine of ``threshold`` or more.

    Equal vectors fall together first. Each vector is projected to eight random dimensions per table, and lies in the
    E8 cell that it decodes to; it is also looked up in the ``probes`` neighbouring cells that it is nearest to. Pairs
    that meet are verified in double precision, and connect components. Inside a component every pair is compared once,
    so a link is counted even if hashing has missed it, as long as its ends are connected. Large cells and components
    are cut into blocks that meet in pairs; only forests and counts leave a tile.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Vectors of different
    lengths never link. Every row counts as a vector, also those of one id; a null id names no component of others.
    An empty table gives no rows; other columns are ignored.
    """
    base = vectors.select(F.col(item).alias("id"), F.col(vector).alias("x"))
    rows = written(arrow_map(base, _usable, extended(base.select("id").schema, "unit binary")), "units")
    distinct = rows.where("unit is not null").groupBy("unit").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    nodes = written(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    hits = written(arrow_map(nodes.select("node", "unit"), _hashed(tables, probes, cell), "key bigint, node bigint, own boolean, dim int"), "cells")
    crowded = hits.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("home")).where("n > 1 and home")
    tiles = _tiles(hits, crowded, nodes, "key", ["own"], tile_rows)
    edges = written(arrow_map(tiles, _verify(threshold), "a bigint, b bigint"), "links")
    found = written(components(edges), "found")
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    inside = found.withColumn("dim", F.lit(0))
    counted = arrow_map(_tiles(inside, sizes, nodes, "component", [], tile_rows), _count(threshold), "node bigint, links bigint")
    links = counted.groupBy("node").agg(F.sum("links").alias("links"))
    named = (
        nodes.join(found, "node", "left").join(links, "node", "left")
        .select("unit", "least", F.coalesce("component", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = named.join(least, "root").select("unit", "n_links", "component_id")
    out = rows.join(labelled, "unit", "left").select(
        F.col("id").alias(item),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("unit").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col(item).eqNullSafe(F.col("component_id")))
