"""Resolution of "keep a row iff no earlier kept row is similar" as Spark jobs.

Nodes are rows ``(o, sketch)`` with unique order keys. A sketch has a fixed number of keys,
and two similar ones share at least one of them, so each node stands in that many buckets.
Only nodes that share a bucket with another one take part. A pair is listed in the first
bucket that it shares and in no other.

Small buckets are joined with themselves. A larger one goes on in rounds: its first nodes are
compared with its later ones, which gives edges from earlier to later nodes, and leave the
bucket; what the edges settle leaves as well. The number of first nodes grows from round to
round: a group of similar nodes is gone after the first few. Once the rounds gain little, what
is left are nodes that merely share a key, and all their pairs are compared. Every join with a
large bucket cuts it into tiles of bounded size, each with a key of its own, so a bucket is
never one task. Nothing is capped or dropped.

Edges are settled in serial order: a node stays unless an earlier one that stays is its
neighbour. A chain of nodes can be as long as it likes, so edges are not settled one step of
the chain a round but by connected components, each in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .components import components

# How much the number of first nodes of a large bucket grows from one round to the next, and the share of
# the members that a round must settle for another one to follow when there were some of them.
GROWTH, GAIN, STARS = 4, 0.1, 4
# Edges of a component, or of all of them, that one pass settles; rounds cut larger components down.
PASS_EDGES, ROUNDS = 1 << 20, 4


def keyed(nodes: DataFrame, sketch) -> DataFrame:
    """One row per node and key: ``place`` is the number of the key, ``bucket`` stands for it and its value."""
    parts = nodes.select("o", F.posexplode(F.array(*sketch.keys(F.col("sketch")))).alias("place", "key"))
    return parts.select("o", "place", F.xxhash64("place", "key").alias("bucket"))


def met(nodes: DataFrame, sketch) -> DataFrame:
    """(bucket, n, place, o): the members of buckets of n > 1. Most nodes share none, and go no further."""
    members = written(keyed(nodes, sketch), "keys")
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return written(members.join(sizes, "bucket").select("bucket", "n", "place", "o"), "met")


def _near(pairs: DataFrame, sketch) -> DataFrame:
    both = F.col("sketch_a"), F.col("sketch_b")
    near = pairs.where(F.col("a") < F.col("b")).where(sketch.similar(*both))
    return near.where(sketch.first_key(*both) == F.col("place")).select("a", "b")


def _side(members: DataFrame, name: str, *keys) -> DataFrame:
    return members.select(*keys, F.col("o").alias(name), F.col("sketch").alias(f"sketch_{name}"))


def _listed(members: DataFrame, sketch) -> DataFrame:
    """Similar pairs (a, b), a before b, of the members of small buckets, each from the first one that it shares."""
    return _near(_side(members, "a", "bucket", "place").join(_side(members, "b", "bucket"), "bucket"), sketch)


def _tiled(members: DataFrame, sketch) -> DataFrame:
    """The members of large buckets with the number of tiles of their bucket and the one they are in."""
    tiles = F.ceil(F.col("n") / F.lit(sketch.bucket_rows)).cast("int")
    return members.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("o"), F.col("tiles")).cast("int"))


def _against(first: DataFrame, members: DataFrame, *more: str) -> DataFrame:
    """Few ``first`` nodes of each large bucket beside its ``members``, tile by tile."""
    spread = first.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return _side(spread, "a", "bucket", "place", "tile").join(_side(members, "b", "bucket", "tile", *more), ["bucket", "tile"])


def _all_pairs(members: DataFrame, sketch) -> DataFrame:
    """Similar pairs of the members of large buckets: each two tiles meet under a key of their own."""
    other = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    meeting = ["bucket", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high")]
    left = _side(other, "a", *meeting, "place", F.col("tile").alias("tile_a"))
    right = _side(other, "b", *meeting, F.col("tile").alias("tile_b"))
    pairs = left.join(right, ["bucket", "low", "high"])
    return _near(pairs.where((F.col("low") == F.col("high")) | (F.col("tile_a") != F.col("tile_b"))), sketch)


def resolve(
    nodes: DataFrame, sketch, exact: Callable[[DataFrame], DataFrame] | None = None, sharing: DataFrame | None = None
) -> DataFrame:
    """The order keys ``o`` of the nodes that go.

    ``exact`` narrows similar pairs ``(a, b)`` further, where sketches only suggest them; ``sharing`` is
    what ``met`` gives, if that is known already.
    """
    return _resolved(nodes, sketch, exact, sharing)[0]


def _resolved(nodes: DataFrame, sketch, exact=None, sharing=None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The nodes that go, all edges that were listed, and the members of large buckets (None if there are none)."""

    def narrowed(pairs: DataFrame) -> DataFrame:
        return written(exact(pairs) if exact else pairs, "edges")

    sharing = met(nodes, sketch) if sharing is None else sharing
    members = sharing.join(nodes.select("o", "sketch"), "o")
    edges = narrowed(_listed(members.where(F.col("n") <= sketch.bucket_rows), sketch))
    listed, gone, large, width = [edges], [], None, 1
    if not sharing.where(F.col("n") > sketch.bucket_rows).isEmpty():
        large = written(_tiled(members.where(F.col("n") > sketch.bucket_rows), sketch), "crowded")
    crowded, before = large, large.count() if large is not None else 0
    while crowded is not None:
        # The rank is limited inside the tasks first, so a bucket never comes to one task whole.
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy("o"))
        first = written(crowded.withColumn("rank", rank).where(F.col("rank") <= width).drop("rank"), "first")
        found = narrowed(_near(_against(first, crowded), sketch))
        listed.append(found)
        edges = edges.unionByName(found)
        crowded = crowded.join(first.select("bucket", "o"), ["bucket", "o"], "left_anti")
        # A node may have earlier neighbours that are not listed while it stands behind others in a large bucket.
        front = crowded.groupBy("bucket").agg(F.min("o").alias("front"))
        unlisted = crowded.join(front, "bucket").where(F.col("o") != F.col("front")).select("o")
        dropped = _settled(edges, unlisted)
        gone.append(dropped)
        edges = written(_without(edges, dropped), "edges")
        crowded = written(crowded.join(dropped, "o", "left_anti"), "crowded")
        left = crowded.count()
        if not left or (left > before * (1 - GAIN) and width >= GROWTH ** (STARS - 1)):
            found = narrowed(_all_pairs(crowded, sketch))
            listed.append(found)
            edges, crowded = edges.unionByName(found), None
        before, width = left, width * GROWTH
    gone += _settled_all(edges)
    dropped = reduce(DataFrame.unionByName, gone) if gone else nodes.select("o").limit(0)
    return dropped, reduce(DataFrame.unionByName, listed), large


def _orderable(value):
    """A value as Spark orders it: null first, structs by their fields."""
    return tuple(map(_orderable, value.values())) if isinstance(value, dict) else (value is not None, value)


def _serial(edges: pa.Table) -> pa.Table:
    """The nodes of one component that go, by the serial rule. Edges come in the order of their earlier nodes."""
    a, b = ([_orderable(v) for v in edges.column(c).to_pylist()] for c in ("a", "b"))
    gone: dict[tuple, int] = {}
    for i in sorted(range(len(a)), key=a.__getitem__):
        if a[i] not in gone:
            gone.setdefault(b[i], i)
    return pa.table({"o": edges.column("b").take(pa.array(list(gone.values()), pa.int64()))})


def _settled_all(edges: DataFrame) -> Iterator[DataFrame]:
    """The nodes that go by ``edges``, in parts: components in one pass each, large ones after rounds."""
    for _ in range(2):
        count = edges.count()
        if count <= PASS_EDGES:
            break
        dropped = _settled(edges)
        yield dropped
        edges = written(_without(edges, dropped), "edges")
    while count:
        if count <= PASS_EDGES:
            labelled = edges.withColumn("component", F.lit(0)).withColumn("n", F.lit(count))
        else:
            found = components(edges).withColumnRenamed("node", "a")
            found = written(edges.join(found, "a"), "labelled")
            sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
            labelled = written(found.join(sizes, "component"), "sized")
        passes = labelled.where(F.col("n") <= PASS_EDGES).select("component", "a", "b")
        schema = passes.select(F.col("b").alias("o")).schema
        yield written(passes.groupBy("component").applyInArrow(_serial, schema), "dropped")
        edges = labelled.where(F.col("n") > PASS_EDGES).select("a", "b")
        count = edges.count()
        for _ in range(ROUNDS if count else 0):
            dropped = _settled(edges)
            yield dropped
            edges = written(_without(edges, dropped), "edges")


def _settled(edges: DataFrame, unlisted: DataFrame | None = None) -> DataFrame:
    """The later neighbours of nodes that stay: those without an open earlier neighbour, listed or not.

    Of a plain set of edges this settles at least the first open node, in practice a large share of them.
    """
    waiting = edges.select(F.col("b").alias("a"))
    if unlisted is not None:
        waiting = waiting.unionByName(unlisted.select(F.col("o").alias("a")))
    ready = edges.select("a").distinct().join(waiting.distinct(), "a", "left_anti")
    return written(edges.join(ready, "a", "left_semi").select(F.col("b").alias("o")).distinct(), "dropped")


def _without(edges: DataFrame, dropped: DataFrame) -> DataFrame:
    """The edges between nodes that are still open."""
    from_open = edges.join(dropped.withColumnRenamed("o", "a"), "a", "left_anti")
    return from_open.join(dropped.withColumnRenamed("o", "b"), "b", "left_anti").select("a", "b")


def removals(nodes: DataFrame, sketch, carry: list[str]) -> DataFrame:
    """Each node that goes with the earliest one that stays and is similar to it, and their measure.

    ``o`` and the carried columns come with the suffixes _a (stays) and _b (goes). One row
    per node that goes, so the result never outgrows the nodes.

    The edges name them. A node that left a large bucket early has edges to the nodes before it there that
    were first by then only, so those that stay and come before the best it has are compared once more.
    """
    dropped, listed, large = _resolved(nodes, sketch)
    dropped = written(dropped.distinct(), "removed")
    staying = listed.join(dropped.withColumnRenamed("o", "a"), "a", "left_anti")
    best = written(staying.groupBy("b").agg(F.min("a").alias("a")), "best")
    if large is not None:
        stay = large.join(dropped, "o", "left_anti")
        go = large.join(best.select(F.col("b").alias("o"), F.col("a").alias("known")), "o")
        near = _against(stay, go, "known").where(F.col("a") < F.col("known"))
        near = near.where(sketch.similar(F.col("sketch_a"), F.col("sketch_b"))).select("a", "b")
        best = written(best.unionByName(near).groupBy("b").agg(F.min("a").alias("a")), "best")
    found = best.select(F.col("a").alias("o_a"), F.col("b").alias("o_b"))
    for side in ("a", "b"):
        names = nodes.select(F.col("o").alias(f"o_{side}"), F.col("sketch").alias(f"sketch_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in carry])
        found = found.join(names, f"o_{side}")
    return found.withColumn("measure", sketch.measure(F.col("sketch_a"), F.col("sketch_b"))).drop("sketch_a", "sketch_b")
