"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import few, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b of one ordered type); the component is its smallest node.

    Large and small stars in turns: every node hands its larger neighbours, then its smaller ones, to the smallest
    node that it knows. Edges never grow in number, and the rounds grow with the logarithm of a component's width.
    Each step is a written table, so a lost executor repeats one step at most; it has tasks and files for its edges, not
    for the partitions of a shuffle. Self-loops give no node.
    """
    spark = edges.sparkSession
    first = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    # Edges are two numbers each: an eighth of the partitions that suit the data serve them.
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions")) // 8
    current = written(first.coalesce(max(1, spark.sparkContext.defaultParallelism, partitions)), "edges")
    rows, before = current.count(), None
    while True:
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            current.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        # Minima come from sums inside tasks, in a table of their own: a hub's edges then meet its one row in a join
        # between plain exchanges, which Spark splits.
        least = written(few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * rows), "minima")
        large = current.select(F.col("lo").alias("u"), F.col("hi").alias("v")).join(least, "u")
        large = written(few(large.select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), rows), "large")
        # Of a node's smaller neighbours the smallest one takes the others and the node itself.
        root = written(few(large.groupBy("hi").agg(F.min("lo").alias("m")), rows), "roots")
        small = large.join(root, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        current = written(few(small.union(root.select("hi", F.col("m").alias("lo"))).distinct(), rows), "edges")
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    roots = current.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
