"""Near-duplicate search and removal with SimHash and MinHash.

A row stays unless an earlier row that itself stayed is similar to it. The work:

1. one narrow row per text: its order key and its sketch;
2. equal sketches fall together to the first row, inside the tasks before the shuffle.
   Whatever removes that row removes its copies too, so this is exact;
3. sketches are cut into more blocks than two similar ones can differ in, and each choice of
   so many blocks as must agree is a key. Similar sketches therefore share a key, and an
   equi-join on keys misses nothing;
4. the rule is resolved on what the keys show (see ``greedy``).

Rows with a null order key have no place in the order: they remove nothing and stay.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checks import as_list, col, require_batch, require_columns
from ..functions import fingerprint
from ..functions.text import squash, words
from ..scratch import written
from .greedy import met, removals, resolve

SIMHASH_BITS = 64
# Most keys that a sketch may have, and how many bits a key should tell apart if that allows it.
MAX_KEYS, KEY_BITS = 64, 24
MAX_DISTANCE = 9


@dataclass(frozen=True)
class Sketch:
    """A fingerprint column ``sketch`` with its keys and its test of similarity.

    ``keys(value)`` are the keys of one sketch, always equally many. ``agree(left, right)``
    says for each key whether a pair shares it. ``measure(left, right)`` compares a pair and
    ``near`` decides on the measure. Buckets up to ``bucket_rows`` are joined with
    themselves: so many pairs per member at most.
    """

    keys: Callable[[Column], list[Column]]
    agree: Callable[[Column, Column], list[Column]]
    measure: Callable[[Column, Column], Column]
    near: Callable[[Column], Column]
    bucket_rows: int

    def similar(self, left: Column, right: Column) -> Column:
        return self.near(self.measure(left, right))

    def first_key(self, left: Column, right: Column) -> Column:
        """The number of the first key that a pair shares, from 0."""
        return (F.array_position(F.array(*self.agree(left, right)), F.lit(True)) - 1).cast("int")


def _blocks(size: int, parts: int) -> list[range]:
    """The places 0..size-1 in ``parts`` runs."""
    return [range(i * size // parts, (i + 1) * size // parts) for i in range(parts)]


def _agreeing(threshold: int) -> int:
    """How many of ``threshold`` and so many blocks make a key: the least that tell ``KEY_BITS`` apart."""
    choices = [n for n in range(1, SIMHASH_BITS) if comb(threshold + n, n) <= MAX_KEYS and threshold + n <= SIMHASH_BITS]
    wide = [n for n in choices if n * SIMHASH_BITS >= KEY_BITS * (threshold + n)]
    return wide[0] if wide else choices[-1]


def simhash_sketch(threshold: int, bucket_rows: int = 2048) -> Sketch:
    """At most ``threshold`` differing bits leave n of threshold + n blocks of bits equal.

    Every choice of n blocks is a key: 10 keys of 25 bits for a threshold of 3. Past
    ``MAX_DISTANCE`` bits, ``MAX_KEYS`` keys would be too short to tell rows apart.
    """
    if not 0 <= threshold <= MAX_DISTANCE:
        raise ValueError(f"threshold must be in 0..{MAX_DISTANCE}: a larger one needs more than {MAX_KEYS} keys a row")
    agreeing = _agreeing(threshold)
    masks = []
    for chosen in combinations(_blocks(SIMHASH_BITS, threshold + agreeing), agreeing):
        mask = sum(1 << p for block in chosen for p in block)
        masks.append(F.lit(mask - (1 << SIMHASH_BITS) if mask >> (SIMHASH_BITS - 1) else mask).cast("bigint"))

    return Sketch(
        lambda value: [value.bitwiseAND(mask) for mask in masks],
        lambda left, right: [left.bitwiseXOR(right).bitwiseAND(mask) == 0 for mask in masks],
        fingerprint.hamming_distance,
        lambda distance: distance <= threshold,
        bucket_rows,
    )


def needed_agreement(threshold: float, num_perm: int) -> int:
    """The least number of equal positions whose share reaches the threshold."""
    return next(m for m in range(num_perm + 1) if m / num_perm >= threshold)


def minhash_sketch(threshold: float, num_perm: int = 64, bucket_rows: int = 512) -> Sketch:
    """``need`` equal positions leave one of num_perm - need + 1 blocks of positions equal."""
    if not 0.5 <= threshold <= 1:
        raise ValueError("threshold must be in 0.5..1; below, keys are too short to filter")
    need = needed_agreement(threshold, num_perm)
    blocks = _blocks(num_perm, num_perm - need + 1)

    def keys(value: Column) -> list[Column]:
        return [F.xxhash64(*[F.get(value, F.lit(p)) for p in block]) for block in blocks]

    def agree(left: Column, right: Column) -> list[Column]:
        same = [[F.get(left, F.lit(p)) == F.get(right, F.lit(p)) for p in block] for block in blocks]
        return [reduce(Column.__and__, positions) for positions in same]

    return Sketch(keys, agree, fingerprint.signature_agreement, lambda equal: equal >= need, bucket_rows)


def _order_key(order: list[str]) -> Column:
    return col(order[0]) if len(order) == 1 else F.struct(*[col(c) for c in order])


def _sketched(df: DataFrame, column: str, order: list[str], sketch: Column, *extra: Column) -> DataFrame:
    require_batch(df, "near-duplicate search")
    require_columns(df, [column, *order])
    return written(df.select(_order_key(order).alias("o"), sketch.alias("sketch"), *extra), "sketches")


def _keep(df: DataFrame, order: list[str], sketched: DataFrame, first: DataFrame, dropped: DataFrame) -> DataFrame:
    """``df`` without the rows that go: those that are not first of their sketch, and the ``dropped`` first ones.

    The keys of the rows that go are the smaller side of the only join that moves ``df``.
    """
    removed = sketched.select("o").join(first.select("o").join(dropped, "o", "left_anti"), "o", "left_anti")
    removed = written(removed.where(F.col("o").isNotNull()).select(F.col("o").alias("_o")), "removed")
    return df.join(removed, _order_key(order) == F.col("_o"), "left_anti")


def _text(column: str) -> Column:
    return col(column).cast("string")


def simhash(df: DataFrame, column: str, variant: str = "token", output_column: str = "simhash") -> DataFrame:
    require_columns(df, [column])
    return df.withColumn(output_column, fingerprint.simhash(_text(column), variant))


def minhash(df: DataFrame, column: str, num_perm: int = 64, output_column: str = "minhash") -> DataFrame:
    require_columns(df, [column])
    return df.withColumn(output_column, fingerprint.minhash_signature(_text(column), num_perm))


def _pairs(sketched: DataFrame, order: list[str], sketch: Sketch) -> DataFrame:
    """Removals among distinct sketches, each named by its first row, with its number of rows."""
    groups = sketched.groupBy("sketch").agg(F.min("o").alias("o"), F.count(F.lit(1)).alias("copies"))
    pairs = removals(written(groups, "groups"), sketch, carry=["copies"])
    names = []
    for side in ("a", "b"):
        if len(order) == 1:
            names.append(F.col(f"o_{side}").alias(f"{order[0]}_{side}"))
        else:
            names += [F.col(f"o_{side}")[c].alias(f"{c}_{side}") for c in order]
    return pairs.select(*names, "copies_a", "copies_b", "measure")


def near_dup_pairs(
    df: DataFrame, column: str, threshold: int = 3, order_by: str | list[str] = "id", variant: str = "token"
) -> DataFrame:
    """Each SimHash fingerprint that goes, with the earliest one that stays within ``threshold`` bits of it.

    A fingerprint is named by its first row and carries its number of rows (``copies``):
    rows with equal fingerprints are at distance 0 and are not spelled out. Which ones stay
    is what ``simhash_deduplicate`` decides: _a stays, _b goes. One row per fingerprint that
    goes, so a large family of near copies gives no more rows than it has members.
    """
    order = as_list(order_by)
    sketch = simhash_sketch(threshold)
    sketched = _sketched(df, column, order, fingerprint.simhash(_text(column), variant))
    return _pairs(sketched, order, sketch).withColumnRenamed("measure", "distance")


def minhash_pairs(
    df: DataFrame, column: str, threshold: float = 0.85, order_by: str | list[str] = "id", num_perm: int = 64
) -> DataFrame:
    """Each MinHash signature that goes, with the earliest one that stays and agrees in a share of ``threshold``.

    Named and counted as in ``near_dup_pairs``; ``minhash_deduplicate`` decides which ones stay.
    """
    order = as_list(order_by)
    sketch = minhash_sketch(threshold, num_perm)
    sketched = _sketched(df, column, order, fingerprint.minhash_signature(_text(column), num_perm))
    pairs = _pairs(sketched, order, sketch)
    return pairs.withColumn("similarity", F.col("measure") / F.lit(float(num_perm))).drop("measure")


def _deduplicate(df: DataFrame, order: list[str], sketched: DataFrame, sketch: Sketch) -> DataFrame:
    first = written(sketched.groupBy("sketch").agg(F.min("o").alias("o")), "first")
    return _keep(df, order, sketched, first, resolve(first, sketch))


def simhash_deduplicate(
    df: DataFrame, column: str, threshold: int = 3, order_by: str | list[str] = "id", variant: str = "token"
) -> DataFrame:
    """Keeps a row iff no earlier kept row is within ``threshold`` bits."""
    order = as_list(order_by)
    sketch = simhash_sketch(threshold)
    sketched = _sketched(df, column, order, fingerprint.simhash(_text(column), variant))
    return _deduplicate(df, order, sketched, sketch)


def minhash_deduplicate(
    df: DataFrame, column: str, threshold: float = 0.85, order_by: str | list[str] = "id", num_perm: int = 64
) -> DataFrame:
    """Keeps a row iff no earlier kept row agrees in a share of ``threshold`` positions."""
    order = as_list(order_by)
    sketch = minhash_sketch(threshold, num_perm)
    sketched = _sketched(df, column, order, fingerprint.minhash_signature(_text(column), num_perm))
    return _deduplicate(df, order, sketched, sketch)


def dedup_fuzzy(
    df: DataFrame, column: str, threshold: float = 0.85, order_by: str | list[str] = "id", num_perm: int = 64
) -> DataFrame:
    """Keeps a row iff no earlier kept row is similar by MinHash and by exact Jaccard.

    A pair counts if its signatures reach the threshold and the exact Jaccard similarity
    of the two sets of word bigrams does too.
    """
    order = as_list(order_by)
    sketch = minhash_sketch(threshold, num_perm)
    text = F.lower(F.coalesce(_text(column), F.lit("")))
    # Texts equal but for case and white space have equal sets; the first of them stands for all.
    digest = F.sha2(squash(text), 256)
    sketched = _sketched(df, column, order, fingerprint.minhash_signature(_text(column), num_perm), digest.alias("digest"))
    groups = sketched.where(F.col("o").isNotNull()).groupBy("digest").agg(F.min(F.struct("o", "sketch")).alias("first"))
    first = written(groups.select("first.o", "first.sketch"), "first")
    # The sets are written once, for the rows that share a key with another, whatever the number of rounds.
    sharing = met(first, sketch)
    texts = df.select(_order_key(order).alias("o"), text.alias("text")).join(sharing.select("o").distinct(), "o", "left_semi")
    texts = texts.withColumn("words", words(F.col("text")))
    # Numbers of 64 bits stand for the bigrams.
    bigrams = F.transform(fingerprint.word_bigrams(F.col("words")), lambda pair: F.xxhash64(pair))
    shingles = written(texts.select("o", F.array_distinct(bigrams).alias("shingles")), "shingles")

    def exact(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sets reach the threshold."""
        left = shingles.select(F.col("o").alias("a"), F.col("shingles").alias("_left"))
        right = shingles.select(F.col("o").alias("b"), F.col("shingles").alias("_right"))
        both = pairs.join(left, "a").join(right, "b")
        common = F.size(F.array_intersect("_left", "_right"))
        union = F.size("_left") + F.size("_right") - common
        alike = F.when(union == 0, True).otherwise(common / union >= F.lit(float(threshold)))
        return both.where(alike).select("a", "b")

    return _keep(df, order, sketched, first, resolve(first, sketch, exact, sharing))
