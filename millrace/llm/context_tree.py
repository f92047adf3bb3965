"""Language-model scoring by context-tree weighting over binary-decomposed bytes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from math import log, log10, pi

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .common import arrow_map, blocks, extended, text_bytes

#: Bytes of context.
DEPTH = 5
#: Words and byte strings that tasks hold in memory: the most frequent ones, as many as are within these bounds. All
#: others meet their counts in a join.
HELD_WORDS, HELD_GRAMS = 1 << 17, 1 << 21
#: Rows of counts that a task gathers before it hands them on.
GATHERED = 1 << 20

#: A byte that UTF-8 never has: it stands before a text and ends it.
EDGE = b"\xff"


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``depth + 1`` bytes up to each byte of each text and its end, as numbers, and how many each text has."""
    pad = EDGE * depth
    data = np.frombuffer(b"".join([pad + t + EDGE for t in texts]), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    keys = np.zeros(len(data) - depth, np.int64)
    for i in range(depth + 1):
        keys <<= 8
        keys |= data[i : i + len(keys)]
    # The last `depth` windows that start in a text reach into the next one.
    starts = np.cumsum(sizes + depth) - (sizes + depth)
    inside = np.ones(len(keys), bool)
    for i in range(depth):
        at = starts + sizes + i
        inside[at[at < len(keys)]] = False
    return keys[inside], sizes


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def _counted(depth: int):
    """Counts of byte strings and words in training texts; byte strings of other texts have the count 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        words: Counter = Counter()

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            unique, place = np.unique(keys, return_inverse=True)
            return unique, np.bincount(place, weights=counts, minlength=len(unique)).astype(np.int64)

        def rows(keys=None, counts=None) -> pa.RecordBatch:
            n = len(words) if keys is None else len(keys)
            arrays = [
                pa.nulls(n, pa.int64()) if keys is None else pa.array(keys),
                pa.array(list(words), pa.binary()) if keys is None else pa.nulls(n, pa.binary()),
                pa.array(list(words.values()), pa.int64()) if keys is None else pa.array(counts),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=["gram", "word", "n"])

        for batch in batches:
            texts, held = text_bytes(batch.column("text")), batch.column("held").to_numpy(zero_copy_only=False)
            for start, end in blocks(texts):
                for train in (True, False):
                    some = [t for t, h in zip(texts[start:end], held[start:end], strict=True) if h != train]
                    if not some:
                        continue
                    keys, counts = np.unique(grams(some, depth)[0], return_counts=True)
                    parts.append((keys, counts if train else np.zeros_like(counts)))
                    if train:
                        words.update(b" ".join(some).lower().split())
                        words[b""] += len(some)
                if sum(len(k) for k, _ in parts) > 4 * GATHERED:
                    parts = [merged()]
                    if len(parts[0][0]) > GATHERED:
                        yield rows(*parts.pop())
                if len(words) > GATHERED // 2:
                    yield rows()
                    words.clear()
        if parts:
            yield rows(*merged())
        if words:
            yield rows()

    return run


def _ln_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma by Stirling's series at x + 8 and the recurrence back; ten digits and more from x = 0.5 on."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * log(2 * pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - np.log(np.prod([x + i for i in range(8)], axis=0))


def _kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with a zeros and b ones."""
    return _ln_gamma(a + 0.5) + _ln_gamma(b + 0.5) - _ln_gamma(a + b + 1.0) - log(pi)


class Level:
    """Nodes of contexts of one length: keys (context * 256 + place in the byte's tree), counts of the digits 0 and 1, ln
    of the weighted probability, and the parts that the own estimate and the children's product have in it."""

    def __init__(self, keys, a, b, children=None, weighted=None):
        self.keys, self.a, self.b = keys, a, b
        self.parent: np.ndarray | None = None
        if weighted is not None:
            self.weighted = weighted
            return
        estimate = _kt(a, b)
        if children is None:
            self.weighted, self.own, self.rest = estimate, 1.0, 0.0
            return
        self.weighted = np.logaddexp(estimate, children) - log(2)
        self.own, self.rest = np.exp(estimate - log(2) - self.weighted), np.exp(children - log(2) - self.weighted)

    def above(self, depth: int) -> Level:
        """The nodes of the contexts without the oldest byte, which have ``depth`` bytes."""
        shorter = ((self.keys >> 8) & ((1 << 8 * depth) - 1)) << 8 | self.keys & 255
        keys, self.parent = np.unique(shorter, return_inverse=True)
        a, b, children = (np.bincount(self.parent, weights=w, minlength=len(keys)) for w in (self.a, self.b, self.weighted))
        return Level(keys, a, b, children)

    def mix(self, mixed: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of the digit 0 as far as this level decides it, and the part left to longer contexts."""
        zero = (self.a + 0.5) / (self.a + self.b + 1)
        return mixed + left * self.own * zero, left * self.rest


def _climb(level: Level, deep: int, shallow: int) -> list[Level]:
    levels = [level]
    for depth in range(deep - 1, shallow - 1, -1):
        levels.append(levels[-1].above(depth))
    return levels


def _leaves(grams_: np.ndarray, counts: np.ndarray) -> tuple[Level, np.ndarray, np.ndarray]:
    """The deepest level of byte strings, the number of each one's eight nodes in it, and the digits taken there."""
    steps = np.arange(8)
    byte = (grams_ & 255)[:, None]
    digits = byte >> (7 - steps) & 1
    keys, place = np.unique((grams_ >> 8)[:, None] << 8 | 1 << steps | byte >> (8 - steps), return_inverse=True)
    place = place.reshape(-1, 8)
    times = np.repeat(counts, 8).reshape(-1, 8)
    ones = np.bincount(place.ravel(), weights=(times * digits).ravel(), minlength=len(keys))
    every = np.bincount(place.ravel(), weights=times.ravel(), minlength=len(keys))
    return Level(keys, every - ones, ones), place, digits


def _numpy(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def gram_chances(counts: DataFrame, depth: int) -> DataFrame:
    """(gram, n, chance): log10 of the weighted probability of the last byte after the others, for each byte string.

    A node is a context of up to ``depth`` bytes and a place in the binary tree of the next byte; a and b count the
    digits 0 and 1 there. From the longest contexts up, a node's weighted probability is the mean of its own
    Krichevsky-Trofimov estimate and the product of its children's. The estimate's part in that mean is its weight,
    and a digit's probability mixes the estimates along the path by these weights. Nodes without counts have weight
    one half, which is what the recursion gives for a context that was never seen.

    All longer contexts of two bytes lie under them, so those two bytes group the byte strings: a group climbs to its
    two bytes, one task joins the nodes of all groups (255 for each pair of bytes at most) up to the empty context and
    returns what these have mixed so far, and the groups go down from there.
    """
    shared = min(2, depth)
    grouped = counts.withColumn("suffix", F.shiftright("gram", 8).bitwiseAND((1 << 8 * shared) - 1))

    def up(table: pa.Table) -> pa.Table:
        top = _climb(_leaves(_numpy(table, "gram"), _numpy(table, "n"))[0], depth, shared)[-1]
        return pa.table({"key": top.keys, "a": top.a, "b": top.b, "weighted": top.weighted})

    def join(table: pa.Table) -> pa.Table:
        levels = _climb(Level(*(_numpy(table, c) for c in ("key", "a", "b")), weighted=_numpy(table, "weighted")), shared, 0)
        mixed, left = np.zeros(len(levels[-1].keys)), np.ones(len(levels[-1].keys))
        for upper, lower in zip(levels[:0:-1], levels[-2::-1], strict=True):
            mixed, left = upper.mix(mixed, left)
            mixed, left = mixed[lower.parent], left[lower.parent]
        return pa.table({"key": levels[0].keys, "suffix": levels[0].keys >> 8, "mixed": mixed, "left": left})

    def down(table: pa.Table, above: pa.Table) -> pa.Table:
        grams_, n = _numpy(table, "gram"), _numpy(table, "n")
        leaves, place, digits = _leaves(grams_, n)
        levels = _climb(leaves, depth, shared)
        order = np.argsort(_numpy(above, "key"))
        mixed, left = levels[-1].mix(_numpy(above, "mixed")[order], _numpy(above, "left")[order])
        for lower in levels[-2::-1]:
            mixed, left = lower.mix(mixed[lower.parent], left[lower.parent])
        zero = mixed[place]
        chance = np.log10(np.maximum(np.where(digits == 0, zero, 1 - zero), 1e-300)).sum(axis=1)
        return pa.table({"gram": grams_, "n": n, "chance": chance})

    tops = written(grouped.groupBy("suffix").applyInArrow(up, "key bigint, a double, b double, weighted double"), "tops")
    paths = tops.groupBy().applyInArrow(join, "key bigint, suffix bigint, mixed double, left double")
    return grouped.groupBy("suffix").cogroup(paths.groupBy("suffix")).applyInArrow(down, "gram bigint, n bigint, chance double")


def _most_frequent(table: DataFrame, most: int) -> int:
    """The least power of two so that at most ``most`` rows of ``table`` have a count ``n`` of it or more, or 0 if all fit."""
    sizes = {r[0]: r[1] for r in table.groupBy(F.when(F.col("n") > 0, F.floor(F.log2("n"))).otherwise(-1)).count().collect()}
    rows, least = 0, 63
    for power in range(63, -2, -1):
        rows += sizes.get(power, 0)
        if rows > most:
            break
        least = power
    return 0 if least < 0 else 1 << least


class Places:
    """Places of numbers among distinct ``keys``: a hash table at most half full, next slot on a collision. A lookup
    touches two cells or a few more, where halving sorted keys touches one for each of their digits."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(1, (2 * len(keys)).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        todo, slot = np.arange(len(keys), dtype=np.int32), self._slots(keys)
        while len(todo):
            free = self.table[slot] < 0
            self.table[slot[free]] = todo[free]
            left = self.table[slot] != todo
            todo, slot = todo[left], (slot[left] + 1) & (len(self.table) - 1)

    def _slots(self, numbers: np.ndarray) -> np.ndarray:
        return ((numbers.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, numbers: np.ndarray) -> np.ndarray:
        """The place of each of the int64 ``numbers``, or -1."""
        if not len(self.keys):
            return np.full(len(numbers), -1, np.int32)
        slot = self._slots(numbers)
        place = self.table[slot]
        at = np.flatnonzero((place >= 0) & (self.keys[place] != numbers))
        slot = slot[at]
        while len(at):
            slot = (slot + 1) & (len(self.table) - 1)
            place[at] = found = self.table[slot]
            again = (found >= 0) & (self.keys[found] != numbers[at])
            at, slot = at[again], slot[again]
        return place


def _lists(lengths: list[int] | np.ndarray, columns: dict[str, pa.Array]) -> pa.Array:
    """Lists of the given lengths of the structs that lie one after the other in ``columns``."""
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))


def _scored(depth: int, held_grams, held_words):
    """Sums over the held words and byte strings of each text, and lists of the others with their counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, chances = held_grams.value
        # The place -1 takes the 0 at the end.
        places, chances, logs = Places(keys), np.append(chances, 0.0), held_words.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            sums, rare, rare_counts = [], [np.zeros((0, 2), np.int64)], []
            for start, end in blocks(texts):
                found, sizes = grams(texts[start:end], depth)
                place = places.find(found)
                ends = np.cumsum(sizes)
                sums += np.add.reduceat(chances[place], ends - sizes).tolist()
                missing = np.flatnonzero(place < 0)
                owner, missing = np.searchsorted(ends, missing, "right"), found[missing]
                order = np.lexsort((missing, owner))
                owner, missing = owner[order], missing[order]
                first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (missing[1:] != missing[:-1]))[: len(missing)])
                rare.append(np.stack([missing[first], np.diff(first, append=len(missing))], axis=1))
                rare_counts += np.bincount(owner[first], minlength=end - start).tolist()
            grams_ = np.concatenate(rare)
            out: list[list] = [[] for _ in range(4)]
            rare_words, rare_times = [], []
            for text in texts:
                words = tokens(text)
                counts = Counter(words)
                counts[b""] = 1
                base, known_words, before = 0.0, 0, len(rare_words)
                for word, n in counts.items():
                    if (value := logs.get(word)) is None:
                        rare_words.append(word)
                        rare_times.append(n)
                    else:
                        base += n * value
                        known_words += n
                for values_, x in zip(out, (len(words) + 1, known_words, base, len(rare_words) - before), strict=True):
                    values_.append(x)
            number = np.arange(row, row + len(texts))
            row += len(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("held"), pa.array(number), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                    pa.array(out[2], pa.float64()), pa.array(sums, pa.float64()),
                    _lists(out[3], {"word": pa.array(rare_words, pa.binary()), "n": pa.array(rare_times, pa.int64())}),
                    _lists(rare_counts, {"gram": pa.array(grams_[:, 0]), "n": pa.array(grams_[:, 1])}),
                ],
                names=["id", "held", "row", "n_tokens", "known", "base", "chance", "words", "grams"],
            )

    return run


def score(
    docs: DataFrame, held: Column, item: str = "doc_id", text: str = "text", depth: int = DEPTH,
    held_words: int = HELD_WORDS, held_grams: int = HELD_GRAMS,
) -> DataFrame:
    """(item, held_out, n_tokens, n_known, train_tokens, base_score, score) of each whole text.

    The model learns from all rows where ``held`` is false and scores all rows. ``score`` is log10 of the probability
    of the text's bytes and its end; the code length per byte follows from it. ``base_score`` is that of the words and
    the end as single tokens with add-half smoothing. Nothing is pruned: the counts of all byte strings of all texts
    take part. Tasks hold the most frequent ones within fixed bounds; a text's other words and byte strings meet their
    values in a join, so the result is the same for any bound.

    Null and empty texts have one token, the end. Without training rows all counts are 0, and every bit costs one bit.
    Repeated rows give a row each. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col(item).alias("id"), F.col(text).cast("string").alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    counts = written(
        arrow_map(picked.select("text", "held"), _counted(depth), "gram bigint, word binary, n bigint").groupBy("gram", "word").agg(F.sum("n").alias("n")), "counts"
    )
    words = counts.where("word is not null").select("word", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    chances = written(gram_chances(counts.where("gram is not null").select("gram", "n"), depth), "chances")

    least_word, least_gram = _most_frequent(words, held_words), _most_frequent(chances, held_grams)
    top_words = words.where(F.col("n") >= least_word).toArrow()
    logs = dict(zip(top_words["word"].to_pylist(), np.log10(top_words["n"].to_numpy() + 0.5).tolist(), strict=True))
    top_grams = chances.where(F.col("n") >= least_gram).select("gram", "chance").toArrow()
    order = np.argsort(top_grams["gram"].to_numpy())
    held_g = spark.sparkContext.broadcast((top_grams["gram"].to_numpy()[order], top_grams["chance"].to_numpy()[order]))
    held_w = spark.sparkContext.broadcast(logs)

    schema = extended(
        picked.select("id", "held").schema,
        "row bigint, n_tokens bigint, known bigint, base double, chance double, words array<struct<word:binary,n:bigint>>, grams array<struct<gram:bigint,n:bigint>>",
    )
    rows = written(arrow_map(picked, _scored(depth, held_g, held_w), schema), "scored")
    rare_words = rows.select("row", F.inline("words")).withColumnRenamed("n", "times").join(words, "word", "left")
    rare_grams = rows.select("row", F.inline("grams")).withColumnRenamed("n", "times").join(chances.select("gram", "chance"), "gram")
    more = rare_words.select(
        "row",
        (F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("base"),
        F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("known"),
        F.lit(0.0).alias("chance"),
    ).union(rare_grams.select("row", F.lit(0.0), F.lit(0), F.col("times") * F.col("chance")))
    same = rows.select("row", "base", "known", "chance")
    sums = more.union(same).groupBy("row").agg(F.sum("base").alias("base"), F.sum("known").alias("known"), F.sum("chance").alias("chance"))
    width = log10(total + 0.5 * (distinct + 1))
    out = rows.select("id", "held", "row", "n_tokens").join(sums, "row")
    return out.select(
        F.col("id").alias(item),
        F.col("held").alias("held_out"),
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * width).alias("base_score"),
        F.col("chance").alias("score"),
    )
