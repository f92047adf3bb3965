"""Packing of documents into windows of fixed length by deficit round-robin over source queues."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import scratch_path
from .common import Remembered, arrow_map, extended, slices, text_strings

WINDOW = 4096
END_ID = 2
#: Parts and words that a task keeps the ids of, once and again.
CACHE_PARTS = 200_000
#: Documents that a task holds at one time as texts, ids or pieces.
SLICE_DOCS = 256
#: Rounds that a task keeps the tokens of.
KEPT_ROUNDS = 10_000


_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", re.escape("!\"#$%&()*+,-./:;=?@[\\]^_`{|}~")
#: Letters and marks that lower-casing and normal forms treat one by one; no digits, apostrophes or special tokens.
_ODD, _SPACE = re.compile(f"[^{_LETTERS}{_MARKS} \n]"), re.compile("[ \n]")
_PARTS = re.compile(f"[{_LETTERS}]+|[{_MARKS}]+")


def cut(text: str) -> list[str]:
    """The runs of letters and of marks of a text, lower-cased, and whole words with any other character, after a line feed."""
    out, at = [], 0
    while odd := _ODD.search(text, at):
        begin = max(at, text.rfind(" ", at, odd.start()) + 1, text.rfind("\n", at, odd.start()) + 1)
        space = _SPACE.search(text, odd.end())
        end = space.start() if space else len(text)
        out += _PARTS.findall(text[at:begin].lower())
        out.append("\n" + text[begin:end])
        at = end
    return out + _PARTS.findall(text[at:].lower())


class WordEncoder:
    """Ids of a text as little-endian 32-bit numbers, encoded part by part and kept for the parts to come.

    The tokenizer drops white space before it merges, so ids never depend on what lies beyond a space. Plain letters and
    marks are cut here as its pattern cuts them, and go to the merges directly, many in one call; a token with the
    word-end suffix ends each. Words with any other character pass through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.whole = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.whole.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        # The byte alphabet of the vocabulary, read off the pre-tokenizer itself.
        spell = Sequence([ByteLevel(add_prefix_space=False, use_regex=False)])
        self.alphabet = {b: spell.pre_tokenize_str(bytes([b]).decode("latin-1"))[0][0][-1] for b in range(33, 127)}
        for b in range(128, 256):
            char = (bytes([0xC2, b]) if b < 0xC0 else bytes([0xC3, b - 0x40])).decode()
            pair = spell.pre_tokenize_str(char)[0][0]
            self.alphabet[0x80 + (b & 0x3F)] = pair[1]
            self.alphabet[0xC2 if b < 0xC0 else 0xC3] = pair[0]
        self.alphabet[32] = " "
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known = Remembered(CACHE_PARTS)

    def _learn(self, new: set[str]) -> None:
        odd, parts = [k for k in new if k[0] == "\n"], [k for k in new if k[0] != "\n"]
        found = self.whole.encode_batch_fast([k[1:] for k in odd], add_special_tokens=False)
        self.known.now.update((k, np.array(f.ids, "<u4").tobytes()) for k, f in zip(odd, found, strict=True))
        line = " ".join(parts).encode().decode("latin-1").translate(self.alphabet)
        ids = np.array(self.merges.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
        data, ends = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        self.known.now.update(zip(parts, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        keys = [cut(t) for t in texts]
        new = self.known.missing(set().union(*keys))
        if new:
            self._learn(new)
        known = self.known.now.__getitem__
        return [b"".join(map(known, k)) for k in keys]


def _encode(path: str, item: str, text: str, source: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, starts = WordEncoder(path), TaskContext.get().partitionId(), {}
        for batch in slices(batches, SLICE_DOCS):
            ids = [x + end for x in encoder.encode(text_strings(batch.column(text)))]
            queues = ["none" if s is None else f"is {s}" for s in batch.column(source).to_pylist()]
            local = []
            for queue, x in zip(queues, ids, strict=True):
                local.append(starts.get(queue, 0))
                starts[queue] = local[-1] + len(x) // 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(item), pa.array([part] * len(ids), pa.int32()), pa.array(queues), pa.array(local, pa.int64()), pa.array(ids, pa.binary())],
                names=["item", "part", "queue", "local", "ids"],
            )

    return run


class Rounds:
    """Tokens that deficit round-robin has served to each queue after any number of rounds, in closed form.

    A round hands each open queue a quantum, its share of ``window`` tokens by weight. What of its credit is no whole
    token stays as its deficit: after r rounds a queue of quantum q has had floor(q * r) tokens. When a queue runs dry,
    the others share its part from that moment on. So any task can place any token without the rounds before it.
    """

    def __init__(self, totals: dict[str, int], weights: dict[str, float] | None, window: int):
        self.names = sorted(totals)
        self.totals = [totals[n] for n in self.names]
        shares = [Fraction((weights or totals).get(n, 0)) for n in self.names]
        self.begins: list[Fraction] = []
        #: For each phase and queue (p, q, d): (p + q * r) / d tokens after r rounds.
        self.phases: list[list[tuple[int, int, int]]] = []
        had, now = [Fraction(0)] * len(self.names), Fraction(0)
        while any(h < n for h, n in zip(had, self.totals, strict=True)):
            open_ = [h < n for h, n in zip(had, self.totals, strict=True)]
            # Queues without a weight wait for those that have one.
            if not any(o and s for o, s in zip(open_, shares, strict=True)):
                shares = [Fraction(n) if o else s for o, s, n in zip(open_, shares, self.totals, strict=True)]
            whole = sum(s for o, s in zip(open_, shares, strict=True) if o)
            quanta = [window * s / whole if o else Fraction(0) for o, s in zip(open_, shares, strict=True)]
            self.begins.append(now)
            phase = []
            for h, q in zip(had, quanta, strict=True):
                at_zero = h - q * now
                d = at_zero.denominator * q.denominator
                phase.append((int(at_zero * d), int(q * d), d))
            self.phases.append(phase)
            step = min((n - h) / q for h, n, q in zip(had, self.totals, quanta, strict=True) if q)
            had = [h + q * step for h, q in zip(had, quanta, strict=True)]
            now += step
        self.end = now
        self.last = ceil(now)
        self._rounds: dict[int, tuple[list[int], list[int]]] = {}

    def served(self, r: int) -> list[int]:
        if r >= self.last:
            return self.totals
        phase = self.phases[bisect_right(self.begins, r) - 1]
        return [min((p + q * r) // d, n) for (p, q, d), n in zip(phase, self.totals, strict=True)]

    def round(self, r: int) -> tuple[list[int], list[int], list[int]]:
        """Tokens served before the round and after it, and where each queue's part of it begins in the stream."""
        if r not in self._rounds:
            if len(self._rounds) > KEPT_ROUNDS:
                self._rounds = {}
            before, after = self.served(r), self.served(r + 1)
            at, begins = sum(before), []
            for a, b in zip(before, after, strict=True):
                begins.append(at)
                at += b - a
            self._rounds[r] = (before, after, begins)
        return self._rounds[r]

    def find(self, queue: int, token: int) -> int:
        """The round that serves this token of the queue."""
        for i, phase in enumerate(self.phases):
            p, q, d = phase[queue]
            if q:
                ends = max(-((p - d * (token + 1)) // q), ceil(self.begins[i]))
                if ends < (self.begins[i + 1] if i + 1 < len(self.begins) else self.end):
                    return ends - 1
            elif p // d > token:  # served within the phase before
                return ceil(self.begins[i]) - 1
        return self.last - 1


def _pieces(rounds: Rounds, window: int, with_ids: bool):
    numbers = {name: i for i, name in enumerate(rounds.names)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_DOCS):
            columns: list[list] = [[] for _ in range(7)]
            rows, out_ids = [], []
            for row, (queue, local, base, ids) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("queue", "local", "base", "ids")), strict=True)):
                k, first, size = numbers[queue], base + local, len(ids) // 4
                token, r = first, rounds.find(k, first)
                while token < first + size:
                    before, after, begins = rounds.round(r)
                    stop = min(first + size, after[k])
                    while token < stop:
                        at = begins[k] + token - before[k]
                        n = min(stop - token, window - at % window)
                        piece = ids[(token - first) * 4 : (token - first + n) * 4]
                        for values, value in zip(columns, (token - first, n, zlib.crc32(piece), size, at // window, at % window, queue[3:] if queue[0] == "i" else None), strict=True):
                            values.append(value)
                        rows.append(row)
                        if with_ids:
                            out_ids.append(piece)
                        token += n
                    r += 1
            items = batch.column("item").take(pa.array(rows, pa.int64()))
            arrays = [items, *(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(out_ids, pa.binary())] * with_ids, names=PIECE + ["ids"] * with_ids)

    return run


PIECE = ["item", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]


def pack(
    docs: DataFrame, tokenizer: str, weights: dict[str, float] | None = None, item: str = "doc_id", text: str = "text", source: str = "source",
    window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True,
) -> DataFrame:
    """One row per piece of a document: (item, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, ids).

    The sources' token streams are merged by deficit round-robin (`Rounds`) and cut into windows; only the last window
    can be short. ``weights`` gives the target proportions by source; without them the targets are the sources' own
    totals, so that all run dry together. Sources without a weight come when those with one are packed.

    A document's ids are those of its text and ``end_id``; a null or empty text has that id only. A null source is a
    queue of its own. Repeated rows are packed each. An empty table gives no rows; other columns are ignored.

    The driver holds one total per source: the sources are those of a mixture. Positions inside a source follow the
    order of the encoded table, whose tasks number their own tokens; sums per task and source do the rest.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text"), F.col(source).cast("string").alias("source"))
    schema = extended(picked.select("item").schema, "part int, queue string, local bigint, ids binary")
    path = scratch_path(spark, "encoded")
    arrow_map(picked, _encode(tokenizer, "item", "text", "source", end_id), schema).write.option("compression", "zstd").parquet(path)
    encoded = spark.read.schema(schema).parquet(path)
    sums = encoded.groupBy("part", "queue").agg(F.sum(F.octet_length("ids") / 4).cast("bigint").alias("tokens"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases_path = scratch_path(spark, "bases")
    sums.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))).write.parquet(bases_path)
    bases = spark.read.parquet(bases_path)
    totals = {r[0]: int(r[1]) for r in bases.groupBy("queue").agg(F.sum("tokens")).collect()}
    named = {f"is {k}": v for k, v in weights.items()} if weights else None
    rounds = Rounds(totals, named, window)
    full = encoded.join(bases.select("part", "queue", "base"), ["part", "queue"])
    columns = [f"{name} bigint" for name in PIECE[1:7]] + ["source string"] + ["ids binary"] * with_ids
    out = extended(picked.select("item").schema, ", ".join(columns).replace("offset", "`offset`"))
    return arrow_map(full, _pieces(rounds, window, with_ids), out).withColumnRenamed("item", item)
