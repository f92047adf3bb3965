"""Text fingerprints.

Each fingerprint is a function of one text, so it needs no shuffle. Spark hands
Arrow batches to the tasks and numpy does the counting, for a slice of a batch at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .slices import sliced_udf

# Fixed values of the MinHash family: hash i is (base ^ (i * STEP)) & MASK.
MINHASH_STEP = 0x45D9F3B
MINHASH_MASK = 0xFFFFFFFF

# Bounds the memory of a task, not the input: long texts are counted piece by piece.
PIECE = 1 << 16
CACHE_LIMIT = 1 << 16


class _Digests:
    """md5 digests of tokens, remembered within one task."""

    def __init__(self):
        self.known: dict[str, bytes] = {}

    def of(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_LIMIT:
            self.known.clear()
        known, out = self.known, []
        for token in tokens:
            digest = known.get(token)
            if digest is None:
                digest = known[token] = hashlib.md5(token.encode("utf-8", "surrogatepass")).digest()
            out.append(digest)
        return np.frombuffer(b"".join(out), dtype=np.uint8).reshape(-1, 16)


def _pieces(rows: np.ndarray) -> Iterator[np.ndarray]:
    return (rows[at : at + PIECE] for at in range(0, len(rows), PIECE))


def _lists(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as a list."""
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))


def simhash(text: Column, variant: str = "token") -> Column:
    """64-bit SimHash as a signed bigint; null and empty text give 0.

    ``token``: tokens between white space, upper half of md5, a bit is set on votes >= 0.
    ``word``: runs of word characters, lower half of md5, a bit is set on votes > 0.
    """
    if variant not in ("token", "word"):
        raise ValueError(f"Unknown SimHash variant '{variant}'")

    def start():
        digests = _Digests()
        half = slice(0, 8) if variant == "token" else slice(8, 16)
        word = re.compile(r"\w+")

        def one(text: str) -> np.ndarray:
            tokens = text.split() if variant == "token" else word.findall(text)
            if not tokens:
                return np.zeros(64, dtype=bool)
            bits = _pieces(digests.of(tokens)[:, half])
            votes = 2 * sum(np.unpackbits(b, axis=1).sum(axis=0, dtype=np.int64) for b in bits) - len(tokens)
            return votes >= 0 if variant == "token" else votes > 0

        def convert(texts: list[str | None]) -> pa.Array:
            bits = np.stack([one((value or "").lower()) for value in texts])
            return pa.array(np.packbits(bits, axis=1).view(">i8").ravel().astype(np.int64))

        return convert

    return sliced_udf(text, "bigint", start)


def hamming_distance(left: Column, right: Column) -> Column:
    """Number of differing bits of two 64-bit fingerprints."""
    return F.bit_count(left.bitwiseXOR(right))


def minhash_signature(text: Column, num_perm: int = 64) -> Column:
    """MinHash of the set of word bigrams (of the single word if there is only one).

    The base hash is the first 32 bits of md5, so that results repeat. Null and empty
    text give the largest value everywhere.
    """

    def start():
        digests = _Digests()
        steps = ((np.arange(num_perm, dtype=np.uint64) * MINHASH_STEP) & MINHASH_MASK).astype(np.uint32)

        def one(text: str) -> np.ndarray:
            tokens = text.split()
            shingles = list({f"{a} {b}" for a, b in zip(tokens, tokens[1:])} or tokens)
            least = np.full(num_perm, MINHASH_MASK, dtype=np.uint32)
            if shingles:
                base = np.ascontiguousarray(digests.of(shingles)[:, :4]).view(">u4").astype(np.uint32).ravel()
                for part in _pieces(base):
                    least = np.minimum(least, (steps[:, None] ^ part[None, :]).min(axis=1))
            return least.astype(np.int64)

        def convert(texts: list[str | None]) -> pa.Array:
            return _lists(np.stack([one((value or "").lower()) for value in texts]))

        return convert

    return sliced_udf(text, "array<bigint>", start)


def signature_agreement(left: Column, right: Column) -> Column:
    """Number of positions in which two signatures agree."""
    same = F.zip_with(left, right, lambda a, b: (a == b).cast("int"))
    return F.aggregate(same, F.lit(0), lambda total, x: total + x)


def word_bigrams(words: Column) -> Column:
    """The distinct pairs of adjacent words, or the words themselves if there is only one.

    Give the words as a column of their own: they are read several times.
    """
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.array_distinct(F.when(F.size(words) > 1, pairs).otherwise(words))


def hashed_vector(text: Column, dim: int = 384, unit_length: bool = True) -> Column:
    """Hashing-trick vector: md5 gives each token a position and a sign."""
    if dim < 1:
        raise ValueError("dim must be positive")

    def start():
        digests = _Digests()

        def convert(texts: list[str | None]) -> pa.Array:
            tokens = [(value or "").lower().split() for value in texts]
            sizes = np.array([len(t) for t in tokens], dtype=np.int64)
            out = np.zeros((len(tokens), dim), dtype=np.float64)
            if sizes.sum():
                flat = digests.of([t for row in tokens for t in row])
                place = np.ascontiguousarray(flat[:, :4]).view(">u4").ravel() % dim
                cell = np.repeat(np.arange(len(tokens)) * dim, sizes) + place
                sign = np.where(flat[:, 4] >= 128, -1.0, 1.0)
                out = np.bincount(cell, weights=sign, minlength=out.size).reshape(out.shape)
            if unit_length:
                norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
                out = np.divide(out, norm, out=out, where=norm > 0)
            return _lists(out.astype(np.float32))

        return convert

    return sliced_udf(text, "array<float>", start)
