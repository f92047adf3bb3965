"""Byte-level BPE by recursive DuckDB queries inside each partition."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Remembered, arrow_map, blocks, extended, text_strings

#: Words in one query, words kept by a task, once and again, and characters of text looked at together.
QUERY_WORDS, CACHE_WORDS, STEP_CHARS = 50_000, 250_000, 8_000_000

#: Bytes from which on a word contracts several pairs a round.
LONG_BYTES = 256

# A row of `start` and `steps` is a token: k = word * 2**32 + position. Rows stay in the order of k, which windows without
# an order rely on; a row out of order fails the query. A round contracts each word's leftmost pair of minimum rank.
CONTRACT = """
WITH RECURSIVE steps(k, t, done) AS (
  SELECT k, t, false FROM start
  UNION ALL (
    WITH beside AS (
      SELECT k, t, lead(k) OVER () AS next_k, lead(t) OVER () AS next_t, lag(k) OVER () AS last_k FROM steps WHERE NOT done
    ), pairs AS (
      SELECT k, t, last_k, CASE WHEN next_k >> 32 = k >> 32 THEN next_t END AS next_t,
             CASE WHEN next_k <= k THEN error('rows are out of order') END AS wrong
      FROM beside
    ), least AS (
      SELECT k >> 32 AS word, min((merged << 32) + (k & 4294967295)) AS best
      FROM pairs JOIN merges ON a = t AND b = next_t GROUP BY 1
    )
    SELECT k, CASE WHEN k & 4294967295 = best & 4294967295 THEN best >> 32 ELSE t END, best IS NULL
    FROM pairs LEFT JOIN least ON word = k >> 32
    WHERE wrong IS NULL AND (best IS NULL OR last_k IS NULL OR last_k <> (word << 32) + (best & 4294967295))
  )
)
SELECT k >> 32 AS word, string_agg(t, ',' ORDER BY k) AS ids FROM steps WHERE done GROUP BY 1
"""

# The same for long words, of which a round also contracts the other pairs of that rank that do not overlap it: the first,
# third, fifth ... of neighbours. That is the same as one at a time unless a pair with the new token may rank before it;
# such tokens are marked when the table is loaded, and give their leftmost pair only.
CONTRACT_LONG = """
WITH RECURSIVE steps(k, t, done) AS (
  SELECT k, t, false FROM start
  UNION ALL (
    WITH beside AS (
      SELECT k, t, lead(k) OVER () AS next_k, lead(t) OVER () AS next_t, row_number() OVER () AS i FROM steps WHERE NOT done
    ), pairs AS (
      SELECT k, t, i, CASE WHEN next_k >> 32 = k >> 32 THEN next_t END AS next_t,
             CASE WHEN next_k <= k THEN error('rows are out of order') END AS wrong
      FROM beside
    ), ranked AS (
      SELECT k, t, i, wrong, merged FROM pairs LEFT JOIN merges ON a = t AND b = next_t
    ), least AS (
      SELECT k >> 32 AS word, min(merged) AS best, arg_min(k, (merged, k)) AS first FROM ranked WHERE merged IS NOT NULL GROUP BY 1
    ), marked AS (
      SELECT k, t, i, wrong, best, coalesce(merged = best AND (k = first OR best NOT IN (FROM risky)), false) AS hit
      FROM ranked LEFT JOIN least ON word = k >> 32
    ), runs AS (
      SELECT *, i - coalesce(max(CASE WHEN NOT hit THEN i END) OVER (ROWS UNBOUNDED PRECEDING), 0) AS place FROM marked
    ), taken AS (
      SELECT *, place % 2 = 1 AS take, coalesce(lag(place % 2) OVER () = 1, false) AS gone FROM runs
    )
    SELECT k, CASE WHEN take THEN best ELSE t END, best IS NULL FROM taken WHERE wrong IS NULL AND NOT gone
  )
)
SELECT k >> 32 AS word, string_agg(t, ',' ORDER BY k) AS ids FROM steps WHERE done GROUP BY 1
"""

DECODE = """
SELECT word, unhex(string_agg(piece, '' ORDER BY place)) AS bytes
FROM (
  SELECT word, unnest(ids) AS id, generate_subscripts(ids, 1) AS place
  FROM (SELECT word, CAST(string_split(ids, ',') AS BIGINT[]) AS ids FROM given)
) JOIN vocabulary USING (id)
GROUP BY 1
"""


class Codec:
    """Encodes and decodes words with a DuckDB connection of its own, in memory and on one thread."""

    def __init__(self, path: str):
        import duckdb

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.con = duckdb.connect(config={"threads": 1, "temp_directory": "", "memory_limit": "500MB"})
        # Joins keep their sides, and with them the order of the left one.
        self.con.execute("SET disabled_optimizers = 'join_order,build_side_probe_side'")
        get = self.ranks.get
        halves = [(get(p[:i]), get(p[i:]), r) for p, r in self.ranks.items() for i in range(1, len(p))]
        a, b, merged = zip(*(h for h in halves if h[0] is not None and h[1] is not None), strict=True)
        # Tokens that are half of a token of lower rank.
        risky = {half for x, y, r in zip(a, b, merged, strict=True) for half in (x, y) if r < half}
        self._table("risky", t=pa.array(sorted(risky), pa.int64()))
        self._table("merges", a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()), merged=pa.array(merged, pa.int64()))
        self._table("vocabulary", id=pa.array(self.ranks.values(), pa.int64()), piece=pa.array([p.hex() for p in self.ranks]))

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.con.register("incoming", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def encode(self, words: list[bytes]) -> list[str]:
        """The ids of each word as decimal text joined by commas: its own id if the vocabulary holds it whole, else
        those that contraction ends with. An empty word has none."""
        whole = list(map(self.ranks.get, words))
        out = ["" if w is None else str(w) for w in whole]
        cut = [n for n, w in enumerate(whole) if w is None and words[n]]
        for query, part in ((CONTRACT, [n for n in cut if len(words[n]) < LONG_BYTES]), (CONTRACT_LONG, [n for n in cut if len(words[n]) >= LONG_BYTES])):
            if not part:
                continue
            lengths = np.array([len(words[n]) for n in part], np.int64)
            tokens = self.bytes[np.frombuffer(b"".join([words[n] for n in part]), np.uint8)]
            starts = np.cumsum(lengths) - lengths
            places = np.arange(len(tokens)) - np.repeat(starts, lengths)
            self._table("start", k=pa.array((np.repeat(np.arange(len(part)), lengths) << 32) + places), t=pa.array(tokens))
            found = self.con.sql(query).to_arrow_table()
            for n, ids in zip(found["word"].to_pylist(), found["ids"].to_pylist(), strict=True):
                out[part[n]] = ids
        return out

    def decode(self, sequences: list[str]) -> list[bytes]:
        """The bytes of each sequence of ids, given as decimal text joined by commas, put together in order."""
        some = [n for n, ids in enumerate(sequences) if ids]
        self._table("given", word=pa.array(some, pa.int64()), ids=pa.array([sequences[n] for n in some], pa.string()))
        found = self.con.sql(DECODE).to_arrow_table()
        out = [b""] * len(sequences)
        for n, data in zip(found["word"].to_pylist(), found["bytes"].to_pylist(), strict=True):
            out[n] = data
        return out


#: Texts of these characters are cut by the plain form of the pattern below, which `re` runs faster.
_SIMPLE = re.compile("[\n -~À-ÖØ-öø-ÿ]*")
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"


def _simple_pattern(pattern: str) -> str:
    """``pattern`` with its classes spelled out for simple texts."""
    return pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_LETTER}0-9]").replace(r"\p{L}", f"[{_LETTER}]").replace(r"\p{N}", "[0-9]")


class TextCodec:
    """Encodes whole texts word by word, a word being a match of the pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.codec, self.cut = Codec(path), regex.compile(pattern).findall
        plain = _simple_pattern(pattern)
        self.cut_simple = self.cut if "\\p" in plain else re.compile(plain).findall
        #: For each word: its ids as text, and the bytes they decode to.
        self.ids, self.data = Remembered(CACHE_WORDS), Remembered(CACHE_WORDS)

    def _words(self, text: str) -> list[str]:
        return self.cut_simple(text) if _SIMPLE.fullmatch(text) else self.cut(text)

    def texts(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """The ids of each text as decimal text joined by commas, and the bytes they decode to."""
        split = [self._words(t) for t in texts]
        met = set().union(*split)
        new = list(self.ids.missing(met))
        self.data.missing(met)
        for at in range(0, len(new), QUERY_WORDS):
            part = new[at : at + QUERY_WORDS]
            found = self.codec.encode([w.encode() for w in part])
            self.ids.now.update(zip(part, found, strict=True))
            self.data.now.update(zip(part, self.codec.decode(found), strict=True))
        ids, data = self.ids.now.__getitem__, self.data.now.__getitem__
        for words in split:
            yield ",".join(map(ids, words)), b"".join(map(data, words))


def _text_map(docs: DataFrame, item: str, text: str, path: str, pattern: str, columns: list[tuple[str, str, pa.DataType]], make) -> DataFrame:
    schema = extended(docs.select(item).schema, ", ".join(f"{name} {kind}" for name, kind, _ in columns))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TextCodec(path, pattern)
        for whole in batches:
            strings = text_strings(whole.column(text))
            for start, end in blocks(strings, STEP_CHARS):
                batch = whole.slice(start, end - start)
                rows = [make(*found) for found in codec.texts(strings[start:end])]
                arrays = [pa.array(values, kind) for values, (_, _, kind) in zip(zip(*rows, strict=True), columns, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(item), *arrays], names=[item, *(c[0] for c in columns)])

    return arrow_map(docs.select(*dict.fromkeys([item, text])), run, schema)


def encode(docs: DataFrame, vocabulary: str, pattern: str, item: str = "doc_id", text: str = "text") -> DataFrame:
    """(item, ids array<int>) of each whole text; null and empty texts have no ids. Repeated rows give a row each."""

    def ids(listed: str, _: bytes) -> tuple[list[int]]:
        return (list(map(int, listed.split(","))) if listed else [],)

    return _text_map(docs, item, text, vocabulary, pattern, [("ids", "array<int>", pa.list_(pa.int32()))], ids)


def decode(encoded: DataFrame, vocabulary: str, item: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(item, decoded binary) of each list of ids; null decodes to no bytes, and ids that are unknown are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                data = codec.decode([",".join(str(i) for i in x or [] if i is not None) for x in batch.column(ids).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(item), pa.array(data, pa.binary())], names=[item, "decoded"])

    return arrow_map(encoded.select(*dict.fromkeys([item, ids])), run, extended(encoded.select(item).schema, "decoded binary"))


def digests(docs: DataFrame, vocabulary: str, pattern: str, item: str = "doc_id", text: str = "text") -> DataFrame:
    """(item, n_tokens, ids_sha256, decoded_sha256) of each whole text, encoded and then decoded.

    The ids are hashed as decimal text joined by commas, the decoded bytes as they are, both as lower-case hex digits.
    A null text is an empty one: no ids, and the hash of no bytes twice. Repeated rows give a row each; other columns
    are ignored; an empty table gives no rows.
    """

    def hashes(listed: str, data: bytes) -> tuple[int, str, str]:
        count = listed.count(",") + 1 if listed else 0
        return count, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(data).hexdigest()

    columns = [("n_tokens", "bigint", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return _text_map(docs, item, text, vocabulary, pattern, columns, hashes)
