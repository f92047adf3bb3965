"""The registered queries of this package: thin digests of its operators under their contracts."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bit_slices, boosted_toxicity, context_tree, conversation_repair, duckdb_bpe, histogram_sort, lattice_dedup, mixture_packing, notice_search, pivotal_grams, positive_unlabelled, segment_language, simhash_tiles
from .common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return context_tree.score(docs, held_out("doc_id", 5, 1))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = boosted_toxicity.fit(docs.where(~held_out("doc_id", 5, 0)).join(labels, "doc_id"))
    scored = boosted_toxicity.score(docs, model)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op3_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.link_vectors(_table(spark, sf_dir, "embeddings"))


def op4_segment_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = segment_language.fit(docs.where(~held_out("doc_id", 4, 2)), public_tokenizers.path("piece_bpe_32k.model"))
    found = segment_language.identify(docs, model)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op5_bit_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return bit_slices.top_products(vectors, F.col("vec_id") % 100 == 0)


def op6_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    packed = mixture_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = histogram_sort.shard_documents(_table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_tiles.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_duckdb_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return duckdb_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_notice_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notice_search.scan_notices(_table(spark, sf_dir, "documents")).drop("spans")


def _slips(item: str) -> Callable[[str], str]:
    """A slip of the pen in one word of 97: the contract's deletion of a code point."""
    start = zlib.crc32(f"{item}:".encode())

    def slip(word: str) -> str:
        h = zlib.crc32(word.encode(), start)
        return word if h % 97 else word[: h % len(word)] + word[h % len(word) + 1 :]

    return slip


def op11_pivotal_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal_grams.spelling_variants(_table(spark, sf_dir, "documents"), alter=_slips)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with the contract's damage, by the CRC32 of conversation and turn: a row of 20 each is dropped,
    emptied, loses its full stops, is repeated, or becomes the user's."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind, text, role = F.crc32(key.cast("binary")) % 20, F.coalesce("text", space), F.coalesce("role", space)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1)))
    picked = rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), copies.alias("copy"))
    return picked.drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return conversation_repair.audit(damaged(rows), all_rows=rows)


def op13_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    positives = docs.where(~held_out("doc_id", 5, 0)).join(good, "doc_id", "left_semi")
    scored = positive_unlabelled.score(docs, positive_unlabelled.fit(positives, docs))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


QUERIES = {f.__name__: f for f in (
    op1_context_tree, op2_toxicity, op3_lattice_dedup, op4_segment_language, op5_bit_slices,
    op6_mixture_packing, op7_histogram_sort, op8_simhash_tiles, op9_duckdb_bpe, op10_notice_search,
    op11_pivotal_grams, op12_conversation_repair, op13_positive_unlabelled,
)}

_CUBE = "list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT))"

#: CRC32 of a text in DuckDB: the table by shifts, then one step a byte.
_CRC = """
        t AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (
          SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
          FROM range(256) r(i)))"""


def _crc(text: str) -> str:
    bytes_ = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce([4294967295] || {bytes_}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _repair_sql() -> str:
    """The cheapest edits from the last row back to the first, one struct (cost, edits, rows) for each state."""

    def way(cost: str, letter: str, state: int, line: str = "") -> str:
        return f"{{'c': v{state}.c + {cost}, 'a': '{letter}' || v{state}.a, 'r': {f'list_concat([{line}], v{state}.r)' if line else f'v{state}.r'}}}"

    def added(state: int, due: int) -> str:
        name = {2: "user:", 3: "assistant:"}[due]
        return f"{{'c': w{due}.c + 2, 'a': 'I' || w{due}.a, 'r': list_concat(['{name}'], w{due}.r)}}"

    due = {0: 2, 1: 2, 2: 3, 3: 2}
    rows = []
    for state, to in due.items():
        name = {2: "user", 3: "assistant"}[to]
        kept = [way(f"CASE WHEN must OR initial <> '{'sua'[to - 1]}' THEN 1000000 ELSE cut END", "K", to, "role || ':' || text")]
        if state == 0:
            kept.append(way("CASE WHEN must OR initial <> 's' THEN 1000000 ELSE cut END", "K", 1, "role || ':' || text"))
        renamed = way("CASE WHEN must THEN 1000000 ELSE 2 + cut END", "R", to, f"'{name}:' || text")
        rows.append(f"list_min([{', '.join([way('3', 'D', state), *kept, renamed])}]) AS w{state}")
    user = f"list_min([w2, {added(2, 3)}])"
    none = "{'c': CAST(%d AS BIGINT), 'a': '%s', 'r': CAST(%s AS VARCHAR[])}"
    return f"""
        WITH RECURSIVE {_CRC}, base AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 {_crc("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind
          FROM conversations, t
        ), damaged AS (
          SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                 CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                 unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
          FROM base WHERE kind <> 0
        ), placed AS (
          SELECT *, left(role, 1) AS initial, trim(text, e' \\t\\n\\x0b\\x0c\\r') AS body,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                 row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
                 left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS beside
          FROM damaged
        ), judged AS MATERIALIZED (
          SELECT *, body = '' AS blank, body <> '' AND seen AS duplicate, body <> '' AND NOT seen AND right(body, 1) NOT IN ('.', '!', '?') AS truncated,
                 body = '' OR seen AS must, CASE WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS cut
          FROM placed
        ), counts AS (
          SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) AS n,
                 count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
                 count(*) FILTER (beside IS NOT NULL AND beside NOT IN ('su', 'ua', 'au')) AS illegal
          FROM judged GROUP BY conv_id
        ), walk AS (
          SELECT conv_id, n AS i, {none % (0, "", "[]")} AS v0, {none % (4, "II", "['user:', 'assistant:']")} AS v1,
                 {none % (2, "I", "['assistant:']")} AS v2, {none % (0, "", "[]")} AS v3
          FROM counts
          UNION ALL
          SELECT conv_id, i - 1, list_min([w0, {{'c': u.c + 2, 'a': 'I' || u.a, 'r': list_concat(['user:'], u.r)}}]),
                 list_min([w1, {{'c': u.c + 2, 'a': 'I' || u.a, 'r': list_concat(['user:'], u.r)}}]), u, list_min([w3, {added(3, 2)}])
          FROM (SELECT *, {user} AS u FROM (
            SELECT walk.conv_id, walk.i, {", ".join(rows)}
            FROM walk JOIN judged ON walk.conv_id IS NOT DISTINCT FROM judged.conv_id AND walk.i = judged.i))
        ), done AS (SELECT conv_id, v0 FROM walk WHERE i = 0)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(v0.c, 0) AS cost, coalesce(v0.a, '') AS audit, sha256(coalesce(array_to_string(v0.r, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o
        LEFT JOIN counts ON o.conv_id IS NOT DISTINCT FROM counts.conv_id
        LEFT JOIN done ON o.conv_id IS NOT DISTINCT FROM done.conv_id"""


SQL = {
    "op12_conversation_repair": _repair_sql(),
    "op11_pivotal_grams": f"""
        WITH RECURSIVE {_CRC}, runs AS (
          SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc,
                 unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run
          FROM documents
        ), counted AS (SELECT doc, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
        hashed AS (SELECT run, n, {_crc("(doc || ':' || run)")} AS h FROM counted, t),
        words AS MATERIALIZED (
          SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
            SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
          WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
        ), cut AS MATERIALIZED (
          SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
        ), near AS (
          SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
          UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word
        ), best AS (
          SELECT word, count(*) AS n_near, max(n) AS best_n, arg_min(near, (-n, near)) AS best FROM near GROUP BY word
        ), formed AS MATERIALIZED (
          SELECT word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * words.n THEN best END AS form, CASE WHEN best_n >= 2 * words.n THEN best_n END AS form_n
          FROM words LEFT JOIN best USING (word)
        ), chain AS (
          SELECT word, word AS root, form AS next FROM formed
          UNION ALL SELECT chain.word, formed.word, formed.form FROM chain JOIN formed ON chain.next = formed.word
        )
        SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, root FROM chain WHERE next IS NULL) USING (word)""",
    "op5_bit_slices": f"""
        WITH v AS (
          SELECT vec_id, {_CUBE} AS x FROM embeddings
          WHERE embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        ), r AS (
          SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p
        )
        SELECT * FROM r WHERE rank <= 10""",
}
