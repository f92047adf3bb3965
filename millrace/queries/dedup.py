"""Duplicates: exact, by digest, by SimHash and by MinHash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import operators as ops
from ..functions import hamming_distance
from ..functions.fingerprint import MINHASH_MASK, MINHASH_STEP
from ..functions.text import WORD_BODY
from .catalog import query, sql_words, table


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def simhash_cte(source: str, variant: str = "token", name: str = "sim") -> str:
    """CTEs ending in ``name(doc_id, fp)``: SimHash of a relation with doc_id and text."""
    if variant == "token":
        tokens, first, reached = sql_words("lower(text)"), 1, ">="
    else:
        tokens, first, reached = f"regexp_extract_all(lower(text), '[{WORD_BODY}]+')", 17, ">"
    high = " + ".join(f"CASE WHEN sum(n * (2 * ((hi >> {i}) & 1) - 1)) {reached} 0 THEN {1 << i} ELSE 0 END" for i in range(32))
    low = " + ".join(f"CASE WHEN sum(n * (2 * ((lo >> {i}) & 1) - 1)) {reached} 0 THEN {1 << i} ELSE 0 END" for i in range(32))
    return f"""
    {name}_tokens AS (SELECT doc_id, unnest({tokens}) AS token FROM ({source})),
    {name}_counts AS (SELECT doc_id, md5(token) AS m, count(*) AS n FROM {name}_tokens GROUP BY doc_id, token),
    {name}_halves AS (
        SELECT doc_id, n, CAST('0x' || substr(m, {first}, 8) AS BIGINT) AS hi, CAST('0x' || substr(m, {first + 8}, 8) AS BIGINT) AS lo
        FROM {name}_counts),
    {name}_votes AS (
        SELECT doc_id, CAST({high} AS UBIGINT) AS hi, CAST({low} AS UBIGINT) AS lo FROM {name}_halves GROUP BY doc_id),
    {name} AS (
        SELECT d.doc_id, coalesce(v.hi, 0) * 4294967296 + coalesce(v.lo, 0) AS fp
        FROM ({source}) d LEFT JOIN {name}_votes v ON d.doc_id = v.doc_id)
    """


def greedy_cte(pairs: str, docs: str) -> str:
    """CTE ``kept(doc_id)``: documents without an earlier kept neighbour in pairs(a, b), a < b."""
    return f"""
    seq AS (
        SELECT d.doc_id, row_number() OVER (ORDER BY d.doc_id) AS rn,
            (SELECT list(p.a) FROM ({pairs}) p WHERE p.b = d.doc_id) AS earlier
        FROM ({docs}) d),
    walk AS (
        SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS ids
        UNION ALL
        SELECT s.rn, CASE WHEN list_has_any(w.ids, coalesce(s.earlier, CAST([] AS BIGINT[]))) THEN w.ids
            ELSE list_append(w.ids, s.doc_id) END
        FROM walk w JOIN seq s ON s.rn = w.rn + 1),
    kept AS (SELECT unnest(ids) AS doc_id FROM walk WHERE rn = (SELECT max(rn) FROM walk))
    """


SHINGLES = f"""
    toks AS (SELECT doc_id, {sql_words('lower(text)')} AS w FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, shingle FROM (
            SELECT doc_id, unnest(CASE WHEN len(w) > 1
                THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS shingle
            FROM toks))
"""
# The least of h ^ c over a set of h, for each of the 64 constants c.
MINHASH = f"""
    {SHINGLES},
    bases AS (SELECT doc_id, CAST('0x' || substr(md5(shingle), 1, 8) AS BIGINT) AS h FROM shingles),
    mins AS (
        SELECT b.doc_id, i, min(xor(h, (i * {MINHASH_STEP}) & {MINHASH_MASK})) AS v
        FROM bases b, range(64) AS r(i) GROUP BY b.doc_id, i),
    sigs AS (
        SELECT d.doc_id, coalesce(s.sig, list_transform(range(64), lambda i: CAST({MINHASH_MASK} AS BIGINT))) AS sig
        FROM documents d LEFT JOIN (SELECT doc_id, list(v ORDER BY i) AS sig FROM mins GROUP BY doc_id) s ON d.doc_id = s.doc_id),
    sig_groups AS (SELECT min(doc_id) AS doc_id, sig, count(*) AS copies FROM sigs GROUP BY sig),
    places AS (SELECT doc_id, unnest(range(64)) AS i, unnest(sig) AS v FROM sig_groups),
    agree AS (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM places x JOIN places y ON x.i = y.i AND x.v = y.v AND x.doc_id < y.doc_id
        GROUP BY x.doc_id, y.doc_id HAVING count(*) >= 55)
"""
SIM = simhash_cte("SELECT doc_id, text FROM documents")
FP_GROUPS = "fps AS (SELECT min(doc_id) AS doc_id, fp, count(*) AS copies FROM sim GROUP BY fp)"
NEAR = "SELECT x.doc_id AS a, y.doc_id AS b FROM fps x JOIN fps y ON x.doc_id < y.doc_id WHERE bit_count(xor(x.fp, y.fp)) <= 3"


@query("d1_exact_all", "SELECT DISTINCT text, lang, source, n_chars FROM documents")
def d1(spark, sf_dir):
    return ops.dedup_exact(table(spark, sf_dir, "documents").drop("doc_id"))


@query(
    "d2_exact_keys",
    "SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders QUALIFY row_number() OVER "
    "(PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice, o_orderkey) = 1",
)
def d2(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    return ops.dedup_exact(orders, ["o_custkey", "o_orderpriority"], ["o_totalprice", "o_orderkey"])


@query(
    "d3_hash",
    "SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1",
)
def d3(spark, sf_dir):
    return ops.dedup_hash(_documents(spark, sf_dir), "text", "doc_id")


@query("d4_simhash", f"WITH {SIM} SELECT doc_id, printf('%016x', fp) AS simhash FROM sim")
def d4(spark, sf_dir):
    hashed = ops.simhash(_documents(spark, sf_dir), "text")
    return hashed.select("doc_id", _hex(F.col("simhash")).alias("simhash"))


SIM_WORD = simhash_cte("SELECT doc_id, text FROM documents", "word", "simw")


@query("d4b_simhash_word", f"WITH {SIM_WORD} SELECT doc_id, printf('%016x', fp) AS simhash FROM simw")
def d4b(spark, sf_dir):
    hashed = ops.simhash(_documents(spark, sf_dir), "text", variant="word")
    return hashed.select("doc_id", _hex(F.col("simhash")).alias("simhash"))


@query(
    "d5_hamming",
    f"WITH {SIM}, {SIM_WORD} SELECT sim.doc_id, CAST(bit_count(xor(sim.fp, simw.fp)) AS INTEGER) AS distance "
    "FROM sim JOIN simw ON sim.doc_id = simw.doc_id",
)
def d5(spark, sf_dir):
    hashed = ops.simhash(_documents(spark, sf_dir), "text")
    both = ops.simhash(hashed, "text", variant="word", output_column="other")
    return both.select("doc_id", hamming_distance(F.col("simhash"), F.col("other")).alias("distance"))


@query(
    "d6_pairs",
    f"""
    WITH RECURSIVE {SIM}, {FP_GROUPS}, near AS MATERIALIZED ({NEAR}), {greedy_cte('SELECT a, b FROM near', 'SELECT doc_id FROM fps')},
    removed AS (
        SELECT min(a) AS a, b FROM near WHERE a IN (SELECT doc_id FROM kept) AND b NOT IN (SELECT doc_id FROM kept) GROUP BY b)
    SELECT x.doc_id AS doc_id_a, y.doc_id AS doc_id_b, x.copies AS copies_a, y.copies AS copies_b,
        CAST(bit_count(xor(x.fp, y.fp)) AS INTEGER) AS distance
    FROM removed JOIN fps x ON x.doc_id = removed.a JOIN fps y ON y.doc_id = removed.b
    """,
)
def d6(spark, sf_dir):
    return ops.near_dup_pairs(_documents(spark, sf_dir), "text", 3, "doc_id")


@query(
    "d7_simhash_dedup",
    f"""
    WITH RECURSIVE {SIM}, {FP_GROUPS}, near AS MATERIALIZED ({NEAR}), {greedy_cte('SELECT a, b FROM near', 'SELECT doc_id FROM fps')}
    SELECT d.doc_id, d.text FROM documents d JOIN kept ON d.doc_id = kept.doc_id
    """,
)
def d7(spark, sf_dir):
    return ops.simhash_deduplicate(_documents(spark, sf_dir), "text", 3, "doc_id")


@query("d8_minhash", f"WITH {MINHASH} SELECT doc_id, array_to_string(sig, ',') AS signature FROM sigs")
def d8(spark, sf_dir):
    signed = ops.minhash(_documents(spark, sf_dir), "text")
    return signed.select("doc_id", F.array_join(F.col("minhash").cast("array<string>"), ",").alias("signature"))


@query(
    "d9_minhash_pairs",
    f"""
    WITH RECURSIVE {MINHASH}, near AS MATERIALIZED (SELECT a, b, n FROM agree),
    {greedy_cte('SELECT a, b FROM near', 'SELECT doc_id FROM sig_groups')},
    removed AS (
        SELECT min(a) AS a, arg_min(n, a) AS n, b FROM near
        WHERE a IN (SELECT doc_id FROM kept) AND b NOT IN (SELECT doc_id FROM kept) GROUP BY b)
    SELECT a AS doc_id_a, b AS doc_id_b, x.copies AS copies_a, y.copies AS copies_b, n / CAST(64 AS DOUBLE) AS similarity
    FROM removed JOIN sig_groups x ON x.doc_id = a JOIN sig_groups y ON y.doc_id = b
    """,
)
def d9(spark, sf_dir):
    return ops.minhash_pairs(_documents(spark, sf_dir), "text", 0.85, "doc_id")


@query(
    "d10_minhash_dedup",
    f"""
    WITH RECURSIVE {MINHASH}, near AS MATERIALIZED (SELECT a, b FROM agree),
    {greedy_cte('SELECT a, b FROM near', 'SELECT doc_id FROM sig_groups')}
    SELECT d.doc_id, d.text FROM documents d JOIN kept ON d.doc_id = kept.doc_id
    """,
)
def d10(spark, sf_dir):
    return ops.minhash_deduplicate(_documents(spark, sf_dir), "text", 0.85, "doc_id")


@query(
    "d11_fuzzy",
    f"""
    WITH RECURSIVE {MINHASH},
    alike AS (
        SELECT x.doc_id AS a, y.doc_id AS b FROM sigs x JOIN sigs y ON x.sig = y.sig AND x.doc_id < y.doc_id
        UNION
        SELECT x.doc_id, y.doc_id FROM agree
            JOIN sig_groups gx ON gx.doc_id = agree.a JOIN sig_groups gy ON gy.doc_id = agree.b
            JOIN sigs sx ON sx.sig = gx.sig JOIN sigs sy ON sy.sig = gy.sig
            JOIN documents x ON x.doc_id = least(sx.doc_id, sy.doc_id) JOIN documents y ON y.doc_id = greatest(sx.doc_id, sy.doc_id)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (
        SELECT a, b, count(*) AS n FROM alike JOIN shingles x ON x.doc_id = a JOIN shingles y ON y.doc_id = b AND y.shingle = x.shingle
        GROUP BY a, b),
    near AS MATERIALIZED (
        SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b
        WHERE c.n / CAST(x.n + y.n - c.n AS DOUBLE) >= CAST(0.85 AS DOUBLE)),
    {greedy_cte('SELECT a, b FROM near', 'SELECT doc_id FROM documents')}
    SELECT d.doc_id, d.text FROM documents d JOIN kept ON d.doc_id = kept.doc_id
    """,
)
def d11(spark, sf_dir):
    return ops.dedup_fuzzy(_documents(spark, sf_dir), "text", 0.85, "doc_id")


@query(
    "d12_report",
    "SELECT count(*) AS rows_before, count(DISTINCT text) AS rows_after, count(*) - count(DISTINCT text) AS removed, "
    "round((count(*) - count(DISTINCT text)) * CAST(100.0 AS DOUBLE) / count(*), 2) AS removed_percent FROM documents",
)
def d12(spark, sf_dir):
    documents = _documents(spark, sf_dir)
    return ops.dedup_report(documents, ops.dedup_hash(documents, "text", "doc_id"))
