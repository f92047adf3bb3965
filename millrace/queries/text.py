"""Text filters and text transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import operators as ops
from ..functions.text import DIGIT_BODY, ENGLISH_WORDS, ENTITY, SENTENCE_END, SPACE_BODY, TAG, TAG_OR_EMPTY
from ..scratch import written
from .catalog import query, sql_squash, sql_strip, sql_words, table

ENGLISH = f"list_has_any({sql_words('lower(text)')}, {list(ENGLISH_WORDS)})"


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "html")


# Filters


@query("f3_length_filter", "SELECT doc_id, text FROM documents WHERE length(text) BETWEEN 500 AND 3000")
def f3(spark, sf_dir):
    return ops.length_filter(_documents(spark, sf_dir), "text", 500, 3000)


@query("f3_length_filter_words", f"SELECT doc_id, text FROM documents WHERE len({sql_words('text')}) BETWEEN 50 AND 500")
def f3_words(spark, sf_dir):
    return ops.length_filter(_documents(spark, sf_dir), "text", 50, 500, unit="words")


@query(
    "f4_remove_empty",
    f"SELECT doc_id, lang, note FROM (SELECT doc_id, lang, CASE WHEN lang = 'de' THEN chr(160) WHEN lang <> 'fr' THEN text END "
    f"AS note FROM documents) WHERE {sql_strip('note')} <> '' AND {sql_strip('lang')} <> ''",
)
def f4(spark, sf_dir):
    note = F.when(F.col("lang") == "de", " ").when(F.col("lang") != "fr", F.col("text"))
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", note.alias("note"))
    return ops.remove_empty(documents, "note, lang")


@query("f5_search_text", f"SELECT doc_id, text FROM documents WHERE regexp_matches(text, '[{DIGIT_BODY}]{{3}}')")
def f5(spark, sf_dir):
    return ops.search_text(_documents(spark, sf_dir), "text", r"\d{3}")


@query("f5_search_substring", "SELECT doc_id, text FROM documents WHERE contains(text, 'tion.')")
def f5_plain(spark, sf_dir):
    return ops.search_text(_documents(spark, sf_dir), "text", "tion.", regex=False)


@query(
    "f6_regex_partition",
    "SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)the.*and') THEN 'filtered' ELSE 'rejected' END AS port FROM documents",
)
def f6(spark, sf_dir):
    filtered, rejected = ops.regex_partition(_documents(spark, sf_dir), "text", "THE.*AND", case_insensitive=True)
    sides = filtered.withColumn("port", F.lit("filtered")).unionByName(rejected.withColumn("port", F.lit("rejected")))
    return sides.select("doc_id", "port")


@query("f8_language_filter", f"SELECT doc_id, text FROM documents WHERE {ENGLISH}")
def f8(spark, sf_dir):
    return ops.language_filter(_documents(spark, sf_dir), "text", "en")


# Transforms


@query("t1_lowercase", "SELECT doc_id, lower(text) AS text FROM documents")
def t1(spark, sf_dir):
    return ops.lowercase(_documents(spark, sf_dir), "text")


@query("t2_uppercase", "SELECT doc_id, replace(replace(upper(text), 'ẞ', 'SS'), 'ß', 'SS') AS text FROM documents")
def t2(spark, sf_dir):
    return ops.uppercase(_documents(spark, sf_dir), "text")


@query("t3_strip_whitespace", f"SELECT doc_id, {sql_squash('text')} AS text FROM documents")
def t3(spark, sf_dir):
    return ops.strip_whitespace(_documents(spark, sf_dir), "text", collapse=True)


@query(
    "t4_strip_html",
    f"SELECT page_id, regexp_replace(regexp_replace(html, '{TAG}', '', 'g'), '{ENTITY}', '', 'g') AS html FROM pages",
)
def t4(spark, sf_dir):
    return ops.strip_html(_pages(spark, sf_dir), "html")


@query("t5_strip_tags", f"SELECT page_id, regexp_replace(html, '{TAG_OR_EMPTY}', '', 'g') AS html FROM pages")
def t5(spark, sf_dir):
    return ops.strip_tags(_pages(spark, sf_dir), "html")


@query("t6_unicode_nfc", "SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def t6(spark, sf_dir):
    # The texts are NFC already: taking them apart first gives the operator work to do.
    apart = ops.unicode_normalize(_documents(spark, sf_dir), "text", "NFD")
    return ops.unicode_normalize(apart, "text", "NFC")


@query("t6_unicode_nfkd")
def t6_nfkd(spark, sf_dir):
    return ops.unicode_normalize(_documents(spark, sf_dir), "text", "NFKD")


@query(
    "t7_regex_replace",
    f"SELECT doc_id, regexp_replace(text, '([{DIGIT_BODY}]+)[{SPACE_BODY}]*', '<\\1>', 'g') AS text FROM documents",
)
def t7(spark, sf_dir):
    return ops.regex_replace(_documents(spark, sf_dir), "text", r"(\d+)\s*", r"<\1>")


@query("t8_normalize", f"SELECT doc_id, {sql_squash('lower(text)')} AS text FROM documents")
def t8(spark, sf_dir):
    return ops.normalize(_documents(spark, sf_dir), "text")


@query(
    "t9_tokenize",
    f"SELECT doc_id, len({sql_words('text')}) AS n, array_to_string({sql_words('text')}, '|') AS tokens FROM documents",
)
def t9(spark, sf_dir):
    tokens = ops.tokenize(_documents(spark, sf_dir), "text")
    return tokens.select("doc_id", F.size("text_tokens").cast("bigint").alias("n"), F.array_join("text_tokens", "|").alias("tokens"))


@query(
    "t10_sentences",
    f"""
    SELECT doc_id, len(parts) AS n, array_to_string(parts, '|') AS sentences FROM (
        SELECT doc_id, list_filter(list_transform(string_split_regex(text, '{SENTENCE_END}'), lambda s: {sql_strip('s')}),
            lambda x: x <> '') AS parts FROM documents)
    """,
)
def t10(spark, sf_dir):
    tokens = ops.tokenize(_documents(spark, sf_dir), "text", mode="sentence")
    return tokens.select("doc_id", F.size("text_tokens").cast("bigint").alias("n"), F.array_join("text_tokens", "|").alias("sentences"))


def chunk_sql(source: str, size: int, overlap: int, keep_text: bool = False) -> str:
    """Windows of words over a relation with doc_id and text."""
    step = size - overlap
    return f"""
    SELECT doc_id, chunk_index, array_to_string(w[chunk_index * {step} + 1 : chunk_index * {step} + {size}], ' ') AS chunk_text,
        doc_id AS source_row_id{", text" if keep_text else ""}
    FROM (
        SELECT doc_id, text, w, unnest(range(0, least((len(w) - 1) // {step}, CASE WHEN len(w) < {size} THEN 0
            ELSE (len(w) - {size}) // {step} + 1 END) + 1)) AS chunk_index
        FROM (SELECT doc_id, text, {sql_words('text')} AS w FROM ({source})) WHERE len(w) > 0)
    """


@query("t11_chunk_text", chunk_sql("SELECT doc_id, text FROM documents", 100, 20))
def t11(spark, sf_dir):
    return ops.chunk_text(_documents(spark, sf_dir), "text", 100, 20, "doc_id", keep_text=False)


@query("t12_detect_lang", f"SELECT doc_id, CASE WHEN {ENGLISH} THEN 'en' ELSE 'other' END AS lang FROM documents")
def t12(spark, sf_dir):
    return ops.detect_lang(_documents(spark, sf_dir), "text").select("doc_id", "lang")


def _lexicon(spark, sf_dir):
    """Words of labelled documents; weight = good minus bad documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    tokens = F.array_distinct(F.split(F.lower("text"), " "))
    words = _documents(spark, sf_dir).join(labels, "doc_id").select("quality", F.explode(tokens).alias("word"))
    return words.groupBy("word").agg(F.sum(2 * F.col("quality") - 1).alias("weight"))


@query(
    "t13_sentiment",
    f"""
    WITH lexicon AS (
        SELECT word, sum(2 * quality - 1) AS weight FROM (
            SELECT l.quality, unnest(list_distinct(string_split(lower(d.text), ' '))) AS word
            FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
        GROUP BY word),
    scores AS (
        SELECT t.doc_id, CAST(sum(weight) AS DOUBLE) AS x
        FROM (SELECT doc_id, unnest({sql_words('lower(text)')}) AS word FROM documents) t JOIN lexicon USING (word)
        GROUP BY t.doc_id)
    SELECT d.doc_id, round(coalesce(x, 0) / sqrt(coalesce(x, 0) * coalesce(x, 0) + 15), 6) AS sentiment
    FROM documents d LEFT JOIN scores s ON d.doc_id = s.doc_id
    """,
)
def t13(spark, sf_dir):
    lexicon = written(_lexicon(spark, sf_dir), "lexicon")
    scored = ops.sentiment(_documents(spark, sf_dir), "text", lexicon, "doc_id")
    return scored.select("doc_id", F.round("sentiment", 6).alias("sentiment"))


HASHED_COUNTS = f"""
    SELECT doc_id, place, CAST(sum(sign) AS BIGINT) AS value FROM (
        SELECT doc_id, CAST('0x' || substr(m, 1, 8) AS BIGINT) % 384 AS place, CASE WHEN substr(m, 9, 1) >= '8' THEN -1 ELSE 1 END AS sign
        FROM (SELECT doc_id, md5(unnest({sql_words('lower(text)')})) AS m FROM documents))
    GROUP BY doc_id, place HAVING sum(sign) <> 0
    """


@query("t14_embed", HASHED_COUNTS)
def t14(spark, sf_dir):
    vectors = ops.embed_text(_documents(spark, sf_dir), "text", 384, unit_length=False)
    # The outer form: the plain one infers a filter that would compute every vector twice.
    entries = vectors.select("doc_id", F.posexplode_outer("embedding").alias("place", "value"))
    return entries.where("value <> 0").select("doc_id", F.col("place").cast("bigint").alias("place"), F.col("value").cast("bigint").alias("value"))


@query("t14_embed_unit", HASHED_COUNTS)
def t14_unit(spark, sf_dir):
    """The unit vectors, stretched by the length of the counts again: every component is a whole number then."""
    counted = ops.embed_text(_documents(spark, sf_dir), "text", 384, "counts", unit_length=False)
    both = ops.embed_text(counted, "text", 384, "unit")
    length = F.sqrt(F.aggregate("counts", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    # A column of its own: beside the explode the sum would run once per component.
    measured = both.select("doc_id", "unit", length.alias("length"))
    entries = measured.select("doc_id", "length", F.posexplode_outer("unit").alias("place", "part"))
    value = F.round(F.col("part").cast("double") * F.col("length")).cast("bigint")
    return entries.select("doc_id", F.col("place").cast("bigint").alias("place"), value.alias("value")).where("value <> 0")


@query("t15_hash_key", "SELECT doc_id, sha256(text) AS hash_key FROM documents")
def t15(spark, sf_dir):
    return ops.hash_key(_documents(spark, sf_dir), "text").select("doc_id", "hash_key")
