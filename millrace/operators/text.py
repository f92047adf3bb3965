"""Text transforms: built-in expressions that replace a column or add one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checks import col, require_column, require_columns
from ..functions import fingerprint
from ..functions import text as rules
from ..functions.regex import python_regex_replace
from ..functions.unicode import normalize_form


def _replace(df: DataFrame, column: str, change: Callable[[Column], Column]) -> DataFrame:
    require_column(df, column)
    return df.withColumn(column, change(col(column).cast("string")))


def lowercase(df: DataFrame, column: str) -> DataFrame:
    return _replace(df, column, F.lower)


def uppercase(df: DataFrame, column: str) -> DataFrame:
    return _replace(df, column, F.upper)


def strip_whitespace(df: DataFrame, column: str, collapse: bool = False) -> DataFrame:
    return _replace(df, column, rules.squash if collapse else rules.strip)


def strip_html(df: DataFrame, column: str) -> DataFrame:
    """Removes tags and named entities."""
    return _replace(df, column, rules.strip_html)


def strip_tags(df: DataFrame, column: str) -> DataFrame:
    """Removes tags only."""
    return _replace(df, column, rules.strip_tags)


def unicode_normalize(df: DataFrame, column: str, form: str = "NFC") -> DataFrame:
    return _replace(df, column, lambda text: normalize_form(text, form))


def regex_replace(
    df: DataFrame, column: str, pattern: str = r"\s+", replacement: str = " ", engine: str = "auto"
) -> DataFrame:
    """Python's ``re.sub``; runs in the JVM when the pattern has a faithful Java form."""
    return _replace(df, column, lambda text: python_regex_replace(text, pattern, replacement, engine))


def normalize(df: DataFrame, column: str, lower: bool = True, trim: bool = True) -> DataFrame:
    """Case and white space together."""

    def change(text: Column) -> Column:
        text = F.lower(text) if lower else text
        return rules.squash(text) if trim else text

    return _replace(df, column, change)


def tokenize(df: DataFrame, column: str, mode: str = "word") -> DataFrame:
    """Adds ``<column>_tokens``: words, or sentences."""
    require_column(df, column)
    if mode not in ("word", "sentence"):
        raise ValueError(f"Unknown token mode '{mode}'")
    split = rules.sentences if mode == "sentence" else rules.words
    return df.withColumn(f"{column}_tokens", split(col(column).cast("string")))


def chunk_text(
    df: DataFrame,
    column: str,
    chunk_size: int = 500,
    chunk_overlap: int = 50,
    id_column: str | None = "id",
    keep_text: bool = True,
) -> DataFrame:
    """Sliding windows of words, one row per window; blank text gives no rows.

    The window after the first one that is not full is not made. The whole text stays in
    every row unless ``keep_text`` is off; a later select prunes it too. Without an id column the
    ``source_row_id`` is a digest of the row's content, which rows that are equal in all share.
    """
    require_columns(df, [column, id_column] if id_column else [column])
    if column == id_column and not keep_text:
        raise ValueError("The id column cannot be dropped")
    if chunk_size < 1:
        raise ValueError("chunk_size must be at least 1")
    step = chunk_size - chunk_overlap
    if step <= 0:
        step = chunk_size
    # A column of its own: inside the lambda the split would run once per window.
    split = df.withColumn("_tokens", rules.words(col(column).cast("string")))
    tokens = F.col("_tokens")
    n = F.size(tokens)
    last = F.least(
        F.floor((n - 1) / step).cast("int"),
        F.when(n < chunk_size, 0).otherwise(F.floor((n - chunk_size) / step).cast("int") + 1),
    )
    chunks = F.when(
        n > 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.array_join(F.slice(tokens, i * step + 1, chunk_size), " "),
        ),
    )
    kept = [col(c) for c in df.columns if keep_text or c != column]
    if not id_column:
        content = F.to_json(F.struct(*[col(c) for c in df.columns]), {"ignoreNullFields": "false"})
        kept.append(F.sha2(content, 256).alias("_source"))
    exploded = split.select(*kept, F.posexplode(chunks).alias("chunk_index", "chunk_text"))
    numbered = exploded.withColumn("chunk_index", F.col("chunk_index").cast("bigint"))
    return numbered.withColumn("source_row_id", col(id_column)) if id_column else numbered.withColumnRenamed("_source", "source_row_id")


def detect_lang(df: DataFrame, column: str) -> DataFrame:
    """Adds ``lang``: en or other; null for null text."""
    require_column(df, column)
    text = col(column).cast("string")
    lang = F.when(rules.is_english(text), "en").when(text.isNotNull(), "other")
    return df.withColumn("lang", lang)


def sentiment(df: DataFrame, column: str, lexicon: DataFrame, key: str, output_column: str = "sentiment") -> DataFrame:
    """Adds the summed word weights of a text, squashed to (-1, 1) by x / sqrt(x^2 + 15).

    ``lexicon`` has unique ``word`` and ``weight``; ``key`` is unique per row. Words are
    weighted and summed inside the task that reads the text while Spark finds the lexicon
    small enough in bytes to broadcast; else words are shuffled.
    """
    require_columns(df, [column, key])
    require_columns(lexicon, ["word", "weight"])
    tokens = df.select(
        col(key).alias("_key"), F.explode(rules.words(F.lower(col(column).cast("string")))).alias("word")
    )
    joined = tokens.join(lexicon.select("word", "weight"), "word")
    sums = joined.groupBy("_key").agg(F.sum("weight").alias("_sum"))
    total = F.coalesce(F.col("_sum"), F.lit(0)).cast("double")
    score = total / F.sqrt(total * total + 15)
    scored = df.join(sums, col(key) == F.col("_key"), "left")
    return scored.withColumn(output_column, score).drop("_key", "_sum")


def embed_text(
    df: DataFrame, column: str, dim: int = 384, output_column: str = "embedding", encoder=None, unit_length: bool = True
) -> DataFrame:
    """Adds a fixed-size vector: hashed words, or a model given as a pandas UDF."""
    require_column(df, column)
    text = col(column).cast("string")
    vector = encoder(text) if encoder is not None else fingerprint.hashed_vector(text, dim, unit_length)
    return df.withColumn(output_column, vector)


def hash_key(df: DataFrame, column: str, algo: str = "sha256", output_column: str = "hash_key") -> DataFrame:
    require_column(df, column)
    text = col(column).cast("string")
    if algo == "sha256":
        return df.withColumn(output_column, F.sha2(text, 256))
    if algo == "xxhash64":
        return df.withColumn(output_column, F.lower(F.lpad(F.hex(F.xxhash64(text)), 16, "0")))
    raise ValueError(f"Unknown hash '{algo}'")
