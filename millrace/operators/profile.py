"""Column profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checks import col, require_batch, require_columns
from ..functions.text import is_blank

# Kinds of dataset by lower-cased column names.
TEXT_COLUMNS = ("text", "content", "body", "document", "story", "raw_text")
INSTRUCTION = ("Instruction Tuning", 0.98, "Unicode Normalize -> Lowercase Instructions -> Filter Empty")
CHAT = ("Multi-turn Chat", 0.95, "Strip HTML -> SimHash Dedup -> Export Parquet")
TEXT = ("Unstructured Text", 0.92, "Unicode NFC -> Regex Replace -> Length Filter -> Export JSONL")
TABULAR = ("Tabular Data", 0.85, "Remove Nulls -> Dedup Exact -> Export Parquet")

# Texts longer than this are counted as distinct by their digest, to keep the shuffle narrow.
LONG_TEXT = 64


def _rows(df: DataFrame, columns: list[tuple[str, list[Column]]], names: list[str]) -> DataFrame:
    """One row per column from a single aggregated row."""
    entries = [F.struct(F.lit(name).alias("column"), *[v.alias(n) for v, n in zip(values, names)]) for name, values in columns]
    return df.select(F.explode(F.array(*entries)).alias("entry")).select("entry.*")


def column_statistics(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: rows, nulls, distinct values (null counts as one), and min, max, mean of numbers.

    Exact distinct counts go through one long table of (column, value), grouped inside
    the tasks before it is shuffled, so that a frequent value is one row per task.
    """
    require_batch(df, "column_statistics")
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    null = F.lit(None).cast("double")
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(df.columns):
        aggregates.append(F.count_if(col(name).isNull()).alias(f"nulls_{i}"))
        if approx:
            text = F.coalesce(F.concat(F.lit("="), col(name).cast("string")), F.lit(""))
            aggregates.append(F.approx_count_distinct(text).alias(f"unique_{i}"))
        if name in numeric:
            aggregates.append(F.min(col(name)).cast("double").alias(f"min_{i}"))
            aggregates.append(F.max(col(name)).cast("double").alias(f"max_{i}"))
            aggregates.append(F.avg(col(name)).cast("double").alias(f"mean_{i}"))
    fields = ["count", "nulls", *(["unique"] if approx else []), "min", "max", "mean"]
    entries = []
    for i, name in enumerate(df.columns):
        unique = [F.col(f"unique_{i}")] if approx else []
        stats = [F.col(f"{s}_{i}") if name in numeric else null for s in ("min", "max", "mean")]
        entries.append((name, [F.col("rows"), F.col(f"nulls_{i}"), *unique, *stats]))
    profile = _rows(df.agg(*aggregates), entries, fields)
    if not approx:
        values = F.array(
            *[
                F.struct(F.lit(c).alias("column"), _short(col(c).cast("string")).alias("value"))
                for c in df.columns
            ]
        )
        pairs = df.select(F.explode(values).alias("cell")).select("cell.*")
        unique = pairs.groupBy("column", "value").agg(F.lit(1).alias("one")).groupBy("column").agg(
            F.count(F.lit(1)).alias("unique")
        )
        profile = profile.join(F.broadcast(unique), "column", "left").withColumn(
            "unique", F.coalesce("unique", F.lit(0))
        )
    return profile.select("column", "count", "nulls", "unique", "min", "max", "mean")


def _short(text: Column) -> Column:
    return F.when(F.length(text) <= LONG_TEXT, F.concat(F.lit("="), text)).otherwise(F.sha2(text, 256))


def _blanks(df: DataFrame) -> list[Column]:
    return [
        F.count_if(is_blank(col(f.name), f.dataType.simpleString())).alias(f"blanks_{i}")
        for i, f in enumerate(df.schema.fields)
    ]


def blank_counts(df: DataFrame) -> DataFrame:
    """Null or blank cells per column, in one pass."""
    require_batch(df, "blank_counts")
    entries = [(name, [F.col(f"blanks_{i}")]) for i, name in enumerate(df.columns)]
    return _rows(df.agg(*_blanks(df)), entries, ["blanks"])


def dataset_summary(df: DataFrame) -> DataFrame:
    """Row count, column count, blanks per column and the kind of dataset, in one pass."""
    require_batch(df, "dataset_summary")
    kind, confidence, advice = _kind(df.columns)
    one = df.agg(F.count(F.lit(1)).alias("row_count"), *_blanks(df))
    counts = F.map_from_arrays(
        F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.col(f"blanks_{i}") for i in range(len(df.columns))])
    )
    return one.select(
        "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        counts.alias("null_counts"),
        F.lit(kind).alias("type"),
        F.lit(confidence).alias("confidence"),
        F.lit(advice).alias("recommendation"),
    )


def _kind(columns: list[str]) -> tuple[str, float, str]:
    names = {c.lower() for c in columns}
    if {"instruction", "output"} <= names or {"prompt", "response"} <= names:
        return INSTRUCTION
    if names & {"messages", "conversations"}:
        return CHAT
    return TEXT if names & set(TEXT_COLUMNS) else TABULAR


def classify_dataset(df: DataFrame) -> DataFrame:
    """Kind, confidence and advice, from the column names, beside the row count."""
    require_batch(df, "classify_dataset")
    return dataset_summary(df).select("row_count", "type", "confidence", "recommendation")


# Type names of the data model per Spark type.
TYPE_NAMES = {
    T.BooleanType: "boolean",
    T.ByteType: "integer",
    T.ShortType: "integer",
    T.IntegerType: "integer",
    T.LongType: "integer",
    T.FloatType: "float",
    T.DoubleType: "float",
    T.ArrayType: "array",
    T.StructType: "struct",
    T.StringType: "string",
}


def infer_schema(df: DataFrame) -> DataFrame:
    """Name, type and whether nulls occur, per column. Types outside the model keep Spark's name."""
    require_batch(df, "infer_schema")
    nulls = df.agg(*[F.count_if(col(c).isNull()).alias(f"nulls_{i}") for i, c in enumerate(df.columns)])
    entries = []
    for i, field in enumerate(df.schema.fields):
        name = TYPE_NAMES.get(type(field.dataType), field.dataType.simpleString())
        entries.append((field.name, [F.lit(name), F.col(f"nulls_{i}") > 0]))
    return _rows(nulls, entries, ["data_type", "nullable"])


def vote_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The narrowest type that every non-blank text of a column reads as, in one pass.

    For all-text sources such as CSV. Columns without any value stay text.
    """
    require_batch(df, "vote_types")
    names = columns or df.columns
    require_columns(df, names)
    votes, entries = [], []
    for i, name in enumerate(names):
        text = col(name).cast("string")
        filled = ~is_blank(text)
        votes.append(F.count_if(filled).alias(f"filled_{i}"))
        for kind, spark_type in (("boolean", "boolean"), ("integer", "bigint"), ("float", "double")):
            reads = filled & text.try_cast(spark_type).isNotNull()
            if kind == "boolean":
                reads = filled & F.lower(F.btrim(text)).isin("true", "false")
            votes.append(F.count_if(reads).alias(f"{kind}_{i}"))
        votes.append(F.count_if(~filled).alias(f"blank_{i}"))
        kind = F.when(F.col(f"filled_{i}") == 0, "string")
        for candidate in ("boolean", "integer", "float"):
            kind = kind.when(F.col(f"{candidate}_{i}") == F.col(f"filled_{i}"), candidate)
        entries.append((name, [kind.otherwise("string"), F.col(f"blank_{i}") > 0]))
    return _rows(df.agg(*votes), entries, ["data_type", "nullable"])


def dedup_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after, rows removed and their share, in one job."""
    require_batch(before, "dedup_report")
    require_batch(after, "dedup_report")
    counts = before.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("before")).unionByName(
        after.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("after"))
    )
    totals = counts.agg(
        F.sum(F.when(F.col("side") == "before", F.col("n")).otherwise(0)).alias("rows_before"),
        F.sum(F.when(F.col("side") == "after", F.col("n")).otherwise(0)).alias("rows_after"),
    )
    removed = F.col("rows_before") - F.col("rows_after")
    share = F.when(F.col("rows_before") > 0, F.round(removed * 100.0 / F.col("rows_before"), 2)).otherwise(F.lit(0.0))
    return totals.select("rows_before", "rows_after", removed.alias("removed"), share.alias("removed_percent"))
