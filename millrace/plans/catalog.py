"""The operators that pipelines can name."""

from __future__ import annotations

from pyspark.sql.types import StructType

from .. import operators as ops
from .. import sources, streaming
from ..checks import as_list
from .registry import Param, operator


def _column(default: str = "text") -> Param:
    return Param("column", default=default)


ORDER = Param("text", default="id", help="unique column, or comma-separated columns, that say which row is first")


# Sources


@operator("import_dataset", (), kind="source", path=Param("file", required=True), format=Param("text", default="auto"),
          delimiter=Param("text", default=","), root_key=Param("text", default=""), encoding=Param("text", default="utf-8"),
          multi_line=Param("boolean", default=True))
def _import(spark, **settings):
    return sources.import_dataset(spark, **settings)


@operator("load_csv", (), kind="source", path=Param("file", required=True), delimiter=Param("text", default=","),
          encoding=Param("text", default="utf-8"), header=Param("boolean", default=True),
          multi_line=Param("boolean", default=True), split=Param("boolean", default=False, help="read a large file by many tasks"))
def _csv(spark, path, delimiter, encoding, header, multi_line, split):
    if not header:
        raise ValueError("load_csv reads files with a header")
    if split:
        if encoding.lower().replace("-", "") != "utf8":
            raise ValueError("load_csv splits files in UTF-8 only")
        return sources.read_csv_split(spark, path, delimiter)
    return sources.read_csv(spark, path, delimiter, encoding, multi_line)


@operator("load_json", (), kind="source", path=Param("file", required=True), root_key=Param("text", default=""))
def _json(spark, path, root_key):
    return sources.read_json(spark, path, root_key)


@operator("load_jsonl", (), kind="source", path=Param("file", required=True))
def _jsonl(spark, path):
    return sources.read_jsonl(spark, path)


@operator("load_parquet", (), kind="source", path=Param("file", required=True))
def _parquet(spark, path):
    return sources.read_parquet(spark, path)


@operator("load_stream", (), kind="source", path=Param("file", required=True), format=Param("select", default="json", options=("json", "parquet", "csv")),
          schema=Param("textarea", required=True, help="columns and types, as in id bigint, text string"))
def _stream(spark, path, format, schema):
    return sources.read_stream(spark, path, format, StructType.fromDDL(schema))


@operator("load_sql", (), kind="source", query=Param("textarea", required=True), connection=Param("text"),
          partition_column=Param("text"), lower=Param("number"), upper=Param("number"), partitions=Param("number", default=1, min=1))
def _sql(spark, query, connection, partition_column, lower, upper, partitions):
    bounds = None if lower is None or upper is None else (lower, upper)
    return sources.read_sql(spark, query, connection, partition_column, bounds, partitions)


@operator("load_s3", (), kind="source", bucket=Param("text", required=True), prefix=Param("text", default=""))
def _objects(spark, bucket, prefix):
    return sources.list_objects(spark, bucket if "://" in bucket else f"s3a://{bucket}", prefix)


@operator("load_images", (), kind="source", directory=Param("file", required=True),
          pattern=Param("regex", default=sources.readers.IMAGE_PATTERN), recursive=Param("boolean", default=False))
def _images(spark, directory, pattern, recursive):
    return sources.read_images(spark, directory, pattern, recursive)


# Columns

operator("select_columns", columns=Param("text", required=True))(ops.select_columns)
operator("drop_columns", columns=Param("text", required=True))(ops.drop_columns)
operator("rename_columns", mapping=Param("json", required=True))(ops.rename_columns)
operator("map_expr", expression=Param("expression", required=True), output_column=Param("text", default="result"))(
    ops.map_expr
)
operator("append_suffix", suffix=Param("text", required=True), columns=Param("text"))(ops.append_suffix)


@operator("split_col", column=Param("column", required=True), delimiter=Param("text", default=","),
          output_columns=Param("text"))
def _split_col(df, column, delimiter, output_columns):
    return ops.split_col(df, column, delimiter, as_list(output_columns) if output_columns else None)


# Rows


@operator("filter_rows", column=_column(), op=Param("select", default="==", options=tuple(ops.filters.OPERATORS)),
          value=Param("text"), condition=Param("expression"))
def _filter_rows(df, column, op, value, condition):
    return ops.filter_expr(df, condition) if condition else ops.filter_rows(df, column, op, value)


operator("length_filter", column=_column(), min_len=Param("number", default=10, min=0),
         max_len=Param("number", min=0), unit=Param("select", default="chars", options=("chars", "words")))(
    ops.length_filter
)
operator("remove_empty", columns=Param("text", default="text"))(ops.remove_empty)
operator("search_text", column=_column(), pattern=Param("regex", required=True), regex=Param("boolean", default=True))(
    ops.search_text
)
operator("min_threshold", column=_column("score"), min_value=Param("number", required=True))(ops.min_threshold)
operator("language_filter", column=_column(), target_lang=Param("text", default="en"))(ops.language_filter)


@operator("regex_partition", outputs=("filtered", "rejected"), column=_column(), pattern=Param("regex", required=True),
          case_insensitive=Param("boolean", default=False))
def _regex_partition(df, **settings):
    filtered, rejected = ops.regex_partition(df, **settings)
    return {"filtered": filtered, "rejected": rejected}


# Text

for _name in ("lowercase", "uppercase", "strip_html", "strip_tags", "detect_lang"):
    operator(_name, column=_column())(getattr(ops, _name))
operator("strip_whitespace", column=_column(), collapse=Param("boolean", default=False))(ops.strip_whitespace)
operator("unicode_normalize", column=_column(),
         form=Param("select", default="NFC", options=("NFC", "NFD", "NFKC", "NFKD")))(ops.unicode_normalize)
operator("regex_replace", column=_column(), pattern=Param("regex", default=r"\s+"), replacement=Param("text", default=" "))(
    ops.regex_replace
)
operator("normalize", column=_column(), lower=Param("boolean", default=True), trim=Param("boolean", default=True))(
    ops.normalize
)
operator("tokenize", column=_column(), mode=Param("select", default="word", options=("word", "sentence")))(ops.tokenize)
operator("chunk_text", column=_column(), chunk_size=Param("number", default=500, min=1),
         chunk_overlap=Param("number", default=50, min=0), id_column=Param("column", default="id"),
         keep_text=Param("boolean", default=True))(ops.chunk_text)
operator("hash_key", column=_column(), algo=Param("select", default="sha256", options=("sha256", "xxhash64")))(ops.hash_key)
operator("embed_text", column=_column(), dim=Param("number", default=384, min=1))(ops.embed_text)


@operator("sentiment", ("in", "lexicon"), column=_column(), key=_column("id"))
def _sentiment(df, lexicon, column, key):
    return ops.sentiment(df, column, lexicon, key)


# Order

operator("sort_rows", by=_column("id"), ascending=Param("boolean", default=True), tiebreak=Param("text", default=""))(
    ops.sort_rows
)
operator("shuffle", seed=Param("number", default=42), key=_column("id"))(ops.shuffle)
operator("head", n=Param("number", default=5, min=0), order_by=ORDER)(ops.head)
operator("batches", chunk_size=Param("number", default=1000, min=1), order_by=ORDER)(ops.batches)


@operator("sample_rows", count=Param("number", default=100, min=1), seed=Param("number", default=42), key=_column("id"))
def _sample(df, count, seed, key):
    return ops.sample_rows(df, int(count), seed, key)


@operator("split_dataset", outputs=("train", "test"), ratio=Param("slider", default=0.8, min=0.0, max=1.0),
          seed=Param("number", default=42), key=_column("id"))
def _split(df, ratio, seed, key):
    train, test = ops.split_dataset(df, ratio, seed, key)
    return {"train": train, "test": test}


# Several inputs

operator("concatenate", ("a", "b"))(ops.concatenate)


@operator("join_rows", ("left", "right"), join_key=_column("id"),
          join_type=Param("select", default="inner", options=tuple(ops.combine.JOIN_KINDS)),
          skewed=Param("boolean", default=True))
def _join(left, right, join_key, join_type, skewed):
    return ops.join_rows(left, right, join_key, join_type, skewed=skewed)


operator("dedup_report", ("before", "after"))(ops.dedup_report)


# Duplicates


@operator("dedup_exact", method=Param("select", default="exact", options=("exact", "hash", "simhash", "minhash")),
          columns=Param("text"), column=_column(), order_by=ORDER, hamming=Param("number", default=3, min=0, max=8),
          threshold=Param("slider", default=0.85, min=0.5, max=1.0))
def _dedup(df, method, columns, column, order_by, hamming, threshold):
    if method == "hash":
        return ops.dedup_hash(df, column, order_by)
    if method == "simhash":
        return ops.simhash_deduplicate(df, column, int(hamming), order_by)
    if method == "minhash":
        return ops.minhash_deduplicate(df, column, threshold, order_by)
    return ops.dedup_exact(df, columns, order_by if columns else None)


operator("dedup_fuzzy", column=_column(), threshold=Param("slider", default=0.85, min=0.5, max=1.0), order_by=ORDER)(
    ops.dedup_fuzzy
)

operator("simhash", column=_column(), variant=Param("select", default="token", options=("token", "word")),
         output_column=Param("text", default="simhash"))(ops.simhash)
operator("minhash", column=_column(), num_perm=Param("number", default=64, min=1),
         output_column=Param("text", default="minhash"))(ops.minhash)
operator("near_dup_pairs", column=_column(), threshold=Param("number", default=3, min=0, max=9), order_by=ORDER)(ops.near_dup_pairs)
operator("minhash_pairs", column=_column(), threshold=Param("slider", default=0.85, min=0.5, max=1.0), order_by=ORDER)(ops.minhash_pairs)

# Streams


@operator("dedup_stream", keys=Param("text", required=True), time_column=_column("ts"), watermark=Param("text", default="1 hour"),
          first=Param("boolean", default=False, help="wait for the first copy by event time"))
def _dedup_stream(df, keys, time_column, watermark, first):
    return (streaming.first_stream if first else streaming.dedup_stream)(df, keys, time_column, watermark)


@operator("write_stream", kind="sink", path=Param("file", required=True), checkpoint=Param("file", required=True),
          format=Param("select", default="parquet", options=("parquet", "json", "csv")))
def _write_stream(df, path, checkpoint, format):
    streaming.run_available(df, path, checkpoint, format)


# Profiles

operator("statistics", approx=Param("boolean", default=False))(ops.column_statistics)
for _name in ("blank_counts", "dataset_summary", "classify_dataset", "infer_schema", "vote_types"):
    operator(_name)(getattr(ops, _name))


# Sinks

operator("write_csv", kind="sink", path=Param("file", required=True), delimiter=Param("text", default=","),
         gzip=Param("boolean", default=False))(sources.write_csv)
operator("write_json", kind="sink", path=Param("file", required=True))(sources.write_json)
operator("write_jsonl", kind="sink", path=Param("file", required=True))(sources.write_jsonl)
operator("write_parquet", kind="sink", path=Param("file", required=True))(sources.write_parquet)
operator("save", kind="sink", path=Param("file", required=True))(sources.save)


@operator("upload_s3", kind="sink", bucket=Param("text", required=True), key_prefix=Param("text", default="output/"),
          format=Param("select", default="jsonl", options=("csv", "json", "jsonl", "parquet")))
def _upload(df, bucket, key_prefix, format):
    root = bucket if "://" in bucket else f"s3a://{bucket}"
    sources.save(df, f"{root}/{key_prefix.strip('/')}.{format}")
