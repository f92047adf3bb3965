"""Sources and sinks. Written copies of the tables go to the shared scratch folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sources
from ..functions.slices import text_slices
from ..scratch import scratch_path
from .catalog import query, table

DOCUMENTS = "SELECT doc_id, text, lang, source, n_chars FROM documents"
DOCUMENTS_AS_TEXT = (
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents"
)
ORDERS_AS_TEXT = """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
       CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
       o_orderpriority
FROM orders
"""


def _orders_as_text(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("decimal(18, 2)")
    orders = orders.withColumns({"o_totalprice": price, "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")})
    return orders.select(*[F.col(c).cast("string").alias(c) for c in orders.columns])


@query("s1_read_csv", DOCUMENTS_AS_TEXT)
def s1(spark, sf_dir):
    path = scratch_path(spark, "s1")
    sources.write_csv(table(spark, sf_dir, "documents"), path)
    return sources.read_csv(spark, path)


@query("s1_read_csv_split", DOCUMENTS_AS_TEXT)
def s1_split(spark, sf_dir):
    path = scratch_path(spark, "s1_split")
    sources.write_csv(table(spark, sf_dir, "documents"), path)
    return sources.read_csv_split(spark, path)


@query("s2_read_tsv", ORDERS_AS_TEXT)
def s2(spark, sf_dir):
    path = scratch_path(spark, "s2")
    sources.write_csv(_orders_as_text(spark, sf_dir), path, delimiter="\t")
    return sources.import_dataset(spark, path, format="tsv")


def _document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The JSON records of one task as the lines of one document with a list under "data"."""
    lead = '{"note": "x", "data": ['
    for batch in batches:
        for part in text_slices(batch.column(0)):
            yield pa.RecordBatch.from_pydict({"value": [lead + ",\n".join(part.to_pylist())]})
            lead = ","
    yield pa.RecordBatch.from_pydict({"value": ["]}" if lead == "," else lead + "]}"]})


def write_documents(df: DataFrame, path: str) -> None:
    """The rows of each task as one JSON document."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(_document, "value string").write.text(path)


@query("s3_read_json", "SELECT conv_id, turn, role, text FROM conversations")
def s3(spark, sf_dir):
    path = scratch_path(spark, "s3")
    write_documents(table(spark, sf_dir, "conversations"), path)
    return sources.read_json(spark, path).select("conv_id", "turn", "role", "text")


@query("s4_read_jsonl", DOCUMENTS)
def s4(spark, sf_dir):
    path = scratch_path(spark, "s4")
    sources.write_jsonl(table(spark, sf_dir, "documents"), path)
    return sources.read_jsonl(spark, path)


@query("s5_read_parquet", "SELECT * FROM lineitem")
def s5(spark, sf_dir):
    return sources.read_parquet(spark, f"{sf_dir}/lineitem.parquet")


@query("s6_import_dataset", "SELECT * FROM customer")
def s6(spark, sf_dir):
    return sources.import_dataset(spark, f"{sf_dir}/customer.parquet")


@query(
    "s7_read_sql",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'",
)
def s7(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("millrace_orders")
    return sources.read_sql(
        spark, "SELECT o_orderkey, o_custkey, o_totalprice FROM millrace_orders WHERE o_orderpriority = '1-URGENT'"
    )


@query("s8_list_objects")
def s8(spark, sf_dir):
    files = sources.list_objects(spark, sf_dir)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query("s9_read_images")
def s9(spark, sf_dir):
    return sources.read_images(spark, sf_dir, pattern=r".*\.parquet").select("name", "length")


@query("s11_read_csv_strict", ORDERS_AS_TEXT + " WHERE o_orderstatus <> 'F'")
def s11(spark, sf_dir):
    path = scratch_path(spark, "s11")
    orders = _orders_as_text(spark, sf_dir)
    columns = orders.columns
    # The rows of one status get a field too many, which the strict reader drops.
    extra = F.when(F.col("o_orderstatus") == "F", F.lit("surplus"))
    orders.select(F.concat_ws(",", *columns, extra).alias("value")).write.text(path)
    return sources.read_csv_strict(spark, path, columns, header=False)


@query("k1_write_csv", DOCUMENTS_AS_TEXT)
def k1(spark, sf_dir):
    path = scratch_path(spark, "k1")
    sources.write_csv(table(spark, sf_dir, "documents"), path, delimiter=";", gzip=True)
    return sources.read_csv(spark, path, delimiter=";")


@query(
    "k2_write_json",
    "SELECT d.*, CAST(l.quality AS BIGINT) AS quality, CAST(l.toxic AS BIGINT) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def k2(spark, sf_dir):
    path = scratch_path(spark, "k2")
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    sources.write_json(labelled, path)
    return sources.read_jsonl(spark, path)


@query("k3_write_jsonl", "SELECT page_id, url, html FROM pages")
def k3(spark, sf_dir):
    path = scratch_path(spark, "k3")
    sources.write_jsonl(table(spark, sf_dir, "pages"), path)
    return sources.read_jsonl(spark, path)


@query(
    "k4_write_parquet",
    "SELECT vec_id, label, CAST(unnest(range(len(embedding))) AS BIGINT) AS place, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings",
)
def k4(spark, sf_dir):
    path = scratch_path(spark, "k4")
    sources.write_parquet(table(spark, sf_dir, "embeddings"), path, partition_by=["label"])
    vectors = sources.read_parquet(spark, path).select("vec_id", "label", F.posexplode("embedding").alias("place", "value"))
    return vectors.select("vec_id", "label", F.col("place").cast("bigint").alias("place"), F.col("value").cast("double").alias("value"))


@query("k5_save", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def k5(spark, sf_dir):
    path = scratch_path(spark, "k5") + ".parquet"
    sources.save(table(spark, sf_dir, "part"), path)
    return sources.import_dataset(spark, path)
