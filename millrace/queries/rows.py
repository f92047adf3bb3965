"""Columns, filters, order, joins and profiles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from .. import operators as ops
from ..plans import Param, get_operator, operator
from .catalog import query, table

# Columns


@query("p1_select", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def p1(spark, sf_dir):
    return ops.select_columns(table(spark, sf_dir, "orders"), "o_custkey, o_orderkey, o_totalprice")


@query("p2_drop", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def p2(spark, sf_dir):
    return ops.drop_columns(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderpriority"])


@query("p3_rename", "SELECT c_custkey AS customer, c_name AS name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def p3(spark, sf_dir):
    return ops.rename_columns(table(spark, sf_dir, "customer"), {"c_custkey": "customer", "c_name": "name"})


@query(
    "p4_map_expr",
    "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem",
)
def p4(spark, sf_dir):
    items = ops.map_expr(table(spark, sf_dir, "lineitem"), "l_extendedprice * (1 - l_discount)", "revenue")
    return items.select("l_orderkey", "l_linenumber", "revenue")


@query(
    "p5_split_col",
    "SELECT p_partkey, string_split(p_name, ' ')[1] AS adjective, string_split(p_name, ' ')[2] AS noun, "
    "len(string_split(p_name, ' ')) AS parts FROM part",
)
def p5(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    named = ops.split_col(part, "p_name", " ", ["adjective", "noun"])
    return ops.split_col(named, "p_name", " ").select("p_partkey", "adjective", "noun", F.size("p_name").cast("bigint").alias("parts"))


@query(
    "p6_append_suffix",
    "SELECT CAST(n_nationkey AS VARCHAR) || '_x' AS n_nationkey, n_name || '_x' AS n_name, "
    "CAST(n_regionkey AS VARCHAR) || '_x' AS n_regionkey FROM nation",
)
def p6(spark, sf_dir):
    return ops.append_suffix(table(spark, sf_dir, "nation"), "_x")


# Filters

LABELLED = """
SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


def _labelled(spark, sf_dir):
    """Documents with their quality, null where there is no label."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return documents.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("f1a_eq", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def f1a(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return ops.filter_rows(orders, "o_orderstatus", "==", "F")


@query("f1b_neq", f"SELECT * FROM ({LABELLED}) WHERE quality IS DISTINCT FROM 1")
def f1b(spark, sf_dir):
    return ops.filter_rows(_labelled(spark, sf_dir), "quality", "neq", 1)


@query(
    "f1c_compare",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem "
    "WHERE l_quantity > 10 AND l_quantity <= 40 AND l_discount >= 0.03 AND l_linenumber < 6",
)
def f1c(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    items = ops.filter_rows(items, "l_quantity", ">", "10")
    items = ops.filter_rows(items, "l_quantity", "lte", 40)
    items = ops.filter_rows(items, "l_discount", ">=", 0.03)
    return ops.filter_rows(items, "l_linenumber", "lt", 6)


@query(
    "f1d_contains",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE contains(o_orderpriority, 'URG') "
    "AND contains(CAST(o_orderkey AS VARCHAR), '7')",
)
def f1d(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return ops.filter_rows(ops.filter_rows(orders, "o_orderpriority", "contains", "URG"), "o_orderkey", "in", 7)


# Blanks and nulls derived from the data.
BLANKED = """
SELECT event_id, CASE WHEN event_type = 'view' THEN '  ' WHEN event_type = 'click' THEN NULL ELSE props END AS note
FROM events
"""


def _blanked(spark, sf_dir):
    kind = F.col("event_type")
    note = F.when(kind == "view", "  ").when(kind == "click", F.lit(None)).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", note.alias("note"))


@query("f1e_not_blank", f"SELECT * FROM ({BLANKED}) WHERE trim(note) <> ''")
def f1e(spark, sf_dir):
    return ops.filter_rows(_blanked(spark, sf_dir), "note", "not_null")


@query("f1f_is_blank", f"SELECT * FROM ({BLANKED}) WHERE note IS NULL OR trim(note) = ''")
def f1f(spark, sf_dir):
    return ops.filter_rows(_blanked(spark, sf_dir), "note", "is_null")


@query(
    "f2_filter_expr",
    "SELECT event_id, event_type, value FROM events WHERE event_type = 'purchase' AND value > 20",
)
def f2(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return ops.filter_expr(events, "event_type = 'purchase' AND value > 20")


@query(
    "f7_min_threshold",
    "SELECT o_orderkey, o_orderpriority FROM orders "
    "WHERE TRY_CAST(substr(o_orderpriority, 1, 2 - CAST(o_orderstatus = 'F' AS INTEGER)) AS DOUBLE) >= 3",
)
def f7(spark, sf_dir):
    # "3" reads as a number, "3-" does not.
    short = F.expr("substring(o_orderpriority, 1, IF(o_orderstatus = 'F', 1, 2))")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", short.alias("rank"))
    return ops.min_threshold(orders, "rank", 3).drop("rank")


# Order


@query("r1_sort", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def r1(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return ops.sort_rows(orders, "o_totalprice", ascending=False, tiebreak="o_orderkey")


@query(
    "r2_sample",
    "SELECT doc_id, lang, n_chars FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 100",
)
def r2(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return ops.sample_rows(documents, 100, 42, "doc_id")


@query(
    "r2_sample_large",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 1400",
)
def r2_large(spark, sf_dir):
    return ops.sample_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 1400, 42, "o_orderkey")


@query(
    "r3_shuffle",
    "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1 AS shuffle_pos "
    "FROM orders",
)
def r3(spark, sf_dir):
    return ops.shuffle(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 42, "o_orderkey")


@query(
    "r4_split",
    """
    WITH placed AS (
        SELECT doc_id, text, row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id) AS place FROM documents)
    SELECT doc_id, text,
        CASE WHEN place <= floor((SELECT count(*) FROM documents) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split
    FROM placed
    """,
)
def r4(spark, sf_dir):
    return ops.tag_split(table(spark, sf_dir, "documents").select("doc_id", "text"), 0.8, 7, "doc_id")


@query("r5_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50")
def r5(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ops.head(orders, 50, ["o_totalprice", "o_orderkey"])


@query(
    "r5_head_large",
    "SELECT v FROM (SELECT CASE WHEN o_orderkey % 7 > 0 THEN floor(o_totalprice / 100000) END AS v FROM orders) "
    "ORDER BY v NULLS LAST LIMIT 1100",
)
def r5_large(spark, sf_dir):
    price = F.when(F.col("o_orderkey") % 7 > 0, F.floor(F.col("o_totalprice") / 100000).cast("double"))
    return ops.head(table(spark, sf_dir, "orders").select(price.alias("v")), 1100, "v")


@query(
    "r6_batches",
    "SELECT l_orderkey, l_linenumber, l_returnflag, "
    "(row_number() OVER (ORDER BY l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) // 1000 "
    "AS batch_id FROM lineitem",
)
def r6(spark, sf_dir):
    order = ["l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    batched = ops.batches(table(spark, sf_dir, "lineitem").select(*order), 1000, order)
    return batched.select("l_orderkey", "l_linenumber", "l_returnflag", "batch_id")


# Several tables


@query(
    "u1_concatenate",
    "SELECT c_name AS name, c_acctbal AS balance, CAST(c_custkey AS VARCHAR) AS code, c_mktsegment AS segment FROM customer "
    "UNION ALL SELECT s_name, s_acctbal, 'S' || s_suppkey, NULL FROM supplier",
)
def u1(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_custkey").alias("code"),
        F.col("c_mktsegment").alias("segment"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("balance"),
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("code"),
    )
    return ops.concatenate(customers, suppliers)


@query(
    "j1_inner",
    "SELECT o_orderkey, o_totalprice, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
)
def j1(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), "o_orderkey", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), "c_name", "c_mktsegment")
    return ops.join_rows(orders, customers, "cust", "inner").drop("cust")


def _sides(spark, sf_dir):
    """All documents against all labels."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("source"), "toxic")
    return documents, labels


def _join_sql(kind: str) -> str:
    return (
        "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.lang, d.source, l.quality AS source_right, l.toxic "
        f"FROM documents d {kind} JOIN labels l ON d.doc_id = l.doc_id"
    )


@query("j1_left", _join_sql("LEFT"))
def j1_left(spark, sf_dir):
    return ops.join_rows(*_sides(spark, sf_dir), "doc_id", "left")


@query("j1_right", _join_sql("RIGHT"))
def j1_right(spark, sf_dir):
    return ops.join_rows(*_sides(spark, sf_dir), "doc_id", "right")


@query("j1_outer", _join_sql("FULL"))
def j1_outer(spark, sf_dir):
    return ops.join_rows(*_sides(spark, sf_dir), "doc_id", "outer")


# Profiles

STATISTICS = " UNION ALL ".join(
    f"SELECT '{name}' AS \"column\", count(*) AS count, count(*) - count({name}) AS nulls, "
    f"count(DISTINCT {name}) + max(CAST({name} IS NULL AS INTEGER)) AS \"unique\", "
    + (
        f"CAST(min({name}) AS DOUBLE) AS min, CAST(max({name}) AS DOUBLE) AS max, round(avg({name}), 4) AS mean"
        if numeric
        else "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean"
    )
    + " FROM (SELECT d.*, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
    for name, numeric in (
        ("doc_id", True),
        ("text", False),
        ("lang", False),
        ("source", False),
        ("n_chars", True),
        ("quality", True),
    )
)


def _documents_with_quality(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left")


@query("a1_statistics", STATISTICS)
def a1(spark, sf_dir):
    return ops.column_statistics(_documents_with_quality(spark, sf_dir)).withColumn("mean", F.round("mean", 4))


@query(
    "a2_blank_counts",
    f"SELECT 'event_id' AS \"column\", 0 AS blanks UNION ALL "
    f"SELECT 'note', count(*) FROM ({BLANKED}) WHERE note IS NULL OR trim(note) = ''",
)
def a2(spark, sf_dir):
    return ops.blank_counts(_blanked(spark, sf_dir))


@query(
    "a3_summary",
    f"SELECT count(*) AS row_count, CAST(2 AS BIGINT) AS column_count, CAST(0 AS BIGINT) AS blanks_event_id, "
    f"CAST(count_if(note IS NULL OR trim(note) = '') AS BIGINT) AS blanks_note, 'Tabular Data' AS type FROM ({BLANKED})",
)
def a3(spark, sf_dir):
    summary = ops.dataset_summary(_blanked(spark, sf_dir))
    return summary.select(
        "row_count",
        "column_count",
        F.col("null_counts")["event_id"].alias("blanks_event_id"),
        F.col("null_counts")["note"].alias("blanks_note"),
        "type",
    )


@query(
    "a4_schema",
    "SELECT 'doc_id' AS \"column\", 'integer' AS data_type, count(*) > count(doc_id) AS nullable FROM documents "
    "UNION ALL SELECT 'text', 'string', count(*) > count(text) FROM documents "
    "UNION ALL SELECT 'lang', 'string', count(*) > count(lang) FROM documents "
    "UNION ALL SELECT 'source', 'string', count(*) > count(source) FROM documents "
    "UNION ALL SELECT 'n_chars', 'integer', count(*) > count(n_chars) FROM documents "
    f"UNION ALL SELECT 'quality', 'integer', count(*) > count(quality) FROM ({LABELLED})",
)
def a4(spark, sf_dir):
    return ops.infer_schema(_documents_with_quality(spark, sf_dir))


@query(
    "a4_vote_types",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CASE WHEN count(*) = count(TRY_CAST({c} AS {kind})) THEN '{name}' ELSE 'string' END AS data_type, "
        f"count(*) > count({c}) AS nullable FROM orders"
        for c, kind, name in (
            ("o_orderkey", "BIGINT", "integer"), ("o_custkey", "BIGINT", "integer"), ("o_orderstatus", "DOUBLE", "float"),
            ("o_totalprice", "DOUBLE", "float"), ("o_orderdate", "DOUBLE", "float"), ("o_orderpriority", "DOUBLE", "float"),
        )
    ).replace("TRY_CAST(o_orderdate AS", "TRY_CAST(CAST(o_orderdate AS VARCHAR) AS"),
)
def a4_vote(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return ops.vote_types(orders.select(*[F.col(c).cast("string").alias(c) for c in orders.columns]))


@query(
    "a6_classify",
    "SELECT count(*) AS row_count, 'Unstructured Text' AS type, CAST(0.92 AS DOUBLE) AS confidence, "
    "'Unicode NFC -> Regex Replace -> Length Filter -> Export JSONL' AS recommendation FROM documents",
)
def a6(spark, sf_dir):
    return ops.classify_dataset(table(spark, sf_dir, "documents"))


# A user's operator


@operator("price_band", column=Param("column", required=True), width=Param("number", default=100.0, min=1), replace=True)
def price_band(df, column, width):
    """The band of a price, by a pandas UDF."""

    @F.pandas_udf("bigint")
    def band(price: pd.Series) -> pd.Series:
        return (price // width).astype("int64")

    return df.withColumn("band", band(F.col(column)))


@query("n1_custom_operator", "SELECT p_partkey, CAST(floor(p_retailprice / 250) AS BIGINT) AS band FROM part")
def n1(spark, sf_dir):
    named = get_operator("price_band")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return named.run(part, **named.settings({"column": "p_retailprice", "width": 250})).drop("p_retailprice")
