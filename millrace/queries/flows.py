"""Pipelines run from their descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources
from ..functions.text import ENTITY, SPACE_BODY, SPACES, TAG, TAG_OR_EMPTY
from ..plans import FLOWS, run_pipeline
from ..plans.flows import flow
from ..scratch import scratch_path
from .catalog import query, sql_strip, sql_words, table
from .dedup import FP_GROUPS, NEAR, greedy_cte, simhash_cte
from .io import write_documents
from .text import chunk_sql


# How the input of a flow is written for its source, and how the output of its sink is read.
GIVEN = {
    "import_dataset": sources.write_jsonl,
    "load_csv": sources.write_csv,
    "load_json": write_documents,
    "load_jsonl": sources.write_jsonl,
}
RESULT = {"write_csv": sources.read_csv, "write_jsonl": sources.read_jsonl, "write_parquet": sources.read_parquet}


def _run(spark, name, frame):
    """Writes ``frame`` where a flow reads, runs its steps and reads what its sink wrote, in the types of ``frame``."""
    spec = FLOWS[name]
    first, last = spec["nodes"][0], spec["nodes"][-1]
    given, out = scratch_path(spark, f"{name}-in") + ".jsonl", scratch_path(spark, f"{name}-out")
    GIVEN[first["data"]["typeId"]](frame, given)
    run = run_pipeline(spark, spec, {"IN": given, "OUT": out, "ORDER": "doc_id"})
    before = next(e["source"] for e in spec["edges"] if e["target"] == last["id"])
    types = {**dict(run.frame(before).dtypes), **dict(frame.dtypes)}
    result = RESULT[last["data"]["typeId"]](spark, out)
    return result.select(*[F.col(c).cast(types[c]).alias(c) for c in result.columns])


def _html(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '{TAG}', '', 'g'), '{ENTITY}', '', 'g')"


@query(
    "g1_graph",
    "SELECT o_orderkey, lower(o_orderpriority) AS priority, o_totalprice FROM orders WHERE o_totalprice > 200000",
)
def g1(spark, sf_dir):
    nodes = [
        ("read", "load_parquet", {"path": "${DIR}/orders.parquet"}, False),
        ("columns", "select_columns", {"columns": "o_orderkey,o_orderpriority,o_totalprice"}, False),
        ("names", "rename_columns", {"mapping": '{"o_orderpriority": "priority"}'}, False),
        ("lower", "lowercase", {"column": "priority"}, False),
        ("skipped", "uppercase", {"column": "priority"}, True),
        ("rows", "filter_rows", {"column": "o_totalprice", "op": ">", "value": "${LIMIT}"}, False),
    ]
    spec = {
        "variables": {"LIMIT": "200000"},
        "nodes": [
            {"id": i, "type": "pipelineNode", "data": {"typeId": kind, "params": params, "disabled": off}}
            for i, kind, params, off in nodes
        ],
        "edges": [
            {"source": a[0], "target": b[0], "sourceHandle": "out", "targetHandle": "in"} for a, b in zip(nodes, nodes[1:])
        ],
    }
    return run_pipeline(spark, spec, {"DIR": sf_dir}).frame("rows")


TURNS = """
SELECT lower(u.text) AS instruction, u.role AS input, a.text AS output
FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'
"""


@query(
    "g2_alpaca",
    f"SELECT DISTINCT instruction, input, output FROM ({TURNS}) "
    f"WHERE {sql_strip('instruction')} <> '' AND {sql_strip('output')} <> ''",
)
def g2(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    users = turns.where("role = 'user'").select(
        "conv_id", F.col("turn") + 1, F.col("text").alias("instruction"), F.col("role").alias("input")
    )
    users = users.toDF("conv_id", "turn", "instruction", "input")
    answers = turns.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("output"))
    return _run(spark, "alpaca", users.join(answers, ["conv_id", "turn"], "left").drop("conv_id", "turn"))


CLEAN_PAGES = f"SELECT page_id AS doc_id, nfc_normalize(regexp_replace(html, '{TAG_OR_EMPTY}', '', 'g')) AS text FROM pages"


@query(
    "g3_fineweb",
    f"""
    WITH RECURSIVE {simhash_cte(CLEAN_PAGES)}, {FP_GROUPS}, near AS MATERIALIZED ({NEAR}),
    {greedy_cte('SELECT a, b FROM near', 'SELECT doc_id FROM fps')}
    SELECT p.doc_id, p.text FROM ({CLEAN_PAGES}) p JOIN kept ON p.doc_id = kept.doc_id
    """,
)
def g3(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return _run(spark, "fineweb", pages)


@query(
    "g4_tinystories",
    f"SELECT doc_id, regexp_replace(nfc_normalize(text), '{SPACES}', ' ', 'g') AS story FROM documents",
)
def g4(spark, sf_dir):
    return _run(spark, "tinystories", table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("story")))


@query(
    "g5_finetune",
    f"SELECT doc_id, nfc_normalize(lower(text)) AS text, coalesce(lang, '') AS lang FROM documents WHERE {sql_strip('text')} <> ''",
)
def g5(spark, sf_dir):
    return _run(spark, "finetune", table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query("g6_rag", chunk_sql(f"SELECT page_id AS doc_id, nfc_normalize({_html('html')}) AS text FROM pages", 500, 50, keep_text=True))
def g6(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return _run(spark, "rag", pages)


@query(
    "g7_sharegpt",
    f"SELECT conv_id, turn, role AS \"from\", regexp_replace(text, '{SPACES}', ' ', 'g') AS value FROM conversations",
)
def g7(spark, sf_dir):
    return _run(spark, "sharegpt", table(spark, sf_dir, "conversations"))


@query(
    "g8_ocr",
    f"""
    SELECT doc_id, text FROM (
        SELECT doc_id, regexp_replace(text, '[{SPACE_BODY}]*([.,?!])[{SPACE_BODY}]*', '\\1 ', 'g') AS text FROM documents)
    WHERE length(text) >= 200
    """,
)
def g8(spark, sf_dir):
    return _run(spark, "ocr", table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    "g9_common_crawl",
    f"""
    WITH clean AS (SELECT page_id AS doc_id, url, {_html('html')} AS html FROM pages)
    SELECT doc_id, url, html FROM clean
    WHERE list_has_any({sql_words('lower(html)')}, ['the', 'and', 'is', 'of', 'to', 'in', 'it', 'you', 'that'])
    QUALIFY row_number() OVER (PARTITION BY sha256(html) ORDER BY doc_id) = 1
    """,
)
def g9(spark, sf_dir):
    return _run(spark, "common_crawl", table(spark, sf_dir, "pages").withColumnRenamed("page_id", "doc_id"))


@query(
    "g10_tinystories_words",
    f"SELECT doc_id, text FROM (SELECT doc_id, {_html('text')} AS text FROM documents) WHERE len({sql_words('text')}) BETWEEN 50 AND 500",
)
def g10(spark, sf_dir):
    return _run(spark, "tinystories_words", table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("k7_dry_run", "SELECT p_partkey, p_name, upper(p_brand) AS p_brand, CAST(0 AS INTEGER) AS outputs FROM part")
def k7(spark, sf_dir):
    spec = flow(
        "dry",
        ("load_parquet", {"path": "${DIR}/part.parquet"}),
        ("uppercase", {"column": "p_brand"}),
        ("write_parquet", {"path": "${OUT}"}),
    )
    run = run_pipeline(spark, spec, {"DIR": sf_dir, "OUT": scratch_path(spark, "k7")}, dry_run=True)
    return run.frame("s1").select("p_partkey", "p_name", "p_brand", F.lit(len(run.outputs)).alias("outputs"))


@query("g1c_use_cache", "SELECT doc_id, text, lang, upper(source) AS source, n_chars, true AS reused FROM documents")
def g1c(spark, sf_dir):
    """The second of two runs, which reads the table that the first one left."""
    for _ in range(2):
        path = scratch_path(spark, "g1c")
        spec = flow("kept", ("load_parquet", {"path": "${DIR}/documents.parquet"}), ("uppercase", {"column": "source"}), ("write_parquet", {"path": path}))
        spec["nodes"][1]["data"]["use_cache"] = True
        run = run_pipeline(spark, spec, {"DIR": sf_dir})
    return spark.read.parquet(path).withColumn("reused", F.lit(run.reused == ["s1"]))


@query(
    "g1_shared_steps",
    "SELECT o_orderkey, o_totalprice, 'rows' AS sink, 1 AS shared FROM orders WHERE o_totalprice > 200000 "
    "UNION ALL SELECT o_orderkey, NULL, 'keys', 1 FROM orders WHERE o_totalprice > 200000",
)
def g1_shared(spark, sf_dir):
    """A filter that feeds two sinks."""
    rows, keys = scratch_path(spark, "g1_rows"), scratch_path(spark, "g1_keys")
    steps = {
        "read": ("load_parquet", {"path": "${DIR}/orders.parquet"}, None),
        "large": ("filter_rows", {"column": "o_totalprice", "op": ">", "value": 200000}, "read"),
        "columns": ("select_columns", {"columns": "o_orderkey,o_totalprice"}, "large"),
        "rows": ("write_parquet", {"path": rows}, "columns"),
        "key": ("select_columns", {"columns": "o_orderkey"}, "large"),
        "keys": ("write_parquet", {"path": keys}, "key"),
    }
    spec = {
        "nodes": [{"id": i, "type": "pipelineNode", "data": {"typeId": kind, "params": params}} for i, (kind, params, _) in steps.items()],
        "edges": [{"source": a, "target": i, "sourceHandle": "out", "targetHandle": "in"} for i, (_, _, a) in steps.items() if a],
    }
    run = run_pipeline(spark, spec, {"DIR": sf_dir})
    shared = F.lit(int(run.shared == ["large"]))
    whole = spark.read.parquet(rows).withColumns({"sink": F.lit("rows"), "shared": shared})
    return whole.unionByName(spark.read.parquet(keys).withColumns({"sink": F.lit("keys"), "shared": shared}), allowMissingColumns=True)


@query(
    "a5_step_metrics",
    """
    SELECT 's0' AS step, CAST(NULL AS BIGINT) AS rows_in, count(*) AS rows_out, CAST(NULL AS BIGINT) AS removed FROM orders
    UNION ALL
    SELECT 's1', count(*), count(*) FILTER (o_orderstatus = 'F'), count(*) - count(*) FILTER (o_orderstatus = 'F') FROM orders
    """,
)
def a5(spark, sf_dir):
    spec = flow(
        "counted",
        ("load_parquet", {"path": "${DIR}/orders.parquet"}),
        ("filter_rows", {"column": "o_orderstatus", "op": "==", "value": "F"}),
        ("write_parquet", {"path": "${OUT}"}),
    )
    run = run_pipeline(spark, spec, {"DIR": sf_dir, "OUT": scratch_path(spark, "a5")}, metrics=True)
    rows = [(m["step"], m["rows_in"], m["rows_out"], m["removed"]) for m in run.metrics()]
    return spark.createDataFrame(rows, "step string, rows_in bigint, rows_out bigint, removed bigint")
