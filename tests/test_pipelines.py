import json

import pytest
from pyspark.sql import functions as F

from millrace import operators as ops
from millrace.plans import FLOWS, Param, check_pipeline, flow, get_operator, operator, operators, run_pipeline


def node(i, kind, params=None, **data):
    return {"id": i, "type": "pipelineNode", "data": {"typeId": kind, "params": params or {}, **data}}


def edge(a, b, **handles):
    return {"source": a, "target": b, **handles}


def lines(path):
    return [json.loads(x) for p in sorted(path.glob("*.json")) for x in p.read_text("utf-8").splitlines()]


def test_alpaca(spark, tmp_path):
    row = {"instruction": "Say HI", "input": "", "output": "hi"}
    (tmp_path / "in.json").write_text(json.dumps([row, row, {"instruction": "  ", "input": "", "output": "x"}]))
    run = run_pipeline(spark, FLOWS["alpaca"], {"IN": str(tmp_path / "in.json"), "OUT": str(tmp_path / "out")}, metrics=True)
    assert lines(tmp_path / "out") == [{"instruction": "say hi", "input": "", "output": "hi"}]
    assert [h["name"] for h in run.history] == ["import_dataset", "lowercase", "remove_empty", "dedup_exact", "write_jsonl"]
    assert run.history[1]["parameters"] == {"column": "instruction"}
    assert [(m["step"], m["rows_in"], m["rows_out"], m["removed"]) for m in run.metrics()] == [
        ("s0", None, 3, None),
        ("s1", 3, 3, 0),
        ("s2", 3, 2, 1),
        ("s3", 2, 1, 1),
    ]
    assert run.outputs == [{"step": "s4", "operator": "write_jsonl", "path": str(tmp_path / "out")}]


def test_tinystories(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps([{"story": "  Once   upon\n a time "}, {"story": "café"}]))
    run_pipeline(spark, FLOWS["tinystories"], {"IN": str(tmp_path / "in.json"), "OUT": str(tmp_path / "out")})
    assert lines(tmp_path / "out") == [{"story": " Once upon a time "}, {"story": "café"}]


def test_csv_lowercase(spark, tmp_path):
    (tmp_path / "in.csv").write_text("text,category\n  HÉLLO WORLD  ,A\nX,B\n", encoding="utf-8")
    spec = flow("f", ("load_csv", {"path": "${IN}"}), ("lowercase", {"column": "text"}), ("write_jsonl", {"path": "${OUT}"}))
    variables = {"IN": str(tmp_path / "in.csv"), "OUT": str(tmp_path / "out")}
    run_pipeline(spark, json.dumps(spec), variables, dry_run=True)
    assert not (tmp_path / "out").exists()
    run_pipeline(spark, json.dumps(spec), variables)
    assert lines(tmp_path / "out")[0]["text"] == "  héllo world  "


@pytest.mark.parametrize("name", sorted(FLOWS))
def test_flows_are_valid(name):
    assert check_pipeline(FLOWS[name], {"IN": "a.csv", "OUT": "b", "ORDER": "id"}) == ([], [])


def test_branches_ports_and_disabled(spark, items):
    spec = {
        "nodes": [
            node("in", "load_parquet", {"path": "x"}),
            node("parts", "split_dataset", {"ratio": 0.7}, use_cache=True),
            node("up", "uppercase", {"column": "name"}, disabled=True),
            node("all", "concatenate"),
            node("with", "join_rows", {"join_key": "id"}),
            {"id": "note", "type": "commentNode", "data": {"comment": "hello"}},
        ],
        "edges": [
            edge("in", "parts", sourceHandle="out", targetHandle="in"),
            edge("parts", "up", sourceHandle="train"),
            edge("up", "all", targetHandle="a"),
            edge("parts", "all", sourceHandle="test", targetHandle="b"),
            edge("all", "with"),
            edge("in", "with"),
        ],
    }
    run = run_pipeline(spark, spec, frames={"in": items(10)})
    assert run.frame("parts", "train").count() == 7 and run.frame("parts", "test").count() == 3
    assert {r.name for r in run.frame("all").collect()} == {f"ware {i:03d}" for i in range(10)}
    assert run.frame("with").count() == 10 and "name_right" in run.frame("with").columns


def test_problems(spark):
    def found(nodes, edges=(), **more):
        return check_pipeline({"nodes": nodes, "edges": list(edges), **more})

    ok = node("a", "load_csv", {"path": "x"})
    assert "no steps" in found([])[0][0]
    assert "more than once" in found([ok, ok])[0][0]
    assert "unknown operator 'nope'" in found([node("a", "nope")])[0][0]
    assert "unknown step" in found([ok], [edge("a", "b")])[0][0]
    assert "not connected" in found([ok, node("b", "lowercase")])[0][0]
    assert "not connected to any other" in found([ok, node("b", "load_csv", {"path": "y"})])[1][0]
    assert "needed" in found([node("a", "load_csv")])[0][0]
    loop = [node("a", "lowercase"), node("b", "uppercase")]
    assert any("cycle" in p for p in found(loop, [edge("a", "b"), edge("b", "a")])[0])
    assert "more connections" in found([ok, node("b", "lowercase")], [edge("a", "b"), edge("a", "b")])[0][0]
    with pytest.raises(ValueError, match="Variable 'X' is not set"):
        found([node("a", "load_csv", {"path": "${X}/y"})])
    with pytest.raises(ValueError, match="Invalid pipeline"):
        run_pipeline(spark, {"nodes": [node("a", "nope")], "edges": []})


def test_parameter_kinds():
    cases = [
        (Param("number", min=1, max=5), [1, 2.5, 5], [0, 6, "2", True]),
        (Param("slider", min=0.0, max=1.0), [0, 0.5], [1.5]),
        (Param("boolean"), [True], ["yes", 1]),
        (Param("select", options=("a", "b")), ["a"], ["c"]),
        (Param("regex"), [r"\d+"], ["("]),
        (Param("json"), ['{"a": 1}', {"a": 1}], ["{a"]),
        (Param("text", required=True), ["x"], [None]),
    ]
    for param, good, bad in cases:
        assert all(param.problem("p", v) is None for v in good)
        assert all(param.problem("p", v) for v in bad)
    with pytest.raises(ValueError, match="Unknown parameter kind"):
        Param("date")
    with pytest.raises(ValueError, match="unknown"):
        get_operator("lowercase").settings({"colunm": "x"})


def test_user_operators(spark, items):
    @operator("top_per_category", replace=True, n=Param("number", default=1, min=1))
    def top(df, n):
        """The best rows of each category."""

        def best(group):
            return group.nlargest(n, "score")

        return df.groupBy("category").applyInPandas(best, df.schema)

    assert "top_per_category" in operators()
    spec = flow("f", ("load_csv", {"path": "x"}), ("top_per_category", {"n": 2}))
    run = run_pipeline(spark, spec, frames={"s0": items(10)})
    assert sorted(r.id for r in run.frame("s1").collect()) == [1, 2, 4, 6, 8, 9]
    with pytest.raises(ValueError, match="exists already"):
        operator("lowercase")(top)


def test_flow_equals_direct_calls(spark, texts):
    df = texts(["<b>a  b</b>", "<i>a  b</i>", "other words here", None])
    run = run_pipeline(
        spark, FLOWS["fineweb"], {"IN": "x", "OUT": "y", "ORDER": "id"}, dry_run=True, frames={"s0": df.withColumnRenamed("t", "text")}
    )
    direct = ops.simhash_deduplicate(ops.unicode_normalize(ops.strip_tags(df, "t"), "t"), "t", 3, "id")
    assert sorted(r.id for r in run.frame("s3").collect()) == sorted(r.id for r in direct.collect())


def test_plans_use_arrow_udfs_only(spark, texts, capsys):
    df = texts(["a"])
    for frame in (
        ops.unicode_normalize(df, "t"),
        ops.simhash(df, "t"),
        ops.minhash(df, "t"),
        ops.regex_replace(df, "t", r"[^\S\n]"),
    ):
        frame.explain()
        plan = capsys.readouterr().out
        assert "ArrowEvalPython" in plan and "BatchEvalPython" not in plan
    ops.regex_replace(df, "t", r"\s+\w").where(F.col("t") != "").explain()
    assert "EvalPython" not in capsys.readouterr().out


def test_metrics_of_a_dry_run_do_not_wait(spark, items):
    spec = {"nodes": [node("a", "load_parquet", {"path": "x"}), node("b", "lowercase", {"column": "name"}), node("c", "write_jsonl", {"path": "/nowhere"})], "edges": [edge("a", "b"), edge("b", "c")]}
    run = run_pipeline(spark, spec, frames={"a": items(3)}, dry_run=True, metrics=True)
    assert run.metrics() == []


def test_a_step_before_two_sinks_runs_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @operator("counted_rows", replace=True)
    def counted_rows(df):
        def count(batches):
            for batch in batches:
                seen.add(len(batch))
                yield batch

        return df.mapInPandas(count, df.schema)

    spark.range(100).write.json(str(tmp_path / "in"))
    nodes = [
        node("in", "load_jsonl", {"path": str(tmp_path / "in")}), node("count", "counted_rows"),
        node("a", "write_parquet", {"path": str(tmp_path / "a")}), node("b", "write_jsonl", {"path": str(tmp_path / "b")}),
    ]
    spec = {"nodes": nodes, "edges": [edge("in", "count"), edge("count", "a"), edge("count", "b")]}
    run = run_pipeline(spark, spec, metrics=True)
    assert run.shared == ["count"] and seen.value == 100
    assert spark.read.parquet(str(tmp_path / "a")).count() == spark.read.json(str(tmp_path / "b")).count() == 100
    assert {m["step"]: m["rows_out"] for m in run.metrics()} == {"in": 100, "count": 100}
    assert run_pipeline(spark, spec, dry_run=True).shared == []


def test_use_cache_across_runs(spark, tmp_path, items):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(column="name", **more):
        nodes = [node("in", "load_parquet", {"path": source}), node("up", "uppercase", {"column": column}, use_cache=True), node("out", "write_parquet", {"path": out})]
        return run_pipeline(spark, {"nodes": nodes, "edges": [edge("in", "up"), edge("up", "out")]}, **more)

    items(5).write.parquet(source)
    assert run().reused == [] and run().reused == ["up"] and run("category").reused == []
    items(7).write.mode("append").parquet(source)
    assert run().reused == [] and spark.read.parquet(out).count() == 12
    assert run().reused == ["up"] and run(metrics=True).metrics()[-1]["rows_out"] == 12
    # Rows that come from no file, and a sink that fails: nothing stays in the session.
    kept = run_pipeline(spark, {"nodes": [node("up", "uppercase", {"column": "name"}, use_cache=True)], "edges": []}, frames={"up": items(3)})
    assert kept.reused == [] and not kept.frame("up").is_cached
    with pytest.raises(Exception):
        nodes = [node("in", "load_parquet", {"path": source}), node("up", "uppercase", {"column": "name"}, use_cache=True), node("out", "write_parquet", {"path": "nofs://x"})]
        run_pipeline(spark, {"nodes": nodes, "edges": [edge("in", "up"), edge("up", "out")]}, metrics=True)


def test_fingerprints_pairs_and_streams_by_name(spark, texts, tmp_path):
    def through(kind, params, df):
        spec = flow("f", ("load_parquet", {"path": "x"}), (kind, params))
        return run_pipeline(spark, spec, frames={"s0": df}).frame("s1")

    df = texts(["a b c d", "a b c d", "other words", None])
    assert "fp" in through("simhash", {"column": "t", "output_column": "fp"}, df).columns
    assert through("minhash", {"column": "t"}, df).schema["minhash"].dataType.simpleString().startswith("array")
    assert through("near_dup_pairs", {"column": "t", "order_by": "id"}, df).columns[:2] == ["id_a", "id_b"]
    assert "similarity" in through("minhash_pairs", {"column": "t", "order_by": "id"}, df).columns
    assert {r.data_type for r in through("vote_types", {}, df).collect()} == {"integer", "string"}

    rows = [("a", 1, "2024-01-01 00:10:00"), ("a", 2, "2024-01-01 00:05:00"), ("z", 0, "2024-02-01 00:00:00")]
    spark.createDataFrame(rows, "k string, n int, ts string").coalesce(1).write.json(str(tmp_path / "in"))
    settings = {"keys": "k", "time_column": "ts", "watermark": "1 hour", "first": True}
    spec = flow(
        "s", ("load_stream", {"path": str(tmp_path / "in"), "schema": "k string, n int, ts timestamp"}), ("dedup_stream", settings),
        ("write_stream", {"path": str(tmp_path / "out"), "checkpoint": str(tmp_path / "cp")}),
    )
    run_pipeline(spark, spec)
    assert [(r.k, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 2)]
    assert any("schema" in p for p in check_pipeline(flow("s", ("load_stream", {"path": "x"})))[0])


def test_split_csv_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"x\ny"\n2\n')
    spec = flow("f", ("load_csv", {"path": str(tmp_path / "a.csv"), "split": True}))
    assert sorted((r.id, r.t) for r in run_pipeline(spark, spec).frame("s0").collect()) == [("1", "x\ny"), ("2", None)]
