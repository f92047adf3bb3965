import re

import pytest
from pyspark.sql import functions as F

from millrace import operators as ops


@pytest.fixture(scope="module")
def staff(spark):
    rows = [(3, "Charlie", "Dev"), (1, "Alice", "Design"), (2, "Bob", "Dev")]
    return spark.createDataFrame(rows, "id bigint, name string, role string")


def test_columns(staff, items):
    assert ops.select_columns(staff, ["id", "name"]).columns == ["id", "name"]
    assert ops.select_columns(staff, "role, id").columns == ["role", "id"]
    renamed = ops.rename_columns(staff, {"name": "full_name"})
    assert renamed.columns == ["id", "full_name", "role"]
    assert renamed.first().full_name == "Charlie"
    assert ops.drop_columns(items(5), ["score", "category"]).columns == ["id", "name"]
    assert ops.drop_columns(items(3), "category").orderBy("id").first().asDict() == {"id": 0, "name": "ware 000", "score": 0}
    for operator in (ops.drop_columns, ops.select_columns):
        with pytest.raises(ValueError, match="No such column: 'x'"):
            operator(staff, ["x"])
    with pytest.raises(ValueError, match="same name"):
        ops.rename_columns(staff, {"name": "role"})


def test_computed_columns(spark, column):
    df = spark.createDataFrame([(1, "a.b.c", 2), (2, "a", None), (3, None, 4)], "id int, t string, n int")
    assert column(ops.map_expr(df, "id + n", "s"), "s") == [3, None, 7]
    assert column(ops.split_col(df, "t", "."), "t") == [["a", "b", "c"], ["a"], None]
    named = ops.split_col(df, "t", ".", ["x", "y"])
    assert [column(named, c) for c in ("x", "y")] == [["a", "a", None], ["b", None, None]]
    suffixed = {r.id: (r.t, r.n) for r in ops.append_suffix(df, "!").collect()}
    assert suffixed == {"1!": ("a.b.c!", "2!"), "2!": ("a!", None), "3!": (None, "4!")}


def test_filter_operators(spark, column):
    rows = [(1, 5, "x"), (2, None, "  "), (3, 7, None), (4, 9, "xy")]
    df = spark.createDataFrame(rows, "id int, n bigint, t string")

    def kept(name, operator, value=None):
        return column(ops.filter_rows(df, name, operator, value), "id")

    assert kept("n", "==", 5) == kept("n", "eq", "5") == [1]
    assert kept("n", "==", None) == [2]
    assert kept("n", "!=", 5) == [2, 3, 4]
    assert kept("n", "neq", None) == [1, 3, 4]
    assert kept("n", ">", 5) == kept("n", "gt", "5.5") == [3, 4]
    assert kept("n", ">=", 7) == [3, 4]
    assert kept("n", "<", 7) == [1]
    assert kept("n", "lte", 7) == [1, 3]
    assert kept("t", "contains", "x") == [1, 4]
    assert kept("n", "in", 9) == [4]
    assert kept("t", "not_null") == [1, 4]
    assert kept("t", "is_null") == [2, 3]
    assert kept("n", "null") == [2]
    with pytest.raises(ValueError, match="No comparison"):
        kept("n", "~", 1)
    with pytest.raises(ValueError):
        kept("n", ">", "five")


def test_reference_filters(staff, items):
    assert ops.filter_rows(staff, "role", "==", "Dev").count() == 2
    assert ops.filter_expr(items(10), "category = 'wood' and score > 1").count() == 2


def test_text_filters(spark, texts, column):
    df = texts(["Hello World", None, "", "a b c", "12 Ü"])
    assert column(ops.length_filter(df, "t", 4, 5), "id") == [3, 4]
    assert column(ops.length_filter(df, "t", 3, unit="words"), "id") == [3]
    assert column(ops.remove_empty(df, "t"), "id") == [0, 3, 4]
    assert column(ops.search_text(df, "t", r"\d+\s"), "id") == [4]
    assert column(ops.search_text(df, "t", "o W", regex=False), "id") == [0]
    hit, miss = ops.regex_partition(df, "t", "WORLD|^$", case_insensitive=True)
    assert (column(hit, "id"), column(miss, "id")) == ([0, 1, 2], [3, 4])
    scores = spark.createDataFrame([("92.5",), ("78.1",), ("x",), (None,), ("88.0",)], "score string")
    assert ops.min_threshold(scores, "score", 80).count() == 2


def test_concatenate(spark, items):
    assert ops.concatenate(items(5), items(5)).count() == 10
    one, two = (spark.createDataFrame(rows, "x bigint") for rows in ([(1,), (2,)], [(3,), (4,)]))
    assert sorted(r.x for r in ops.concatenate(one, two).collect()) == [1, 2, 3, 4]
    text = spark.createDataFrame([("z", 5)], "x string, y int")
    mixed = ops.concatenate(one, text)
    assert mixed.columns == ["x", "y"]
    assert {(r.x, r.y) for r in mixed.collect()} == {("1", None), ("2", None), ("z", 5)}


def test_joins(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    right = spark.createDataFrame([(2, "B"), (3, "C"), (None, "D")], "k int, v string")

    def joined(how, skewed):
        frame = ops.join_rows(left, right, "k", how, skewed)
        assert frame.columns == ["k", "v", "v_right"]
        return sorted((tuple(r) for r in frame.collect()), key=repr)

    both, lefts, rights = [(2, "b", "B")], [(1, "a", None), (None, "c", None)], [(3, None, "C"), (None, None, "D")]
    for skewed in (False, True):
        assert joined("inner", skewed) == both
        assert joined("left", skewed) == sorted(both + lefts, key=repr)
        assert joined("right", skewed) == sorted(both + rights, key=repr)
        assert joined("outer", skewed) == sorted(both + lefts + rights, key=repr)
    with pytest.raises(ValueError):
        ops.join_rows(left, right, "k", "cross")


def test_statistics(spark):
    rows = [(1, 2.0, "a", True), (2, None, "a", None), (3, 4.0, None, False)]
    df = spark.createDataFrame(rows, "i int, d double, s string, b boolean")
    for approx in (False, True):
        stats = {r["column"]: r for r in ops.column_statistics(df, approx).collect()}
        assert [(s["count"], s["nulls"], s["unique"]) for s in map(stats.get, "idsb")] == [
            (3, 0, 3),
            (3, 1, 3),
            (3, 1, 2),
            (3, 1, 3),
        ]
        assert (stats["d"]["min"], stats["d"]["max"], stats["d"]["mean"]) == (2.0, 4.0, 3.0)
        assert stats["s"]["min"] is None and stats["b"]["mean"] is None


def test_profiles(spark, items):
    df = spark.createDataFrame([(1, " "), (2, None), (3, "x")], "id int, prompt string")
    assert {r["column"]: r.blanks for r in ops.blank_counts(df).collect()} == {"id": 0, "prompt": 2}
    summary = ops.dataset_summary(df).first()
    assert (summary.row_count, summary.column_count, summary.null_counts) == (3, 2, {"id": 0, "prompt": 2})
    assert ops.classify_dataset(df.withColumn("Response", F.lit("y"))).first().type == "Instruction Tuning"
    assert ops.classify_dataset(df.withColumn("messages", F.lit("y"))).first().type == "Multi-turn Chat"
    assert ops.classify_dataset(df).first().type == "Tabular Data"
    schema = {r["column"]: (r.data_type, r.nullable) for r in ops.infer_schema(df).collect()}
    assert schema == {"id": ("integer", False), "prompt": ("string", True)}
    text = spark.createDataFrame([("1", "1.5", "true", "x", ""), ("2", "3", "FALSE", "1", " ")], "a string, b string, c string, d string, e string")
    votes = {r["column"]: r.data_type for r in ops.vote_types(text).collect()}
    assert votes == {"a": "integer", "b": "float", "c": "boolean", "d": "string", "e": "string"}
    report = ops.dedup_report(items(10), items(4)).first()
    assert tuple(report) == (10, 4, 6, 60.0)


def test_plans_push_filters_and_prune(spark, tmp_path, capsys, items):
    items(10).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    ops.filter_rows(df, "score", ">", 30).select("id").explain()
    plan = capsys.readouterr().out
    assert re.search(r"PushedFilters: \[.*GreaterThan\(score,30\)", plan)
    assert "ReadSchema: struct<id:bigint,score:bigint>" in plan
