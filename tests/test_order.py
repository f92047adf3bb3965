import hashlib

import pytest
from pyspark.sql import functions as F

from millrace import operators as ops
from millrace.operators import ordering
from millrace.scratch import written


def test_sort(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (None, "n"), (2, "b")], "id int, name string")
    assert [r.id for r in ops.sort_rows(df, "id").collect()] == [1, 2, 3, None]
    assert [r.id for r in ops.sort_rows(df, "id", ascending=False).collect()] == [None, 3, 2, 1]
    ties = spark.range(90).selectExpr("id % 2 AS k", "id")
    assert [r.k for r in ops.sort_rows(ties, "k").collect()] == [0] * 45 + [1] * 45


def test_sample(items, monkeypatch):
    df = items(100)

    def ids(n, seed, frame=df):
        return sorted(r.id for r in ops.sample_rows(frame, n, seed).collect())

    assert len(ids(10, 42)) == 10
    assert ids(10, 42) == ids(10, 42, df.repartition(7))
    assert ids(10, 42) != ids(10, 99)
    assert ids(100, 1) == ids(500, 1) == list(range(100))
    small = {n: ids(n, 42) for n in (0, 1, 10, 99, 100, 101)}
    assert {n: ids(n, 42) for n in small} == small
    expected = sorted(range(100), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
    assert ids(10, 42) == sorted(expected[:10])


def test_shuffle(items):
    df = items(200)
    expected = sorted(range(200), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
    for digits in (1, 2, 4):
        for parts in (1, 16):
            rows = ops.shuffle(df.repartition(parts), 42, digits=digits).orderBy("shuffle_pos").collect()
            assert [r.shuffle_pos for r in rows] == list(range(200))
            assert [r.id for r in rows] == expected


def test_split(items):
    for n, ratio, size in ((100, 0.8, 80), (50, 0.6, 30), (7, 0.5, 3), (10, 0.0, 0), (10, 1.0, 10)):
        train, test = ops.split_dataset(items(n), ratio, 42)
        train, test = ({r.id for r in side.collect()} for side in (train, test))
        assert (len(train), len(test)) == (size, n - size)
        assert train | test == set(range(n))
        placed = sorted(range(n), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
        assert train == set(placed[:size])
        again = ops.tag_split(items(n).repartition(5), ratio, 42, digits=1).where("split = 'train'")
        assert {r.id for r in again.collect()} == train
    with pytest.raises(ValueError):
        ops.split_dataset(items(10), 1.5)


def test_positions_and_batches(spark, monkeypatch):
    # Most rows share the first order column.
    rows = [(0 if i % 3 else i, (i * 37) % 101, i) for i in range(101)]
    df = spark.createDataFrame(rows, "k int, u int, v int").repartition(6)
    placed = ops.with_position(df, ["k", "u"]).orderBy("position").collect()
    assert [r.position for r in placed] == list(range(101))
    assert [(r.k, r.u) for r in placed] == sorted((r[0], r[1]) for r in rows)
    sizes = ops.batches(df, 20, ["k", "u"]).groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [tuple(r) for r in sizes] == [(0, 20), (1, 20), (2, 20), (3, 20), (4, 20), (5, 1)]
    first = [r.v for r in ops.head(df, 7, ["k", "u"]).collect()]
    assert len(first) == 7
    assert [r.v for r in ops.head(df, 7, ["k", "u"]).collect()] == first
    assert [r.v for r in ops.head(df, 7, ["k", "u"]).collect()] == first


def test_preview(items):
    shown = ops.preview(items(9), 2, "id")
    assert shown["columns"] == ["id", "name", "score", "category"]
    assert [r["id"] for r in shown["rows"]] == [0, 1]
    assert shown["row_count"] == 9 and shown["schema"]["score"] == "bigint"


def test_chain(items):
    shuffled = ops.shuffle(items(100), 42)
    train, test = ops.split_dataset(ops.sample_rows(shuffled, 50, 42), 0.8, 42)
    assert (train.count(), test.count()) == (40, 10)
    dropped = ops.drop_columns(ops.select_columns(items(10), ["id", "name", "score"]), ["score"])
    first = ops.sort_rows(dropped, "id", ascending=False).first()
    assert first.id == 9 and "score" not in first.asDict()


@pytest.mark.parametrize("short", [100_000, 20])
def test_head_and_sample_are_exact_with_nulls_and_ties(spark, monkeypatch, short):
    monkeypatch.setattr(ordering, "SHORT", short)
    rows = [(i, None if i < 10 else i % 3) for i in range(2500)]
    df = spark.createDataFrame(rows, "id bigint, v bigint")
    for n in (0, 1001, 2495, 3000):
        got = [r["v"] for r in ops.head(df, n, "v").collect()]
        assert got == sorted((v for _, v in rows), key=lambda v: (v is None, v))[:n]
        assert ops.sample_rows(df, n, key="v").count() == min(n, 2500)
    assert len(ops.preview(df, 1200, "v")["rows"]) == 1200


def test_head_of_many_columns_without_a_sort(spark, monkeypatch):
    """The cut is found in rounds; only what lies before it is sorted, and nothing is written but bounds."""
    monkeypatch.setattr(ordering, "SHORT", 30)
    tables = []
    monkeypatch.setattr(ordering, "written", lambda df, name: written(tables.append((name, df.columns)) or df, name))
    rows = [(None if i % 5 == 0 else f"k{i % 3}", (i * 7919) % 1000 if i % 4 else None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, u int, v int").repartition(6)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1] is None, r[1] or 0, r[2]))
    for n in (1, 5, 700, 2400, 2999):
        assert [tuple(r) for r in ops.head(df, n, ["k", "u", "v"]).collect()] == order[:n]
    assert {name for name, _ in tables} == {"splits"}


def test_positions_move_the_rows_once(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(ordering, "written", lambda df, name: written(tables.append((name, df.columns)) or df, name))
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k"), F.lit("wide").alias("w")).repartition(5)
    placed = ops.with_position(df, "k", "p")
    assert all("w" not in columns for _, columns in tables)
    assert {r.k: r.p for r in placed.collect()} == {k: k for k in range(5000)}
    assert ops.with_position(df.limit(0), "k").count() == 0


@pytest.mark.parametrize("count", [0, 1, 2, 7, 8, 9])
def test_runs_are_found_by_halving(spark, count):
    """Compiled steps, no walk over the splits for each row."""
    splits = spark.createDataFrame([([(i * 3, "m") for i in range(count)],)], "splits array<struct<a:int,b:string>>")
    rows = spark.range(-2, 30).select(F.col("id").cast("int").alias("a"), F.when(F.col("id") % 2 == 0, "z").alias("b"))
    found = ordering._with_run(rows, splits, F.struct("a", "b"), 9)
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    for r in found.collect():
        assert r._run == sum(1 for i in range(count) if (i * 3, "m") < (r.a, r.b or ""))
    assert found.columns == ["a", "b", "_run"]
