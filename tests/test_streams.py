import pytest
from pyspark.sql import functions as F

from millrace import operators as ops
from millrace import sources
from millrace.streaming import streams
from millrace.streaming import dedup_stream, first_stream, read_batches, run_available, write_batches

SCHEMA = "k string, n int, ts timestamp_ntz"


@pytest.fixture
def feed(spark, tmp_path):
    """A stream of one file per trigger over the given lists of rows (k, n, minute)."""

    def make(*files):
        for i, rows in enumerate(files):
            df = spark.createDataFrame(rows, "k string, n int, m int")
            df.select("k", "n", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,m,0)").alias("ts")).coalesce(
                1
            ).write.mode("append").parquet(str(tmp_path / "in"))
        return sources.read_stream(spark, str(tmp_path / "in"), "parquet", spark.createDataFrame([], SCHEMA).schema, 1)

    return make


def test_stateless(spark, feed, tmp_path):
    stream = feed([("a ", 1, 0), (" ", 2, 0)], [("b", 3, 5)])
    clean = ops.uppercase(ops.remove_empty(stream, "k"), "k")
    run_available(clean.transform(ops.strip_whitespace, "k"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted((r.k, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("A", 1), ("B", 3)]


@pytest.mark.parametrize("combine", [True, False])
def test_dedup(spark, feed, tmp_path, combine):
    stream = feed([("a", 1, 0), ("a", 2, 1), ("b", 1, 2)], [("a", 3, 30), ("c", 1, 31)], [("b", 4, 40), ("d", 1, 41)])
    run_available(dedup_stream(stream, "k", "ts", "1 hour", combine), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c", "d"]


def test_batches_are_not_doubled(spark, feed, tmp_path):
    stream = feed([("a", 1, 0)], [("b", 2, 0)])
    write_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    write_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_batch_only_operators(feed):
    stream = feed([("a", 1, 0)])
    for operator in (
        lambda d: ops.sort_rows(d, "n"),
        lambda d: ops.sample_rows(d, 1, key="n"),
        lambda d: ops.shuffle(d, key="n"),
        lambda d: ops.split_dataset(d, key="n"),
        lambda d: ops.simhash_deduplicate(d, "k", order_by="n"),
        lambda d: ops.dedup_exact(d),
        lambda d: ops.column_statistics(d),
    ):
        with pytest.raises(ValueError, match="stream"):
            operator(stream)


def test_batch_combine_keeps_exact_keys(spark):
    from millrace.streaming.streams import _latest_per_key

    schema = "k bigint, a array<int>, t timestamp"
    rows = spark.sql(
        "SELECT * FROM VALUES (10L * 100000000000000000 + 1, array(1), timestamp'2024-01-01'), "
        "(10L * 100000000000000000 + 2, array(1), timestamp'2024-01-01'), (null, array(2), null), "
        "(null, array(2), timestamp'2024-01-02'), (null, null, timestamp'2024-01-03') AS x(k, a, t)"
    )
    found = rows.coalesce(1).mapInArrow(_latest_per_key(["k", "a"], "t"), schema).collect()
    assert len(found) == 4 and sum(r["k"] is None for r in found) == 2


def test_first_copy_by_event_time(spark, feed, tmp_path):
    """An earlier copy that arrives later stays; copies that come while the key is known are dropped, then it begins anew."""
    stream = feed(
        [("a", 1, 10), ("b", 2, 11)],
        [("a", 3, 5), ("b", 4, 30)],
        [("a", 5, 40), ("c", 6, 80), ("e", 12, None)],
        [("b", 7, 95), ("c", 8, 81), ("d", 9, 200)],
        [("a", 10, 210), ("a", 11, 205), ("z", 0, 5000)],
        [("z", 0, 9000)],
    )
    run_available(first_stream(stream, "k", "ts", "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")).collect()
    assert sorted((r.k, r.n) for r in rows if r.k != "z") == [("a", 3), ("a", 11), ("b", 2), ("c", 6), ("d", 9)]
    assert {r.n: r.ts.minute for r in rows if r.n == 3} == {3: 5}


def test_first_copy_keeps_values_exact(spark, tmp_path):
    schema = "k array<string>, big bigint, f double, t timestamp, b binary, s struct<x:int,y:string>"
    rows = spark.sql(
        "SELECT * FROM VALUES (array('a', null), 9007199254740993, 0.1D, timestamp'2024-01-01 00:00:00.123456', X'00FF', named_struct('x', 1, 'y', 'é')), "
        "(array('a', null), null, 1.5D, timestamp'2024-01-01 00:00:00.123457', null, null), "
        "(null, 1, double('NaN'), timestamp'2024-01-02 00:00:00', null, null), "
        "(array('end'), 0, 0D, timestamp'2034-01-02 00:00:00', null, null) AS v(k, big, f, t, b, s)"
    )
    rows.write.parquet(str(tmp_path / "in"))
    stream = sources.read_stream(spark, str(tmp_path / "in"), "parquet", rows.schema)
    run_available(first_stream(stream, "k", "t", "1 day"), str(tmp_path / "out"), str(tmp_path / "cp"))
    found = spark.read.schema(schema).parquet(str(tmp_path / "out")).orderBy("t").collect()
    assert len(found) == 2 and found[0].big == 9007199254740993 and found[0].f == 0.1 and bytes(found[0].b) == b"\x00\xff"
    assert found[0].t.microsecond == 123456 and found[0].s.y == "é" and found[0].k == ["a", None] and found[1].f != found[1].f


def test_batches_that_fail_are_never_seen(spark, feed, tmp_path):
    stream = feed([("a", 1, 0), ("b", 2, 1)], [("c", 3, 2)])
    calls = []

    def save(batch, folder):
        calls.append(folder)
        sources.write_parquet(batch, folder)
        if len(calls) == 2:
            raise OSError("gone")

    schema = "k string, n int, ts timestamp_ntz"
    assert read_batches(spark, str(tmp_path / "out"), schema).count() == 0
    with pytest.raises(Exception, match="gone"):
        write_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp"), save).awaitTermination()
    assert sorted(r.n for r in read_batches(spark, str(tmp_path / "out"), schema).collect()) == [1, 2]
    write_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp"), save).awaitTermination()
    found = read_batches(spark, str(tmp_path / "out"), schema).collect()
    assert sorted((r.n, r.batch_id) for r in found) == [(1, 0), (2, 0), (3, 1)] and len(calls) == 3


@pytest.mark.parametrize("buckets", [1, 3])
def test_first_copies_of_keys_in_one_bucket(spark, feed, tmp_path, monkeypatch, buckets):
    """Keys that share a state are held, given out and forgotten each by its own times."""
    monkeypatch.setattr(streams, "BUCKETS", buckets)
    stream = feed(
        [("a", 1, 10), ("b", 2, 11)],
        [("a", 3, 5), ("b", 4, 30)],
        [("a", 5, 40), ("c", 6, 80), ("e", 12, None)],
        [("b", 7, 95), ("c", 8, 81), ("d", 9, 200)],
        [("a", 10, 210), ("a", 11, 205), ("z", 0, 5000)],
        [("z", 0, 9000)],
    )
    run_available(first_stream(stream, "k", "ts", "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")).collect()
    assert sorted((r.k, r.n) for r in rows if r.k != "z") == [("a", 3), ("a", 11), ("b", 2), ("c", 6), ("d", 9)]
