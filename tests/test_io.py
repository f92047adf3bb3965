import csv
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace import scratch, sources
from millrace.functions.slices import SLICE_ROWS
from millrace.queries.io import _document

HARD = [("1", 'say "hi", you'), ("2", "two\nlines"), ("3", " padded "), ("4", ""), ("5", "NULL"), ("6", "back\\slash"), ("7", "ünï")]


@pytest.fixture
def codes(spark):
    return spark.createDataFrame([("A101", 10), ("B202", 20)], "code string, val bigint")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("extension", ["json", "jsonl", "parquet", "csv", "tsv"])
def test_round_trip(spark, codes, tmp_path, extension):
    path = str(tmp_path / f"out.{extension}")
    sources.save(codes, path)
    sources.save(codes, path)  # overwrites
    back = sources.import_dataset(spark, path, format="jsonl" if extension == "json" else None)
    text = extension in ("csv", "tsv")
    assert rows(back) == [("A101", "10" if text else 10), ("B202", "20" if text else 20)]


def test_csv_cells(spark, tmp_path):
    df = spark.createDataFrame(HARD, "id string, t string")
    for gzip in (False, True):
        path = str(tmp_path / f"csv{gzip}")
        sources.write_csv(df, path, ";", gzip)
        assert rows(sources.read_csv(spark, path, ";")) == HARD


def test_csv_files(spark, tmp_path):
    file = tmp_path / "in.csv"
    file.write_text("a,b,c\n1,2,3\n\n4,5\n6,,7\n", encoding="utf-8")
    assert rows(sources.read_csv(spark, str(file))) == [("1", "2", "3"), ("4", "5", ""), ("6", "", "7")]
    kept = sources.read_csv(spark, str(file), keep_nulls=True)
    assert kept.where("c is null").count() == 1
    assert kept.dtypes == [("a", "string"), ("b", "string"), ("c", "string")]
    strict = sources.read_csv_strict(spark, str(file), ["a", "b", "c"])
    assert rows(strict) == [("1", "2", "3"), ("6", "", "7")]
    assert strict.select("a").count() == 2
    (tmp_path / "latin.csv").write_bytes("a\nü\n".encode("latin-1"))
    assert rows(sources.read_csv(spark, str(tmp_path / "latin.csv"), encoding="iso-8859-1")) == [("ü",)]
    (tmp_path / "odd.data").write_text("a|b\n1|2\n")
    assert rows(sources.import_dataset(spark, str(tmp_path / "odd.data"), delimiter="|")) == [("1", "2")]


@pytest.mark.parametrize(
    "document, root_key, expected",
    [
        ([{"a": 1}, {"a": 2}], "", [(1,), (2,)]),
        ({"data": [{"a": 1}, {"a": 2}], "n": 5}, "", [(1,), (2,)]),
        ({"mine": [{"a": 3}], "data": [{"a": 1}]}, "mine", [(3,)]),
        ({"items": [{"a": 4}], "stories": [{"a": 5}]}, "", [(4,)]),
        ({"data": [{"a": 1}]}, "absent", [(1,)]),
        ({"a": 7}, "", [(7,)]),
    ],
)
def test_json_documents(spark, tmp_path, document, root_key, expected):
    (tmp_path / "d.json").write_text(json.dumps(document, indent=2))
    assert rows(sources.import_dataset(spark, str(tmp_path / "d.json"), root_key=root_key)) == expected


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "ü"), (2, "x", None)], "a int, b string, c string")
    sources.write_jsonl(df, str(tmp_path / "o"))
    lines = [json.loads(x) for p in (tmp_path / "o").glob("*.json") for x in p.read_text("utf-8").splitlines()]
    assert sorted(lines, key=lambda r: r["a"]) == [{"a": 1, "b": None, "c": "ü"}, {"a": 2, "b": "x", "c": None}]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n{"a": \n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        sources.read_jsonl(spark, str(tmp_path / "bad.jsonl"), schema="a int").collect()
    with pytest.raises(Exception, match="(?i)path"):
        sources.import_dataset(spark, str(tmp_path / "none.parquet"))


def test_partitioned_parquet(spark, items, tmp_path):
    sources.write_parquet(items(10), str(tmp_path / "p"), ["category"])
    assert {p.name for p in (tmp_path / "p").iterdir() if p.is_dir()} == {"category=wood", "category=iron", "category=__HIVE_DEFAULT_PARTITION__"}
    assert sources.read_parquet(spark, str(tmp_path / "p")).where("category = 'wood'").count() == 4


def test_sql_objects_images(spark, items, tmp_path):
    items(10).createOrReplaceTempView("some_items")
    assert sources.read_sql(spark, "SELECT id FROM some_items WHERE score >= 2").count() == 5
    with pytest.raises(ValueError, match="bounds"):
        sources.read_sql(spark, "SELECT 1", "jdbc:x:y", partition_column="id")
    for name in ("a/one.png", "a/two.JPG", "b/three.jpeg", "four.txt", "five.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"abc")
    listed = sources.list_objects(spark, str(tmp_path))
    assert listed.columns == ["path", "length", "modificationTime"] and listed.count() == 5
    assert sources.list_objects(spark, str(tmp_path), prefix="a/").count() == 2
    assert [r.name for r in sources.read_images(spark, str(tmp_path)).collect()] == ["five.png"]
    every = sources.read_images(spark, str(tmp_path), recursive=True)
    assert rows(every.select("name", F.col("content").cast("string"))) == [("five.png", "abc"), ("one.png", "abc"), ("three.jpeg", "abc")]


def test_scratch_follows_the_session(spark):
    root = scratch.scratch_root(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or root == configured.rstrip("/")
    written = scratch.written(spark.range(5), "t")
    assert root.removeprefix("file:") in written.inputFiles()[0]


def _cells(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("split", [60, 333, 1 << 20])
def test_csv_with_line_breaks_is_read_in_splits(spark, tmp_path, split):
    """One file in many splits, cells over several of them, equals the read by one task."""
    rng = random.Random(split)
    parts = ["a", "b,c", 'say "x"', "", "line\nbreak", "\n\n", "ü\r\nwin", "x" * 150, "many\n" * 60]
    rows = [[str(i), *(rng.choice(parts) for _ in range(2)), f"end {i}"] for i in range(400)]
    path = tmp_path / "one.csv"
    with open(path, "w", newline="", encoding="utf-8") as file:
        csv.writer(file, lineterminator="\n").writerows([["id", "first cell", "b", "c"], *rows])
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = sources.read_csv_split(spark, str(path))
        assert found.columns == ["id", "first cell", "b", "c"]
        if split < 1000:
            assert spark.read.text(str(path)).rdd.getNumPartitions() > 50
        assert _cells(found) == sorted(map(tuple, rows), key=repr)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert _cells(found) == _cells(sources.read_csv(spark, str(path)))


def test_csv_split_tells_short_rows_from_empty_cells(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.csv").write_text('id;t;u\r\n1;;x\r\n2\r\n\r\n3;"";"a\r\nb"\r\n4;y\r\n5;1;2;3\r\n')
    (folder / "b.csv").write_text("id;t;u\n6;7;8")
    (folder / "c.csv").write_text('id;t;u\n9;"open ""cell""\n\n;";\n')
    (folder / "d.csv").write_text("")
    found = {r.id: (r.t, r.u) for r in sources.read_csv_split(spark, str(folder), ";").collect()}
    assert found == {
        "1": ("", "x"), "2": (None, None), "3": ("", "a\r\nb"), "4": ("y", None), "5": ("1", "2"), "6": ("7", "8"), "9": ('open "cell"\n\n;', ""),
    }


def test_document_lines_are_slices():
    batch = pa.RecordBatch.from_pydict({"value": [json.dumps({"i": i}) for i in range(3 * SLICE_ROWS)]})
    lines = [v for out in _document(iter([batch, batch.slice(0, 0)])) for v in out.column(0).to_pylist()]
    assert len(lines) == 4
    assert [r["i"] for r in json.loads("\n".join(lines))["data"]] == list(range(3 * SLICE_ROWS))
    assert json.loads("\n".join(v for out in _document(iter([])) for v in out.column(0).to_pylist()))["data"] == []
