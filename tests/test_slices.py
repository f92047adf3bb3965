import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace import operators as ops
from millrace.functions.slices import SLICE_BYTES, SLICE_ROWS, text_slices


@pytest.mark.parametrize("lengths", [[], [0], [3, 0, 2] * 2000, [SLICE_BYTES * 2, 1, SLICE_BYTES, SLICE_BYTES + 1], [SLICE_BYTES // 3] * 10])
def test_slices_hold_few_rows_and_bytes(lengths):
    texts = pa.array([None if n == 2 else "x" * n for n in lengths], pa.string())
    parts = list(text_slices(texts))
    assert [t for part in parts for t in part.to_pylist()] == texts.to_pylist()
    for part in parts:
        assert 1 <= len(part) <= SLICE_ROWS
        assert len(part) == 1 or sum(len(t or "") for t in part.to_pylist()) <= SLICE_BYTES


@pytest.fixture(scope="module")
def many(spark):
    """More rows than a slice in one Arrow batch, with nulls and a text that is longer than a slice."""
    rows = [(i, None if i % 7 == 3 else f"Ware ﬁ{i % 50} é {'ab ' * (i % 9)}") for i in range(3 * SLICE_ROWS)]
    rows.append((len(rows), "long ﬁ " * (SLICE_BYTES // 6)))
    return rows, spark.createDataFrame(rows, "id bigint, t string").coalesce(1)


def test_rows_keep_their_values_across_slices(many):
    rows, df = many
    made = df.select("id", "t").transform(ops.unicode_normalize, "t", "NFKD")
    assert {r.id: r.t for r in made.collect()} == {i: t and unicodedata.normalize("NFKD", t) for i, t in rows}
    short = df.where(F.length("t").isNull() | (F.length("t") < 100))
    found = {r.id: r for r in ops.minhash(ops.simhash(short, "t"), "t").transform(ops.embed_text, "t", 16).collect()}
    alone = short.where("id % 100 = 7")
    for r in ops.minhash(ops.simhash(alone, "t"), "t").transform(ops.embed_text, "t", 16).repartition(50).collect():
        assert r == found[r.id]
