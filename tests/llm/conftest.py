import os

import pytest


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Nulls in all columns, empty and very long texts, ties, repeated rows, clashing names, one hot text."""
    rows = [
        (1, "the cat sat on the mat and then it ran off", "en", "a", "x"),
        (1, "the cat sat on the mat and then it ran off", "en", "a", "x"),
        (2, None, None, None, None),
        (3, "", "de", "b", ""),
        (None, "no id here, all rights reserved", "en", None, "y"),
        (4, "long " * 30_000, "en", "a", "z"),
        (5, "x" * 50_000, None, "b", "z"),
        (6, "  spaces \n\t and\x0bmarks!!! ", "en", "b", None),
        (7, "Größe über Äpfel 漢字 😀 <|endoftext|> it's", "de", "c", None),
        *[(100 + i, "a hot text that many documents share, word for word", "en", "a", "h") for i in range(60)],
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score string").withColumnRenamed("score", "fp")


@pytest.fixture(scope="session")
def no_docs(hard_docs):
    return hard_docs.limit(0)


@pytest.fixture(scope="session")
def data_dir():
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("the test tables are not here")
    return folder
