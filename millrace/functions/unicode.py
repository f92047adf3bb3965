"""Unicode normal forms. Spark has no built-in for them, so an Arrow-batched UDF."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column

from .slices import sliced_udf

FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def normalize_form(text: Column, form: str = "NFC") -> Column:
    if form not in FORMS:
        raise ValueError(f"Unknown normal form '{form}', expected one of {FORMS}")

    def start():
        def one(value):
            if value is None or value.isascii() or unicodedata.is_normalized(form, value):
                return value
            return unicodedata.normalize(form, value)

        return lambda texts: pa.array([one(value) for value in texts], pa.string())

    return sliced_udf(text, "string", start)
