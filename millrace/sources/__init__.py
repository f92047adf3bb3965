"""Readers and writers."""

from .csv_split import read_csv_split
from .readers import (
    import_dataset,
    list_objects,
    read_csv,
    read_csv_strict,
    read_images,
    read_json,
    read_jsonl,
    read_parquet,
    read_sql,
    read_stream,
)
from .writers import save, write_csv, write_json, write_jsonl, write_parquet

__all__ = [
    "import_dataset",
    "list_objects",
    "read_csv",
    "read_csv_split",
    "read_csv_strict",
    "read_images",
    "read_json",
    "read_jsonl",
    "read_parquet",
    "read_sql",
    "read_stream",
    "save",
    "write_csv",
    "write_json",
    "write_jsonl",
    "write_parquet",
]
