"""Writers. Each output is a folder of part files that its tasks write in parallel."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from ..checks import require_frame


def write_csv(df: DataFrame, path: str, delimiter: str = ",", gzip: bool = False) -> None:
    """Header CSV; null and empty text are both written as an empty field."""
    require_frame(df).write.mode("overwrite").csv(
        path,
        header=True,
        sep=delimiter,
        quote='"',
        escape='"',
        emptyValue="",
        nullValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        compression="gzip" if gzip else "none",
    )


def _write_json_lines(df: DataFrame, path: str) -> None:
    require_frame(df).write.mode("overwrite").json(path, ignoreNullFields=False)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object per line, nulls written."""
    _write_json_lines(df, path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON records. A single bracketed array would need one writer, so records are lines."""
    _write_json_lines(df, path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    require_frame(df).write.mode("overwrite").parquet(path, partitionBy=partition_by or None)


def save(df: DataFrame, path: str) -> None:
    """Writes by the extension of the path; anything unknown is JSON lines."""
    extension = os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    if extension == "csv":
        write_csv(df, path)
    elif extension == "tsv":
        write_csv(df, path, delimiter="\t")
    elif extension == "json":
        write_json(df, path)
    elif extension in ("parquet", "pq"):
        write_parquet(df, path)
    else:
        write_jsonl(df, path)
