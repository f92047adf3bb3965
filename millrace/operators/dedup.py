"""Exact deduplication: the first row of each key by ``order_by`` stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checks import as_list, col, require_batch, require_column, require_columns


def _groupable(df: DataFrame, name: str) -> Column:
    """Maps cannot be grouped; their sorted entries can."""
    if isinstance(df.schema[name].dataType, T.MapType):
        return F.array_sort(F.map_entries(col(name)))
    return col(name)


def _first_rows(df: DataFrame, keys: list[Column], order_by: list[str]) -> DataFrame:
    """The first row per key.

    Spark limits each key to its first row inside every task before the shuffle
    (WindowGroupLimit), so a key that holds most of the data is one row per task by then.
    """
    window = Window.partitionBy(*keys).orderBy(*[col(c) for c in order_by])
    return df.withColumn("_place", F.row_number().over(window)).where(F.col("_place") == 1).drop("_place")


def dedup_exact(
    df: DataFrame, columns: str | list[str] | None = None, order_by: str | list[str] | None = None
) -> DataFrame:
    """Drops rows equal to an earlier one in ``columns``, or in all columns. Nulls are equal.

    Rows equal in all columns are interchangeable, so only a column list needs an order.
    """
    require_batch(df, "dedup_exact")
    if not columns:
        if not any(isinstance(f.dataType, T.MapType) for f in df.schema.fields):
            return df.dropDuplicates()
        keys = {f"_key_{i}": _groupable(df, c) for i, c in enumerate(df.columns)}
        return df.withColumns(keys).dropDuplicates(list(keys)).drop(*keys)
    names = as_list(columns)
    require_columns(df, names)
    if not order_by:
        raise ValueError("dedup_exact on columns needs order_by to say which row is first")
    order = as_list(order_by)
    require_columns(df, order)
    return _first_rows(df, [_groupable(df, c) for c in names], order)


def dedup_hash(df: DataFrame, column: str, order_by: str | list[str]) -> DataFrame:
    """Drops rows whose text has the digest of an earlier one: short keys for long texts."""
    require_batch(df, "dedup_hash")
    require_column(df, column)
    order = as_list(order_by)
    require_columns(df, order)
    return _first_rows(df, [F.sha2(col(column).cast("string"), 256)], order)
