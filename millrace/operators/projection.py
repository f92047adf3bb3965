"""Choosing, renaming and computing columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checks import as_list, col, require_column, require_columns, require_frame


def select_columns(df: DataFrame, columns: str | list[str]) -> DataFrame:
    names = as_list(columns)
    require_columns(df, names)
    return df.select(*[col(c) for c in names])


def drop_columns(df: DataFrame, columns: str | list[str]) -> DataFrame:
    names = as_list(columns)
    require_columns(df, names)
    return df.select(*[col(c) for c in df.columns if c not in names])


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    require_columns(df, mapping)
    renamed = [mapping.get(c, c) for c in df.columns]
    if len(set(renamed)) < len(renamed):
        raise ValueError(f"Renaming gives the same name twice: {renamed}")
    return df.withColumnsRenamed(mapping)


def map_expr(df: DataFrame, expression: str, output_column: str = "result") -> DataFrame:
    """Adds a column computed from a Spark SQL expression."""
    return require_frame(df).withColumn(output_column, F.expr(expression))


def split_col(
    df: DataFrame, column: str, delimiter: str = ",", output_columns: list[str] | None = None
) -> DataFrame:
    """Splits by a literal delimiter: into an array, or into the named columns (null where short)."""
    require_column(df, column)
    java_literal = re.sub(r"([^\w\s])", r"\\\1", delimiter)
    parts = F.split(col(column).cast("string"), java_literal, -1)
    if output_columns is None:
        return df.withColumn(column, parts)
    return df.withColumns({name: F.get(parts, F.lit(i)) for i, name in enumerate(output_columns)})


def append_suffix(df: DataFrame, suffix: str, columns: str | list[str] | None = None) -> DataFrame:
    """Appends text to the cells of the given columns (default: all); null stays null."""
    names = df.columns if columns is None else as_list(columns)
    require_columns(df, names)
    return df.withColumns({c: F.concat(col(c).cast("string"), F.lit(suffix)) for c in names})
