"""Registration of queries and the SQL pieces they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import SPACE_CHARS, SPACES

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = sql
        return function

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{SPACES}'), lambda x: x <> '')"


def sql_strip(text: str) -> str:
    chars = " || ".join(f"chr({ord(c)})" for c in SPACE_CHARS)
    return f"trim({text}, {chars})"


def sql_squash(text: str) -> str:
    return f"regexp_replace({sql_strip(text)}, '{SPACES}', ' ', 'g')"
