"""Row filters. All are plain predicates, so Catalyst pushes what it can into the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checks import as_list, col, require_column, require_columns, require_frame
from ..functions import text as text_rules
from ..functions.regex import python_regex_search
from ..functions.text import is_blank, words

# Operator names and their aliases.
OPERATORS = {
    "==": "eq",
    "eq": "eq",
    "!=": "neq",
    "neq": "neq",
    ">": "gt",
    "gt": "gt",
    ">=": "gte",
    "gte": "gte",
    "<": "lt",
    "lt": "lt",
    "<=": "lte",
    "lte": "lte",
    "contains": "contains",
    "in": "contains",
    "not_null": "not_null",
    "is_not_null": "not_null",
    "is_null": "is_null",
    "null": "is_null",
}


def _literal(value, data_type: T.DataType) -> Column:
    """A user value in the type of the column; fails here rather than in a task."""
    if value is None:
        return F.lit(None).cast(data_type)
    if isinstance(data_type, T.NumericType):
        if isinstance(value, str):
            try:
                value = int(value)
            except ValueError:
                value = float(value)
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise ValueError(f"Cannot compare {data_type.simpleString()} with {value!r}")
        return F.lit(value)
    if isinstance(data_type, T.BooleanType):
        if isinstance(value, str):
            if value.lower() not in ("true", "false"):
                raise ValueError(f"Cannot compare boolean with {value!r}")
            value = value.lower() == "true"
        return F.lit(bool(value))
    return F.lit(value).cast(data_type)


def _is_blank(df: DataFrame, column: str) -> Column:
    return is_blank(col(column), df.schema[column].dataType.simpleString())


def filter_rows(df: DataFrame, column: str, operator: str, value=None) -> DataFrame:
    require_column(df, column)
    if operator not in OPERATORS:
        raise ValueError(f"No comparison is named '{operator}'; there are {sorted(OPERATORS)}")
    kind, cell = OPERATORS[operator], col(column)
    if kind == "is_null":
        return df.where(_is_blank(df, column))
    if kind == "not_null":
        return df.where(~_is_blank(df, column))
    if kind == "contains":
        return df.where(cell.cast("string").contains(str(value)))
    literal = _literal(value, df.schema[column].dataType)
    if kind == "eq":
        return df.where(cell.eqNullSafe(literal))
    if kind == "neq":
        return df.where(~cell.eqNullSafe(literal))
    return df.where({"gt": cell > literal, "gte": cell >= literal, "lt": cell < literal, "lte": cell <= literal}[kind])


def filter_expr(df: DataFrame, condition: str) -> DataFrame:
    """Keeps the rows for which a Spark SQL condition holds."""
    return require_frame(df).where(F.expr(condition))


def length_filter(
    df: DataFrame, column: str, min_len: int = 10, max_len: int | None = None, unit: str = "chars"
) -> DataFrame:
    """Keeps texts within inclusive bounds, in characters or words; null is dropped."""
    require_column(df, column)
    if unit not in ("chars", "words"):
        raise ValueError(f"Unknown unit '{unit}'")
    text = col(column).cast("string")
    size = F.length(text) if unit == "chars" else F.size(words(text))
    keep = text.isNotNull() & (size >= min_len)
    return df.where(keep if max_len is None else keep & (size <= max_len))


def remove_empty(df: DataFrame, columns: str | list[str]) -> DataFrame:
    """Drops a row if any of the columns is blank."""
    names = as_list(columns)
    require_columns(df, names)
    for name in names:
        df = df.where(~_is_blank(df, name))
    return df


def search_text(df: DataFrame, column: str, pattern: str, regex: bool = True) -> DataFrame:
    require_column(df, column)
    text = col(column).cast("string")
    return df.where(python_regex_search(text, pattern) if regex else text.contains(pattern))


def regex_partition(
    df: DataFrame, column: str, pattern: str, case_insensitive: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The rows that match and the rows that do not; null counts as empty text."""
    require_column(df, column)
    text = F.coalesce(col(column).cast("string"), F.lit(""))
    matches = python_regex_search(text, pattern, case_insensitive)
    return df.where(matches), df.where(~matches)


def min_threshold(df: DataFrame, column: str, min_value: float) -> DataFrame:
    """Keeps values that read as a number of at least ``min_value``."""
    require_column(df, column)
    return df.where(col(column).try_cast("double") >= float(min_value))


def language_filter(df: DataFrame, column: str, target_lang: str = "en") -> DataFrame:
    """Keeps English texts, or for any other target the texts that are not English."""
    require_column(df, column)
    english = text_rules.is_english(col(column).cast("string"))
    return df.where(english if target_lang == "en" else ~english)
