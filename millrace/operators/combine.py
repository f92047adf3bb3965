"""Concatenation and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from ..checks import as_list, col, require_columns, require_frame

# Join kinds and their Spark names.
JOIN_KINDS = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full"}


def concatenate(df: DataFrame, other: DataFrame) -> DataFrame:
    """All rows of both; missing columns are null, columns of different type become text."""
    require_frame(df)
    require_frame(other)
    left, right = dict(df.dtypes), dict(other.dtypes)
    clash = [c for c in df.columns if c in right and left[c] != right[c]]
    for name in clash:
        df = df.withColumn(name, col(name).cast("string"))
        other = other.withColumn(name, col(name).cast("string"))
    return df.unionByName(other, allowMissingColumns=True)


def join_rows(
    left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", skewed: bool = True
) -> DataFrame:
    """Equi-join on shared keys; other shared columns of the right side get ``_right``.

    Null keys match nothing. Spark picks broadcast or sort-merge by the sizes it sees, and
    its adaptive execution splits frequent keys: on both sides of an inner join, on the
    left of a left or anti join, on the right of a right join, never in a full join. A
    full join is therefore a left join and the right rows without a match. ``skewed``
    builds left, right and full joins from an inner join and the rows without a match, so
    that keys may be frequent on either side; without it a left or right join is one join,
    for keys known to be rare on the optional side.
    """
    keys = as_list(on)
    require_columns(left, keys)
    require_columns(right, keys)
    if how not in JOIN_KINDS:
        raise ValueError(f"Unknown join type '{how}', expected one of {sorted(JOIN_KINDS)}")
    taken = set(left.columns) - set(keys)
    names = {c: f"{c}_right" for c in right.columns if c in taken}
    if set(names.values()) & (set(left.columns) | set(right.columns)):
        raise ValueError(f"Columns {sorted(names.values())} exist already")
    right = right.withColumnsRenamed(names)
    kind = JOIN_KINDS[how]
    if kind == "full" or (skewed and kind != "inner"):
        matched = left.join(right, keys, "inner" if skewed else "left")
        parts = [matched]
        if skewed and kind in ("left", "full"):
            parts.append(_unmatched(left, right, keys))
        if kind in ("right", "full"):
            parts.append(_unmatched(right, left, keys))
        joined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return joined.select(*[col(c) for c in matched.columns])
    return left.join(right, keys, kind)


def _unmatched(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a match. The other side is reduced to its keys inside the tasks first."""
    return df.join(other.select(*[col(k) for k in keys]).distinct(), keys, "left_anti")
