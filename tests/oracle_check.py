"""Runs every query in Spark and its SQL in DuckDB and compares the rows.

    python tests/oracle_check.py [--dir /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duckdb_with(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def plain(value):
    """A value in a form that is equal in both engines."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    return value


# DuckDB types and the Spark types they stand for.
SAME_TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "SMALLINT": "smallint",
    "DOUBLE": "double",
    "FLOAT": "float",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz",
}


def type_problem(dtypes: list[tuple], columns: list[str], types: list) -> str | None:
    duck = {c: SAME_TYPES.get(str(t), str(t)) for c, t in zip(columns, types)}
    wrong = {c: (t, duck.get(c)) for c, t in dtypes if duck.get(c) != t}
    return f"types {wrong}" if wrong else None


def kinds(rows: list[tuple], width: int) -> list[set]:
    return [{type(r[i]).__name__ for r in rows if r[i] is not None} for i in range(width)]


def compare(spark_rows, spark_columns, duck_rows, duck_columns) -> str | None:
    """What differs, or None."""
    if sorted(spark_columns) != sorted(duck_columns):
        return f"columns {sorted(spark_columns)} against {sorted(duck_columns)}"
    if len(spark_rows) != len(duck_rows):
        return f"{len(spark_rows)} rows against {len(duck_rows)}"
    order = sorted(spark_columns)
    left = [tuple(plain(r[spark_columns.index(c)]) for c in order) for r in spark_rows]
    right = [tuple(plain(r[duck_columns.index(c)]) for c in order) for r in duck_rows]
    if kinds(left, len(order)) != kinds(right, len(order)):
        return f"types {kinds(left, len(order))} against {kinds(right, len(order))}"
    left.sort(key=repr)
    right.sort(key=repr)
    for a, b in zip(left, right):
        if a != b:
            return f"first difference\n   spark {str(a)[:300]}\n   duck  {str(b)[:300]}"
    return None


def check(spark, connection, sf_dir: str, names=None, report=print) -> list[str]:
    import __spark_entry__ as entry

    queries, oracles, failed = entry.queries(), entry.oracle_sql(), []
    for name in names or queries:
        started = time.time()
        try:
            frame = queries[name](spark, sf_dir)
            rows = [tuple(r) for r in frame.collect()]
            spent = time.time() - started
            if name not in oracles:
                report(f"rows   {name:26} {len(rows):>8} rows {spent:6.2f}s")
                continue
            started = time.time()
            result = connection.sql(oracles[name])
            expected = result.fetchall()
            problem = compare(rows, frame.columns, expected, result.columns)
            problem = problem or type_problem(frame.dtypes, result.columns, result.types)
            report(
                f"{'ok    ' if problem is None else 'FAILED'} {name:26} {len(rows):>8} rows {spent:6.2f}s "
                f"sql {time.time() - started:5.2f}s {problem or ''}"
            )
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
            report(f"FAILED {name:26} {problem}")
        if problem:
            failed.append(name)
    return failed


def main() -> int:
    from session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--dir", default="/root/testdata/sf0.01")
    args = parser.parse_args()
    spark = local_session()
    failed = check(spark, duckdb_with(args.dir), args.dir, args.names, lambda line: print(line, flush=True))
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
