"""Intermediate tables in the shared folder the cluster names.

A written table cuts lineage, survives the loss of executors, is read back with
column pruning and gives the optimizer true sizes for its join choices.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Short rows for which a table gets a task and a file of its own.
FILE_ROWS = 1 << 16


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
    # One folder for each application; the checkpoint folder of the session is the caller's to set.
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="millrace-")
    return _LOCAL[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int, file_rows: int = FILE_ROWS) -> DataFrame:
    """``df``, of about ``rows`` rows at most, in as many tasks as these ask for: one for each core of the cluster, or more
    of ``file_rows`` rows. A shuffle into many partitions else makes a file of a few rows for each."""
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism, -(-rows // file_rows)))
