"""Results of steps that outlive a run: tables named by what they were made from."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import scratch_root


def input_versions(df: DataFrame) -> str | None:
    """A digest of the paths, sizes and times of the files that ``df`` reads; None if it reads none.

    Only the listing of the files is read, by tasks.
    """
    files = df.inputFiles()
    if not files:
        return None
    listed = df.sparkSession.read.format("binaryFile").load(files).select("path", "length", "modificationTime")
    mark = listed.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return f"{mark[0]}-{mark[1]}"


def result_name(df: DataFrame) -> str | None:
    """A name that equal plans over unchanged files share; None if ``df`` reads no files, so that nothing tells its rows."""
    versions = input_versions(df)
    if versions is None:
        return None
    plan = df._jdf.queryExecution().analyzed().canonicalized()
    digest = hashlib.sha256(f"{plan.toString()}|{df.semanticHash()}|{df.schema.json()}|{versions}".encode())
    return digest.hexdigest()[:32]


def reused(df: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """The table ``name`` of the shared folder, made from ``df`` unless it is there already, and whether it was.

    A table is written beside and renamed when it is whole, so a run that fails leaves none behind under the name.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/steps/{name}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    there = files.exists(hadoop(path))
    if not there:
        draft = f"{path}-{uuid.uuid4().hex}"
        df.write.parquet(draft)
        # Of two runs at once the first one's table stays; they hold the same rows.
        files.rename(hadoop(draft), hadoop(path))
    return spark.read.schema(df.schema).parquet(path), there
