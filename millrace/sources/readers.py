"""Readers. Paths are Hadoop URIs: a file, a folder or a glob, local or in an object store."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checks import col

# Keys under which a JSON document may hold its records.
RECORD_KEYS = ("data", "items", "records", "stories", "train", "documents")
# File extensions per format.
EXTENSIONS = {
    "json": "json",
    "jsonl": "jsonl",
    "ndjson": "jsonl",
    "parquet": "parquet",
    "pq": "parquet",
    "csv": "csv",
    "tsv": "tsv",
}
IMAGE_PATTERN = r".*\.(png|jpg|jpeg)"


def _csv_options(delimiter: str, encoding: str, multi_line: bool) -> dict:
    return {
        "header": True,
        "inferSchema": False,
        "sep": delimiter,
        "encoding": encoding,
        "quote": '"',
        "escape": '"',
        "multiLine": multi_line,
        "enforceSchema": False,
        "maxCharsPerColumn": -1,
    }


def read_csv(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    encoding: str = "utf-8",
    multi_line: bool = True,
    keep_nulls: bool = False,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Header CSV, every column a string.

    Spark reads an empty field as null; it becomes "" unless ``keep_nulls``, where cells
    that a short row lacks stay null too. Cells may hold line breaks, so a file is read by
    one task: a dataset is a folder of many files. ``multi_line=False`` splits large files
    by lines, for files whose cells are known to hold no line break.
    """
    reader = spark.read.options(**_csv_options(delimiter, encoding, multi_line))
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(path)
    return df if keep_nulls else df.fillna("")


def read_csv_strict(
    spark: SparkSession, path: str, columns: list[str], delimiter: str = ",", encoding: str = "utf-8", header: bool = True
) -> DataFrame:
    """CSV that drops the rows whose field count differs from that of ``columns``."""
    # Without pruning every field is parsed, so a wrong count shows whatever the query selects.
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.read.options(**_csv_options(delimiter, encoding, False))
    reader = reader.options(mode="DROPMALFORMED", columnPruning=False, enforceSchema=True, header=header)
    return reader.schema(schema).csv(path).fillna("")


def read_json(
    spark: SparkSession, path: str, root_key: str = "", encoding: str = "utf-8", schema: T.StructType | None = None
) -> DataFrame:
    """JSON documents: a list of records, an object holding such a list, or one record.

    A document is read by one task; a dataset is a folder of them, or JSON lines.
    """
    reader = spark.read.options(multiLine=True, encoding=encoding, mode="FAILFAST")
    df = (reader.schema(schema) if schema is not None else reader).json(path)
    lists = {
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)
    }
    for key in ([root_key] if root_key else []) + list(RECORD_KEYS):
        if key in lists:
            return df.select(F.explode(col(key)).alias("record")).select("record.*")
    return df


def read_jsonl(
    spark: SparkSession, path: str, encoding: str = "utf-8", schema: T.StructType | None = None
) -> DataFrame:
    """One JSON object per line; blank lines are skipped, a bad line fails the read."""
    reader = spark.read.options(mode="FAILFAST", encoding=encoding)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def import_dataset(
    spark: SparkSession,
    path: str,
    format: str | None = None,
    delimiter: str = ",",
    root_key: str = "",
    encoding: str = "utf-8",
    multi_line: bool = True,
) -> DataFrame:
    """Reads by the given format, else by the extension; anything unknown is CSV.

    ``multi_line`` is that of `read_csv`.
    """
    named = format.lower() if format and format.lower() != "auto" else None
    extension = named or os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    kind = EXTENSIONS.get(extension, "csv")
    if kind == "json":
        return read_json(spark, path, root_key=root_key, encoding=encoding)
    if kind == "jsonl":
        return read_jsonl(spark, path, encoding=encoding)
    if kind == "parquet":
        return read_parquet(spark, path)
    return read_csv(spark, path, delimiter="\t" if kind == "tsv" else delimiter, encoding=encoding, multi_line=multi_line)


def read_sql(
    spark: SparkSession,
    query: str,
    connection: str | None = None,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    properties: dict | None = None,
) -> DataFrame:
    """A SELECT on the session's catalog, or on a database by its JDBC URL.

    Give ``partition_column`` with ``bounds`` and ``partitions`` to read a database in
    parallel; without them JDBC reads in one task.
    """
    if connection is None:
        return spark.sql(query)
    reader = spark.read.format("jdbc").options(url=connection, **(properties or {}))
    if partition_column is None:
        return reader.option("query", query).load()
    if bounds is None:
        raise ValueError("partition_column needs bounds")
    return reader.options(
        dbtable=f"({query}) source",
        partitionColumn=partition_column,
        lowerBound=bounds[0],
        upperBound=bounds[1],
        numPartitions=partitions,
    ).load()


def _binary_files(spark: SparkSession, directory: str, recursive: bool) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(directory)


def list_objects(spark: SparkSession, uri: str, prefix: str = "", recursive: bool = True) -> DataFrame:
    """Path, length and time of the objects under a URI. Their content is not read."""
    files = _binary_files(spark, uri, recursive).select("path", "length", "modificationTime")
    root = uri.rstrip("/").split("://")[-1].lstrip("/")
    return files.where(F.col("path").contains(f"/{root}/{prefix}")) if prefix else files


def read_images(
    spark: SparkSession, directory: str, pattern: str = IMAGE_PATTERN, recursive: bool = False
) -> DataFrame:
    """Files whose name matches the pattern, with their bytes in ``content``."""
    name = F.element_at(F.split("path", "/"), -1)
    files = _binary_files(spark, directory, recursive).withColumn("name", name)
    return files.where(F.col("name").rlike(f"^(?:{pattern})$"))


def read_stream(
    spark: SparkSession,
    path: str,
    format: str,
    schema: T.StructType,
    files_per_trigger: int | None = None,
    **options,
) -> DataFrame:
    """A stream over the files of a folder."""
    reader = spark.readStream.format(format).schema(schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)
