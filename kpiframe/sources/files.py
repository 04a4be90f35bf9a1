"""File sources and sinks.

Reads always take an explicit schema: inference costs an extra pass over the
data and types an all-empty column as string, which breaks a strict union.
"""

from __future__ import annotations

import math
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kpiframe.sources.store import delete_path, exists, rename


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None,
               fmt: str = "csv", **options) -> DataFrame:
    """One table from CSV (header row) or Parquet.

    A CSV file whose header differs from the schema (other names, another order) is an
    error, not a table with swapped columns, and so is a value that does not parse as its
    column's type; ``options`` override both (``enforceSchema``, ``mode``).
    """
    if fmt == "csv":
        reader = spark.read.option("header", "true")
        for k, v in {"enforceSchema": "false", "mode": "FAILFAST", **options}.items():
            reader = reader.option(k, v)
        if schema is None:
            raise ValueError("read_table: CSV needs an explicit schema")
        return reader.schema(schema).csv(path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(fmt).load(path)


def read_many(spark: SparkSession, pattern: str, schema: StructType | str,
              fmt: str = "csv", source_col: str = "source_file", **options) -> DataFrame:
    """Many files of one layout as one table, with the file each row came from.

    ``_metadata.file_path`` is a hidden column of every file source: it costs
    nothing extra and needs no per-file read loop on the driver.
    """
    df = read_table(spark, pattern, schema, fmt, **options)
    return df.withColumn(source_col, F.col("_metadata.file_path"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write with a header row (one file per task; no coalesce to one writer)."""
    df.write.mode(mode).option("header", "true").csv(path)


def write_if_absent(df: DataFrame, path: str, fmt: str = "csv") -> bool:
    """Create the output only when nothing exists at ``path``; whether this call did.

    The rows are written beside ``path`` and put in place by one rename that refuses to
    replace anything. What exists at ``path`` is therefore whole: a write that failed leaves
    nothing there, so the next call creates it, and of two writers at once one wins and the
    other's rows are dropped.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    if exists(spark, path):
        return False
    draft = f"{path}.{uuid.uuid4().hex}.writing"
    try:
        writer = df.write.mode("errorifexists")
        if fmt == "csv":
            writer = writer.option("header", "true")
        writer.format(fmt).save(draft)
        rename(spark, draft, path, overwrite=False)
        return True
    except Py4JJavaError as failed:
        if "FileAlreadyExistsException" not in failed.java_exception.getClass().getName():
            raise
        return False
    finally:
        delete_path(spark, draft)  # nothing is there after the rename


def parquet_range(spark: SparkSession, path: str, column: str) -> tuple[float, float] | None:
    """(least, greatest) value of a numeric Parquet column from the files' footers, by Spark's
    aggregate push-down; no data page is read. None where footers cannot tell: statistics are
    missing, the column holds an infinity or no value, or the table is not plain Parquet.
    NaN is not counted (files whose statistics it spoils have none).
    """
    session = spark.newSession()  # the settings below are for this look-up only
    session.conf.set("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    c = F.col(column)
    try:
        found = session.read.parquet(path).agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        if "PushedAggregation: [MIN(" not in plan:
            return None
        lo, hi = found.first()
    except (PySparkException, Py4JJavaError):  # a footer without statistics
        return None
    if lo is None or not all(isinstance(v, (int, float)) and math.isfinite(v) for v in (lo, hi)):
        return None
    return float(lo), float(hi)


def write_bucketed(df: DataFrame, key: str, buckets: int, path: str) -> DataFrame:
    """``df`` written under ``path`` in ``buckets`` files by the hash of ``key``, sorted by it,
    and read back: joins and aggregations on ``key`` need no exchange. Nothing stays in the
    catalog."""
    spark = df.sparkSession
    name = f"kpiframe_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key) \
        .format("parquet").option("path", path).saveAsTable(name)
    out = spark.table(name).select(*df.columns)
    out.schema  # resolved: the plan holds the files and their buckets
    spark.sql(f"DROP TABLE {name}")  # external: the files stay
    return out
