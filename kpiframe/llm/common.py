"""Helpers shared by the training-data operators.

Words are runs of characters other than space and ``\\t \\n \\v \\f \\r``; that is what
``bytes.split()`` separates, so Python code works on UTF-8 bytes (``text.lower()`` on
bytes lower-cases A-Z only).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiframe.session import scratch_path

#: space, tab, line feed, vertical tab, form feed, carriage return
WHITE = " \t\n\x0b\x0c\r"
#: one word, as a regular expression that Spark and RE2 read alike
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder under the cluster's shared folder and read it back.

    Cuts lineage: a lost executor costs a reread, not a recomputation. ``session``
    removes the folder when the driver's Python ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else (``lower`` alone also changes É or İ)."""
    plain = F.length(col) == F.octet_length(col)
    return F.when(plain, F.lower(col)).otherwise(
        F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def text_bytes(col: str = "text") -> Column:
    """The text as UTF-8 bytes, NULL as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], stem: str) -> str:
    """A column name that starts with ``stem`` and clashes with none of ``columns``."""
    taken = {c.lower() for c in columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def squeezed(col: Column) -> Column:
    """The text without any space, ``\\t \\n \\v \\f \\r``."""
    for white in WHITE:
        col = F.replace(col, F.lit(white), F.lit(""))
    return col
