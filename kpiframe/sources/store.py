"""Small files, renames and deletions through Hadoop's file system: any store Spark can write."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def hadoop(spark: SparkSession):
    """Hadoop's file system classes: any store that Spark can write."""
    return spark._jvm.org.apache.hadoop.fs


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's content; None if there is none."""
    fs = hadoop(spark)
    where = fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        return None
    stream = store.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def rename(spark: SparkSession, source: str, target: str, overwrite: bool) -> None:
    """Rename in one step; without ``overwrite`` an existing target is an error
    (``FileAlreadyExistsException``)."""
    fs = hadoop(spark)
    conf = spark._jsc.hadoopConfiguration()
    place = fs.Path(target)
    store = place.getFileSystem(conf)
    how = spark._sc._gateway.new_array(fs.Options.Rename, 1 if overwrite else 0)
    if overwrite:
        how[0] = fs.Options.Rename.OVERWRITE
    context = fs.FileContext.getFileContext(store.getUri(), conf)
    context.rename(store.makeQualified(fs.Path(source)), store.makeQualified(place), how)


def exists(spark: SparkSession, path: str) -> bool:
    where = hadoop(spark).Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def replace_text(spark: SparkSession, path: str, content: str) -> None:
    """Write a small file under another name and put it in place in one rename."""
    fs = hadoop(spark)
    draft = f"{path}.{uuid.uuid4().hex}"
    where = fs.Path(draft)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(content.encode()))
    out.close()
    rename(spark, draft, path, overwrite=True)


def delete_path(spark: SparkSession, path: str) -> None:
    where = hadoop(spark).Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
