"""Incremental refresh of an aggregate over a growing folder of files.

The dashboards re-read a file when a button is pressed (or every 30 s). Here
that is a Structured Streaming file source: each refresh processes only the
files that arrived since the previous one (tracked in the checkpoint) and keeps
the running aggregate in the state store. Given the keys of the result, only the rows
that changed are written, as an upsert into a keyed table (``streaming.keyed``); without
them the complete result goes to a new folder and a pointer file then names it. Either
way a reader sees a whole result.

* ``refresh_once``: ``trigger(availableNow=True)`` — process what is there, stop.
* ``refresh_every``: ``trigger(processingTime=...)`` — keep polling.

The checkpoint and the output must live in a folder every executor sees (the
session's ``spark.checkpoint.dir``), never on one machine's local disk.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from kpiframe.sources.store import hadoop, read_text, replace_text
from kpiframe.streaming.keyed import BUCKETS, KeyedTable

POINTER = "_current"
KEPT = 2


def _publish(spark: SparkSession, output_path: str, version: str) -> None:
    """Make ``version`` the current result: a new pointer file replaces the old one in
    one rename. Versions before the last ``KEPT`` go; a reader that has just resolved
    the pointer still finds its files."""
    fs = hadoop(spark)
    root = fs.Path(output_path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    replace_text(spark, f"{output_path}/{POINTER}", version)
    versions = sorted((s.getModificationTime(), s.getPath().getName())
                      for s in store.listStatus(root)
                      if s.isDirectory() and s.getPath().getName().startswith("version-"))
    for _, old in versions[:-KEPT]:
        if old != version:
            store.delete(fs.Path(root, old), True)


def read_current(spark: SparkSession, output_path: str, fmt: str = "parquet") -> DataFrame:
    """The result that the last finished refresh wrote."""
    keyed = KeyedTable(spark, output_path)
    if keyed.manifest() is not None:
        return keyed.read()
    version = read_text(spark, f"{output_path}/{POINTER}")
    if version is None:
        raise FileNotFoundError(f"no refresh has finished at {output_path}")
    return spark.read.format(fmt).load(f"{output_path}/{version}")


def _new_version(output_path: str, fmt: str):
    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        # complete mode hands over the whole result; a replayed epoch or a failed write
        # leaves the current version as it is
        version = f"version-{epoch_id:012d}-{uuid.uuid4().hex[:8]}"
        batch.write.format(fmt).save(f"{output_path}/{version}")
        _publish(batch.sparkSession, output_path, version)
    return write_batch


def _upserts(output_path: str, checkpoint: str, keys, buckets: int):
    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        # update mode hands over the rows that changed; the stream's own id tells a replayed
        # epoch from the same number of a stream that was started afresh
        spark = batch.sparkSession
        stream = json.loads(read_text(spark, f"{checkpoint}/metadata") or "{}").get("id", "")
        KeyedTable(spark, output_path, keys, buckets).upsert(batch, epoch_id, stream)
    return write_batch


def _start(spark: SparkSession, source: str, schema: StructType | str,
           transform: Callable[[DataFrame], DataFrame], output_path: str, checkpoint: str,
           fmt: str, out_fmt: str, trigger: dict, max_files: int | None, keys,
           buckets: int) -> StreamingQuery:
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.load(source)
    result = transform(stream)
    if keys is None:
        mode, write = "complete", _new_version(output_path, out_fmt)
    elif out_fmt != "parquet":
        raise ValueError("a keyed result is kept as Parquet")
    else:
        mode, write = "update", _upserts(output_path, checkpoint, keys, buckets)
    return (result.writeStream.outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .foreachBatch(write)
            .trigger(**trigger)
            .start())


def refresh_once(spark: SparkSession, source: str, schema: StructType | str,
                 transform: Callable[[DataFrame], DataFrame], output_path: str,
                 checkpoint: str, fmt: str = "parquet", out_fmt: str = "parquet",
                 max_files: int | None = None, timeout_s: float | None = None, keys=None,
                 buckets: int = BUCKETS) -> DataFrame:
    """Fold every file that arrived since the last refresh into the aggregate and return
    the result (lazily read; ``read_current`` reads it later).

    With ``keys``, the columns that tell the result's rows apart (the grouping columns),
    only rows that changed are written, to a ``KeyedTable`` at ``output_path``. Without,
    the complete result becomes a new version there: right for small results."""
    q = _start(spark, source, schema, transform, output_path, checkpoint, fmt, out_fmt,
               {"availableNow": True}, max_files, keys, buckets)
    finished = q.awaitTermination(timeout_s) if timeout_s else q.awaitTermination()
    if finished is False:
        q.stop()
        raise TimeoutError("refresh_once: stream did not finish in time")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return read_current(spark, output_path, out_fmt)


def refresh_every(spark: SparkSession, source: str, schema: StructType | str,
                  transform: Callable[[DataFrame], DataFrame], output_path: str,
                  checkpoint: str, interval: str = "30 seconds", fmt: str = "parquet",
                  out_fmt: str = "parquet", keys=None, buckets: int = BUCKETS) -> StreamingQuery:
    """Poll ``source`` every ``interval`` and keep the result under ``output_path`` up to
    date (``read_current``; ``keys`` as in ``refresh_once``). Returns the running query;
    the caller stops it."""
    return _start(spark, source, schema, transform, output_path, checkpoint, fmt, out_fmt,
                  {"processingTime": interval}, None, keys, buckets)
