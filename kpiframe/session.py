"""Session helpers: one place for the engine's Spark settings and shared folders."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import SparkSession

# Settings every query relies on. AQE re-plans joins and partition counts at
# runtime (broadcast only when the measured side is below the threshold,
# split skewed shuffle partitions, coalesce small ones).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


_MB = 1024 * 1024


def scale_conf(input_bytes: int, cores: int, target_partition_mb: int = 128) -> dict:
    """Settings sized to the input: scan splits and shuffle partitions of about
    ``target_partition_mb`` each, so every task's share fits in executor memory.

    The initial shuffle width covers the whole input at the target size (a
    pre-aggregated shuffle is smaller, and AQE coalesces it down at runtime);
    it is at least 3 tasks per core. Skewed shuffle partitions above 4× the
    target are split by AQE.
    """
    target = target_partition_mb * _MB
    parts = max(3 * cores, -(-int(input_bytes) // target))
    return {
        "spark.sql.files.maxPartitionBytes": str(2 * target),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    }


def session_conf(shuffle_partitions: int | None = None, extra: dict | None = None,
                 input_bytes: int | None = None, cores: int | None = None) -> dict:
    """The settings ``get_session`` applies: the engine defaults, then the
    input-sized ones (``input_bytes``), then an explicit shuffle width, then
    ``extra`` (later entries win)."""
    conf = dict(DEFAULT_CONF)
    if input_bytes:
        conf.update(scale_conf(input_bytes, cores or os.cpu_count() or 1))
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    return conf


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "kpiframe", extra: dict | None = None,
                input_bytes: int | None = None, cores: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine defaults.

    On a cluster pass ``master=None`` and let the launcher decide, and give
    ``input_bytes`` (and the total ``cores``) to size splits and shuffles to
    the data; tests and the bench pass ``local[N]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in session_conf(shuffle_partitions, extra, input_bytes, cores).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_scratch: list[str] = []


def _delete(path: str) -> None:
    """Delete a folder through Hadoop's file system (any store Spark can write)."""
    jvm = SparkContext._jvm
    if jvm is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        sc = SparkContext._active_spark_context
        conf = sc._jsc.hadoopConfiguration() if sc else jvm.org.apache.hadoop.conf.Configuration()
        where.getFileSystem(conf).delete(where, True)


@atexit.register
def remove_scratch() -> None:
    """Remove what ``scratch_path`` handed out (and a local checkpoint folder of our own);
    runs when the driver's Python ends, and may be called when results are no longer read."""
    while _scratch:
        path = _scratch.pop()
        with contextlib.suppress(Py4JError, OSError):  # the JVM may be gone already
            _delete(path)


def _is_local(spark: SparkSession) -> bool:
    return re.match(r"local(\[|$)", spark.sparkContext.master) is not None


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder named by ``spark.checkpoint.dir``.

    The setting is read from the session. Where it is unset, a local master
    (one machine: tests) gets a fresh folder of its own, which is registered as
    the checkpoint dir and removed at the end; on a cluster that folder would be
    another one on each machine, so an unset setting is an error there.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        path = tempfile.mkdtemp(prefix="kpiframe-ckpt-")
        _scratch.append(path)
    if not sc.getCheckpointDir():
        # DataFrame.checkpoint() needs the context's folder
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique location under the shared folder for one job's output; removed
    at the end (``remove_scratch``)."""
    path = f"{shared_dir(spark)}/kpiframe/{name}-{uuid.uuid4().hex[:12]}"
    _scratch.append(path)
    return path
