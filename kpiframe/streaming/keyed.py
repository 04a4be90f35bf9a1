"""A keyed result table that takes upserts: what a trigger writes follows the rows it brings.

Rows are dealt to ``buckets`` by the hash of their key. An upsert writes only the rows it was
given, one folder per touched bucket, and the manifest lists for each bucket its folders in
order: of rows with the same key the one in the last folder counts. A bucket whose added rows
reach ``COMPACT_SHARE`` of those below them (or that has ``MOST_PARTS`` folders) is rewritten
into one folder by the upsert that finds it so. A row is therefore written a bounded number of
times (about two and a half, for each doubling of the bucket) whatever the table's size.

The manifest is one small file that is replaced in one rename, after the data are written: a
reader sees the table before or after an upsert, a failed one leaves folders that nothing
lists, and an upsert that is played again is recognised by its stream and number.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kpiframe.functions.util import as_list
from kpiframe.sources.store import delete_path, read_text, replace_text

MANIFEST = "_manifest"
BUCKETS = 64
COMPACT_SHARE = 0.5
MOST_PARTS = 16

_BUCKET, _SEQ = "__bucket", "__seq"


class KeyedTable:
    """The table at ``path`` with one row per value of ``keys`` (NULL is a value). One writer
    at a time; any number of readers. ``buckets`` is fixed by the first upsert."""

    def __init__(self, spark: SparkSession, path: str, keys=(), buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.keys, self.buckets = as_list(keys) or [], buckets

    def manifest(self) -> dict | None:
        text = read_text(self.spark, f"{self.path}/{MANIFEST}")
        return None if text is None else json.loads(text)

    # ------------------------------------------------------------------ reading

    def read(self) -> DataFrame:
        """The table as its last finished upsert left it. Buckets of one folder are read as
        they are; for the others the latest row of each key is picked."""
        now = self.manifest()
        if now is None:
            raise FileNotFoundError(f"no keyed table at {self.path}")
        return self._rows(now, now["parts"])

    def _folder(self, part: dict, bucket: str) -> str:
        return f"{self.path}/{part['folder']}/{_BUCKET}={bucket}"

    def _rows(self, now: dict, parts: dict) -> DataFrame:
        """The rows of the buckets in ``parts`` ({bucket: folders})."""
        schema = StructType.fromJson(now["schema"])
        stored = StructType.fromJson(now["schema"]).add(_SEQ, "long")
        read = self.spark.read.schema(stored)
        single = [self._folder(p[0], b) for b, p in parts.items() if len(p) == 1]
        layered = [self._folder(x, b) for b, p in parts.items() if len(p) > 1 for x in p]
        none = self.spark.createDataFrame([], schema)
        plain = read.parquet(*single).drop(_SEQ) if single else none
        return plain.unionByName(self._latest(read.parquet(*layered), now["keys"])
                                 .select(*schema.names)) if layered else plain

    @staticmethod
    def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
        """Of the rows of each key the one with the greatest number."""
        values = [c for c in rows.columns if c not in keys and c != _SEQ]
        if not values:
            return rows.select(*keys).distinct()
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(_SEQ)).alias("__row"))
        return last.select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in values])

    # ------------------------------------------------------------------ writing

    def upsert(self, rows: DataFrame, seq: int, stream: str = "") -> bool:
        """Put ``rows`` (one row per key) in place of the rows with their keys; others stay.

        ``stream`` names where upserts come from and ``seq`` numbers them: one that was done
        already changes nothing (False is returned). Rows of another stream replace the
        table, for a stream starts with nothing.
        """
        now = self.manifest()
        if now and now["stream"] == stream and seq <= now["seq"]:
            return False
        if now is None or now["stream"] != stream:
            now = {"keys": self.keys, "buckets": self.buckets, "parts": {}, "held":
                   sorted(self._folders(now)) if now else []}
        keys = now["keys"]
        schema = rows.schema
        bucket = F.pmod(F.xxhash64(*keys), F.lit(now["buckets"])) if keys else F.lit(0)
        dealt = rows.withColumn(_SEQ, F.lit(seq).cast("long")).withColumn(_BUCKET, bucket)
        folder = f"data/{seq:012d}-{uuid.uuid4().hex[:8]}"
        # one task per bucket: a bucket is one file, whatever the width of shuffles
        dealt.repartition(now["buckets"], _BUCKET).write.partitionBy(_BUCKET) \
            .parquet(f"{self.path}/{folder}")
        added = self._counted(f"{self.path}/{folder}")
        parts = {b: list(p) for b, p in now["parts"].items()}
        for b, n in added.items():
            parts.setdefault(b, []).append({"folder": folder, "rows": n})
        following = {"stream": stream, "seq": seq, "keys": keys, "buckets": now["buckets"],
                     "schema": json.loads(schema.json()), "parts": parts}
        full = {b: p for b, p in parts.items() if len(p) > 1 and (
            len(p) >= MOST_PARTS
            or sum(x["rows"] for x in p[1:]) >= COMPACT_SHARE * p[0]["rows"])}
        if full:
            compact = f"data/{seq:012d}-{uuid.uuid4().hex[:8]}-c"
            (self._rows(following, full).withColumn(_SEQ, F.lit(seq).cast("long"))
             .withColumn(_BUCKET, bucket).repartition(now["buckets"], _BUCKET)
             .write.partitionBy(_BUCKET).parquet(f"{self.path}/{compact}"))
            for b, n in self._counted(f"{self.path}/{compact}").items():
                parts[b] = [{"folder": compact, "rows": n}]
        before = self._folders(now)
        # folders of the state before stay for readers that have just opened it
        following["held"] = sorted(before | self._paths(folder, added))
        replace_text(self.spark, f"{self.path}/{MANIFEST}", json.dumps(following))
        for gone in (set(now.get("held", [])) | before) - self._folders(following) \
                - set(following["held"]):
            delete_path(self.spark, f"{self.path}/{gone}")
        return True

    def _counted(self, folder: str) -> dict[str, int]:
        """Rows per bucket of a folder just written (from Parquet footers; one row a bucket)."""
        # an upsert without rows leaves a folder without buckets
        rows = self.spark.read.schema(f"{_BUCKET} int").parquet(folder).groupBy(_BUCKET) \
            .agg(F.count(F.lit(1)).alias("n")).collect()
        return {str(r[_BUCKET]): r.n for r in rows}

    @staticmethod
    def _paths(folder: str, buckets) -> set[str]:
        return {f"{folder}/{_BUCKET}={b}" for b in buckets}

    def _folders(self, now: dict | None) -> set[str]:
        parts = (now or {}).get("parts", {})
        return reduce(lambda a, b: a | b, (self._paths(x["folder"], [b])
                                           for b, p in parts.items() for x in p), set())
