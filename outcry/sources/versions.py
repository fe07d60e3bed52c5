"""A partitioned Parquet table whose writes are committed by a pointer.

A write puts the partitions it touches under a new version, then a manifest
(which version holds each partition), then moves the manifest to ``heads/`` by
one rename.  That rename is the commit: readers go by the newest head and see
the table before or after a write, never a mixture; what a failed write left
behind is referenced by no manifest, is never read, and is overwritten when the
write is tried again.  A write carries a token (a batch id); a token that is
committed already is not written again, so re-runs change nothing.

A manifest has one row per partition (slots, dates, blocks), the only thing the
driver holds.  One writer at a time; any number of readers, with ``keep`` older
heads left for them.

    root/data/version=7/dow=1/hod=13/part-...parquet
    root/heads/7/part-...parquet        dow, hod, version
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outcry.sources.signals import upsert


class PartitionStore:
    """A table partitioned by the integer columns ``by``; rows of a file are
    sorted by ``order``, so that readers skip row groups."""

    def __init__(self, spark: SparkSession, root: str, by: list[str], order: list[str] | tuple = ()):
        self.spark, self.root, self.by, self.order = spark, root.rstrip("/"), by, list(order)

    # ------------------------------------------------------------ files
    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, folder: str, prefix: str = "") -> list[int]:
        fs, path = self._fs(), self._path(folder)
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit())

    # ------------------------------------------------------------ reading
    def head(self) -> int | None:
        """The newest committed version."""
        found = self._numbers("heads")
        return found[-1] if found else None

    def manifest(self, head: int | None = None) -> DataFrame | None:
        """(partition columns, version, schema) as of a head."""
        head = self.head() if head is None else head
        return None if head is None else self.spark.read.parquet(f"{self.root}/heads/{head}")

    def read(self, where: Column | None = None, head: int | None = None) -> DataFrame | None:
        """The table as of a head (the newest by default); ``where`` chooses
        partitions by their columns, and only their files are opened."""
        manifest = self.manifest(head)
        if manifest is None:
            return None
        rows = (manifest if where is None else manifest.where(where)).collect()
        any_row = rows[0] if rows else manifest.first()
        if any_row is None:
            return None
        schema = T.StructType.fromJson(json.loads(any_row["schema"]))
        if not rows:
            return self.spark.createDataFrame([], schema)
        paths = ["/".join([f"{self.root}/data/version={r['version']}", *[f"{c}={r[c]}" for c in self.by]]) for r in rows]
        found = self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*paths)
        return found.select(*schema.names)

    # ------------------------------------------------------------ writing
    def stage(self, df: DataFrame, version: int) -> DataFrame:
        """Writes the rows under ``version`` without committing them; returns
        their partitions."""
        path = f"{self.root}/data/version={version}"
        # Partitions of any size: small ones share a task, large ones are split.
        (df.hint("rebalance", *[F.col(c) for c in self.by]).sortWithinPartitions(*self.by, *self.order)
           .write.mode("overwrite").partitionBy(*self.by).parquet(path))
        return self.spark.read.schema(df.schema).parquet(path).select(*self.by).distinct()

    def commit(self, written: DataFrame, version: int, schema: T.StructType, replaced: DataFrame | None = None) -> None:
        """Makes the staged partitions ``written`` part of the table, in place
        of those and of ``replaced`` (partitions that may have become empty)."""
        rows = written.select(*self.by, F.lit(version).cast("long").alias("version"), F.lit(schema.json()).alias("schema"))
        before = self.manifest()
        if before is not None:
            gone = written if replaced is None else written.unionByName(replaced.select(*self.by))
            rows = before.join(gone, self.by, "left_anti").drop("schema").withColumn("schema", F.lit(schema.json())).unionByName(rows)
        held = f"heads_being_written/{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(f"{self.root}/{held}")
        fs, target = self._fs(), self._path(f"heads/{version}")
        fs.mkdirs(self._path("heads"))
        if fs.exists(target) or not fs.rename(self._path(held), target):
            raise RuntimeError(f"version {version} of {self.root} was committed by another writer")

    def write(self, df: DataFrame, token: int | None = None, replaced: DataFrame | None = None) -> int:
        """Replaces the partitions that ``df`` has rows for, and those of
        ``replaced``.  Returns the head that holds them; a token that is
        committed already changes nothing."""
        head = self.head()
        if token is not None and head is not None and token <= head:
            return head
        version = token if token is not None else 0 if head is None else head + 1
        self.commit(self.stage(df, version), version, df.schema, replaced)
        return version

    def upsert(self, updates: DataFrame, keys: list[str], token: int | None = None) -> int:
        """Insert or replace by ``keys`` (which include the partition columns):
        reads and rewrites only the partitions of ``updates``."""
        head = self.head()
        if token is not None and head is not None and token <= head:
            return head
        return self.write(self.merged(updates, keys), token)

    def merged(self, updates: DataFrame, keys: list[str]) -> DataFrame:
        """The touched partitions with ``updates`` in them."""
        touched = updates.select(*self.by).distinct().collect()
        if not touched or self.head() is None:
            return updates
        current = self.read(self._among(touched))
        return updates.select(*current.columns) if current.isEmpty() else upsert(current, updates, keys)

    def _among(self, rows) -> Column:
        if len(self.by) == 1:
            return F.col(self.by[0]).isin([r[0] for r in rows])
        return F.struct(*self.by).isin([F.struct(*[F.lit(v) for v in r]) for r in rows])

    def prune(self, keep: int = 1) -> None:
        """Deletes heads but the newest and ``keep`` before it, and the data
        and unfinished writes that none of them refers to."""
        heads = self._numbers("heads")
        if not heads:
            return
        fs, left = self._fs(), heads[-1 - keep:]
        used = {r["version"] for h in left for r in self.manifest(h).select("version").distinct().collect()}
        for h in heads[:-1 - keep]:
            fs.delete(self._path(f"heads/{h}"), True)
        for v in self._numbers("data", "version="):
            if v not in used:
                fs.delete(self._path(f"data/version={v}"), True)
        fs.delete(self._path("heads_being_written"), True)
