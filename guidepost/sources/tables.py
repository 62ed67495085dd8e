"""Keyed tables that take batch after batch without being rewritten.

Rows lie in buckets by a hash of their key. A batch reads and writes only the buckets
its keys fall into, as new files beside the old ones; a manifest names the files of each
bucket that make up a version, and is written last, so a version is there as a whole or
not at all. The same batch run again reads the version before it and replaces its own.
Files that none of the last ``keep`` versions names are deleted.

``buckets`` is fixed when a table is created: choose it so that a bucket fits a task.
What passes through the driver is one number per bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .sinks import upsert

_BUCKET = "__bucket"


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64, keep: int = 2):
        if keep < 2:
            raise ValueError("a batch that is run again needs the version before it")
        self.spark, self.path, self.keys, self.buckets, self.keep = spark, path.rstrip("/"), list(keys), buckets, keep
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._hadoop.Path("/".join((self.path, *parts)))

    def versions(self) -> list[int]:
        """Complete versions that are still there, oldest first."""
        if not self._fs.exists(self._at("manifest")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("manifest"))]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and self._fs.exists(self._at("manifest", n, "_SUCCESS")))

    def files(self, version: int) -> dict[int, int]:
        """Bucket to the version that wrote it."""
        rows = self.spark.read.schema("bucket int, written int").parquet(f"{self.path}/manifest/v={version}").collect()
        return {r["bucket"]: r["written"] for r in rows}

    def _rows(self, files: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.path}/data/v={v}/{_BUCKET}={b}" for b, v in sorted(files.items())]
        return self.spark.read.option("mergeSchema", True).parquet(*paths) if paths else None

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version, by default the newest."""
        there = self.versions()
        if not there:
            raise ValueError(f"nothing was written to {self.path} yet")
        got = self._rows(self.files(there[-1] if version is None else version))
        return got if got is not None else self.spark.createDataFrame([], "empty int")

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def merge(self, batch: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], version: int | None = None) -> list[int]:
        """Write the next version; the buckets it rewrote.

        ``change(stored, batch)`` gets all stored rows of the touched buckets (none at first:
        an empty frame with the columns of the batch) and returns what they hold from now on.
        """
        older = [v for v in self.versions() if version is None or v < version]
        version = (older[-1] + 1 if older else 1) if version is None else version
        files = self.files(older[-1]) if older else {}
        batch = cut_lineage(batch.withColumn(_BUCKET, self.bucket()))
        touched = sorted(r[0] for r in batch.select(_BUCKET).distinct().collect())
        stored = self._rows({b: v for b, v in files.items() if b in set(touched)})
        batch = batch.drop(_BUCKET)
        self._fs.delete(self._at("data", f"v={version}"), True)  # left by a run that did not end
        if touched:
            now = change(batch.limit(0) if stored is None else stored, batch).withColumn(_BUCKET, self.bucket())
            now.repartition(len(touched), _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/data/v={version}")
        own = {b: version for b in touched if self._fs.exists(self._at("data", f"v={version}", f"{_BUCKET}={b}"))}
        files = {b: v for b, v in files.items() if b not in set(touched)} | own
        named = self.spark.createDataFrame(sorted(files.items()), "bucket int, written int")
        named.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={version}")
        self.prune()
        return touched

    def upsert(self, batch: DataFrame, order: Sequence[str] = (), version: int | None = None) -> list[int]:
        """Put rows in by key; with ``order`` the newest of a key stays, stored or new."""
        return self.merge(batch, lambda stored, new: upsert(stored, new, self.keys, order), version)

    def prune(self) -> None:
        there = self.versions()
        named = {(b, v) for n in there[-self.keep :] for b, v in self.files(n).items()}
        for n in there[: -self.keep]:
            for b, v in self.files(n).items():
                if (b, v) not in named:
                    self._fs.delete(self._at("data", f"v={v}", f"{_BUCKET}={b}"), True)
            self._fs.delete(self._at("manifest", f"v={n}"), True)
