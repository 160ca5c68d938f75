"""A cache keyed by name and stamp: what is computed from a file or a text is kept until that changes or goes.

A folder holds batches of rows, each written once, and manifests, numbered: a manifest says in which batch the rows of each key
are, and for which stamp. A run writes the rows of new and changed keys as a batch beside the others and then the next
manifest; only a complete manifest counts, so a run that fails leaves the cache as it was. Rows that no manifest names any
more are orphans. When they are the larger part, what is left is written as one batch and the rest removed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "key string, stamp string, batch string, n bigint"


@dataclass(frozen=True)
class KeyedCache:
    """Rows with columns ``key`` and ``stamp`` and those of ``schema``, below ``folder``, which all executors share."""

    spark: SparkSession
    folder: str
    schema: str

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _names(self, name: str) -> list[str]:
        path = self._path(name)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def _remove(self, name: str) -> None:
        path = self._path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _complete(self, version: str) -> bool:
        path = self._path(f"manifests/{version}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def version(self) -> int:
        """The number of the manifest that counts, 0 if there is none."""
        return max((int(v) for v in self._names("manifests") if self._complete(v)), default=0)

    def manifest(self) -> DataFrame:
        """(key, stamp, batch, n) of what the cache holds."""
        version = self.version()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifests/{version:08d}") if version else self.spark.createDataFrame([], MANIFEST)

    def _batch(self, name: str) -> str:
        return f"{self.folder}/batches/{name}"

    def rows(self) -> DataFrame:
        """The rows of the manifest's keys, orphans left out."""
        kinds = f"key string, stamp string, {self.schema}, batch string"
        held = self.spark.read.schema(kinds).parquet(self._batch("")) if self._names("batches") else self.spark.createDataFrame([], kinds)
        return held.join(self.manifest().select("key", "stamp", "batch"), ["key", "stamp", "batch"], "left_semi").drop("batch")

    def refresh(self, current: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The rows of ``current`` (key, stamp; each key once), of which only those are made that the cache lacks.

        ``make`` gets (key, stamp) of these and returns (key, stamp, ...); a key may have any number of rows. A row whose key is
        null takes no part.
        """
        current = current.select("key", "stamp").where(F.col("key").isNotNull())
        before = self.manifest()
        name = f"batch={uuid.uuid4().hex}"
        missing = current.join(before, ["key", "stamp"], "left_anti")
        kept = before.join(current, ["key", "stamp"], "left_semi")
        if not missing.isEmpty():
            fields = [c.split()[0] for c in self.schema.split(", ")]
            make(missing).select("key", "stamp", *fields).write.parquet(self._batch(name))
            made = self.spark.read.schema(f"key string, stamp string, {self.schema}").parquet(self._batch(name)).groupBy("key", "stamp").agg(F.count("*").alias("n"))
            found = missing.join(made, ["key", "stamp"], "left").select("key", "stamp", F.lit(name.split("=")[1]).alias("batch"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
            kept = kept.unionByName(found)
        elif before.join(current, ["key", "stamp"], "left_anti").isEmpty():  # nothing new, nothing gone
            return self.rows()
        self._write(kept)
        self.collect()
        return self.rows()

    def _write(self, manifest: DataFrame) -> None:
        manifest.select("key", "stamp", "batch", "n").write.mode("overwrite").parquet(f"{self.folder}/manifests/{self.version() + 1:08d}")

    def collect(self, least: float = 0.5) -> None:
        """Removes orphans: batches without any live row at once, and once no more than the share ``least`` of all rows is live, the
        others by writing what is live anew. Manifests before the one that counts go too."""
        alive = {r[0]: r[1] for r in self.manifest().groupBy("batch").agg(F.sum("n")).collect()}  # a row for each run since the last cleaning
        for name in self._names("batches"):
            if name.startswith("batch=") and name.split("=")[1] not in alive:
                self._remove(f"batches/{name}")
        held = self.spark.read.parquet(self._batch("")).count() if self._names("batches") else 0
        if held and sum(alive.values()) <= least * held:
            old, name = self._names("batches"), f"batch={uuid.uuid4().hex}"
            self.rows().write.parquet(self._batch(name))
            self._write(self.manifest().withColumn("batch", F.lit(name.split("=")[1])))
            for x in old:
                self._remove(f"batches/{x}")
        for version in self._names("manifests"):
            if int(version) < self.version():
                self._remove(f"manifests/{version}")


def vectors(cache: KeyedCache, texts: DataFrame, embed: Callable, name: str) -> DataFrame:
    """(key, vector) of ``texts`` (key, text): vectors are made where the text or the embedder, known by ``name``, has changed."""
    body = F.coalesce("text", F.lit(""))
    stamped = texts.select("key", "text", F.concat(F.lit(f"{name}:"), F.sha2(body.cast("binary"), 256)).alias("stamp")).dropDuplicates(["key"])
    make = lambda missing: stamped.join(missing, ["key", "stamp"], "left_semi").select("key", "stamp", embed(body).alias("vector"))
    return cache.refresh(stamped, make).select("key", "vector")
