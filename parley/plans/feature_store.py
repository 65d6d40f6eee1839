"""Measured sessions kept between runs, so that only those whose log changed are measured again.

One row per session with the fingerprint of the log it was measured from, in a fixed number of
buckets. An update compares fingerprints, measures the sessions that are new or changed, and writes
the buckets they lie in under a new version. A manifest, one small file per version, then says which
version of each bucket counts. Until it is written the old state stays valid, whatever a lost driver
left behind; the next update uses the same version number and overwrites that. Updates of one store
must not overlap. Works on any file system Spark writes to.
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from parley.operators.eventlog import fingerprint
from parley.operators.scope import events_for
from parley.session import stage

BUCKETS = 256
ADDED, CHANGED, GONE = "added", "changed", "gone"
MANIFEST = "bucket int, bucket_version int, features string"

Measure = Callable[[DataFrame], DataFrame]


class Refresh(NamedTuple):
    """What an update did: its version, None if nothing changed, and (session_id, status) of the sessions it touched."""

    version: int | None
    touched: DataFrame


class FeatureStore:
    """Features of sessions under ``path``.

    ``signature`` names what the measures depend on beside the log, such as a lexicon or prices;
    each signature has a state of its own.
    """

    def __init__(self, spark: SparkSession, path: str, signature: str = "", buckets: int = BUCKETS) -> None:
        own = hashlib.sha256(f"{buckets}:{signature}".encode()).hexdigest()[:16]
        self.spark, self.path, self.buckets = spark, f"{path.rstrip('/')}/{own}", buckets

    # ---- files

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        path, fs = self._folder(name)
        if not fs.exists(path):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))

    def _committed(self) -> list[int]:
        """Versions whose manifest is complete."""
        return [v for v in self._versions("manifest") if (found := self._folder(f"manifest/version={v}/_SUCCESS"))[1].exists(found[0])]

    def _manifest(self, version: int) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/version={version}")

    def manifest(self) -> dict[int, int]:
        """Bucket -> version that counts; at most ``buckets`` entries."""
        done = self._committed()
        if not done:
            return {}
        return {r.bucket: r.bucket_version for r in self._manifest(done[-1]).collect()}

    def _schema(self) -> T.StructType | None:
        done = self._committed()
        if not done:
            return None
        row = self._manifest(done[-1]).first()
        return None if row is None else T.StructType.fromJson(json.loads(row.features))

    # ---- reading

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _rows(self) -> DataFrame | None:
        """All columns of the rows that count, bookkeeping among them; None for an empty store."""
        schema, manifest = self._schema(), self.manifest()
        if schema is None:
            return None
        of = defaultdict(list)
        for bucket, version in manifest.items():
            of[version].append(bucket)
        counts = reduce(Column.__or__, [(F.col("version") == v) & F.col("bucket").isin(b) for v, b in of.items()], F.lit(False))
        full = T.StructType([*schema.fields, T.StructField("version", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(full).option("basePath", f"{self.path}/features").parquet(f"{self.path}/features").where(counts).drop("version")

    def read(self) -> DataFrame | None:
        """The features as last committed."""
        rows = self._rows()
        return None if rows is None else rows.drop("bucket", "_fingerprint")

    # ---- updating

    def compare(self, ev: DataFrame, whole: bool = True) -> DataFrame:
        """(session_id, bucket, _fingerprint, status) of sessions that are not as stored.

        Reads three columns of the log and two of the store. Unless the log is ``whole``, sessions it lacks are left alone.
        """
        now = fingerprint(ev).select("session_id", F.col("fingerprint").alias("_fingerprint"))
        rows = self._rows()
        old = now.limit(0) if rows is None else rows.select("session_id", "_fingerprint")
        both = now.join(old.withColumnRenamed("_fingerprint", "_old"), "session_id", "full" if whole else "left")
        status = F.when(F.col("_fingerprint").isNull(), GONE).when(F.col("_old").isNull(), ADDED).when(F.col("_old") != F.col("_fingerprint"), CHANGED)
        return both.withColumn("status", status).where("status IS NOT NULL").select(
            "session_id", self.bucket_of(F.col("session_id")).alias("bucket"), "_fingerprint", "status")

    def refresh(self, ev: DataFrame, measure: Measure, whole: bool = True) -> Refresh:
        """Bring the store up to the log ``ev``: ``measure`` (events -> one row per session) sees new and changed sessions only."""
        differ = stage(self.compare(ev, whole))
        touched = [r.bucket for r in differ.select("bucket").distinct().collect()]  # at most ``buckets``
        if not touched:
            return Refresh(None, differ.select("session_id", "status"))
        fresh = differ.where(F.col("status") != GONE).select("session_id", "bucket", "_fingerprint")
        made = measure(events_for(ev, fresh.select("session_id"))).join(fresh, "session_id")
        rows, columns = self._rows(), made.columns
        if rows is not None:
            if set(rows.columns) != set(columns):
                raise ValueError("other measures than those stored: give them a signature of their own")
            kept = rows.where(F.col("bucket").isin(touched)).join(differ.select("session_id"), "session_id", "left_anti")
            made = made.unionByName(kept.select(*columns))
        manifest = self.manifest()
        version = max(self._committed(), default=0) + 1
        self._write(made, version)
        self._commit(version, {**manifest, **dict.fromkeys(touched, version)}, made.drop("bucket").schema)
        return Refresh(version, differ.select("session_id", "status"))

    def _write(self, rows: DataFrame, version: int) -> None:
        out = rows.withColumn("version", F.lit(version)).repartition("bucket")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "bucket").parquet(f"{self.path}/features")

    def _commit(self, version: int, manifest: dict[int, int], schema: T.StructType) -> None:
        rows = [(b, v, schema.json()) for b, v in sorted(manifest.items())]
        table = self.spark.createDataFrame(rows, MANIFEST).coalesce(1)
        table.write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def vacuum(self) -> list[int]:
        """Delete versions no bucket refers to any more; returns them. Not while others read an older state."""
        needed, done = set(self.manifest().values()), self._committed()
        stale = [v for v in self._versions("features") if v not in needed and done and v <= done[-1]]
        for version in stale:
            for name in ("features", "manifest"):
                if name == "features" or version != done[-1]:
                    path, fs = self._folder(f"{name}/version={version}")
                    fs.delete(path, True)
        return stale
