"""The event log stored by session, so that work per session needs no shuffle.

Events lie in a fixed number of buckets by session, sorted by time within one. What groups by
session or joins on it then reads a bucket to a task and exchanges nothing. A bucket is read by one
task, so sessions of more than ``limit`` events lie apart, as plain files that any number of tasks
share; measures take them through the exchange as before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from parley.functions.events import complete
from parley.operators.ordering import SLICE_ROWS, LargeKeys, large_keys
from parley.operators.primitives import SESSION_ROWS, primitives

KEY, ORDER = "session_id", ("session_id", "timestamp", "event_id")


class LaidOutLog(NamedTuple):
    """Events of ordinary sessions, in buckets, and of large ones, each session wholly in one of the two."""

    ordinary: DataFrame
    large: DataFrame

    @property
    def events(self) -> DataFrame:
        return self.ordinary.unionByName(self.large)

    def per_session(self, measure: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``measure`` (events -> one row per session) over both parts."""
        return measure(self.ordinary).unionByName(measure(self.large))

    def primitives(self, price: DataFrame, limit: int = SESSION_ROWS, **options) -> DataFrame:
        """The feature row of every session; ordinary ones are known to hold no large session."""
        spark = self.ordinary.sparkSession
        none = LargeKeys(spark.createDataFrame([], f"{KEY} string"), 0, 0, limit)
        return primitives(self.ordinary, price, large=none, **options).unionByName(primitives(self.large, price, limit=limit, **options))


def write_log(ev: DataFrame, path: str, buckets: int, limit: int = SESSION_ROWS) -> None:
    """Store the events under ``path``: one shuffle, once. A bucket should hold what one task reads, about 128 MB.

    Events without a session id belong to no session and lie with the large ones.
    """
    ev = complete(ev)
    hot = large_keys(ev.where(F.col(KEY).isNotNull()), [KEY], min(limit, SLICE_ROWS))
    cold, rest = hot.split(ev.where(F.col(KEY).isNotNull()))
    name = _name(path)
    ev.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    (cold.repartition(buckets, KEY).write.mode("overwrite").format("parquet").bucketBy(buckets, KEY).sortBy(*ORDER)
     .option("path", f"{path}/ordinary").saveAsTable(name))
    rest.unionByName(ev.where(F.col(KEY).isNull())).write.mode("overwrite").parquet(f"{path}/large")


def read_log(spark: SparkSession, path: str, buckets: int) -> LaidOutLog:
    """The stored log, with as many buckets as it was written in; works in a session that did not write it."""
    large = spark.read.parquet(f"{path}/large")
    name = _name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in large.schema.fields)
        order = ", ".join(ORDER)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{path}/ordinary'")
    return LaidOutLog(spark.table(name), large)


def _name(path: str) -> str:
    """The catalog's name for the buckets under a path."""
    return "parley_log_" + hashlib.sha256(path.encode()).hexdigest()[:16]
