"""Session settings the operators rely on, and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings every report assumes; safe to call on any session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # split a skewed join even where an aggregate then needs its own small shuffle
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    # sessions a task aggregates in memory before it sorts instead
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096")
    return spark


def literal_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A small configured table as part of the plan, so that its size is known."""
    cells = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema.fields)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*cells)))


def if_small(df: DataFrame, rows: int) -> DataFrame | None:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else None."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else None


def shared_folder(spark: SparkSession) -> str:
    """This application's place in the folder named by ``spark.checkpoint.dir``.

    A machine-local folder is used only in local mode and only when none is set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="parley-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    It cuts the lineage, outlives lost executors, is computed once however often
    it is read, and later reads take only the columns they need. The planner
    also knows its size, so it can broadcast a small one.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def discard(staged: DataFrame) -> None:
    """Delete a table of ``stage`` whose successor is written and that nothing reads any more."""
    jvm, conf = staged.sparkSession._jvm, staged.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(staged._staged_at)
    path.getFileSystem(conf).delete(path, True)
