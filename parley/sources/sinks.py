"""Writers. Every one is a plain distributed write; nothing passes the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame


def materialize(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> DataFrame:
    """Write a table as Parquet and read it back, cutting its lineage."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def missing_only(sessions: DataFrame, cached: DataFrame, key: str = "session_id") -> DataFrame:
    """Sessions a cached feature table does not hold yet."""
    return sessions.join(cached.select(key), key, "left_anti")


def write_per_conversation(rows: DataFrame, path: str) -> None:
    """One JSON line per session with its values and flags, a folder per cohort."""
    rows.write.mode("overwrite").partitionBy("cohort").json(path)


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
