"""Event, trace, turn-row, session and timing readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from parley import schemas
from parley.functions.events import complete, field


def _read(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"')
    return reader.schema(schema).load(path)


def flatten_event_value(raw: DataFrame) -> DataFrame:
    """Read the JSON of each event once and keep the known keys as typed columns.

    Written to Parquet in this form, a measure scans only the keys it needs.
    """
    if "event_value" not in raw.columns:
        return complete(raw)
    is_text = isinstance(raw.schema["event_value"].dataType, T.StringType)
    text = F.col("event_value") if is_text else F.to_json("event_value")
    # parse once, then read every key from the parsed value
    parsed = raw.withColumn("_v", F.try_parse_json("event_value") if is_text else F.col("event_value"))
    cols = {k: field(parsed, k, t, "_v") for k, t in schemas.EVENT_VALUE_FIELDS.items()}
    return complete(parsed.withColumns({**cols, "event_value": text}).drop("_v"))


def read_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The event table in flat form from Parquet, JSON lines or CSV."""
    # CSV columns go by position, so only the common ones are declared there
    schema = schemas.RAW_EVENT if fmt == "csv" else schemas.LOGGED_EVENT
    if fmt != "json":
        schema = T.StructType([
            T.StructField(f.name, T.StringType() if f.name == "event_value" else f.dataType)
            for f in schema.fields
        ])
    return flatten_event_value(_read(spark, path, fmt, schema))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace responses ``{session_id, resolved_from, events[]}`` as flat events.

    An event without an id takes its place in the response.
    """
    traces = _read(spark, path, "json", schemas.TRACE)
    rows = traces.select(F.col("session_id").alias("_sid"), F.posexplode("events").alias("_pos", "e"))
    flat = rows.select("_sid", "_pos", "e.*")
    flat = flat.withColumns({
        "session_id": F.coalesce("session_id", "_sid"),
        "event_id": F.coalesce("event_id", F.col("_pos").cast("long")),
    }).drop("_sid", "_pos")
    return flatten_event_value(flat)


def read_sessions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, fmt, schemas.SESSION_INDEX)


def read_turn_rows(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, fmt, schemas.TURN_ROW)


def read_proposals(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return _read(spark, path, fmt, schemas.PROPOSAL)


def read_timing(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "json", schemas.TIMING)
