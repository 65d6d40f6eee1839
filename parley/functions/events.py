"""Expressions over one event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from parley.schemas import EVENT_FIELDS

# Event types the measures count.
USER_QUERY = "USER_QUERY"
RESPONSE_FINAL = "RESPONSE.FINAL"
SESSION_END = "SESSION_END"
METRICS = "SESSION_METRICS_COMPUTED"
LLM_SUCCESS = "LLM_INVOCATION_SUCCESS"
LLM_ERROR = "LLM_INVOCATION_ERROR"
LLM_CONFIG = "LLM_CONFIG_RESOLVED"
TOKENS = "TOKEN_USAGE_DETAILS"
GUARDRAIL = "GUARDRAIL_CHECK"
TRANSFER = "CALL_TRANSFER_COMPLETED"
INTERRUPTION = "INTERRUPTION_HANDLER_RESULT"
TOOL_INVOKED = "DEBUG.TOOL_INVOKED"
TOOL_RESULT = "TOOL_CALL_RESULT"
TOOL_ERROR = "TOOL_CALL_ERROR"
CANARY = "CANARY_BUCKET_DECISION"

# The event types shown by default in an event-count audit.
DISPLAY_TYPES = [
    "CALL_TRANSFER_COMPLETED", "CALL_TRANSFER_PAYLOAD", "CALL_TRANSFER_REQUESTED",
    "CONTEXTUAL_QUERY_GENERATED", "DEBUG.SKILL_ROUTED", "DEBUG.TOOL_INVOKED",
    "RESPONSE.FINAL", "SESSION_END", "TOOL_CALL_ERROR", "TOOL_CALL_RESULT",
    "USER_QUERY", "WEBSOCKET.CONNECTED",
]


def of_type(*types: str) -> Column:
    c = F.col("event_type")
    return c == types[0] if len(types) == 1 else c.isin(list(types))


def parse_time(text: Column) -> Column:
    """ISO-8601 text to a timestamp; bad text is null."""
    return F.try_to_timestamp(text)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def ms_between(first: Column, last: Column) -> Column:
    """Whole milliseconds from one time in microseconds to another, cut toward 0."""
    d = last - first
    return F.signum(d).cast("long") * F.floor(F.abs(d) / 1000)


def event_order() -> Column:
    """Chronological key; a missing time comes first, ties by event id."""
    return F.expr("struct(unix_micros(cast(timestamp AS timestamp)) AS us, event_id AS id)")


def field(df: DataFrame, key: str, kind: T.DataType | str, value: str = "event_value") -> Column:
    """``event_value[key]`` where the key is present, else the event's own ``key``.

    ``event_value`` is a VARIANT or JSON text. A present JSON null counts as
    present.
    """
    name = kind if isinstance(kind, str) else kind.simpleString()
    source = F.col(value)
    if isinstance(df.schema[value].dataType, T.StringType):
        source = F.try_parse_json(source)
    path = f"$.{key}"
    inside = F.try_variant_get(source, path, name)
    if key not in df.columns:
        return inside
    present = F.try_variant_get(source, path, "variant").isNotNull()
    return F.when(present, inside).otherwise(F.col(key).cast(name))


def event_key(ev: DataFrame, key: str, kind: T.DataType | str = "string") -> Column:
    """Any key of an event: its typed column if there is one, else from ``event_value``."""
    return F.col(key) if key in ev.columns else field(ev, key, kind)


def complete(ev: DataFrame) -> DataFrame:
    """Add the event columns ``ev`` lacks as typed nulls."""
    have = set(ev.columns)
    missing = [
        F.expr(f"CAST(NULL AS {t.simpleString()}) AS {n}") for n, t in EVENT_FIELDS.items() if n not in have
    ]
    return ev.select("*", *missing) if missing else ev
