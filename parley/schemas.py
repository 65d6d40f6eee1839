"""Explicit schemas of the input tables; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


_S, _L, _D, _B, _TS = (
    T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)

SESSION_INDEX = _struct(
    _id=_S, voice_session_id=_S, tenant=_S, assistant_origin_id=_S, assistant_id=_S,
    start_time=_TS, external_chat_session=_S, chat_transport_provider=_S,
    voice_session=_struct(reconnects=T.IntegerType()),
)

# an event as it is logged: event_value is free JSON
RAW_EVENT = _struct(
    event_id=_L, session_id=_S, request_id=_S, turn_id=_S, event_type=_S, timestamp=_TS,
    content=_S, event_value=T.VariantType(), is_debug_event=_B,
)

# keys of event_value the measures read, as typed columns of the flat event table
EVENT_VALUE_FIELDS: dict[str, T.DataType] = {
    "purpose": _S, "latency_ms": _D, "model_id": _S, "final_model_id": _S,
    "input_tokens": _L, "output_tokens": _L,
    "would_block": _B, "flagged_categories": T.ArrayType(_S),
    "latency": _D, "error": _S, "result": _S, "output": _S,
    "status": _S, "end_reason": _S, "agent_name": _S, "selected_variant_key": _S,
    "skill_name": _S, "skill": _S, "skill_id": _S,
    "tool_name": _S, "tool": _S, "tool_id": _S,
    "node_name": _S, "node": _S, "dialog_node": _S,
    "secs_since_session_start": _L,
}

# a logged event may carry those keys beside event_value, which goes first
LOGGED_EVENT = T.StructType(RAW_EVENT.fields + [T.StructField(n, t, True) for n, t in EVENT_VALUE_FIELDS.items()])

TRACE = _struct(session_id=_S, resolved_from=_S, events=T.ArrayType(LOGGED_EVENT))

EVENT_FIELDS: dict[str, T.DataType] = {
    "event_id": _L, "session_id": _S, "request_id": _S, "turn_id": _S, "event_type": _S,
    "timestamp": _TS, "content": _S, "event_value": _S, "is_debug_event": _B,
    **EVENT_VALUE_FIELDS,
}

TURN_ROW = _struct(
    session_id=_S, query=_S, final_response=_S, agent_name=_S,
    tool_call_list=T.ArrayType(_struct(name=_S, arguments=_S, result=_S, error=_S)),
    created_at=_TS,
)

PRICE = _struct(
    model_id=_S, input_usd_per_million=_D, output_usd_per_million=_D, zero_cost=_B,
)

PROPOSAL = _struct(
    seq=_L, id=_S, target_key=_S, confidence=_S, title=_S, status=_S,
    evidence=T.ArrayType(_struct(finding_id=_S, summary=_S, session_ids=T.ArrayType(_S))),
)

TIMING = _struct(
    ts=_TS, phase=_S, component=_S, session_id=_S, duration_ms=_D, cache_hit=_B, error=_S,
)
