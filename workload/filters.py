"""Field access, cohort-filter atoms, predicate trees and other row tests."""

from __future__ import annotations

from parley.functions import predicates as PR
from parley.functions.events import field
from parley.operators import cohort as C, primitives as P, sampling
from parley.operators.digest import primitive_snapshot
from workload.binding import CHAT, EV, chat_events, events, table
from workload.features import FV, STRATUM, features
from workload.registry import add, r


@add("b1_event_field", """SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
  event_type, CAST(user_id AS VARCHAR) AS user_id FROM events""")
def _(spark, sf):
    raw = table(spark, sf, "events")
    return raw.select("event_id", field(raw, "k", "bigint", "props").alias("k"),
                      field(raw, "event_type", "string", "props").alias("event_type"),
                      field(raw, "user_id", "string", "props").alias("user_id"))


def keep(name, where, column, reuse=False):
    """Register a filter over the feature frame: the kept session ids."""
    @add(name, f"WITH {FV} SELECT session_id FROM fv WHERE {where}")
    def run(spark, sf):
        fv = features(spark, sf, reuse)
        test = column(fv) if callable(column) else column
        return fv.where(test).select("session_id")


def atom(*args):
    return lambda fv: PR.atom(*args)


def tree(node, **kw):
    return lambda fv: PR.predicate(node, fv, **kw)


keep("b2_cohort_filter", "turn_count >= 2 AND tool_error_count > 0",
     lambda fv: PR.cohort_filter([{"atom_id": "turn_count_at_least", "value": 2}, {"atom_id": "tool_error_occurred"},
                                  {"atom_id": "no_such_atom", "value": 1}]))
keep("b2a_main_stream_model_is", "main_stream_model_invoked = 'm_small'", atom("main_stream_model_is", "m_small"))
keep("b2b_main_stream_model_is_not", "main_stream_model_invoked IS DISTINCT FROM 'm_small'", atom("main_stream_model_is_not", "m_small"))
keep("b2c_turn_count_at_least", "turn_count >= 4", atom("turn_count_at_least", 4))
keep("b2d_turn_count_at_most", "turn_count <= 2", atom("turn_count_at_most", 2))
keep("b2e_duration_at_least_minutes", "session_duration_ms >= 6000 * 60000", atom("session_duration_at_least_minutes", "6000"))
keep("b2f_guardrail_triggered", "guardrail_triggered", atom("guardrail_triggered"))
keep("b2g_transfer_completed", "transfer_completed", atom("transfer_completed"))
keep("b2h_tool_error_occurred", "tool_error_count > 0", atom("tool_error_occurred"))
keep("b2i_tool_invoked_at_least", "tool_invocation_count >= 3", atom("tool_invoked_at_least", 3))
keep("b2j_interruption_at_least", "interruption_count >= 2", atom("interruption_at_least", 2))
keep("b2k_agent_ever_active", "contains(lower(agent_path), 'agent_2')", atom("agent_ever_active", "AGENT_2"))
keep("b2l_canary_variant_is", "traffic_split_variant = 'v1'", atom("canary_variant_is", "v1"))
keep("b2m_session_outcome_in", "session_outcome IN ('timeout', 'transferred')", atom("session_outcome_in", ["timeout", "transferred"]))
keep("b2n_opening_intent_is", "opening_intent_class = 'm_large'", atom("opening_intent_is", "m_large"))

GE3 = {"op": "CMP", "name": "turn_count", "cmp": ">=", "value": 3}
ERR = {"op": "CMP", "name": "tool_error_count", "cmp": ">", "value": 1}
keep("b3_predicate_tree", "(turn_count >= 3 OR tool_error_count > 1) AND NOT coalesce(main_stream_model = 'm_small', false)",
     tree({"op": "AND", "args": [{"op": "OR", "nodes": [GE3, ERR]},
                                 {"op": "NOT", "arg": {"op": "CMP", "name": "main_stream_model", "cmp": "==", "value": "m_small"}}]}))
keep("b3a_and", "turn_count >= 3 AND tool_error_count > 1", tree({"op": "AND", "args": [GE3, ERR]}))
keep("b3b_or", "turn_count >= 3 OR tool_error_count > 1", tree({"op": "OR", "args": [GE3, ERR]}))
keep("b3c_not", "NOT coalesce(traffic_split_variant = 'v1', false)",
     tree({"op": "NOT", "args": [{"op": "CMP", "name": "traffic_split_variant", "cmp": "==", "value": "v1"}]}))
keep("b3d_cmp_not_equal", "main_stream_model IS DISTINCT FROM 'm_zero'",
     tree({"op": "CMP", "name": "main_stream_model", "cmp": "!=", "value": "m_zero"}))
keep("b3d_cmp_numeric_text", "main_stream_latency_p95 < 12.5", tree({"op": "CMP", "name": "main_stream_latency_p95", "cmp": "<", "value": "12.5"}))
keep("b3d_cmp_boolean", "guardrail_triggered", tree({"name": "guardrail_triggered", "operator": "==", "value": True}))
keep("b3e_is_null", "traffic_split_variant IS NULL", tree({"op": "IS_NULL", "name": "traffic_split_variant"}))
keep("b3f_in", "interruption_count IN (1, 3)", tree({"op": "IN", "name": "interruption_count", "values": [1, 3, "2"]}))
keep("b3g_between", "main_stream_latency_p95 BETWEEN 5 AND 20.5", tree({"op": "BETWEEN", "name": "main_stream_latency_p95", "low": 5, "high": 20.5}))
keep("b4_median_relative", "turn_count > (SELECT median(turn_count) FROM fv)",
     lambda fv: PR.predicate({"op": "CMP", "name": "turn_count", "cmp": ">", "value": "median(turn_count)"}, fv,
                             {"turn_count": C.cohort_median(fv).scalar()}), reuse=True)
keep("b5_traffic_split", "traffic_split_variant = 'v0'", lambda fv: PR.traffic_split("v0"))
keep("b8_min_turns", "turn_count >= 2", lambda fv: PR.min_turns(2))


@add("b9_simple_predicate", f"""WITH {CHAT} SELECT session_id, count(*) FILTER (event_type = 'USER_QUERY') >= 2
    AND coalesce(bool_or(contains(lower(content), 'on')) FILTER (event_type = 'USER_QUERY'), false) AS matched
  FROM chat GROUP BY session_id""")
def _(spark, sf):
    return P.simple_flags(chat_events(spark, sf), min_turn_count=2, requires_tool_error=False, keyword="ON")


@add("b9_simple_predicate_tool_error", f"""WITH {EV} SELECT session_id, count(*) FILTER (event_type = 'USER_QUERY') >= 2
    AND count(*) FILTER (event_type = 'TOOL_CALL_RESULT' AND error IS NOT NULL) > 0 AS matched FROM ev GROUP BY session_id""")
def _(spark, sf):
    return P.simple_flags(events(spark, sf), min_turn_count=2, requires_tool_error=True)


@add("b11_primitive_snapshot", f"""WITH {FV} SELECT session_id, turn_count, round(main_stream_latency_p95, 6) AS main_stream_latency_p95,
  round(main_stream_estimated_cost_usd, 9) AS main_stream_estimated_cost_usd, tool_error_count, guardrail_triggered,
  opening_intent_class, session_outcome, main_stream_model FROM fv""")
def _(spark, sf):
    fv = features(spark, sf)
    s = fv.select("session_id", primitive_snapshot(fv).alias("s")).select("session_id", "s.*")
    return s.withColumns({"main_stream_latency_p95": r("main_stream_latency_p95"),
                          "main_stream_estimated_cost_usd": r("main_stream_estimated_cost_usd", 9)})


@add("g3_stratum", f"WITH {FV} SELECT session_id, {STRATUM} AS stratum FROM fv")
def _(spark, sf):
    return features(spark, sf).select("session_id", sampling.stratum().alias("stratum"))
