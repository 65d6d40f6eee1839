"""The per-session primitives."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import events as E
from parley.operators import primitives as P
from parley.operators.pricing import with_price
from workload.binding import CHAT, EV, chat_events, events, price
from workload.registry import add, joined, r


def per_session(name, sql_expr, having=""):
    """Register one combinable measure: its Column against its SQL aggregate."""
    def keep(make):
        @add(name, f"WITH {EV} SELECT session_id, {sql_expr} FROM ev GROUP BY session_id {having}")
        def run(spark, sf, make=make):
            cols = make()
            return events(spark, sf).groupBy("session_id").agg(*(cols if isinstance(cols, list) else [cols]))
        return make
    return keep


def n_of(t):
    return f"count(*) FILTER (event_type = '{t}')"


TURN_COUNT = n_of("USER_QUERY")
OUTCOME = """CASE WHEN count(*) FILTER (event_type = 'CALL_TRANSFER_COMPLETED') > 0 THEN 'transferred'
  ELSE coalesce(arg_min(status, us) FILTER (event_type = 'SESSION_END'), 'unknown') END"""


@per_session("d1_turn_count", f"{TURN_COUNT} AS turn_count")
def _():
    return P.count_of(E.USER_QUERY).alias("turn_count")


@per_session("d2_session_duration_ms", "(max(us) - min(us)) // 1000 AS session_duration_ms")
def _():
    return P.session_duration_ms().alias("session_duration_ms")


@per_session("d3_session_outcome", f"{OUTCOME} AS session_outcome")
def _():
    return P.session_outcome().alias("session_outcome")


@per_session("d4_outcome_bucket", f"CASE WHEN {OUTCOME} IN ('transferred', 'timeout', 'completed') THEN {OUTCOME} ELSE 'other' END AS outcome_bucket")
def _():
    return P.outcome_bucket(P.session_outcome()).alias("outcome_bucket")


@per_session("d5_length_bucket", f"CASE WHEN {TURN_COUNT} <= 4 THEN 'short' WHEN {TURN_COUNT} <= 10 THEN 'medium' ELSE 'long' END AS length_bucket")
def _():
    return P.length_bucket(P.count_of(E.USER_QUERY)).alias("length_bucket")


@per_session("d6_transfer_completed", f"{n_of('CALL_TRANSFER_COMPLETED')} > 0 AS transfer_completed")
def _():
    return P.any_of(E.of_type(E.TRANSFER)).alias("transfer_completed")


@per_session("d7_guardrail_triggered", "count(*) FILTER (event_type = 'GUARDRAIL_CHECK' AND would_block) > 0 AS guardrail_triggered")
def _():
    return P.guardrail_triggered().alias("guardrail_triggered")


@per_session("d8_interruption_count", f"{n_of('INTERRUPTION_HANDLER_RESULT')} AS interruption_count")
def _():
    return P.count_of(E.INTERRUPTION).alias("interruption_count")


LAST_MODEL = "arg_max(model_id, us) FILTER (event_type = 'LLM_INVOCATION_SUCCESS' AND purpose = 'main_stream')"


@per_session("d9_main_stream_model", f"{LAST_MODEL} AS main_stream_model")
def _():
    return P.main_stream_model().alias("main_stream_model")


@per_session("d10_main_stream_model_invoked", f"{LAST_MODEL} AS main_stream_model_invoked")
def _():
    return P.main_stream_model_invoked().alias("main_stream_model_invoked")


P95 = """p95 AS (
  SELECT session_id, purpose, CASE WHEN n = 1 THEN v[1] ELSE (v[j] * (20 - d) + v[j + 1] * d) / 20 END AS p95
  FROM (SELECT *, 19 * (n + 1) - 20 * j AS d FROM (
    SELECT *, greatest(least(19 * (n + 1) // 20, n - 1), 1) AS j FROM (
      SELECT session_id, purpose, list(latency_ms ORDER BY latency_ms) AS v, count(*) AS n
      FROM ev WHERE event_type = 'LLM_INVOCATION_SUCCESS' AND latency_ms <> 0 GROUP BY ALL))))"""
P95_WIDE = """wide AS (SELECT session_id,
  coalesce(max(p95) FILTER (purpose = 'main_stream'), 0.0) AS main_stream_latency_p95,
  coalesce(max(p95) FILTER (purpose = 'contextual_query'), 0.0) AS contextual_query_latency_p95,
  coalesce(max(p95) FILTER (purpose = 'router'), 0.0) AS router_latency_p95
  FROM (SELECT DISTINCT session_id FROM ev) LEFT JOIN p95 USING (session_id) GROUP BY session_id)"""


@add("d11_latency_p95", f"""WITH {EV}, {P95}, {P95_WIDE} SELECT session_id, round(main_stream_latency_p95, 6) AS main_stream_latency_p95,
  round(contextual_query_latency_p95, 6) AS contextual_query_latency_p95, round(router_latency_p95, 6) AS router_latency_p95 FROM wide""")
def _(spark, sf):
    fv = P.primitives(events(spark, sf), price(spark), None, None)
    return fv.select("session_id", *[r(f"{p}_latency_p95").alias(f"{p}_latency_p95") for p in P.PURPOSES])


@add("d11_latency_p95_any_size", f"WITH {EV}, {P95} SELECT session_id, round(p95, 6) AS p95 FROM p95 WHERE purpose = 'router'")
def _(spark, sf):
    return P.latency_p95(events(spark, sf), "router").select("session_id", r("p95").alias("p95"))


RATES = """(CASE model_id WHEN 'm_small' THEN {a} WHEN 'm_large' THEN {b} ELSE 0.0::DOUBLE END / 1000000)"""
COST = ("coalesce(sum(input_tokens * " + RATES.format(a="0.5::DOUBLE", b="2.0::DOUBLE") + " + output_tokens * "
        + RATES.format(a="1.5::DOUBLE", b="8.0::DOUBLE") + ") FILTER (event_type = 'TOKEN_USAGE_DETAILS' AND purpose = '{p}'), 0.0)")


@add("d12_estimated_cost", f"WITH {EV} SELECT session_id, " + ", ".join(
    f"round({COST.format(p=p)}, 9) AS {p}_estimated_cost_usd" for p in P.PURPOSES) + " FROM ev GROUP BY session_id")
def _(spark, sf):
    ev = with_price(events(spark, sf), price(spark))
    return ev.groupBy("session_id").agg(*[r(P.estimated_cost_usd(p), 9).alias(f"{p}_estimated_cost_usd") for p in P.PURPOSES])


@add("c3_with_price", f"""WITH {EV} SELECT event_id, model_id, {RATES.format(a="0.5::DOUBLE", b="2.0::DOUBLE")} AS input_rate,
  {RATES.format(a="1.5::DOUBLE", b="8.0::DOUBLE")} AS output_rate FROM ev WHERE event_type = 'TOKEN_USAGE_DETAILS'""")
def _(spark, sf):
    usage = events(spark, sf).where(E.of_type(E.TOKENS))
    return with_price(usage, price(spark)).select("event_id", "model_id", "input_rate", "output_rate")


@per_session("d13_token_sums", ", ".join(
    f"CAST(coalesce(sum({side}_tokens) FILTER (event_type = 'TOKEN_USAGE_DETAILS' AND purpose = '{p}'), 0) AS BIGINT) AS {p}_{side}_tokens_sum"
    for p in P.PURPOSES for side in ("input", "output")))
def _():
    return [P.tokens_sum(p, side).alias(f"{p}_{side}_tokens_sum") for p in P.PURPOSES for side in ("input", "output")]


@per_session("d14_tool_invocation_count", "count(*) FILTER (event_type IN ('DEBUG.TOOL_INVOKED', 'TOOL_CALL_RESULT')) AS tool_invocation_count")
def _():
    return P.count_of(E.TOOL_INVOKED, E.TOOL_RESULT).alias("tool_invocation_count")


@per_session("d15_tool_error_count", f"{n_of('TOOL_CALL_ERROR')} AS tool_error_count, count(*) FILTER (event_type = 'TOOL_CALL_RESULT' AND error IS NOT NULL) AS tool_result_error_count")
def _():
    return [P.count_of(E.TOOL_ERROR).alias("tool_error_count"), P.measures()["tool_result_error_count"].alias("tool_result_error_count")]


AVG_TOOL = "coalesce(avg(latency) FILTER (event_type = 'TOOL_CALL_RESULT' AND latency <> 0), 0.0)"


@per_session("d16_avg_tool_latency", f"round({AVG_TOOL}, 6) AS avg_tool_latency_ms")
def _():
    return r(P.avg_tool_latency_ms()).alias("avg_tool_latency_ms")


PATH = """path AS (SELECT session_id, string_agg(agent_name, '→' ORDER BY us, event_id) AS agent_path FROM (
    SELECT *, lag(agent_name) OVER (PARTITION BY session_id ORDER BY us, event_id) AS prev FROM ev WHERE event_type = 'RESPONSE.FINAL')
  WHERE prev IS NULL OR prev <> agent_name GROUP BY session_id)"""


@add("d17_agent_path", f"WITH {EV}, {PATH} SELECT session_id, coalesce(agent_path, '') AS agent_path FROM (SELECT DISTINCT session_id FROM ev) LEFT JOIN path USING (session_id)")
def _(spark, sf):
    return P.primitives(events(spark, sf), price(spark)).select("session_id", "agent_path")


@add("f3_agent_changes", f"""WITH {EV} SELECT session_id, pos, agent_name FROM (
    SELECT session_id, agent_name, lag(agent_name) OVER w AS prev, row_number() OVER w - 1 AS pos
    FROM ev WHERE event_type = 'RESPONSE.FINAL' WINDOW w AS (PARTITION BY session_id ORDER BY us, event_id))
  WHERE prev IS NULL OR prev <> agent_name""")
def _(spark, sf):
    return P.agent_changes(events(spark, sf))


@add("d18_traffic_split_variant", f"""WITH {EV} SELECT session_id, arg_min('v' || (k % 2), us) FILTER (event_type = 'INTERRUPTION_HANDLER_RESULT') AS traffic_split_variant
  FROM ev GROUP BY session_id""")
def _(spark, sf):
    # interruptions stand in for the bucket decision, which no driver row carries
    k = F.get_json_object("event_value", "$.k").cast("long")
    ev = events(spark, sf).withColumn("selected_variant_key", F.concat(F.lit("v"), (k % 2).cast("string"))).withColumn(
        "event_type", F.when(E.of_type(E.INTERRUPTION), E.CANARY).otherwise(F.col("event_type")))
    return ev.groupBy("session_id").agg(P.traffic_split_variant().alias("traffic_split_variant"))


def hit_list(col):
    return f"coalesce(string_agg(DISTINCT {col}, '|' ORDER BY {col}) FILTER ({col} <> ''), '')"


@add("d19_structured_hits", f"""WITH {EV} SELECT session_id, '' AS skills, '' AS tools, {hit_list('agent_name')} AS agent_names, '' AS nodes,
  {hit_list('purpose')} AS purposes, {hit_list('event_type')} AS event_types FROM ev GROUP BY session_id""")
def _(spark, sf):
    h = events(spark, sf).groupBy("session_id").agg(P.structured_hits().alias("h"))
    return h.select("session_id", *[joined(f"h.{k}").alias(k) for k in P.HIT_KEYS])


@add("d21_opening_text", f"""WITH {CHAT}, q AS (SELECT session_id, us, content, trim(content, chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)) AS said FROM chat WHERE event_type = 'USER_QUERY'),
  o AS (SELECT session_id, coalesce(arg_min(said, us) FILTER (said <> '' AND NOT contains(substr(lower(said), 1, 40), 'welcome')),
     arg_min(content, us) FILTER (content <> ''), '') AS opening_text FROM q GROUP BY session_id)
  SELECT session_id, coalesce(opening_text, '') AS opening_text FROM (SELECT DISTINCT session_id FROM chat) LEFT JOIN o USING (session_id)""")
def _(spark, sf):
    return chat_events(spark, sf).groupBy("session_id").agg(P.opening_text().alias("opening_text"))


@per_session("d22_agent_ever", "count(*) FILTER (event_type = 'RESPONSE.FINAL' AND lower(agent_name) = 'agent_1') > 0 AS agent_ever_agent_1")
def _():
    return P.agent_ever("AGENT_1").alias("agent_ever_agent_1")


def reducer(name, red, sql, **kw):
    @add(name, f"WITH {EV} SELECT session_id, {sql} FROM ev WHERE event_type = 'TOOL_CALL_RESULT' GROUP BY session_id")
    def run(spark, sf):
        out = P.primitive(events(spark, sf), "v", [E.TOOL_RESULT], red, "latency", **kw)
        return out.withColumn("v", r("v")) if dict(out.dtypes)["v"] == "double" else out


reducer("d23_reducer_p50", "p50", "round(median(latency), 6) AS v")
reducer("d23_reducer_max", "max", "round(max(latency), 6) AS v")
reducer("d23_reducer_min", "min", "round(min(latency), 6) AS v")
reducer("d23_reducer_sum", "sum", "round(sum(latency), 6) AS v")
reducer("d23_reducer_mean", "mean", "round(avg(latency), 6) AS v")
reducer("d23_reducer_distinct_count", "distinct_count", "count(DISTINCT latency) AS v")
reducer("d23_reducer_count", "count", "count(*) AS v")
reducer("d23_reducer_exists", "exists", "count(*) > 0 AS v")
reducer("d23_reducer_first", "first", "round(arg_min(latency, us), 6) AS v")
reducer("d23_reducer_last", "last", "round(arg_max(latency, us), 6) AS v")


@add("d23_reducer_p95", f"""WITH {EV} SELECT session_id, round(CASE WHEN n = 1 THEN v[1] ELSE (v[j] * (20 - d) + v[j + 1] * d) / 20 END, 6) AS v
  FROM (SELECT *, 19 * (n + 1) - 20 * j AS d FROM (SELECT *, greatest(least(19 * (n + 1) // 20, n - 1), 1) AS j FROM (
      SELECT session_id, list(latency ORDER BY latency) AS v, count(*) AS n FROM ev WHERE event_type = 'TOOL_CALL_RESULT' GROUP BY ALL)))""")
def _(spark, sf):
    return P.primitive(events(spark, sf), "v", [E.TOOL_RESULT], "p95", "latency").withColumn("v", r("v"))


@add("d23_reducer_time_diff", f"""WITH {EV} SELECT session_id, CAST(trunc((max(us) FILTER (event_type = 'TOOL_CALL_RESULT') - min(us) FILTER (event_type = 'USER_QUERY')) / 1000.0) AS BIGINT) AS v
  FROM ev GROUP BY session_id""")
def _(spark, sf):
    return P.primitive(events(spark, sf), "v", [E.USER_QUERY], "time_diff", types_to=[E.TOOL_RESULT])


ROLLUP = f"""min(us) AS first_us, max(us) AS last_us, {TURN_COUNT} AS turn_count, {n_of('TOOL_CALL_RESULT')} AS tool_count,
  count(*) FILTER (event_type = 'TOOL_CALL_RESULT' AND error IS NOT NULL) AS tool_error_count,
  coalesce(sum(latency) FILTER (event_type = 'TOOL_CALL_RESULT'), 0.0) AS tool_latency_sum"""


@add("d24_session_rollup", f"WITH {EV} SELECT * REPLACE (round(tool_latency_sum, 6) AS tool_latency_sum) FROM (SELECT session_id, {ROLLUP} FROM ev GROUP BY session_id)")
def _(spark, sf):
    return P.session_rollup(events(spark, sf)).withColumn("tool_latency_sum", r("tool_latency_sum"))


@add("d25_session_queries", f"""WITH {CHAT} SELECT session_id, CAST(0 AS BIGINT) AS part, {TURN_COUNT} AS turn_count, false AS has_tool_error,
  coalesce(string_agg(content, '|' ORDER BY us) FILTER (event_type = 'USER_QUERY'), '') AS queries FROM chat GROUP BY session_id""")
def _(spark, sf):
    q = P.session_queries(chat_events(spark, sf))
    return q.withColumns({"queries": joined("queries"), "part": F.col("part").cast("long")})


@add("f4_first_last", f"""WITH {EV} SELECT session_id, arg_min(model_id, us) FILTER (event_type = 'LLM_INVOCATION_SUCCESS') AS first_model,
  arg_max(model_id, us) FILTER (event_type = 'LLM_INVOCATION_SUCCESS') AS last_model FROM ev GROUP BY session_id""")
def _(spark, sf):
    call = E.of_type(E.LLM_SUCCESS)
    return events(spark, sf).groupBy("session_id").agg(
        P.first_of(F.col("model_id"), call).alias("first_model"), P.last_of(F.col("model_id"), call).alias("last_model"))
