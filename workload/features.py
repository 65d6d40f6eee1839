"""The bound feature frame, in Spark and in SQL, for queries above the event level."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parley.operators import primitives as P
from parley.session import stage
from workload.binding import EV, events, price
from workload.measures import AVG_TOOL, COST, OUTCOME, P95, P95_WIDE, PATH, TURN_COUNT, n_of

KEPT = ["session_id", "turn_count", "session_duration_ms", "session_outcome", "outcome_bucket", "length_bucket",
        "main_stream_model", "main_stream_model_invoked", "tool_invocation_count", "tool_error_count", "transfer_completed",
        "guardrail_triggered", "interruption_count", "agent_path", "main_stream_latency_p95", "router_latency_p95",
        "avg_tool_latency_ms", "main_stream_estimated_cost_usd", "traffic_split_variant", "opening_intent_class"]


def features(spark, sf, reuse: bool = False) -> DataFrame:
    """Feature rows with their cohort; the intent class is the main model's.

    A query that reads the frame more than once writes it first (``reuse``).
    """
    ev = events(spark, sf)
    fv = P.primitives(ev, price(spark), None, None).select(*KEPT, "structured_hits")
    fv = fv.withColumns({
        "opening_intent_class": F.coalesce("main_stream_model", F.lit("unknown")),
        "traffic_split_variant": F.when(F.col("interruption_count") > 0, F.concat(F.lit("v"), (F.col("interruption_count") % 2).cast("string"))),
    })
    # a session id ends in its week, which decides the cohort
    week = F.substring_index("session_id", "-", -1)
    fv = fv.withColumn("cohort", F.when(week < "20240115", "before").otherwise("after"))
    return stage(fv) if reuse else fv


FV = f"""{EV}, {P95}, {P95_WIDE}, {PATH}, base AS (
  SELECT session_id, min(cohort) AS cohort, {TURN_COUNT} AS turn_count, (max(us) - min(us)) // 1000 AS session_duration_ms,
    {OUTCOME} AS session_outcome, arg_max(model_id, us) FILTER (event_type = 'LLM_INVOCATION_SUCCESS' AND purpose = 'main_stream') AS main_stream_model,
    {n_of('TOOL_CALL_RESULT')} AS tool_invocation_count, {n_of('TOOL_CALL_ERROR')} AS tool_error_count,
    {n_of('CALL_TRANSFER_COMPLETED')} > 0 AS transfer_completed,
    count(*) FILTER (event_type = 'GUARDRAIL_CHECK' AND would_block) > 0 AS guardrail_triggered,
    {n_of('INTERRUPTION_HANDLER_RESULT')} AS interruption_count,
    {AVG_TOOL} AS avg_tool_latency_ms, {COST.format(p='main_stream')} AS main_stream_estimated_cost_usd
  FROM ev GROUP BY session_id),
  fv AS (SELECT base.*, main_stream_model AS main_stream_model_invoked,
    CASE WHEN session_outcome IN ('transferred', 'timeout', 'completed') THEN session_outcome ELSE 'other' END AS outcome_bucket,
    CASE WHEN turn_count <= 4 THEN 'short' WHEN turn_count <= 10 THEN 'medium' ELSE 'long' END AS length_bucket,
    CASE WHEN interruption_count > 0 THEN 'v' || (interruption_count % 2) END AS traffic_split_variant,
    coalesce(main_stream_model, 'unknown') AS opening_intent_class,
    coalesce(agent_path, '') AS agent_path, main_stream_latency_p95, router_latency_p95
    FROM base LEFT JOIN path USING (session_id) JOIN wide USING (session_id))"""

# (opening intent | outcome | length) as one string
STRATUM = "opening_intent_class || '|' || outcome_bucket || '|' || length_bucket"
