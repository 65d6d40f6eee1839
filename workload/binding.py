"""Driver tables seen as the engine's inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parley.functions.events import complete
from parley.schemas import PRICE
from parley.session import literal_table


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _role() -> Column:
    k, t = F.col("k"), F.col("event_type")
    return (
        F.when(t == "click", F.array(F.lit("USER_QUERY")))
        .when(t == "view", F.array(F.lit("LLM_INVOCATION_SUCCESS"), F.lit("TOKEN_USAGE_DETAILS")))
        .when(t == "purchase", F.array(F.lit("TOOL_CALL_RESULT")))
        .when(t == "error", F.array(F.when(k < 60, "TOOL_CALL_ERROR").otherwise("GUARDRAIL_CHECK")))
        .otherwise(F.array(
            F.when(k < 5, "CALL_TRANSFER_COMPLETED").when(k < 45, "INTERRUPTION_HANDLER_RESULT")
            .when(k < 75, "SESSION_END").otherwise("RESPONSE.FINAL")))
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The flat event table; a ``view`` row is both a model call and its usage."""
    raw = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    week = F.date_trunc("week", F.col("ts"))
    k, v, role = F.col("k"), F.col("value"), F.col("role")
    llm = role.isin("LLM_INVOCATION_SUCCESS", "TOKEN_USAGE_DETAILS")
    rows = raw.select(
        "*", F.posexplode(_role()).alias("copy", "role")
    ).select(
        (F.col("event_id") * 2 + F.col("copy")).alias("event_id"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format(week, "yyyyMMdd")).alias("session_id"),
        F.when(week < F.lit("2024-01-15").cast("timestamp"), "before").otherwise("after").alias("cohort"),
        role.alias("event_type"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("props").alias("event_value"),
        (k % 7 == 0).alias("is_debug_event"),
        F.when(llm, F.get(F.array(F.lit("main_stream"), F.lit("contextual_query"), F.lit("router")),
                          (k % 3).cast("int"))).alias("purpose"),
        F.when(llm, F.get(F.array(F.lit("m_small"), F.lit("m_large"), F.lit("m_zero"), F.lit("m_unknown")),
                          (k % 4).cast("int"))).alias("model_id"),
        F.when(role == "LLM_INVOCATION_SUCCESS", v).alias("latency_ms"),
        F.when(role == "TOKEN_USAGE_DETAILS", k * 10).alias("input_tokens"),
        F.when(role == "TOKEN_USAGE_DETAILS", F.floor(v)).alias("output_tokens"),
        F.when(role == "TOOL_CALL_RESULT", v).alias("latency"),
        F.when((role == "TOOL_CALL_RESULT") & (k < 10), "e").alias("error"),
        F.when(role == "GUARDRAIL_CHECK", k >= 90).alias("would_block"),
        F.when(role == "SESSION_END", F.when(k < 60, "completed").otherwise("timeout")).alias("status"),
        F.when(role == "RESPONSE.FINAL", F.concat(F.lit("agent_"), (k % 3).cast("string"))).alias("agent_name"),
        (k * 3 % 50).alias("secs_since_session_start"),
    )
    return complete(rows)


EV = """ev AS (
  WITH raw AS (
    SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, date_trunc('week', ts) AS wk FROM events),
  roles AS (
    SELECT *, 0 AS copy, CASE event_type
        WHEN 'click' THEN 'USER_QUERY' WHEN 'view' THEN 'LLM_INVOCATION_SUCCESS'
        WHEN 'purchase' THEN 'TOOL_CALL_RESULT'
        WHEN 'error' THEN CASE WHEN k < 60 THEN 'TOOL_CALL_ERROR' ELSE 'GUARDRAIL_CHECK' END
        ELSE CASE WHEN k < 5 THEN 'CALL_TRANSFER_COMPLETED' WHEN k < 45 THEN 'INTERRUPTION_HANDLER_RESULT'
             WHEN k < 75 THEN 'SESSION_END' ELSE 'RESPONSE.FINAL' END END AS role FROM raw
    UNION ALL SELECT *, 1, 'TOKEN_USAGE_DETAILS' FROM raw WHERE event_type = 'view')
  SELECT event_id * 2 + copy AS event_id,
    user_id || '-' || strftime(wk, '%Y%m%d') AS session_id,
    CASE WHEN wk < TIMESTAMP '2024-01-15' THEN 'before' ELSE 'after' END AS cohort,
    role AS event_type, ts, epoch_us(ts) AS us, user_id, k, value, props, copy,
    k % 7 = 0 AS is_debug_event,
    CASE WHEN role IN ('LLM_INVOCATION_SUCCESS', 'TOKEN_USAGE_DETAILS')
      THEN CASE k % 3 WHEN 0 THEN 'main_stream' WHEN 1 THEN 'contextual_query' ELSE 'router' END END AS purpose,
    CASE WHEN role IN ('LLM_INVOCATION_SUCCESS', 'TOKEN_USAGE_DETAILS')
      THEN CASE k % 4 WHEN 0 THEN 'm_small' WHEN 1 THEN 'm_large' WHEN 2 THEN 'm_zero' ELSE 'm_unknown' END END AS model_id,
    CASE WHEN role = 'LLM_INVOCATION_SUCCESS' THEN value END AS latency_ms,
    CASE WHEN role = 'TOKEN_USAGE_DETAILS' THEN k * 10 END AS input_tokens,
    CASE WHEN role = 'TOKEN_USAGE_DETAILS' THEN CAST(floor(value) AS BIGINT) END AS output_tokens,
    CASE WHEN role = 'TOOL_CALL_RESULT' THEN value END AS latency,
    CASE WHEN role = 'TOOL_CALL_RESULT' AND k < 10 THEN 'e' END AS error,
    CASE WHEN role = 'GUARDRAIL_CHECK' THEN k >= 90 END AS would_block,
    CASE WHEN role = 'SESSION_END' THEN CASE WHEN k < 60 THEN 'completed' ELSE 'timeout' END END AS status,
    CASE WHEN role = 'RESPONSE.FINAL' THEN 'agent_' || (k % 3) END AS agent_name,
    k * 3 % 50 AS secs_since_session_start
  FROM roles)"""


def price(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, [("m_small", 0.5, 1.5, False), ("m_large", 2.0, 8.0, False), ("m_zero", 9.0, 9.0, True)], PRICE)


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The session index derived from the event table."""
    ev = events(spark, sf)
    u = F.col("user_id")
    per = ev.groupBy("session_id").agg(
        F.min("timestamp").alias("start_time"),
        F.count_if(F.col("event_type") == "SESSION_END").alias("ends"),
    ).withColumn("user_id", F.substring_index("session_id", "-", 1).cast("long"))
    return per.select(
        F.md5("session_id").alias("_id"),
        F.when(u % 5 != 0, F.col("session_id")).alias("voice_session_id"),
        F.concat(F.lit("t"), (u % 3).cast("string")).alias("tenant"),
        F.concat(F.lit("o"), (u % 4).cast("string")).alias("assistant_origin_id"),
        F.concat(F.lit("a"), (u % 2).cast("string")).alias("assistant_id"),
        "start_time",
        F.when(u % 10 == 0, "x").alias("external_chat_session"),
        F.lit(None).cast("string").alias("chat_transport_provider"),
        F.struct(F.when(F.col("ends") > 1, 1).otherwise(0).alias("reconnects")).alias("voice_session"),
    )


S = EV + """, s AS (
  SELECT md5(session_id) AS _id, CASE WHEN u % 5 <> 0 THEN session_id END AS voice_session_id,
    't' || (u % 3) AS tenant, 'o' || (u % 4) AS assistant_origin_id, 'a' || (u % 2) AS assistant_id,
    start_time, CASE WHEN u % 10 = 0 THEN 'x' END AS external_chat_session,
    CAST(NULL AS VARCHAR) AS chat_transport_provider,
    CASE WHEN ends > 1 THEN 1 ELSE 0 END AS reconnects
  FROM (SELECT session_id, min(user_id) AS u, min(ts) AS start_time,
          count(*) FILTER (event_type = 'SESSION_END') AS ends FROM ev GROUP BY session_id))"""


def cohort_of(ev: DataFrame) -> DataFrame:
    """(session_id, cohort): a bound session lies in one week, so in one cohort."""
    return ev.groupBy("session_id").agg(F.min("cohort").alias("cohort"))


def chat_events(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as events; two turns make a request."""
    c = table(spark, sf, "conversations")
    return complete(c.select(
        F.col("turn").alias("event_id"), F.col("conv_id").cast("string").alias("session_id"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.floor(F.col("turn") / 2).cast("string")).alias("request_id"),
        F.when(F.col("role") == "user", "USER_QUERY").when(F.col("role") == "assistant", "RESPONSE.FINAL")
        .otherwise("SYSTEM").alias("event_type"),
        F.timestamp_seconds(F.col("turn")).alias("timestamp"),
        F.col("text").alias("content"),
        F.when(F.col("role") == "assistant", F.concat(F.lit("agent_"), (F.col("conv_id") % 3).cast("string")))
        .alias("agent_name"),
    ))


CHAT = """chat AS (
  SELECT turn AS event_id, CAST(conv_id AS VARCHAR) AS session_id, conv_id || '-' || (turn // 2) AS request_id,
    CASE role WHEN 'user' THEN 'USER_QUERY' WHEN 'assistant' THEN 'RESPONSE.FINAL' ELSE 'SYSTEM' END AS event_type,
    turn * 1000000 AS us, text AS content,
    CASE WHEN role = 'assistant' THEN 'agent_' || (conv_id % 3) END AS agent_name
  FROM conversations)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


VEC = "vec AS (SELECT vec_id, label, embedding::DOUBLE[] AS embedding FROM embeddings)"
