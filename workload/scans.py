"""Session scopes, scans and index rollups."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parley.functions.events import micros
from parley.operators import eventlog, scope
from parley.operators.primitives import primitives
from parley.plans.feature_store import FeatureStore
from parley.session import shared_folder
from parley.sources.layout import read_log, write_log
from parley.sources.sinks import missing_only
from workload.binding import EV, S, events, price, sessions, table
from workload.measures import TURN_COUNT
from workload.registry import add, joined

SCOPE = dict(tenant="t1", origin_id="o1", start="2024-01-03 00:00:00", end="2024-01-24 00:00:00")
STUDY = {
    "study_type": "comparative", "tenant": "t1", "assistant_origin_id": "o1", "channel": "voice",
    "date_range_before": {"start": "2024-01-01 00:00:00", "end": "2024-01-17 00:00:00"},
    "date_range_after": {"start": "2024-01-15 00:00:00", "end": "2024-01-31 00:00:00"},
}
IN_SCOPE = """tenant = 't1' AND assistant_origin_id = 'o1'
  AND start_time BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-24'"""
PUBLIC = "coalesce(nullif(voice_session_id, ''), _id)"


@add("a1_scope_sessions", f"WITH {S} SELECT {PUBLIC} AS session_id FROM s WHERE {IN_SCOPE} AND voice_session_id IS NOT NULL AND assistant_id = 'a1'")
def _(spark, sf):
    return scope.scope_sessions(sessions(spark, sf), channel="voice", assistant_id="a1", **SCOPE)


@add("a2_channel_chat", f"""WITH {S} SELECT _id, voice_session_id IS NOT NULL AS voice,
  voice_session_id IS NULL AND (external_chat_session IS NOT NULL OR chat_transport_provider IS NOT NULL) AS chat FROM s""")
def _(spark, sf):
    return sessions(spark, sf).select("_id", scope.channel_is("voice").alias("voice"), scope.channel_is("chat").alias("chat"))


@add("a3_public_id", f"WITH {S} SELECT _id, {PUBLIC} AS session_id FROM s")
def _(spark, sf):
    return sessions(spark, sf).select("_id", scope.public_id().alias("session_id"))


@add("a4_cohorts", f"""WITH {S}, v AS (SELECT {PUBLIC} AS session_id, start_time FROM s
    WHERE tenant = 't1' AND assistant_origin_id = 'o1' AND voice_session_id IS NOT NULL)
  SELECT session_id, 'before' AS cohort FROM v WHERE start_time BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-17'
  UNION ALL
  SELECT session_id, 'after' FROM v WHERE start_time BETWEEN TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-01-31'""")
def _(spark, sf):
    return scope.cohorts(sessions(spark, sf), STUDY).select("session_id", "cohort")


@add("a5_event_scan", """SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
  CAST(NULL AS VARCHAR) AS purpose FROM events""")
def _(spark, sf):
    from parley.sources.events import flatten_event_value
    from parley.functions.events import field

    raw = table(spark, sf, "events").withColumnRenamed("props", "event_value")
    k = field(raw, "k", "bigint")
    return flatten_event_value(raw.withColumn("k", k)).select("event_id", "k", "purpose")


def _turn_rows(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.when(F.col("role") == "user", F.col("text")).alias("query"),
        F.when(F.col("role") != "user", F.col("text")).alias("final_response"),
        F.timestamp_seconds("turn").alias("created_at"))


def _chat_index(spark, sf):
    return table(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("_id")).agg(
        F.max("turn").alias("last")).select(
        "_id", F.lit(None).cast("string").alias("voice_session_id"),
        F.struct(F.when(F.col("last") > 5, 1).otherwise(0).alias("reconnects")).alias("voice_session"))


@add("a6_turn_rows", """SELECT CAST(conv_id AS VARCHAR) AS session_id, text AS query, turn * 1000000 AS us
  FROM conversations WHERE role = 'user' AND conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')""")
def _(spark, sf):
    ids = table(spark, sf, "conversations").where("role = 'system'").select(F.col("conv_id").cast("string").alias("session_id")).distinct()
    rows = _turn_rows(spark, sf)
    return eventlog.turn_rows_for(rows, ids).where("query IS NOT NULL").select(
        "session_id", "query", micros(F.col("created_at")).alias("us"))


@add("a7_session_detail", """SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(0 AS BIGINT) AS part,
    count(*) AS turn_count, max(turn) > 5 AS is_reconnect,
    string_agg(CASE WHEN role = 'user' THEN 'Q:' ELSE 'R:' END || text, '|' ORDER BY turn) AS turns
  FROM conversations GROUP BY conv_id""")
def _(spark, sf):
    d = eventlog.session_detail(_turn_rows(spark, sf), _chat_index(spark, sf))
    line = F.transform("turns", lambda t: F.when(t.query.isNotNull(), F.concat(F.lit("Q:"), t.query))
                       .otherwise(F.concat(F.lit("R:"), t.final_response)))
    return d.select("session_id", F.col("part").cast("long").alias("part"), "turn_count", "is_reconnect",
                    joined(line).alias("turns"))


@add("a8_tenants", f"WITH {S} SELECT DISTINCT tenant FROM s WHERE tenant IS NOT NULL AND tenant NOT IN ('', 'None')")
def _(spark, sf):
    return scope.tenants(sessions(spark, sf))


@add("a9_missing_only", f"""WITH {S} SELECT {PUBLIC} AS session_id FROM s
  WHERE {PUBLIC} NOT IN (SELECT session_id FROM ev WHERE event_type = 'USER_QUERY')""")
def _(spark, sf):
    have = events(spark, sf).where("event_type = 'USER_QUERY'").select("session_id").distinct()
    ids = sessions(spark, sf).select(scope.public_id().alias("session_id"))
    return missing_only(ids, have)


LOG = "count(*) AS n, min(us) AS lo, max(us) AS hi, arg_max(event_id, CAST(us AS HUGEINT) * 10000000000 + event_id) AS last"


@add("a9_incremental", f"""WITH {EV}, a AS (SELECT session_id, {LOG} FROM ev WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1),
  b AS (SELECT session_id, {LOG}, {TURN_COUNT} AS turn_count, (max(us) - min(us)) // 1000 AS session_duration_ms FROM ev WHERE user_id % 11 <> 0 GROUP BY 1)
  SELECT coalesce(a.session_id, b.session_id) AS session_id, CASE WHEN b.n IS NULL THEN 'gone' WHEN a.n IS NULL THEN 'added'
    WHEN (a.n, a.lo, a.hi, a.last) IS DISTINCT FROM (b.n, b.lo, b.hi, b.last) THEN 'changed' ELSE 'kept' END AS status, turn_count, session_duration_ms
  FROM a FULL JOIN b ON a.session_id = b.session_id""")
def _(spark, sf):
    """The store after a first log, then after a later one in which sessions grew, came and went."""
    ev = events(spark, sf)
    store = FeatureStore(spark, f"{shared_folder(spark)}/features-{uuid.uuid4().hex}", buckets=16)

    def measure(log):
        return primitives(log, price(spark)).select("session_id", "turn_count", "session_duration_ms")

    store.refresh(ev.where("timestamp < TIMESTAMP '2024-01-16'"), measure)
    later = store.refresh(ev.where(F.substring_index("session_id", "-", 1).cast("long") % 11 != 0), measure)
    out = store.read().join(later.touched, "session_id", "full")
    return out.withColumn("status", F.coalesce("status", F.lit("kept")))


@add("a5_laid_out_log", f"""WITH {EV} SELECT session_id, count(*) AS n, {TURN_COUNT} AS turn_count, (max(us) - min(us)) // 1000 AS session_duration_ms FROM ev GROUP BY session_id""")
def _(spark, sf):
    """Measures from the log stored in buckets, sessions of more than twenty events apart."""
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    write_log(events(spark, sf), path, 8, limit=20)
    log = read_log(spark, path, 8)
    sizes = log.per_session(lambda ev: ev.groupBy("session_id").agg(F.count("*").alias("n")))
    return log.primitives(price(spark)).select("session_id", "turn_count", "session_duration_ms").join(sizes, "session_id")


@add("a17_preview_count", f"WITH {S} SELECT count(*) AS session_count FROM s WHERE {IN_SCOPE} AND voice_session_id IS NULL AND external_chat_session IS NOT NULL")
def _(spark, sf):
    return scope.preview_count(sessions(spark, sf), channel="chat", **SCOPE)


@add("b10_reconnect", f"WITH {S} SELECT _id, {PUBLIC} AS session_id, reconnects >= 1 AS is_reconnect FROM s")
def _(spark, sf):
    return scope.reconnects(sessions(spark, sf))


@add("c1_events_for", f"""WITH {S} SELECT event_id, session_id, event_type FROM ev
  WHERE session_id IN (SELECT voice_session_id FROM s WHERE tenant = 't1')""")
def _(spark, sf):
    ids = sessions(spark, sf).where("tenant = 't1' AND voice_session_id IS NOT NULL").select(F.col("voice_session_id").alias("session_id"))
    return scope.events_for(events(spark, sf), ids).select("event_id", "session_id", "event_type")


@add("c2_resolve_ids", f"""WITH {S} SELECT i.session_id, coalesce(s._id, i.session_id) AS internal_id
  FROM (SELECT DISTINCT session_id FROM ev) i LEFT JOIN s ON s.voice_session_id = i.session_id""")
def _(spark, sf):
    ids = events(spark, sf).select("session_id").distinct()
    return scope.resolve_ids(ids, sessions(spark, sf))


@add("c2_resolve_known", f"""WITH {S}, i AS (SELECT DISTINCT session_id FROM ev UNION ALL SELECT _id FROM s)
  SELECT i.session_id, coalesce(a._id, b._id) AS internal_id
  FROM i LEFT JOIN s a ON a.voice_session_id = i.session_id LEFT JOIN s b ON b._id = i.session_id""")
def _(spark, sf):
    s = sessions(spark, sf)
    ids = events(spark, sf).select("session_id").distinct().union(s.select("_id"))
    return scope.resolve_known(ids, s)


@add("e17_assistants", f"""WITH {S} SELECT assistant_origin_id, count(*) AS session_count, epoch_us(max(start_time)) AS last_us
  FROM s WHERE tenant = 't1' GROUP BY 1""")
def _(spark, sf):
    a = scope.assistants(sessions(spark, sf), "t1")
    return a.select("assistant_origin_id", "session_count", micros(F.col("last_start")).alias("last_us"))
