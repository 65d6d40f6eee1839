"""Event-log cleaning, turns, transcripts and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions.events import DISPLAY_TYPES
from parley.operators import eventlog
from workload.binding import CHAT, EV, chat_events, events
from workload.registry import add

SHOWN = ", ".join(f"'{t}'" for t in DISPLAY_TYPES)
FIRST_END = """d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, event_type ORDER BY us, event_id) AS rn FROM ev)
  WHERE event_type <> 'SESSION_END' OR rn = 1)"""


@add("b6_only_types", f"WITH {EV} SELECT event_id, event_type FROM ev WHERE event_type IN ({SHOWN})")
def _(spark, sf):
    return eventlog.only_types(events(spark, sf)).select("event_id", "event_type")


@add("b7_drop_debug", f"WITH {EV} SELECT event_id, session_id FROM ev WHERE NOT is_debug_event")
def _(spark, sf):
    return eventlog.drop_debug(events(spark, sf)).select("event_id", "session_id")


@add("f1_dedupe_session_end", f"WITH {EV}, {FIRST_END} SELECT event_id, session_id, event_type, status FROM d")
def _(spark, sf):
    return eventlog.dedupe_session_end(events(spark, sf)).select("event_id", "session_id", "event_type", "status")


@add("f2_dedupe_resent", f"""WITH {EV} SELECT event_id, session_id, event_type FROM (
    SELECT *, row_number() OVER (PARTITION BY session_id, event_type, secs_since_session_start ORDER BY us, event_id) AS rn FROM ev)
  WHERE rn = 1""")
def _(spark, sf):
    return eventlog.dedupe_by_field(events(spark, sf)).select("event_id", "session_id", "event_type")


TURNS = CHAT + """, t AS (SELECT session_id, request_id, min(us) AS started,
    coalesce(arg_min(content, us) FILTER (event_type = 'USER_QUERY'), '') AS user,
    coalesce(arg_min(content, us) FILTER (event_type = 'RESPONSE.FINAL'), '') AS bot,
    arg_min(agent_name, us) FILTER (event_type = 'RESPONSE.FINAL') AS agent_name
  FROM chat GROUP BY ALL HAVING bool_or(event_type <> 'SYSTEM')),
  lines AS (
    SELECT session_id, request_id, started, 0 AS side, 'User' AS speaker, user AS text FROM t WHERE user <> ''
    UNION ALL SELECT session_id, request_id, started, 1, 'Bot', bot FROM t WHERE bot <> ''),
  tr AS (SELECT session_id, speaker, text,
    row_number() OVER (PARTITION BY session_id ORDER BY started, request_id, side) - 1 AS idx,
    row_number() OVER (PARTITION BY session_id ORDER BY side, started, request_id) - 1 AS gidx FROM lines)"""


@add("c4_turns", f'WITH {TURNS} SELECT session_id, request_id, started, "user", bot, agent_name FROM t')
def _(spark, sf):
    return eventlog.turns(chat_events(spark, sf)).withColumn("started", F.col("started.us"))


@add("i10_transcript", f"WITH {TURNS} SELECT session_id, idx, speaker, text FROM tr")
def _(spark, sf):
    return eventlog.transcript(eventlog.turns(chat_events(spark, sf)))


@add("i10_transcript_grouped", f"WITH {TURNS} SELECT session_id, gidx AS idx, speaker, text FROM tr")
def _(spark, sf):
    return eventlog.transcript(eventlog.turns(chat_events(spark, sf)), grouped=True)


@add("d20_searchable_text", f"""WITH {EV} SELECT session_id, CAST(0 AS BIGINT) AS part,
  string_agg(lower(props), chr(10) ORDER BY us, event_id) AS searchable_text FROM ev GROUP BY session_id""")
def _(spark, sf):
    t = eventlog.session_text(events(spark, sf))
    return t.select("session_id", F.col("part").cast("long").alias("part"), "searchable_text")


@add("d20_searchable_text_chat", f"""WITH {CHAT} SELECT session_id, CAST(0 AS BIGINT) AS part,
  string_agg(lower(content), chr(10) ORDER BY us) AS searchable_text FROM chat WHERE content <> '' GROUP BY session_id""")
def _(spark, sf):
    t = eventlog.session_text(chat_events(spark, sf))
    return t.select("session_id", F.col("part").cast("long").alias("part"), "searchable_text")


AUDIT = """SELECT session_id, shown AS events_shown, raw AS raw_event_count, types AS active_types,
  round_even((hi - lo) / 60000000.0, 1) AS span_minutes, debug AS debug_event_count, shown - debug AS non_debug_event_count"""


@add("e15_event_counts", f"""WITH {EV}, a AS (SELECT session_id, count(*) AS shown, count(*) AS raw,
    count(DISTINCT event_type) AS types, max(us) AS hi, min(us) AS lo, count(*) FILTER (is_debug_event) AS debug
    FROM ev GROUP BY session_id) {AUDIT} FROM a""")
def _(spark, sf):
    return eventlog.event_counts(events(spark, sf))


@add("e15_event_counts_filtered", f"""WITH {EV}, {FIRST_END},
  b AS (SELECT session_id, count(*) AS raw, max(us) AS hi, min(us) AS lo FROM ev GROUP BY session_id),
  c AS (SELECT session_id, count(*) AS shown, count(DISTINCT event_type) AS types,
    count(*) FILTER (is_debug_event) AS debug FROM d WHERE event_type IN ({SHOWN}) GROUP BY session_id),
  a AS (SELECT b.*, coalesce(shown, 0) AS shown, coalesce(types, 0) AS types, coalesce(debug, 0) AS debug FROM b LEFT JOIN c USING (session_id))
  {AUDIT} FROM a""")
def _(spark, sf):
    return eventlog.event_counts(events(spark, sf), dedup=True, types=DISPLAY_TYPES)


@add("e15_event_counts_no_debug", f"""WITH {EV}, a AS (SELECT session_id, count(*) AS shown, count(*) AS raw,
    count(DISTINCT event_type) AS types, max(us) AS hi, min(us) AS lo, count(*) FILTER (is_debug_event) AS debug
    FROM ev WHERE NOT is_debug_event GROUP BY session_id) {AUDIT} FROM a""")
def _(spark, sf):
    return eventlog.event_counts(events(spark, sf), include_debug=False)


@add("e16_type_histogram", f"WITH {EV} SELECT event_type, count(*) AS n FROM ev GROUP BY 1")
def _(spark, sf):
    return eventlog.type_histogram(events(spark, sf))


@add("d26_fingerprint", f"""WITH {EV} SELECT session_id, sha256(concat_ws('|', session_id, count(*), min(us), max(us),
  arg_max(event_id, CAST(us AS HUGEINT) * 10000000000 + event_id))) AS fingerprint FROM ev GROUP BY session_id""")
def _(spark, sf):
    return eventlog.fingerprint(events(spark, sf))
