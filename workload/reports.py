"""The five end-to-end reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import eventlog
from parley.plans import studies as R
from workload.binding import EV, S, events, price, sessions
from workload.features import FV
from workload.log import AUDIT, FIRST_END, SHOWN
from workload.registry import add
from workload.results import ASPECTS, CHI, E2, ERFC, HYPS, LONG, MWU, RATES, TITLE, WIDE, fisher_sql
from workload.measures import ROLLUP
from workload.scans import PUBLIC, STUDY

REPORT_STUDY = {
    **STUDY, "cohort_filters": [{"atom_id": "turn_count_at_least", "value": 1}, {"atom_id": "agent_ever_active", "value": "agent"}],
    "date_range_before": {"start": "2024-01-01 00:00:00", "end": "2024-01-14 23:59:59"},
    "n_explore": 12, "min_support": 5,
}
LEXICON = {
    "talk": {"purposes": ["main stream"], "event_type_hints": ["USER_QUERY"], "keywords": ["\"k\": 1"]},
    "route": {"purposes": ["router"], "agent_names": ["agent_1"], "keywords": ["\"k\": 2", "\"k\": 3"], "negative_keywords": ["\"k\": 77"]},
}


def _cohorts(spark, sf, **more):
    return R.build_cohorts(sessions(spark, sf), events(spark, sf), {**REPORT_STUDY, **more}, LEXICON, price(spark))


SCOPE_SQL = f"""v AS (SELECT {PUBLIC} AS session_id, start_time FROM s
    WHERE tenant = 't1' AND assistant_origin_id = 'o1' AND voice_session_id IS NOT NULL),
  raw AS (SELECT session_id, 'before' AS study_cohort FROM v WHERE start_time BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-14 23:59:59'
    UNION ALL SELECT session_id, 'after' FROM v WHERE start_time BETWEEN TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-01-31')"""
S_ONLY = S[len(EV) + 2:]
# features over the log with one SESSION_END per session
CLEAN_FV = EV.replace("ev AS (", "ev0 AS (", 1) + """, ev AS (SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY session_id, event_type ORDER BY us, event_id) AS rn FROM ev0)
  WHERE event_type <> 'SESSION_END' OR rn = 1)""" + FV[len(EV):]


@add("r1_build_cohorts", f"""WITH {CLEAN_FV}, {S_ONLY}, {SCOPE_SQL}
  SELECT fv.session_id, study_cohort AS cohort, turn_count, session_duration_ms,
    CASE WHEN transfer_completed THEN 'transferred' ELSE session_outcome END AS session_outcome, tool_error_count, agent_path
  FROM raw JOIN fv USING (session_id) WHERE turn_count >= 1 AND contains(agent_path, 'agent')""")
def _(spark, sf):
    c = _cohorts(spark, sf)
    return c.features.select("session_id", "cohort", "turn_count", "session_duration_ms", "session_outcome", "tool_error_count", "agent_path")


@add("r1_cohort_stats", f"""WITH {CLEAN_FV}, {S_ONLY}, {SCOPE_SQL}
  SELECT coalesce(study_cohort, 'total') AS cohort, count(*) AS raw_count, count(*) FILTER (turn_count >= 1 AND contains(agent_path, 'agent')) AS filtered_count
  FROM raw JOIN fv USING (session_id) GROUP BY GROUPING SETS ((study_cohort), ())""")
def _(spark, sf):
    return _cohorts(spark, sf).stats


@add("r2_explore")
def _(spark, sf):
    ev = events(spark, sf)
    c = R.build_cohorts(sessions(spark, sf), ev, REPORT_STUDY, LEXICON, price(spark), vec_dim=64)
    # the bound log has no spoken text: embed the agent path in its place
    fv = R.embed(c.features.drop("embedding_opening"), "agent_path", dim=64)
    got = R.explore(fv, c.events, eventlog.transcript(eventlog.turns(c.events)), REPORT_STUDY)
    return got["digests"].select("session_id", "cohort_label", "opening_intent", "outcome", "turn_count", F.size("bullets").alias("bullets"))


STUDY_FV = f"""{CLEAN_FV}, {S_ONLY}, {SCOPE_SQL},
  sfv AS (SELECT fv.* REPLACE (study_cohort AS cohort) FROM raw JOIN fv USING (session_id) WHERE turn_count >= 1 AND contains(agent_path, 'agent'))"""


def _over_study(sql: str) -> str:
    """CTEs written over all features, read over the study's instead."""
    return STUDY_FV + sql[len(FV):].replace("FROM fv", "FROM sfv")


@add("r3_evaluate_aspects", f"""WITH {_over_study(LONG)}, {MWU}, m AS (SELECT id, coalesce(avg(value) FILTER (cohort = 'before'), 0) AS b, coalesce(avg(value) FILTER (cohort = 'after'), 0) AS a FROM long GROUP BY id)
  SELECT id AS aspect_id, {TITLE} AS name, round_even(b, 3) AS "before", round_even(a, 3) AS "after", round_even(CASE WHEN b = 0 THEN 0 ELSE (a - b) * 100 / b END, 1) AS delta_pct,
    round_even(coalesce(p, 1.0), 4) AS p_value, coalesce(p < 0.05 AND n1 >= 2 AND n2 >= 2, false) AS significant FROM m LEFT JOIN mw USING (id)""")
def _(spark, sf):
    c = _cohorts(spark, sf)
    return R.evaluate(c.features, {"aspects": ASPECTS, "hypotheses": HYPS}, REPORT_STUDY, c.text, c.events)["aspect_table"]


@add("r3_evaluate_hypotheses", f"""WITH {_over_study(RATES)}, {WIDE}, {fisher_sql("w")}
  SELECT id AS hypothesis_id, CASE id WHEN 'h_long' THEN 'Long' WHEN 'h_error' THEN 'Error' WHEN 'h_slow' THEN 'Slow' ELSE id END AS title,
    b::BIGINT AS before_support, round_even(b / nb, 4) AS before_rate, a::BIGINT AS after_support, round_even(a / na, 4) AS after_rate, a + b < 5 AS rejected, round_even(coalesce(p, {ERFC}, 1.0), 4) AS p_value
  FROM (SELECT *, 1.0 / (1.0 + 0.3275911 * x) AS t FROM (SELECT *, sqrt(chi / 2) AS x FROM (SELECT *, {CHI} AS chi FROM w LEFT JOIN fp USING (id))))""")
def _(spark, sf):
    c = _cohorts(spark, sf)
    return R.evaluate(c.features, {"aspects": ASPECTS, "hypotheses": HYPS}, REPORT_STUDY, c.text, c.events)["hypothesis_table"]


E1_ROUND = """e1 AS (SELECT cohort, n, round_even(turns / n, 1) AS avg_turn_count, round_even(us / 1000000.0 / n, 1) AS avg_duration_secs,
    round_even(coalesce(errors * 100.0 / nullif(tools, 0), 0), 1) AS tool_error_rate_pct, round_even(coalesce(lat / nullif(tools, 0), 0), 0) AS avg_tool_latency_ms
  FROM (SELECT cohort, count(*) AS n, sum(turn_count) AS turns, sum(last_us - first_us) AS us, sum(tool_count) AS tools, sum(tool_error_count) AS errors, sum(tool_latency_sum) AS lat FROM roll GROUP BY cohort))"""


@add("r4_quick_results", f"""WITH {S}, v AS (SELECT {PUBLIC} AS session_id, start_time FROM s WHERE tenant = 't1' AND assistant_origin_id = 'o1' AND voice_session_id IS NOT NULL),
  ids AS (SELECT session_id, 'before' AS label FROM v WHERE start_time BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-17'
    UNION ALL SELECT session_id, 'after' FROM v WHERE start_time BETWEEN TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-01-31'),
  roll AS (SELECT label AS cohort, session_id, {ROLLUP} FROM ev JOIN ids USING (session_id) GROUP BY ALL), {E1_ROUND}
  {E2.format(b='b', a='a', d='round_even(CASE WHEN b = 0 THEN 0 ELSE (a - b) * 100 / b END, 1)')}""")
def _(spark, sf):
    # the event store keys events by the index's own id
    internal = events(spark, sf).withColumn("session_id", F.md5("session_id"))
    return R.quick_results(internal, sessions(spark, sf), STUDY)


@add("r5_audit_counts", f"""WITH {EV}, {FIRST_END},
  b AS (SELECT session_id, count(*) AS raw, max(us) AS hi, min(us) AS lo FROM ev GROUP BY session_id),
  c AS (SELECT session_id, count(*) AS shown, count(DISTINCT event_type) AS types,
    count(*) FILTER (is_debug_event) AS debug FROM d WHERE event_type IN ({SHOWN}) GROUP BY session_id),
  a AS (SELECT b.*, coalesce(shown, 0) AS shown, coalesce(types, 0) AS types, coalesce(debug, 0) AS debug FROM b LEFT JOIN c USING (session_id))
  {AUDIT} FROM a""")
def _(spark, sf):
    return R.audit_events(events(spark, sf))["counts"]


@add("r5_audit_histogram", f"WITH {EV}, {FIRST_END} SELECT event_type, count(*) AS n FROM d WHERE event_type IN ({SHOWN}) GROUP BY 1")
def _(spark, sf):
    return R.audit_events(events(spark, sf))["histogram"]
