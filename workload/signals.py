"""Intent, text rules, classical signals and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions.predicates import predicate
from parley.functions.text import normal_name, slug
from parley.operators import digest as D, eventlog, intent as I, primitives as P, sampling, signals as S
from workload.binding import EV, chat_events, events, price, table
from workload.features import FV, features
from workload.log import TURNS
from workload.measures import n_of
from workload.registry import add, joined, r

# ---- intent over documents: source as tool, language as purpose, text as text

LEXICON = {
    "unknown": {},
    "north": {"tools": ["SRC1", "src-2"], "keywords": ["the", "tion"], "negative_keywords": ["zzz"], "purposes": ["EN"]},
    "south": {"tools": ["src_3"], "skills": ["none"], "keywords": ["eau", "aux"], "purposes": ["fr"], "event_type_hints": ["DOC"]},
    "east": {"agent_names": ["Src4", "der"], "keywords": ["der", "und"], "negative_keywords": ["the"], "purposes": ["de"]},
    "west": {"nodes": ["x"], "keywords": ["ción", "que"], "tools": ["src5"]},
}


def _documents(spark, sf):
    d = table(spark, sf, "documents")
    text = d.select("doc_id", F.lit(0).alias("part"), F.lit(True).alias("last"), F.lower("text").alias("searchable_text"))
    none = F.array().cast("array<string>")
    tool = F.regexp_replace("source", "src", "src_").alias("t")
    hits = d.select("doc_id", F.struct(
        none.alias("skills"), F.array(F.col("source"), tool).alias("tools"), F.array("source").alias("agent_names"),
        none.alias("nodes"), F.array("lang").alias("purposes"), F.array(F.lit("doc")).alias("event_types")).alias("structured_hits"))
    return text, hits


INTENT_SCORES = """sc AS (SELECT doc_id, source, lang, low,
    (source = 'src1')::INT * 3.0 + (source = 'src2')::INT * 3.0 + (contains(low, 'the'))::INT * 1.0 + (contains(op, 'the'))::INT * 0.5
      + (contains(low, 'tion'))::INT * 1.0 + (contains(op, 'tion'))::INT * 0.5 - (contains(low, 'zzz'))::INT * 2.0 + (lang = 'en')::INT * 2.0 AS north,
    (source = 'src3')::INT * 3.0 + contains(low, 'eau')::INT * 1.0 + contains(op, 'eau')::INT * 0.5 + contains(low, 'aux')::INT * 1.0 + contains(op, 'aux')::INT * 0.5
      + (lang = 'fr')::INT * 2.0 + 1.5 AS south,
    (source = 'src4' OR contains(low, 'src4'))::INT * 2.5 + contains(low, 'der')::INT * 2.5 + contains(low, 'der')::INT * 1.0 + contains(op, 'der')::INT * 0.5
      + contains(low, 'und')::INT * 1.0 + contains(op, 'und')::INT * 0.5 - contains(low, 'the')::INT * 2.0 + (lang = 'de')::INT * 2.0 AS east,
    contains(low, 'ción')::INT * 1.0 + contains(op, 'ción')::INT * 0.5 + contains(low, 'que')::INT * 1.0 + contains(op, 'que')::INT * 0.5 + (source = 'src5')::INT * 3.0 AS west
  FROM (SELECT *, lower(text) AS low, substr(lower(text), 1, 800) AS op FROM documents))"""


@add("i1_classify_intent", f"""WITH {INTENT_SCORES}, p AS (SELECT *, greatest(north, 0) + greatest(south, 0) + greatest(east, 0) + greatest(west, 0) AS total,
    greatest(north, south, east, west, 0) AS best FROM sc)
  SELECT doc_id, CASE WHEN best < 2 THEN 'unknown' WHEN north = best THEN 'north' WHEN south = best THEN 'south' WHEN east = best THEN 'east' ELSE 'west' END AS opening_intent_class,
    round(CASE WHEN total > 0 THEN best / total ELSE 0 END, 6) AS opening_intent_score FROM p""")
def _(spark, sf):
    text, hits = _documents(spark, sf)
    out = I.classify_intent(text, hits, LEXICON, "doc_id", digits=None)
    return out.withColumn("opening_intent_score", r("opening_intent_score"))


@add("c9_lexicon_match", """WITH t AS (SELECT doc_id, lower(text) AS low, source, lang FROM documents),
  m AS (SELECT doc_id, 'north' AS intent, 'tion' AS term FROM t WHERE contains(low, 'tion')
    UNION ALL SELECT doc_id, 'south', 'eau' FROM t WHERE contains(low, 'eau')
    UNION ALL SELECT doc_id, 'north', 'en' FROM t WHERE lang = 'en'
    UNION ALL SELECT doc_id, 'south', 'src_3' FROM t WHERE source = 'src3')
  SELECT doc_id, coalesce(string_agg(intent || ':' || term, '|' ORDER BY intent || ':' || term), '') AS terms FROM t LEFT JOIN m USING (doc_id) GROUP BY doc_id""")
def _(spark, sf):
    text, hits = _documents(spark, sf)
    small = {"north": {"purposes": ["EN"], "keywords": ["tion"]}, "south": {"tools": ["src 3"], "keywords": ["eau"]}}
    # an opening bonus is a term of its own; leave it out of the listing
    names = {n: f"{list(small)[i]}:{t}" for n, i, kind, t, _ in I.lexicon_terms(small) if kind != "opening"}
    found = I.term_hits(text, hits, small, "doc_id")
    listed = F.create_map(*[x for n, t in names.items() for x in (F.lit(n), F.lit(t))])
    return found.select("doc_id", joined(F.array_sort(F.array_compact(F.transform("terms", lambda n: F.element_at(listed, n))))).alias("terms"))


@add("e18_pilot_terms", """WITH p AS (SELECT source, row_number() OVER (ORDER BY md5('parley' || doc_id), doc_id) AS rn FROM documents)
  SELECT 'tool:' || source AS term, count(*) AS n FROM p WHERE rn <= 200 GROUP BY 1 ORDER BY n DESC, term LIMIT 30""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    none = F.array().cast("array<string>")
    fv = d.select("doc_id", F.struct(F.array("source").alias("tools"), none.alias("skills")).alias("structured_hits"))
    return I.pilot_terms(sampling.pilot(fv, 200, "doc_id"))


SPEC = {"keywords": ["the", "tion"], "regex": ["th[a-z]+ing"], "negative_keywords": ["eau"], "min_hits": 2, "labels": ["en", "maybe", "no"]}
RULE = "CASE WHEN contains(x, 'the')::INT + contains(x, 'tion')::INT + regexp_matches({t}, 'th[a-z]+ing', 'i')::INT - contains(x, 'eau')::INT >= 2 THEN 'en' ELSE 'no' END"


@add("i2_rule_score", f"SELECT doc_id, {RULE.format(t='text')} AS label FROM (SELECT *, lower(text) AS x FROM documents)")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.rule_score(F.col("text"), SPEC).alias("label"))


@add("i2_rule_score_opening", f"SELECT doc_id, {RULE.format(t='x')} AS label FROM (SELECT *, lower(substr(text, 1, 800)) AS x FROM documents)")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.rule_score(F.col("text"), {**SPEC, "scope": "opening_turns"}).alias("label"))


@add("i3_intent_signal", f"WITH {FV} SELECT session_id, opening_intent_class = 'm_small' AS is_small, opening_intent_class AS cls FROM fv")
def _(spark, sf):
    return features(spark, sf).select("session_id", S.intent_signal("m_small").alias("is_small"), S.intent_signal().alias("cls"))


@add("i4_regex_signal", "SELECT doc_id, regexp_matches(text, '(und|des|and)\\s+[a-z]+er\\s', 'i') AS hit FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.regex_signal(F.col("text"), r"(und|des|and)\s+[a-z]+er\s").alias("hit"))


@add("i5_agent_path_label", f"WITH {FV} SELECT session_id, agent_path AS label FROM fv")
def _(spark, sf):
    return features(spark, sf).select("session_id", S.agent_path_label().alias("label"))


PLAN = {
    "signals_required": [
        {"name": "asks", "method": "rule_based", "spec": {"keywords": ["on", "zzz"], "regex": ["[?]"], "min_hits": 1}},
        {"name": "turn_count", "method": "rule_based", "spec": {"keywords": ["on"]}},
        {"name": "agent_path", "method": "rule_based", "spec": {}},
        {"name": "single", "method": "rule_based", "spec": {"keywords": ["zzz", "?"], "labels": ["asks"]}},
        {"name": "early", "method": "rule_based", "spec": {"regex": ["[?]"], "scope": "opening_turns"}},
    ],
    "classical_signals_required": [
        {"name": "path_label", "kind": "agent_path_label"},
        {"name": "has_re", "kind": "regex_on_transcript", "pattern": "RE\\w"},
        {"name": "later", "kind": "regex_on_transcript", "pattern": "(?s)[?].*ing.*on\\s"},
        {"name": "plain", "kind": "regex_on_transcript", "pattern": "ing[^?]*[.][^?]*re\\s+[a-z]"},
        {"name": "closes", "kind": "regex_on_transcript", "pattern": "[?]\\s*$"},
        {"name": "first_on", "kind": "turn_index", "contains": "on"},
        {"name": "gap", "kind": "duration_between", "event_type_a": "USER_QUERY", "event_type_b": "RESPONSE.FINAL"},
        {"name": "first_agent", "kind": "conditional_metadata", "event_type": "RESPONSE.FINAL", "field": "agent_name"},
    ],
}


@add("i6_with_signals", f"""WITH {TURNS}, x AS (SELECT session_id, string_agg(lower(content), chr(10) ORDER BY us) AS txt,
    count(*) FILTER (event_type = 'USER_QUERY') AS turn_count, min(agent_name) AS agent,
    (max(us) FILTER (event_type = 'RESPONSE.FINAL') - min(us) FILTER (event_type = 'USER_QUERY')) // 1000 AS gap FROM chat GROUP BY session_id),
  f AS (SELECT session_id, min(idx) FILTER (contains(lower(text), 'on')) AS first_on FROM tr GROUP BY 1)
  SELECT session_id, turn_count, CASE WHEN contains(txt, 'on')::INT + contains(txt, 'zzz')::INT + contains(txt, '?')::INT >= 1 THEN 'match' ELSE 'other' END AS asks,
    CASE WHEN contains(txt, 'zzz') OR contains(txt, '?') THEN 'asks' ELSE 'false' END AS single, NOT (contains(txt, 'zzz') OR contains(txt, '?')) AS quiet,
    CASE WHEN contains(substr(txt, 1, 800), '?') THEN 'match' ELSE 'other' END AS early,
    regexp_matches(txt, '(?s)[?].*ing.*on\\s') AS later, regexp_matches(txt, 'ing[^?]*[.][^?]*re\\s+[a-z]') AS plain, regexp_matches(txt, '[?]\\s*$') AS closes,
    regexp_matches(txt, 're\\w') AS has_re, coalesce(agent, '') AS path_label, coalesce(first_on, -1) AS first_on, gap, agent AS first_agent
  FROM x LEFT JOIN f USING (session_id)""")
def _(spark, sf):
    ev = chat_events(spark, sf)
    fv = P.primitives(ev, price(spark)).select("session_id", "turn_count", "agent_path")
    # two events to a part: rules must find what lies over any number of them
    out = S.with_signals(fv, PLAN, eventlog.session_text(ev, part_rows=2), ev, eventlog.transcript(eventlog.turns(ev)))
    out = out.withColumn("quiet", predicate({"op": "CMP", "name": "single", "cmp": "==", "value": False}, out))
    return out.select("session_id", "turn_count", "asks", "single", "quiet", "early", "later", "plain", "closes", "has_re", "path_label", "first_on", "gap", "first_agent")


@add("f5_turn_index", f"""WITH {TURNS} SELECT session_id, coalesce(min(idx) FILTER (contains(lower(text), 'en')), -1) AS turn_index FROM tr GROUP BY session_id""")
def _(spark, sf):
    return S.turn_index(eventlog.transcript(eventlog.turns(chat_events(spark, sf))), "EN")


@add("f6_duration_between", f"""WITH {EV} SELECT session_id, CAST(trunc((max(us) FILTER (event_type = 'TOOL_CALL_ERROR') - min(us) FILTER (event_type = 'USER_QUERY')) / 1000.0) AS BIGINT) AS ms FROM ev GROUP BY session_id""")
def _(spark, sf):
    return events(spark, sf).groupBy("session_id").agg(S.duration_between("USER_QUERY", "TOOL_CALL_ERROR").alias("ms"))


@add("f7_conditional_metadata", f"""WITH {EV} SELECT session_id, arg_min(error, us) FILTER (event_type = 'TOOL_CALL_RESULT' AND error IS NOT NULL) AS error,
  arg_min(status, us) FILTER (event_type = 'SESSION_END') AS status FROM ev GROUP BY session_id""")
def _(spark, sf):
    return events(spark, sf).groupBy("session_id").agg(
        S.conditional_metadata("TOOL_CALL_RESULT", "error").alias("error"), S.conditional_metadata("SESSION_END", "status").alias("status"))


@add("f10_cap_per_key", """SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3""")
def _(spark, sf):
    return S.cap_per_key(table(spark, sf, "orders"), "o_custkey", 3, [F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey")


@add("i13_score_capped", """SELECT lang, doc_id, length(text) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 10""")
def _(spark, sf):
    def score(frames):
        for pdf in frames:
            yield pdf.assign(score=pdf["text"].str.len())[["lang", "doc_id", "score"]]

    docs = table(spark, sf, "documents").select("lang", "doc_id", "text")
    return S.score_capped(docs, score, "lang string, doc_id long, score long", "lang", 10, ["doc_id"])


# ---- digests

@add("f8_transcript_digest", f"""WITH {TURNS}, n AS (SELECT session_id, count(*) AS n FROM tr GROUP BY 1),
  m AS (SELECT session_id, idx, text, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS hit FROM tr
    WHERE contains(lower(text), 'error') OR contains(lower(text), 'transfer') OR contains(lower(text), 'sorry')),
  d AS (SELECT session_id, 0 AS part, idx, text FROM tr JOIN n USING (session_id) WHERE n <= 8 OR idx < 3
    UNION ALL SELECT session_id, 1, idx, text FROM m JOIN n USING (session_id) WHERE n > 8 AND hit <= 3
    UNION ALL SELECT session_id, 2, idx, text FROM tr JOIN n USING (session_id) WHERE n > 8 AND idx >= n - 2)
  SELECT session_id, string_agg(text, '|' ORDER BY part, idx) AS digest FROM d GROUP BY session_id""")
def _(spark, sf):
    d = D.transcript_digest(eventlog.transcript(eventlog.turns(chat_events(spark, sf))))
    return d.select("session_id", joined("transcript_digest.text").alias("digest"))


FLAG = """coalesce(string_agg(DISTINCT flag, '|' ORDER BY flag), '')"""
FLAGGED = """fl AS (SELECT session_id, CASE WHEN event_type = 'TOOL_CALL_ERROR' THEN 'tool_call_error'
    WHEN event_type = 'GUARDRAIL_CHECK' AND would_block THEN 'guardrail_block' WHEN event_type = 'SESSION_END' AND status = 'timeout' THEN 'timeout'
    WHEN event_type = 'TOOL_CALL_RESULT' THEN 'empty_tool_result' END AS flag FROM ev)"""
NOTES = f"""CASE WHEN {n_of('TOOL_CALL_ERROR')} > 0 THEN {n_of('TOOL_CALL_ERROR')} || ' tool error(s)' END,
  CASE WHEN {n_of('CALL_TRANSFER_COMPLETED')} > 0 THEN {n_of('CALL_TRANSFER_COMPLETED')} || ' transfer(s)' END,
  CASE WHEN {n_of('INTERRUPTION_HANDLER_RESULT')} > 0 THEN {n_of('INTERRUPTION_HANDLER_RESULT')} || ' interruption(s)' END,
  'main_stream model=' || (arg_max(model_id, us) FILTER (event_type = 'LLM_INVOCATION_SUCCESS' AND purpose = 'main_stream')),
  CASE WHEN count(*) FILTER (event_type = 'GUARDRAIL_CHECK' AND would_block) > 0 THEN 'guardrail triggered' END"""


@add("i7_notable_events", f"WITH {EV} SELECT session_id, concat_ws('|', {NOTES}) AS notable FROM ev GROUP BY session_id")
def _(spark, sf):
    n = D.notable(events(spark, sf), features(spark, sf))
    return n.select("session_id", joined("notable_events").alias("notable"))


@add("i8_anomaly_flags", f"WITH {EV}, {FLAGGED} SELECT session_id, {FLAG} AS flags FROM fl GROUP BY session_id")
def _(spark, sf):
    return events(spark, sf).groupBy("session_id").agg(joined(D.anomaly_flags()).alias("flags"))


@add("i9_digests", f"""WITH {FV}, {FLAGGED}, a AS (SELECT session_id, {FLAG} AS flags FROM fl GROUP BY session_id)
  SELECT session_id, opening_intent_class AS opening_intent, session_outcome AS outcome, turn_count, session_duration_ms AS duration_ms, flags,
    'turns=' || turn_count || ' outcome=' || session_outcome || '|intent=' || opening_intent_class || ' model=' || coalesce(main_stream_model, 'None') AS bullets
  FROM fv JOIN a USING (session_id)""")
def _(spark, sf):
    ev = events(spark, sf)
    lines = eventlog.transcript(eventlog.turns(ev))
    d = D.digests(ev, features(spark, sf), lines)
    return d.select("session_id", "opening_intent", "outcome", "turn_count", "duration_ms", joined("anomaly_flags").alias("flags"),
                    joined(F.slice("bullets", 1, 2)).alias("bullets"))


@add("g10_extreme_sessions", f"""WITH {FV}, {FLAGGED}, a AS (SELECT session_id, count(DISTINCT flag) AS f FROM fl GROUP BY session_id), d AS (SELECT session_id, turn_count, f FROM fv JOIN a USING (session_id))
  SELECT session_id FROM ((SELECT session_id FROM d ORDER BY turn_count, session_id LIMIT 1) UNION (SELECT session_id FROM d ORDER BY turn_count DESC, session_id LIMIT 1)
    UNION (SELECT session_id FROM d ORDER BY f DESC, session_id LIMIT 1))""")
def _(spark, sf):
    flags = events(spark, sf).groupBy("session_id").agg(D.anomaly_flags().alias("anomaly_flags"), P.count_of("USER_QUERY").alias("turn_count"))
    return sampling.extreme_sessions(flags)


@add("g12_sample_transcripts", f"""WITH {TURNS} SELECT session_id, idx, speaker, text FROM tr
  WHERE session_id IN (SELECT DISTINCT session_id FROM chat ORDER BY session_id LIMIT 20)""")
def _(spark, sf):
    ev = chat_events(spark, sf)
    return sampling.sample_transcripts(eventlog.transcript(eventlog.turns(ev)), ev, 20)


# ---- scalar functions

@add("k1_normal_name", "SELECT DISTINCT p_type, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_type", normal_name(F.col("p_type")).alias("name")).distinct()


@add("k2_slug", """SELECT doc_id, coalesce(nullif(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'study') AS slug FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", slug(F.col("text")).alias("slug"))
