"""Hand-made frames for the rules that are easy to get wrong."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from parley.functions import numbers as N, predicates as PR, vectors as VF
from parley.functions.events import complete, field
from parley.functions.text import normal_name, slug
from parley.operators import cohort as C, digest, eventlog, intent, primitives as P, proposals as L, signals as S, significance
from parley.operators.pricing import price_table, with_price
from parley.schemas import PROPOSAL
from parley.sources import events as SRC, sinks


def ev(spark, rows, **kinds):
    """rows: (session, type, second, {fields})."""
    names = sorted({k for r in rows for k in r[3]})
    schema = "event_id long, session_id string, event_type string, s long" + "".join(f", {n} {kinds.get(n, 'string')}" for n in names)
    data = [(i, r[0], r[1], r[2], *[r[3].get(n) for n in names]) for i, r in enumerate(rows)]
    return complete(spark.createDataFrame(data, schema).withColumn("timestamp", F.timestamp_seconds("s")).drop("s"))


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


def fv_of(spark, rows, **kw):
    return one(P.primitives(ev(spark, rows, **kw), price_table(spark)))


# ---- primitives

def test_p95_extrapolates_and_drops_zero(spark):
    calls = [("s", "LLM_INVOCATION_SUCCESS", i, {"purpose": "router", "latency_ms": v}) for i, v in enumerate([0.0, 200.0, 100.0])]
    assert fv_of(spark, calls, latency_ms="double").router_latency_p95 == 285.0
    assert fv_of(spark, calls[:1], latency_ms="double").router_latency_p95 == 0.0
    assert fv_of(spark, calls[:2], latency_ms="double").router_latency_p95 == 200.0


def test_outcome_priority(spark):
    end = ("s", "SESSION_END", 2, {"status": "Network TimeOut"})
    assert fv_of(spark, [("s", "CALL_TRANSFER_COMPLETED", 9, {}), end]).session_outcome == "transferred"
    assert fv_of(spark, [("s", "SESSION_END", 1, {"status": ""}), end]).session_outcome == "timeout"
    assert fv_of(spark, [("s", "SESSION_END", 1, {"status": None, "end_reason": "Hangup"})]).session_outcome == "hangup"
    assert fv_of(spark, [("s", "SESSION_END", 1, {"status": None, "end_reason": "Hangup"})]).outcome_bucket == "other"
    assert fv_of(spark, [("s", "SESSION_METRICS_COMPUTED", 1, {})]).session_outcome == "completed"
    assert fv_of(spark, [("s", "USER_QUERY", 1, {})]).session_outcome == "unknown"


def test_first_session_end_is_kept(spark):
    rows = [("s", "SESSION_END", 5, {"status": "timeout"}), ("s", "USER_QUERY", 9, {}), ("s", "SESSION_END", 2, {"status": ""}), ("t", "SESSION_END", 1, {"status": "x"})]
    kept = eventlog.dedupe_session_end(ev(spark, rows))
    assert sorted(r.event_id for r in kept.collect()) == [1, 2, 3]
    # the kept end has no status, so nothing says how the session ended
    assert {r.session_id: r.session_outcome for r in P.primitives(kept, price_table(spark)).collect()} == {"s": "unknown", "t": "x"}


def test_agent_path(spark):
    names = ["a", "a", "b", None, "", "a"]
    rows = [("s", "RESPONSE.FINAL", i, {"agent_name": n}) for i, n in enumerate(names)]
    assert fv_of(spark, rows).agent_path == "a→b→a"


@pytest.mark.parametrize("said,want", [
    (["Hi and WELCOME to the bank", "  pay my bill "], "pay my bill"),
    (["welcome", "Welcome back"], "welcome"),
    (["   "], "   "), ([""], ""), ([None], ""),
])
def test_opening_text(spark, said, want):
    rows = [("s", "USER_QUERY", i, {"content": t}) for i, t in enumerate(said)]
    assert fv_of(spark, rows).opening_text == want


def test_cost(spark):
    use = [("gpt-4.1", 1000, 100), ("openai/gpt-oss-120b", 1_000_000, None), ("main_model", 10**9, 10**9), ("who", 5, 5), (None, 5, 5)]
    rows = [("s", "TOKEN_USAGE_DETAILS", i, {"purpose": "main_stream", "model_id": m, "input_tokens": a, "output_tokens": b}) for i, (m, a, b) in enumerate(use)]
    got = fv_of(spark, rows, input_tokens="long", output_tokens="long")
    assert got.main_stream_estimated_cost_usd == pytest.approx(0.0028 + 0.15)
    assert got.main_stream_output_tokens_sum == 100 + 10**9 + 10


def test_guardrail_model_variant_tools(spark):
    rows = [
        ("s", "GUARDRAIL_CHECK", 1, {"would_block": False, "flagged_categories": []}),
        ("s", "LLM_CONFIG_RESOLVED", 2, {"purpose": "main_stream", "final_model_id": "m1"}),
        ("s", "LLM_CONFIG_RESOLVED", 3, {"purpose": "main_stream", "final_model_id": ""}),
        ("s", "LLM_INVOCATION_SUCCESS", 4, {"purpose": "main_stream", "model_id": "m2"}),
        ("s", "CANARY_BUCKET_DECISION", 5, {"selected_variant_key": None}),
        ("s", "CANARY_BUCKET_DECISION", 6, {"selected_variant_key": "v"}),
        ("s", "DEBUG.TOOL_INVOKED", 7, {"tool_name": "t1", "tool": "t2"}),
        ("s", "TOOL_CALL_RESULT", 8, {"latency": 2.0, "tool_id": "t1", "error": "x"}),
        ("s", "TOOL_CALL_RESULT", 9, {"latency": 0.0}),
    ]
    r = fv_of(spark, rows, would_block="boolean", flagged_categories="array<string>", latency="double")
    assert not r.guardrail_triggered and r.main_stream_model == "m2" and r.traffic_split_variant is None
    assert (r.tool_invocation_count, r.tool_error_count, r.tool_result_error_count, r.avg_tool_latency_ms) == (3, 0, 1, 2.0)
    assert r.structured_hits.tools == ["t1", "t2"] and r.session_duration_ms == 8000
    rows.append(("s", "GUARDRAIL_CHECK", 10, {"would_block": None, "flagged_categories": ["pii"]}))
    assert fv_of(spark, rows, would_block="boolean", flagged_categories="array<string>", latency="double").guardrail_triggered


# ---- predicates

@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame(
        [(1, 5, True, "abc", None), (2, None, None, None, None), (3, 0, False, "12", ["x"])],
        "id int, n int, b boolean, t string, a array<string>")


def cmp(name, op, value):
    return {"op": "CMP", "name": name, "cmp": op, "value": value}


@pytest.mark.parametrize("tree,ids", [
    (None, [1, 2, 3]), (True, [1, 2, 3]), (False, []), ({"op": "XOR"}, []), ("text", []),
    ({"op": "AND", "args": []}, [1, 2, 3]), ({"op": "OR", "args": []}, []), ({"op": "NOT", "args": []}, []),
    (cmp("n", "==", 5), [1]), (cmp("n", "==", None), [2]), (cmp("n", "!=", 5), [2, 3]), (cmp("n", "!=", None), [1, 3]),
    (cmp("n", "==", "5"), []), (cmp("n", ">=", "5"), [1]), (cmp("n", "<", 5), [3]), (cmp("n", "<", "x"), []),
    (cmp("t", ">", 1), []), (cmp("t", ">", "a"), []), (cmp("t", "==", "abc"), [1]), (cmp("t", "==", 12), []), (cmp("t", "!=", 12), [1, 2, 3]),
    (cmp("b", "==", True), [1]), (cmp("b", "==", 1), [1]), (cmp("b", ">", 0), [1]), (cmp("n", "==", False), [3]),
    (cmp("n", "<", True), [2, 3]), (cmp("t", ">=", True), [1, 3]), (cmp("missing", "==", None), [1, 2, 3]), (cmp("missing", ">", 0), []),
    (cmp("n", "~", 5), []), ({"name": "n", "operator": ">", "value": 1}, [1]),
    ({"op": "NOT", "arg": cmp("n", ">", 1)}, [2, 3]), ({"op": "not", "nodes": [cmp("n", ">", 1)]}, [2, 3]),
    ({"op": "IS_NULL", "name": "n"}, [2]), ({"op": "IS_NULL", "name": "missing"}, [1, 2, 3]),
    ({"op": "IN", "name": "n", "value": [0, "5"]}, [3]), ({"op": "IN", "name": "t", "values": ["abc", None]}, [1, 2]), ({"op": "IN", "name": "n"}, []),
    ({"op": "BETWEEN", "name": "n", "value": [0, 5]}, [1, 3]), ({"op": "BETWEEN", "name": "n", "low": 1}, []), ({"op": "BETWEEN", "name": "t", "low": "a", "high": "b"}, [1]),
    (cmp("n", ">", "median(turn_count)"), [1]), (cmp("n", ">", "median(other)"), []),
])
def test_predicate(values, tree, ids):
    test = PR.predicate(tree, values, {"turn_count": F.lit(2.5)})
    assert [r.id for r in values.where(test).orderBy("id").collect()] == ids
    assert values.where(test.isNull()).count() == 0


def test_atoms(spark):
    df = spark.createDataFrame([("a", 3, "Agent_X→b", None, 120000), ("b", None, None, "v", 60000)],
                               "id string, turn_count int, agent_path string, traffic_split_variant string, session_duration_ms long")

    def kept(*filters):
        return [r.id for r in df.where(PR.cohort_filter(list(filters))).orderBy("id").collect()]

    assert kept() == ["a", "b"] and kept({"atom_id": "nope"}) == ["a", "b"]
    assert kept({"atom_id": "turn_count_at_least", "value": 1}) == ["a"]
    assert kept({"atom_id": "agent_ever_active", "value": "AGENT_x"}) == ["a"]
    assert kept({"atom_id": "agent_ever_active", "value": ""}) == ["a", "b"]
    assert kept({"id": "canary_variant_is", "value": "v"}) == ["b"]
    assert kept({"atom_id": "session_duration_at_least_minutes", "value": "2"}) == ["a"]
    assert kept({"atom_id": "session_duration_at_least_minutes", "value": "x"}) == []
    assert [r.id for r in df.withColumn("session_outcome", F.lit("t")).where(PR.atom("session_outcome_in", [])).collect()] == []


# ---- tests and numbers

def test_erfc_and_rate_tests(spark):
    row = one(spark.range(1).select(*[N.erfc(F.lit(x)).alias(f"x{i}") for i, x in enumerate([0.0, 0.3, 1.0, 2.5])]))
    assert list(row) == pytest.approx([math.erfc(x) for x in (0.0, 0.3, 1.0, 2.5)], abs=2e-7)


def _fisher(a, na, b, nb):
    m = a + b
    w = {k: math.comb(na, k) * math.comb(nb, m - k) for k in range(max(0, m - nb), min(na, m) + 1)}
    return sum(x for x in w.values() if x <= w[a] * (1 + 1e-7)) / sum(w.values())


def test_fisher_by_enumeration(spark):
    cases = [(a, na, b, nb) for na, nb in itertools.product([1, 2, 4, 7, 30], [1, 3, 4]) for a in range(na + 1) for b in range(nb + 1)]
    df = spark.createDataFrame(cases, "a long, na long, b long, nb long")
    for r in df.select("*", N.fisher(F.col("a"), F.col("na"), F.col("b"), F.col("nb")).alias("p")).collect():
        assert r.p == pytest.approx(_fisher(r.a, r.na, r.b, r.nb), abs=1e-9), r


def test_rate_test_branches(spark):
    df = spark.createDataFrame([(1, 4, 9, 40), (10, 50, 30, 60), (0, 50, 0, 60)], "a long, na long, b long, nb long")
    got = df.select(*N.rate_test(F.col("a"), F.col("na"), F.col("b"), F.col("nb"), 0.05)).collect()
    assert [r.test for r in got] == ["fisher", "chi_square", "error"]
    # by hand: |10 - 50*40/110| - 0.5 = 7.6818, chi2 = 7.6818^2 * 110^3 / (50*60*40*70) = 9.3504
    assert got[1].p_value == pytest.approx(math.erfc(math.sqrt(9.3504 / 2)), abs=1e-4) and got[1].significant
    assert got[2].p_value == 1.0 and not got[2].significant


def test_z_test_without_spread(spark):
    df = spark.createDataFrame([(0, 0, 1, 5), (0, 5, 0, 5), (2, 10, 6, 10)], "a long, na long, b long, nb long")
    p = [r[0] for r in df.select(N.z_test(F.col("a"), F.col("na"), F.col("b"), F.col("nb"))).collect()]
    z = 0.4 / math.sqrt(0.4 * 0.6 * 0.2)
    assert p[:2] == [1.0, 1.0] and p[2] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-6)


@pytest.mark.parametrize("before,after,test", [
    ([1.0], [2.0, 3.0], "insufficient_data"), ([5.0] * 9, [5.0] * 12, "mann_whitney"),
    ([1.0, 2.5, 9.0], [3.0, 4.0, 5.0, 6.0], "mann_whitney"), ([float(i) for i in range(20)], [i + 0.5 for i in range(5, 30)], "mann_whitney"),
])
def test_mann_whitney_branches(spark, before, after, test):
    df = spark.createDataFrame([("x", "before", v) for v in before] + [("x", "after", v) for v in after], "id string, cohort string, value double")
    r = one(significance.mann_whitney(df, digits=None))
    assert r.test == test
    if test == "insufficient_data" or len(set(before + after)) == 1:
        assert r.p_value == 1.0
    elif len(before) <= 8:
        u = sum(x > y for x in before for y in after)
        every = [sum(s) - 3 for s in itertools.combinations(range(7), 3)]
        tail = sum(x <= min(u, 12 - u) for x in every) / len(every)
        assert r.p_value == pytest.approx(min(1.0, 2 * tail))
    else:
        n1, n2 = len(before), len(after)
        u = sum(x > y for x in before for y in after)
        z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / math.sqrt(n1 * n2 / 12 * (n1 + n2 + 1))
        assert r.p_value == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-6)


def test_exact_p_does_not_grow_with_the_large_sample():
    for n1, n2 in [(1, 1), (2, 5), (4, 6)]:
        us = [sum(s) - n1 * (n1 - 1) // 2 for s in itertools.combinations(range(n1 + n2), n1)]
        for u in range(n1 * n2 + 1):
            want = min(1.0, 2 * sum(x <= min(u, n1 * n2 - u) for x in us) / len(us))
            assert significance.exact_p(u, n1, n2) == pytest.approx(want)
    assert significance.exact_p(10**6, 2, 10**9) < 1e-5


def test_aspect_aggregations(spark):
    fv = spark.createDataFrame([("s", 2, 3.0, True, "Completed")], "session_id string, turn_count int, x double, transfer_completed boolean, session_outcome string")

    def value(agg, *refs):
        return one(fv.select(C.aspect_value({"id": "a", "components": [{"ref": r, "aggregation": agg if i == 0 else "sum"} for i, r in enumerate(refs)]}, fv).alias("v"))).v

    t, x, none = {"kind": "turn_count"}, {"kind": "primitive", "name": "x"}, {"kind": "nothing"}
    assert value("sum", t, x) == 5 and value("max", t, x) == 3 and value("min", t, x) == 2 and value("count", t, x, none) == 2
    assert value("mean", t, x) == 2.5 and value("odd", t, x) == 2.5 and value("p50", t, x) == 2.5 and value("p95", t, x) == pytest.approx(3.85)
    assert value("mean", none) is None and value("count_transfer", none) == 1 and value("rate_payment_success", none) == 1
    assert value("rate", {"kind": "session_outcome", "name": "comp"}) == 1 and value("mean", {"kind": "session_outcome"}) is None
    assert one(fv.select(C.aspect_value({"id": "x"}, fv).alias("v"))).v == 3


# ---- text, intent, digests

def test_text_functions(spark):
    df = spark.createDataFrame([(" Ab--C_",), ("--",), (None,)], "t string")
    assert [tuple(r) for r in df.select(normal_name(F.col("t")), slug(F.col("t"))).collect()] == [("ab_c", "ab-c"), ("", "study"), ("", "study")]


def _intent(spark, lexicon, text, opening_pad="", **hits):
    lists = ["skills", "tools", "agent_names", "nodes", "purposes", "event_types"]
    parts = spark.createDataFrame([("s", i, t) for i, t in enumerate([opening_pad + text] if isinstance(text, str) else text)], "session_id string, part int, searchable_text string")
    h = spark.createDataFrame([("s", tuple(hits.get(k, []) for k in lists))], "session_id string, structured_hits struct<" + ",".join(f"{k}:array<string>" for k in lists) + ">")
    r = one(intent.classify_intent(parts, h, lexicon))
    return r.opening_intent_class, r.opening_intent_score


def test_intent(spark):
    lex = {"unknown": {}, "pay": {"skills": ["Pay Bill"], "keywords": ["bill"]}, "loan": {"keywords": ["loan", "rate"], "negative_keywords": ["bill"]},
           "agent": {"agent_names": ["Agent A"]}}
    assert _intent(spark, lex, "my bill", skills=["pay_bill"]) == ("pay", 1.0)
    assert _intent(spark, lex, "bill") == ("unknown", 1.0)          # 1.5 is below the limit
    assert _intent(spark, lex, "loan rate", opening_pad="x" * 900) == ("loan", 1.0)   # 2.0 without the opening bonus
    assert _intent(spark, lex, "loan rate bill") == ("unknown", 0.6)   # 1.5 of 1.5 + 1.0
    assert _intent(spark, lex, "agent_a here") == ("agent", 1.0)
    assert _intent(spark, lex, "nothing") == ("unknown", 0.0)
    assert _intent(spark, {"a": {"tools": ["x"]}, "b": {"tools": ["x"]}}, "", tools=["X"]) == ("a", 0.5)
    # a term found in two parts of one text counts once
    assert _intent(spark, lex, ["loan", "loan rate"]) == ("loan", 1.0)
    assert _intent(spark, {}, "x") == ("unknown", 0.0)


def test_rule_score(spark):
    df = spark.createDataFrame([("pay the bill now",), ("no",)], "t string")
    spec = {"keywords": ["PAY", "bill"], "regex": ["B.LL"], "negative_keywords": ["now"], "min_hits": 2}
    assert [r[0] for r in df.select(S.rule_score(F.col("t"), spec)).collect()] == ["match", "other"]
    assert [r[0] for r in df.select(S.rule_score(F.col("t"), {**spec, "labels": ["yes"], "min_hits": 3})).collect()] == ["false", "false"]
    assert [r[0] for r in df.select(S.regex_signal(F.col("t"), None)).collect()] == [False, False]


def test_signals_keep_features(spark):
    fv = spark.createDataFrame([("s", 3, "p")], "session_id string, turn_count int, agent_path string")
    text = spark.createDataFrame([("s", 0, "abc"), ("s", 1, "def")], "session_id string, part int, searchable_text string")
    plan = {"signals_required": [{"name": "turn_count", "method": "rule_based", "spec": {"keywords": ["abc"]}},
                                 {"name": "both", "method": "rule_based", "spec": {"keywords": ["abc", "def"], "min_hits": 2}},
                                 {"name": "agent_path", "method": "rule_based"}]}
    r = one(S.with_signals(fv, plan, text))
    assert (r.turn_count, r.both, r.agent_path) == (3, "match", "p")


def test_duration_and_turn_index(spark):
    rows = [("s", "A", 10, {}), ("s", "B", 4, {}), ("s", "A", 2, {}), ("t", "A", 1, {})]
    got = {r.session_id: r.d for r in ev(spark, rows).groupBy("session_id").agg(S.duration_between("A", "B").alias("d")).collect()}
    assert got == {"s": 2000, "t": None}
    lines = spark.createDataFrame([("s", 0, "Hi"), ("s", 1, "Sorry"), ("s", 2, "sorry")], "session_id string, idx int, text string")
    assert one(S.turn_index(lines, "SORRY")).turn_index == 1 and one(S.turn_index(lines, "x")).turn_index == -1 and one(S.turn_index(lines, None)).turn_index == -1


def test_transcript_digest(spark):
    def run(n, telling=()):
        rows = [("s", i, "User", f"{'error ' if i in telling else ''}{i}") for i in range(n)]
        return [x.text for x in one(digest.transcript_digest(spark.createDataFrame(rows, "session_id string, idx long, speaker string, text string"))).transcript_digest]

    assert run(8) == [str(i) for i in range(8)]
    assert run(12, (1, 5, 6, 7)) == ["0", "error 1", "2", "error 1", "error 5", "error 6", "10", "11"]


def test_anomalies_and_notes(spark):
    rows = [("s", "TOOL_CALL_RESULT", 1, {"result": ""}), ("s", "TOOL_CALL_ERROR", 2, {}), ("s", "SESSION_END", 3, {"status": None, "end_reason": "Timeout!"}),
            ("s", "LLM_INVOCATION_ERROR", 4, {}), ("s", "CALL_TRANSFER_COMPLETED", 5, {})]
    e = ev(spark, rows)
    r = one(digest.notable(e, P.primitives(e, price_table(spark))))
    assert r.anomaly_flags == ["empty_tool_result", "llm_error", "timeout", "tool_call_error"]
    assert r.notable_events == ["1 tool error(s)", "1 transfer(s)"]


def test_turns_and_transcript(spark):
    rows = [("s", "USER_QUERY", 1, {"request_id": "r1", "content": "hi"}), ("s", "RESPONSE.FINAL", 2, {"request_id": "r1", "content": "yo", "agent_name": "a"}),
            ("s", "X", 0, {"request_id": "r0"}), ("s", "USER_QUERY", 3, {"request_id": "r2", "content": "bye"}), ("s", "USER_QUERY", 4, {"content": "lost"})]
    t = eventlog.turns(ev(spark, rows))
    assert sorted((r.request_id, r.user, r.bot, r.agent_name) for r in t.collect()) == [("r1", "hi", "yo", "a"), ("r2", "bye", "", None)]
    assert [r.text for r in eventlog.transcript(t).orderBy("idx").collect()] == ["hi", "yo", "bye"]
    assert [r.text for r in eventlog.transcript(t, grouped=True).orderBy("idx").collect()] == ["hi", "bye", "yo"]


# ---- proposals

def test_proposals(spark):
    e = [("f1", "s", ["a", "b"]), (None, "long " * 40, ["b", "c", "d", "e"]), ("", "", None)]
    rows = [(1, "p1", "k", "low", " Same ", "applied", e), (2, "p2", "k", None, "same", "pending", None), (3, "p3", "k", "high", "", "pending", []),
            (4, "p4", None, "high", None, "pending", None), (5, "p5", "j", "odd", "", "pending", None), (6, "p6", "k", "high", "other", "pending", None)]
    df = spark.createDataFrame(rows, PROPOSAL)
    assert sorted(r.id for r in L.best_per_key(df).collect()) == ["p3", "p5"]
    assert sorted(r.id for r in L.first_per_title(df).collect()) == ["p1", "p3", "p4", "p5", "p6"]
    assert [r.finding for r in L.findings(df).collect()] == ["f1", ("long " * 40)[:120]]
    assert {r.id: r.session_ids for r in L.evidence_sessions(df).collect()}["p1"] == ["a", "b", "c", "d", "e"]
    assert {r.id: r.session_ids for r in L.evidence_sessions(df).collect()}["p2"] == []
    assert sorted(r.id for r in L.conflicts(df).collect()) == ["p2", "p3", "p6"]


# ---- sources and sinks

def test_event_field_presence(spark):
    df = spark.createDataFrame([('{"k": 1}', "top"), ('{"k": null}', "top"), ("{}", "top"), ("not json", "top"), (None, None)], "event_value string, k string")
    assert [r[0] for r in df.select(field(df, "k", "string")).collect()] == ["1", None, "top", "top", None]


def test_read_traces_and_events(spark, tmp_path):
    trace = tmp_path / "t.json"
    trace.write_text('{"session_id": "s1", "resolved_from": "x", "events": [{"event_type": "USER_QUERY", "timestamp": "2024-01-01T00:00:00Z", "content": "hi"},'
                     ' {"event_type": "TOOL_CALL_RESULT", "timestamp": "2024-01-01T00:00:02Z", "event_value": {"latency": 12.5, "error": null, "tool": "t"}}]}\n')
    flat = SRC.read_traces(spark, str(trace))
    r = one(P.primitives(flat, price_table(spark)))
    assert (r.session_id, r.turn_count, r.avg_tool_latency_ms, r.session_duration_ms, r.structured_hits.tools) == ("s1", 1, 12.5, 2000, ["t"])
    flat.select("event_id", "session_id", "event_type", "timestamp", "content", "event_value", "is_debug_event").write.parquet(str(tmp_path / "p"))
    again = SRC.read_events(spark, str(tmp_path / "p"))
    assert one(P.primitives(again, price_table(spark))).avg_tool_latency_ms == 12.5


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "before", 1), ("b", "after", 2)], "session_id string, cohort string, n int")
    back = sinks.materialize(df, str(tmp_path / "m"), ["cohort"])
    assert sorted(map(tuple, back.select("session_id", "cohort", "n").collect())) == [("a", "before", 1), ("b", "after", 2)]
    assert [r.session_id for r in sinks.missing_only(df, back.where("n = 1")).collect()] == ["b"]
    sinks.write_per_conversation(df, str(tmp_path / "j"))
    assert (tmp_path / "j" / "cohort=before").exists()
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["session_id", "cohort", "n"]
    (tmp_path / "log.jsonl").write_text('{"phase": "0", "component": "x", "duration_ms": 1.5}\n{"phase": "0", "component": "x", "duration_ms": 2}\n')
    assert [tuple(r) for r in C.timing_rollup(SRC.read_timing(spark, str(tmp_path / "log.jsonl"))).collect()] == [("0:x", 3.5)]


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 1.0]), ([0.0, 0.0], [1.0]), ([], []), (None, [1.0])], "a array<double>, b array<double>")
    got = df.select(VF.normalize(F.col("a")).alias("n"), VF.cosine_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.n for r in got] == [[0.6, 0.8], [0.0, 0.0], [], None] and [r.d for r in got] == [-3.0, 1.0, 1.0, 1.0]


def test_price_rates(spark):
    r = one(with_price(spark.createDataFrame([("gpt-4o",)], "model_id string"), price_table(spark)))
    assert (r.input_rate, r.output_rate) == (2.5e-6, 1e-5)


def test_single_cohort_tables(spark):
    from parley.operators import artifacts as A

    fv = spark.createDataFrame([("a", "all", 2), ("b", "all", 3)], "session_id string, cohort string, turn_count int")
    aspects = [{"id": "turns", "name": "Turns", "components": [{"ref": {"kind": "turn_count"}}]}, {"id": "none", "components": [{"ref": {"kind": "x"}}]}]
    res = C.aspect_results(fv, aspects, comparative=False)
    rows = {r.id: r for r in res.collect()}
    assert rows["turns"].value == 2.5 and not rows["turns"].no_data and rows["none"].value is None and rows["none"].no_data
    assert rows["turns"].before is None and A.aspect_table(res, comparative=False).columns == ["aspect_id", "name", "value"]
    flags = S.hypothesis_flags(fv, [{"id": "h", "predicate": cmp("turn_count", ">", 2)}])
    hyp = C.hypothesis_results(fv.select("session_id", "cohort"), flags, [{"id": "h"}], comparative=False, min_support=1)
    r = one(A.hypothesis_table(hyp, comparative=False))
    assert (r.hypothesis_id, r.support, r.rate, r.rejected) == ("h", 1, 0.5, False)


def test_empty_cohort_rolls_up_to_zeros(spark):
    roll = P.session_rollup(ev(spark, [("s", "USER_QUERY", 1, {})]).withColumn("cohort", F.lit("before")), ["cohort"])
    both = {r.cohort: r for r in C.cohort_rollup(roll, ["before", "after"]).collect()}
    assert both["after"].n == 0 and both["after"].avg_turn_count == 0 and both["before"].avg_turn_count == 1
    deltas = {r.name: r.delta_pct for r in C.compare_cohorts(C.cohort_rollup(roll, ["before", "after"])).collect()}
    assert deltas["Conversation length"] == -100.0 and deltas["Tool error rate"] == 0.0


def test_price_table_beyond_the_broadcast_bound(spark, monkeypatch):
    from parley.operators import pricing

    use = spark.createDataFrame([(1, "gpt-4o"), (2, None), (3, "who"), (4, "main_model")], "i int, model_id string")
    small = sorted(map(tuple, with_price(use, price_table(spark)).collect()))
    monkeypatch.setattr(pricing, "PRICE_ROWS", 3)
    assert sorted(map(tuple, with_price(use, price_table(spark)).select("i", "model_id", "input_rate", "output_rate").collect())) == small


def test_study_reports_on_handmade_sessions(spark):
    """A small study from index and events to its tables, with an overlap and a cap."""
    from parley.plans import studies as R

    rows = []
    for i in range(24):
        sid = f"v{i:02d}"
        rows += [(sid, "USER_QUERY", 86400 * i + t, {"content": f"pay bill {t}", "request_id": f"r{t}"}) for t in range(1 + i % 4)]
        rows.append((sid, "TOOL_CALL_RESULT", 86400 * i + 9, {"latency": float(i), "error": "x" if i % 3 else None}))
        rows += [(sid, "SESSION_END", 86400 * i + e, {"status": "completed" if e == 20 else "timeout"}) for e in (20, 30)]
    log = ev(spark, rows, latency="double")
    start = log.groupBy("session_id").agg(F.min("timestamp").alias("start_time"))
    index = start.select(
        F.md5("session_id").alias("_id"), F.col("session_id").alias("voice_session_id"), F.lit("t").alias("tenant"),
        F.lit("o").alias("assistant_origin_id"), F.lit("a").alias("assistant_id"), "start_time",
        F.lit(None).cast("string").alias("external_chat_session"), F.lit(None).cast("string").alias("chat_transport_provider"))
    study = {"study_type": "comparative", "tenant": "t", "assistant_origin_id": "o",
             "date_range_before": {"start": "1970-01-01", "end": "1970-01-13"}, "date_range_after": {"start": "1970-01-12", "end": "1970-01-24 23:59:59"},
             "cohort_filters": [{"atom_id": "session_outcome_in", "value": ["completed"]}], "min_support": 1, "n_explore": 6}
    lexicon = {"pay": {"keywords": ["pay", "bill"]}}
    made = R.build_cohorts(index, log, study, lexicon, price_table(spark), vec_dim=8)
    fv = made.features.collect()
    assert {r.cohort for r in fv} == {"before", "after"} and len(fv) > len({r.session_id for r in fv})
    assert all(r.session_outcome == "completed" and r.opening_intent_class == "pay" and len(r.embedding_opening) == 8 for r in fv)
    stats = {r.cohort: (r.raw_count, r.filtered_count) for r in made.stats.collect()}
    assert stats["total"] == (len(fv), len(fv)) and stats["before"] == (sum(r.cohort == "before" for r in fv),) * 2
    capped = R.build_cohorts(index, log, {**study, "n_eval": 5}, lexicon, price_table(spark))
    assert {r.cohort: r.n for r in capped.features.groupBy("cohort").agg(F.count("*").alias("n")).collect()} == {"before": 5, "after": 5}
    lines = eventlog.transcript(eventlog.turns(made.events))
    seen = R.explore(made.features, made.events, lines, study)
    assert 0 < seen["digests"].count() <= 6 and 0 < seen["extremes"].count() <= 3
    plan = {"aspects": [{"id": "turns", "components": [{"ref": {"kind": "turn_count"}}]}],
            "hypotheses": [{"id": "h", "predicate": cmp("talks", "==", "match")}],
            "signals_required": [{"name": "talks", "method": "rule_based", "spec": {"keywords": ["bill 2"]}}]}
    out = R.evaluate(made.features, plan, study, made.text, made.events, lines, "embedding_opening")
    h = one(out["hypotheses"])
    assert h.before_support == sum(r.cohort == "before" and r.turn_count > 2 for r in fv) and h.before_size == stats["before"][0]
    assert one(out["aspect_table"]).before == pytest.approx(sum(r.turn_count for r in fv if r.cohort == "before") / stats["before"][0], abs=5e-4)
    assert out["counter_examples"].count() == 3 and out["hypothesis_table"].count() == 1 and out["values"].count() == len(fv)
    quick = {r.name: r for r in R.quick_results(log.withColumn("session_id", F.md5("session_id")), index, study).collect()}
    assert quick["Conversation length"].n_before == stats["before"][0]
    audit = R.audit_events(log)
    assert {r.event_type: r.n for r in audit["histogram"].collect()}["SESSION_END"] == 24


def test_readers_use_declared_schemas(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"_id": "x", "voice_session_id": "v", "tenant": "t", "start_time": "2024-01-01T00:00:00Z", "voice_session": {"reconnects": 2}}\n')
    s = SRC.read_sessions(spark, str(tmp_path / "s.json"), "json")
    from parley.operators import scope

    assert one(scope.reconnects(s)).is_reconnect and one(scope.tenants(s)).tenant == "t"
    (tmp_path / "t.json").write_text('{"session_id": "v", "query": "hi", "created_at": "2024-01-01T00:00:01Z", "tool_call_list": [{"name": "n", "error": "e"}]}\n'
                                     '{"session_id": "v", "final_response": "yo", "created_at": "2024-01-01T00:00:00Z"}\n')
    d = one(eventlog.session_detail(SRC.read_turn_rows(spark, str(tmp_path / "t.json"), "json"), s))
    assert d.turn_count == 2 and d.is_reconnect and [t.query for t in d.turns] == [None, "hi"] and d.turns[1].tool_call_list[0].error == "e"
    (tmp_path / "p.json").write_text('{"seq": 1, "id": "p", "evidence": [{"summary": "s", "session_ids": ["a", "a"]}]}\n')
    p = SRC.read_proposals(spark, str(tmp_path / "p.json"))
    assert one(L.evidence_sessions(p)).session_ids == ["a"] and one(L.findings(p)).finding == "s"
    sinks.write_json(p, str(tmp_path / "out"))
    assert SRC.read_proposals(spark, str(tmp_path / "out")).count() == 1
    csv = tmp_path / "e.csv"
    csv.write_text('event_id,session_id,request_id,turn_id,event_type,timestamp,content,event_value,is_debug_event\n1,s,,,TOOL_CALL_RESULT,2024-01-01T00:00:00Z,,"{""latency"": 3}",false\n')
    assert one(SRC.read_events(spark, str(csv), "csv")).latency == 3.0


def test_empty_cohorts_and_overriding_aspects(spark):
    from parley.plans import studies as R

    fv = spark.createDataFrame([("a", "before", 1), ("b", "after", 3), ("b", "before", 3)], "session_id string, cohort string, turn_count int")
    full = fv.withColumns({c: F.lit(0) for c in ("tool_error_count", "interruption_count")}).withColumns(
        {"session_outcome": F.lit("completed"), "transfer_completed": F.lit(False), "guardrail_triggered": F.lit(False), "latency": F.lit(6.0)})
    plan = {"aspects": [{"id": "turn_count", "components": [{"ref": {"kind": "primitive", "name": "latency"}}]}],
            "hypotheses": [{"id": "h", "predicate": cmp("turn_count", ">", 5)}, {"id": "g", "predicate": cmp("turn_count", ">", 9)}]}
    study = {"study_type": "comparative", "min_support": 1}
    out = R.evaluate(full, plan, study)
    assert {r.turn_count for r in out["values"].collect()} == {6.0}
    assert {r.id: r.before_support for r in out["hypotheses"].collect()} == {"h": 2, "g": 0}
    # a session in both cohorts is picked once, and no vectors are needed
    assert sorted((r.hypothesis_id, r.session_id) for r in out["counter_examples"].collect()) == [("g", "a"), ("g", "b")]
    for kind in ("comparative", "single"):
        none = R.evaluate(full.limit(0), plan, {**study, "study_type": kind})
        assert none["aspects"].count() == 1 and none["hypotheses"].count() == 2
    assert one(R.evaluate(full.limit(0), plan, {"study_type": "single"})["aspects"]).no_data


def test_summaries_with_one_opening_are_two_findings(spark):
    e = [(None, "long " * 40 + "a", None), (None, "long " * 40 + "b", None), (None, "long " * 40 + "b", None)]
    df = spark.createDataFrame([(1, "p1", "k", "low", "t", "applied", e)], PROPOSAL)
    assert L.findings(df).count() == 2


def test_signals_of_sessions_without_text(spark):
    fv = spark.createDataFrame([("a",), ("b",)], "session_id string")
    text = spark.createDataFrame([("a", 0, "pay now")], "session_id string, part int, searchable_text string")
    plan = {"signals_required": [{"name": "pays", "method": "rule_based", "spec": {"keywords": ["pay"], "labels": ["yes", "no"]}}],
            "classical_signals_required": [{"name": "now", "kind": "regex_on_transcript", "pattern": "now"}]}
    assert {r.session_id: (r.pays, r.now) for r in S.with_signals(fv, plan, text).collect()} == {"a": ("yes", True), "b": ("no", False)}
    with pytest.raises(ValueError, match="text table"):
        S.with_signals(fv, plan)


def test_similarity_and_own_scorers(spark):
    fv = spark.createDataFrame([("a", "pay", [1.0, 0.0]), ("b", "go", [0.0, 1.0]), ("c", "", [-1.0, 0.0])], "session_id string, opening_text string, embedding_opening array<double>")
    near = {"name": "near", "method": "embedding_nearest_neighbor", "spec": {"prototypes": [
        {"id": "x", "vectors": [[2.0, 0.0]]}, {"id": "y", "vectors": [[0.0, 3.0], [1.0, 1.0]]}, {"id": "none"}]}}
    own = {"name": "own", "method": "length", "spec": {"prompt": "3"}}
    scorers = {"length": lambda spec: F.length("opening_text") >= int(spec["prompt"])}
    got = {r.session_id: (r.near, r.own) for r in S.with_signals(fv, {"signals_required": [near, own]}, scorers=scorers).collect()}
    assert got == {"a": ("x", True), "b": ("y", False), "c": ("none", False)}
    with pytest.raises(ValueError, match="length"):
        S.with_signals(fv, {"signals_required": [own]})
    assert S.with_signals(fv, {"signals_required": [{"name": "own", "method": "length"}]}).columns == fv.columns


def test_component_sources():
    columns = ["turn_count", "interruption_count", "x", "session_outcome"]
    at = lambda kind, name="", agg="mean": C.component_source({"kind": kind, "name": name}, agg, columns)
    assert at("turn_count", "x") == ("column", "turn_count") and at("odd", "x") == ("column", "x") and at("x") == ("column", "x")
    assert at("turn_count", "interruption") == at("turn_count", "interruption_count") == ("column", "interruption_count")
    assert at("primitive", "y") is None and at("primitive", "x") == ("column", "x") and at("odd") is None
    assert at("guardrail_triggered", "", "rate") == at("guardrail_hits", "all", "rate") == ("flag", "guardrail")
    assert at("session_outcome", "transfer") == at("any", "", "count_transfer") == ("flag", "transferred")
    assert at("session_outcome", "Odd") == ("outcome", "odd") and at("session_outcome") is None


def test_any_key_and_top_level_keys_of_logged_events(spark, tmp_path):
    rows = ['{"event_id": 1, "session_id": "s", "event_type": "TOOL_CALL_RESULT", "timestamp": "2024-01-01T00:00:00Z", "agent_name": "top", "event_value": {"odd": 2.5, "result": [], "secs_since_session_start": 3}}',
            '{"event_id": 2, "session_id": "s", "event_type": "TOOL_CALL_RESULT", "timestamp": "2024-01-01T00:00:01Z", "event_value": {"odd": 4, "agent_name": "in", "result": {}, "secs_since_session_start": 3}}']
    (tmp_path / "e.json").write_text("\n".join(rows))
    ev = SRC.read_events(spark, str(tmp_path / "e.json"), "json")
    assert [r.agent_name for r in ev.orderBy("event_id").collect()] == ["top", "in"]
    from parley.operators.digest import anomaly_flags
    from parley.operators.primitives import primitive

    assert one(primitive(ev, "x", ["TOOL_CALL_RESULT"], "sum", "odd")).x == 6.5
    assert one(ev.groupBy("session_id").agg(anomaly_flags().alias("f"))).f == ["empty_tool_result"]
    assert [r.event_id for r in eventlog.dedupe_by_field(ev).collect()] == [1]
    sig = {"classical_signals_required": [{"name": "m", "kind": "conditional_metadata", "event_type": "TOOL_CALL_RESULT", "field": "odd"}]}
    assert one(S.with_signals(spark.createDataFrame([("s",)], "session_id string"), sig, ev=ev)).m == "2.5"


def test_a_large_lexicon_is_planned_in_linear_time(spark):
    import time

    lexicon = {f"i{i}": {"keywords": [f"k{i}x{j}" for j in range(50)], "tools": [f"t {i} {j}" for j in range(5)]} for i in range(200)}
    text = spark.createDataFrame([("a", 0, "K7x3 and k7x4 k9x1"), ("b", 0, None)], "session_id string, part int, searchable_text string")
    hits = spark.createDataFrame([("a", (["T-9-2"],)), ("b", (["none"],)), ("c", None)], "session_id string, structured_hits struct<tools:array<string>>")
    start = time.perf_counter()
    out = intent.classify_intent(text, hits, lexicon)
    assert time.perf_counter() - start < 2
    got = {r.session_id: (r.opening_intent_class, r.opening_intent_score) for r in out.collect()}
    assert got == {"a": ("i9", round(4.5 / 7.5, 4)), "b": ("unknown", 0.0), "c": ("unknown", 0.0)}
