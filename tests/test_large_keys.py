"""Keys far above the size limits give the same results as small ones."""

import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from parley.functions.events import complete
from parley.functions.spans import chains_of, opening_of, parts_of, pattern_found, text_found
from parley.operators import eventlog, ordering as O, primitives as P, signals, significance
from workload.binding import price

RNG = random.Random(7)


@pytest.fixture(scope="module")
def skewed(spark):
    """300 rows of which key 'hot' holds two thirds."""
    rows = [("hot" if i % 3 else f"k{i % 7}", i * 37 % 101, i) for i in range(300)]
    return rows, spark.createDataFrame(rows, "k string, v int, id int").cache()


def _expected_positions(rows):
    out = {}
    for k in {r[0] for r in rows}:
        for pos, r in enumerate(sorted((r[1], r[2]) for r in rows if r[0] == k)):
            out[r[1]] = pos
    return out


@pytest.mark.parametrize("limit", [10, 64, 1000])
def test_position(skewed, limit):
    rows, df = skewed
    got = {r.id: r.pos for r in O.with_position(df, ["k"], ["v", "id"], limit=limit).collect()}
    assert got == _expected_positions(rows)


@pytest.mark.parametrize("limit", [25, 1000])
def test_global_position_descending(skewed, limit):
    rows, df = skewed
    got = O.with_position(df, [], [F.desc("v"), "id"], limit=limit).collect()
    want = {r[2]: i for i, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[2])))}
    assert {r.id: r.pos for r in got} == want


@pytest.mark.parametrize("limit", [10, 1000])
def test_running_total(skewed, limit):
    rows, df = skewed
    got = {r.id: r.t for r in O.with_running_total(df, ["k"], ["v", "id"], F.col("v"), "t", limit).collect()}
    for k in {r[0] for r in rows}:
        total = 0
        for v, i in sorted((r[1], r[2]) for r in rows if r[0] == k):
            assert got[i] == total
            total += v


@pytest.mark.parametrize("limit,part", [(10, 16), (1000, 1000)])
def test_collect_parts_keeps_everything_in_order(skewed, limit, part):
    rows, df = skewed
    got = O.collect_parts(df, ["k"], ["v", "id"], F.col("id"), "ids", part, limit).collect()
    assert max(len(r.ids) for r in got) <= part
    for k in {r[0] for r in rows}:
        parts = sorted((r.part, r.ids) for r in got if r.k == k)
        assert [p for p, _ in parts] == list(range(len(parts)))
        assert [i for _, ids in parts for i in ids] == [i for _, i in sorted((r[1], r[2]) for r in rows if r[0] == k)]


@pytest.mark.parametrize("limit", [15, 10_000])
def test_quantiles_match_the_statistics_module(spark, limit):
    groups = {f"g{n}": [RNG.choice([RNG.random() * 100, float(RNG.randrange(9))]) for _ in range(n)] for n in (1, 2, 3, 19, 20, 21, 400)}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    for r in O.quantiles(df, ["k"], "v", limit).collect():
        vs = groups[r.k]
        assert r.n == len(vs)
        assert r.p50 == pytest.approx(statistics.median(vs))
        assert r.p95 == pytest.approx(statistics.quantiles(vs, n=20)[-1] if len(vs) > 1 else vs[0])


def test_hash_position_is_a_permutation_per_key(skewed):
    rows, df = skewed
    got = O.with_hash_position(df, "id", "s", ["k"]).collect()
    for k in {r[0] for r in rows}:
        assert sorted(r.pos for r in got if r.k == k) == list(range(sum(1 for r in rows if r[0] == k)))


@pytest.mark.parametrize("n", [0, 1, 7, 10_000])
def test_first_by_hash_is_the_head_of_that_order(spark, skewed, n):
    _, df = skewed
    places = O.with_hash_position(df, "id", "s", ["k"])
    want = sorted(map(tuple, places.where(F.col("pos") < n).collect()))
    assert sorted(map(tuple, O.first_by_hash(df, "id", "s", n, ["k"]).collect())) == want
    quota = df.select("k").distinct().withColumn("quota", F.lit(n) + F.length("k"))
    got = O.first_by_hash(df, "id", "s", F.col("quota"), ["k"], quota).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, places.where(F.col("pos") < n + F.length("k")).collect()))
    whole = O.with_hash_position(df, "id", "s").where(F.col("pos") < n).collect()
    assert sorted(map(tuple, O.first_by_hash(df, "id", "s", n).collect())) == sorted(map(tuple, whole))


def _session(spark, n=400):
    kinds = ["RESPONSE.FINAL", "LLM_INVOCATION_SUCCESS", "USER_QUERY", "TOOL_CALL_RESULT"]
    rows = []
    for i in range(n):
        sid = "big" if i % 4 else f"s{i % 5}"
        t = RNG.choice(kinds)
        rows.append((i, sid, t, 1000 + i * 3 // 2, f"text {i}", RNG.choice(["a", "b"]) if t == "RESPONSE.FINAL" else None,
                     RNG.choice(P.PURPOSES) if t.startswith("LLM") else None, RNG.choice([0.0, 1.5, RNG.random() * 50]) if t.startswith("LLM") else None))
    df = spark.createDataFrame(rows, "event_id long, session_id string, event_type string, s long, content string, agent_name string, purpose string, latency_ms double")
    return complete(df.withColumn("timestamp", F.timestamp_seconds("s")).drop("s")).cache()


def test_primitives_same_for_large_sessions(spark):
    ev = _session(spark)
    whole = P.primitives(ev, price(spark)).orderBy("session_id").collect()
    split = P.primitives(ev, price(spark), limit=50).select(*P.primitives(ev, price(spark)).columns).orderBy("session_id").collect()
    assert whole == split
    path = next(r.agent_path for r in whole if r.session_id == "big").split("→")
    assert all(a != b for a, b in zip(path, path[1:]))


def test_session_text_parts_join_to_the_whole(spark):
    ev = _session(spark)
    whole = {r.session_id: r.searchable_text for r in eventlog.session_text(ev).collect()}
    parts = {}
    for r in sorted(eventlog.session_text(ev, part_rows=32).collect(), key=lambda r: r.part):
        parts.setdefault(r.session_id, []).append(r.searchable_text)
    assert len(parts["big"]) > 5
    assert {k: "\n".join(v) for k, v in parts.items()} == whole


@pytest.mark.parametrize("part_rows", [2, 3, 10_000])
def test_rules_match_over_a_cut(spark, part_rows):
    said = ["hello", "please", "now", "pay the", "bill", "end"]
    rows = [(i, sid, "USER_QUERY", 1000 + i, t) for sid in ("a", "b") for i, t in enumerate(said if sid == "a" else said[:3])]
    ev = complete(spark.createDataFrame(rows, "event_id long, session_id string, event_type string, s long, content string")
                  .withColumn("timestamp", F.timestamp_seconds("s")).drop("s"))
    text = eventlog.session_text(ev, part_rows=part_rows)
    patterns = {"over": r"please\s+now", "far": r"the\nbill\nend$", "cut": r"now$", "start": r"^please", "head": r"^hello\s", "tail": r"bill$"}
    plan = {"signals_required": [{"name": "pays", "method": "rule_based", "spec": {"keywords": ["pay the\nbill"]}}],
            "classical_signals_required": [{"name": n, "kind": "regex_on_transcript", "pattern": p} for n, p in patterns.items()]}
    fv = spark.createDataFrame([("a",), ("b",)], "session_id string")
    got = {r.session_id: [r.pays] + [r[n] for n in patterns] for r in signals.with_signals(fv, plan, text).collect()}
    assert got == {"a": ["match", True, True, False, False, True, False], "b": ["other", True, False, True, False, True, False]}


CHAINS = [r"a\s+b", r"(?s)a.*b.*c", r"a[^c]*b[^a]*c$", r"^a\s*b", r"(?:a|b\s)c", r"a\n{1,3}b", r"a(\s+x)?\s*c", r"b\W?a\Wc", r"\ba\b[\s\S]+?\bc\b", r"c\s*$", r"^\s*b", r"x.x", r"a\n\nb",
          r"(a\s+b|c)\s+(x|a)", r"[^a]{2,4}b", r"x$", r"\Aa[\sx]*c\Z", r"a.b", r"ab\D+a"]


def test_rules_over_parts_equal_the_whole_text(spark):
    rng = random.Random(4)
    said = {f"s{k}": [rng.choice(["a", "b", "c", "x", "ab", "a b", "x c", " ", "a ", " b", "c\nx", "a\n", "b\n\na"]) for _ in range(rng.randrange(1, 9))] for k in range(120)}
    rows = [(1000 + i, sid, "USER_QUERY", i, t) for sid, turns in said.items() for i, t in enumerate(turns)]
    ev = complete(spark.createDataFrame(rows, "event_id long, session_id string, event_type string, s long, content string")
                  .withColumn("timestamp", F.timestamp_seconds("s")).drop("s"))
    words = ["a\nb", "c\nx\na", "x", "b\n"]
    for size in (1, 2, 3, 100):
        text = parts_of(eventlog.session_text(ev, part_rows=size))
        own, pieces = F.col("searchable_text"), F.col("pieces")
        cols = [pattern_found(p, own, pieces).alias(f"p{i}") for i, p in enumerate(CHAINS)] + [text_found(w, own).alias(f"w{i}") for i, w in enumerate(words)]
        for r in text.groupBy("session_id").agg(*cols, opening_of(own, 7).alias("opening")).collect():
            whole = "\n".join(said[r.session_id])
            for i, p in enumerate(CHAINS):
                assert r[f"p{i}"] == bool(re.search(p, whole, re.I)), (size, p, whole)
            assert [r[f"w{i}"] for i in range(len(words))] == [w in whole for w in words]
            assert r.opening == whole[:7]


def test_a_match_spans_any_number_of_events(spark):
    rows = [(i, "s", "USER_QUERY", i, "transfer" if i == 0 else "refund" if i == 299 else f"line {i}") for i in range(300)]
    ev = complete(spark.createDataFrame(rows, "event_id long, session_id string, event_type string, s long, content string")
                  .withColumn("timestamp", F.timestamp_seconds("s")).drop("s"))
    own, pieces = F.col("searchable_text"), F.col("pieces")
    for size in (2, 10_000):
        got = eventlog.session_text(ev, part_rows=size).groupBy("session_id").agg(
            pattern_found(r"(?s)transfer.*refund", own, pieces).alias("over"), pattern_found(r"(?s)refund.*transfer", own, pieces).alias("back"),
            pattern_found(r"line 5(?=\nline)", own, pieces).alias("per_event")).first()
        assert tuple(got)[1:] == (True, False, False)


def test_patterns_of_another_form_are_searched_per_event():
    assert all(chains_of(p) is None for p in (r"a(?=b)", r"(a\s)+b", r"(?m)^a", r"(a)\1", r"\s{1,40}", "("))
    assert all(chains_of(p) for p in CHAINS)


@pytest.mark.parametrize("limit", [20, 10_000])
def test_mann_whitney_u_sums(spark, limit):
    rows = [(k, c, float(RNG.randrange(40))) for k in ("x", "y") for c, n in (("before", 60), ("after", 45)) for _ in range(n)]
    df = spark.createDataFrame(rows, "id string, cohort string, value double")
    for r in significance.mann_whitney(df, digits=None, limit=limit).collect():
        b = [v for k, c, v in rows if k == r.id and c == "before"]
        a = [v for k, c, v in rows if k == r.id and c == "after"]
        u = sum((x > y) + 0.5 * (x == y) for x in b for y in a)
        assert (r.n1, r.n2) == (60, 45) and r.u1 == pytest.approx(u)


def test_results_do_not_depend_on_partitions(spark):
    ev = _session(spark)
    got = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(P.primitives(ev.repartition(int(n)), price(spark), limit=50).orderBy("session_id").collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]
