"""Cohort results: rollups, aspects, hypotheses, tests, tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions.numbers import chi_square, fisher, rate_test, z_test
from parley.operators import artifacts as A, cohort as C, primitives as P
from parley.operators.ordering import quantiles
from parley.operators.signals import enrich, hypothesis_flags
from parley.operators.significance import average_ranks, mann_whitney
from workload.binding import EV, events, table
from workload.features import FV, features
from workload.measures import ROLLUP
from workload.registry import add, r

# ---- fixed aspects

ROLL = f"{EV}, roll AS (SELECT cohort, session_id, {ROLLUP} FROM ev GROUP BY ALL)"
E1 = f"""{ROLL}, e1 AS (SELECT cohort, count(*) AS n, sum(turn_count) / count(*) AS avg_turn_count,
    sum(last_us - first_us) / 1000000.0 / count(*) AS avg_duration_secs, sum(tool_count) / count(*) AS avg_tool_invocations,
    coalesce(sum(tool_error_count) * 100.0 / nullif(sum(tool_count), 0), 0) AS tool_error_rate_pct,
    coalesce(sum(tool_latency_sum) / nullif(sum(tool_count), 0), 0) AS avg_tool_latency_ms FROM roll GROUP BY cohort)"""
E1_COLS = ["avg_turn_count", "avg_duration_secs", "avg_tool_invocations", "tool_error_rate_pct", "avg_tool_latency_ms"]


def _rollup(spark, sf):
    return P.session_rollup(events(spark, sf), ["cohort"])


@add("e1_cohort_rollup", f"WITH {E1} SELECT cohort, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in E1_COLS) + " FROM e1")
def _(spark, sf):
    e1 = C.cohort_rollup(_rollup(spark, sf), digits=False)
    return e1.withColumns({c: r(c) for c in E1_COLS})


E2 = """SELECT name, {b} AS "before", {a} AS "after", unit, {d} AS delta_pct, 'down' AS good_if, n_before, n_after FROM (
  SELECT b.n AS n_before, a.n AS n_after, unnest([
    {{'name': 'Conversation length', 'b': b.avg_turn_count, 'a': a.avg_turn_count, 'unit': 'turns'}},
    {{'name': 'Session duration', 'b': b.avg_duration_secs, 'a': a.avg_duration_secs, 'unit': 's'}},
    {{'name': 'Tool error rate', 'b': b.tool_error_rate_pct, 'a': a.tool_error_rate_pct, 'unit': '%'}},
    {{'name': 'Avg tool latency', 'b': b.avg_tool_latency_ms, 'a': a.avg_tool_latency_ms, 'unit': 'ms'}}], recursive := true)
  FROM (SELECT * FROM e1 WHERE cohort = 'before') b, (SELECT * FROM e1 WHERE cohort = 'after') a)"""
E2_EXACT = E2.format(b="round(b, 6)", a="round(a, 6)", d="round(CASE WHEN b = 0 THEN 0 ELSE (a - b) / b * 100 END, 6)")


@add("e2_compare_cohorts", f"WITH {E1} {E2_EXACT}")
def _(spark, sf):
    e2 = C.compare_cohorts(C.cohort_rollup(_rollup(spark, sf), ["before", "after"], digits=False), None)
    return e2.withColumns({c: r(c) for c in ("before", "after", "delta_pct")})


# ---- aspects

ASPECTS = [
    {"id": "turns", "name": "Turns", "components": [{"ref": {"kind": "turn_count"}, "aggregation": "mean"}]},
    {"id": "tool_error", "components": [{"ref": {"kind": "tool_error_count", "name": "all"}, "aggregation": "sum"}]},
    {"id": "latency", "components": [{"ref": {"kind": "main_stream_latency_p95"}, "aggregation": "mean"}]},
    {"id": "transfers", "components": [{"ref": {"kind": "session_outcome"}, "aggregation": "count_transfer"}]},
    {"id": "success", "components": [{"ref": {"kind": "session_outcome", "name": "completed"}, "aggregation": "rate"}]},
    {"id": "timeouts", "components": [{"ref": {"kind": "session_outcome", "name": "timeout"}, "aggregation": "rate"}]},
    {"id": "guardrail", "components": [{"ref": {"kind": "guardrail_triggered", "name": "all"}, "aggregation": "rate"}]},
    {"id": "two_latencies", "components": [{"ref": {"kind": "primitive", "name": "main_stream_latency_p95"}, "aggregation": "max"},
                                           {"ref": {"name": "router_latency_p95"}, "aggregation": "mean"}]},
    {"id": "spread_p95", "components": [{"ref": {"name": "tool_error_count"}, "aggregation": "p95"}, {"ref": {"name": "turn_count"}},
                                        {"ref": {"name": "interruption_count"}}]},
    {"id": "variant", "components": [{"ref": {"name": "traffic_split_variant"}, "aggregation": "mean"}]},
]
_P3 = "(SELECT (v[2] * (20 - 36) + v[3] * 36) / 20.0 FROM (SELECT list_sort([tool_error_count, turn_count, interruption_count]) AS v))"
ASPECT_SQL = {
    "turns": "turn_count::DOUBLE", "tool_error": "tool_error_count::DOUBLE", "latency": "main_stream_latency_p95",
    "transfers": "(session_outcome = 'transferred' OR transfer_completed)::INT::DOUBLE",
    "success": "(session_outcome = 'completed')::INT::DOUBLE", "timeouts": "contains(session_outcome, 'timeout')::INT::DOUBLE",
    "guardrail": "guardrail_triggered::INT::DOUBLE",
    "two_latencies": "greatest(main_stream_latency_p95, router_latency_p95)",
    "spread_p95": _P3, "variant": "NULL::DOUBLE",
}
IDS = list(ASPECT_SQL)
AV = FV + ", av AS (SELECT session_id, cohort, " + ", ".join(f"{x} AS {n}" for n, x in ASPECT_SQL.items()) + " FROM fv)"
LONG = AV + ", long AS (" + " UNION ALL ".join(f"SELECT cohort, '{n}' AS id, {n} AS value FROM av" for n in IDS) + ")"
TITLE = "CASE id WHEN 'turns' THEN 'Turns' ELSE id END"


@add("e3_components", f"WITH {FV} SELECT session_id, turn_count::DOUBLE AS a, (session_outcome = 'transferred' OR transfer_completed)::INT::DOUBLE AS b, "
     "interruption_count::DOUBLE AS c, guardrail_triggered::INT::DOUBLE AS d, NULL::DOUBLE AS e FROM fv")
def _(spark, sf):
    fv = features(spark, sf)
    refs = {"a": ({"kind": "turn_count", "name": ""}, "mean"), "b": ({"kind": "session_outcome", "name": "transfer"}, "rate"),
            "c": ({"kind": "turn_count", "name": "interruption"}, "mean"), "d": ({"kind": "x", "name": "guardrail_triggered"}, "mean"),
            "e": ({"kind": "session_outcome"}, "mean")}
    return fv.select("session_id", *[C.component(ref, agg, fv).alias(n) for n, (ref, agg) in refs.items()])


@add("e4_aspect_values", f"WITH {AV} SELECT session_id, cohort, " + ", ".join(f"round({n}, 6) AS {n}" for n in IDS) + " FROM av")
def _(spark, sf):
    v = C.aspect_values(features(spark, sf), ASPECTS)
    return v.withColumns({n: r(n) for n in IDS})


# the test in SQL: average ranks, then the normal tail by the same polynomial
ERFC = ("((((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t) * exp(-x * x))")
MWU = """mw AS (
  SELECT id, n1, n2, u1, CASE WHEN n1 < 2 OR n2 < 2 OR sd = 0 OR sd IS NULL OR z <= 0 THEN 1.0 ELSE least(1.0, """ + ERFC + """) END AS p
  FROM (SELECT *, 1.0 / (1.0 + 0.3275911 * x) AS t FROM (SELECT *, z / sqrt(2.0) AS x FROM (
    SELECT *, (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / nullif(sd, 0) AS z FROM (
    SELECT *, r1 - n1 * (n1 + 1) / 2 AS u1, sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM (
    SELECT id, sum(nb)::DOUBLE AS n1, sum(na)::DOUBLE AS n2, sum(nb * (below + (nb + na + 1) / 2)) AS r1,
      sum((nb + na)::DOUBLE ^ 3 - (nb + na)) AS ties
    FROM (SELECT *, coalesce(sum(nb + na) OVER (PARTITION BY id ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
      SELECT id, value, count(*) FILTER (cohort = 'before') AS nb, count(*) FILTER (cohort = 'after') AS na
      FROM long WHERE value IS NOT NULL GROUP BY ALL)) GROUP BY id))))))"""
VERDICT = "CASE WHEN n1 >= 2 AND n2 >= 2 THEN 'mann_whitney' ELSE 'insufficient_data' END"


@add("e5_aspect_results", f"""WITH {LONG}, {MWU}, m AS (SELECT id, coalesce(avg(value) FILTER (cohort = 'before'), 0) AS b,
    coalesce(avg(value) FILTER (cohort = 'after'), 0) AS a FROM long GROUP BY id)
  SELECT id, {TITLE} AS name, round(b, 6) AS "before", round(a, 6) AS "after", round(CASE WHEN b = 0 THEN 0 ELSE (a - b) / b * 100 END, 6) AS delta_pct,
    CASE WHEN id IN ('tool_error', 'latency') THEN 'down' ELSE 'up' END AS good_if, round(coalesce(p, 1.0), 5) AS p_value,
    coalesce(p < 0.05 AND n1 >= 2 AND n2 >= 2, false) AS significant, CASE WHEN n1 IS NULL THEN 'insufficient_data' ELSE {VERDICT} END AS test, 0.05::DOUBLE AS significance_level
  FROM m LEFT JOIN mw USING (id)""")
def _(spark, sf):
    a = C.aspect_results(features(spark, sf, reuse=True), ASPECTS, digits=False)
    return a.withColumns({"before": r("before"), "after": r("after"), "delta_pct": r("delta_pct"), "p_value": r("p_value", 5)})


@add("e6_aspect_results_single", f"""WITH {LONG} SELECT id, {TITLE} AS name, round(avg(value), 6) AS value, count(value) = 0 AS no_data, 'down' AS good_if FROM long GROUP BY id""")
def _(spark, sf):
    fv = features(spark, sf).withColumn("cohort", F.lit("all"))
    a = C.aspect_results(fv, ASPECTS, comparative=False, digits=False)
    return a.select("id", "name", r("value").alias("value"), "no_data", "good_if")


@add("e7_aspect_profile", f"""WITH {LONG}, v AS (SELECT cohort, id, list(value ORDER BY value) FILTER (value IS NOT NULL) AS v, avg(value) AS mean, sum(value) AS sum,
    avg((value <> 0)::INT::DOUBLE) AS rate, count(value) AS count, count(*) AS n, median(value) AS p50 FROM long GROUP BY ALL)
  SELECT cohort, id, round(mean, 6) AS mean, round(sum, 5) AS sum, round(rate, 6) AS rate, count, n, round(p50, 6) AS p50,
    round((v[j] * (20 - (19 * (count + 1) - 20 * j)) + v[j + 1] * (19 * (count + 1) - 20 * j)) / 20, 6) AS p95
  FROM (SELECT *, greatest(least(19 * (count + 1) // 20, count - 1), 1) AS j FROM v)""")
def _(spark, sf):
    p = C.aspect_profile(features(spark, sf, reuse=True), ASPECTS)
    return p.withColumns({"sum": r("sum", 5), **{c: r(c) for c in ("mean", "rate", "p50", "p95")}})


@add("e9_mann_whitney", f"""WITH {LONG}, {MWU} SELECT id, n1::BIGINT AS n1, n2::BIGINT AS n2, u1, round(p, 5) AS p_value,
  p < 0.05 AS significant, {VERDICT} AS test FROM mw""")
def _(spark, sf):
    long = C.unpivot(C.aspect_values(features(spark, sf, reuse=True), ASPECTS), IDS)
    return mann_whitney(long, digits=None).withColumn("p_value", r("p_value", 5))


@add("e9_mann_whitney_lineitem", f"""WITH long AS (SELECT l_linestatus AS id, CASE l_returnflag WHEN 'A' THEN 'before' ELSE 'after' END AS cohort,
    l_extendedprice AS value FROM lineitem), {MWU}
  SELECT id, n1::BIGINT AS n1, n2::BIGINT AS n2, u1, round(p, 5) AS p_value, p < 0.05 AS significant, {VERDICT} AS test FROM mw""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("id"), F.when(F.col("l_returnflag") == "A", "before").otherwise("after").alias("cohort"),
        F.col("l_extendedprice").alias("value"))
    return mann_whitney(rows, digits=None).withColumn("p_value", r("p_value", 5))


@add("f9_average_ranks", """SELECT k, v, n, coalesce(sum(n) OVER (PARTITION BY k ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS avg_rank
  FROM (SELECT l_returnflag AS k, l_quantity AS v, count(*) AS n FROM lineitem GROUP BY ALL)""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("v"))
    return average_ranks(rows, "k", "v")


@add("d11_quantiles_lineitem", """WITH v AS (SELECT l_suppkey AS k, list(l_extendedprice ORDER BY l_extendedprice) AS v, count(*) AS n, median(l_extendedprice) AS p50 FROM lineitem GROUP BY 1)
  SELECT k, n, round(p50, 4) AS p50, round(CASE WHEN n = 1 THEN v[1] ELSE (v[j] * (20 - (19 * (n + 1) - 20 * j)) + v[j + 1] * (19 * (n + 1) - 20 * j)) / 20 END, 4) AS p95
  FROM (SELECT *, greatest(least(19 * (n + 1) // 20, n - 1), 1) AS j FROM v)""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_extendedprice").alias("v"))
    return quantiles(rows, ["k"], "v").withColumns({"p50": r("p50", 4), "p95": r("p95", 4)})


# ---- hypotheses

HYPS = [
    {"id": "h_long", "title": "Long", "predicate": {"op": "CMP", "name": "turn_count", "cmp": ">", "value": "median(turn_count)"}},
    {"id": "h_error", "title": "Error", "predicate": {"op": "AND", "args": [
        {"op": "CMP", "name": "tool_error_count", "cmp": ">=", "value": 2}, {"op": "CMP", "name": "transfer_count", "cmp": "==", "value": 0}]}},
    {"id": "h_rare", "predicate": {"op": "CMP", "name": "turn_count", "cmp": ">", "value": 1000}},
    {"id": "h_slow", "title": "Slow", "predicate": {"op": "BETWEEN", "name": "main_stream_latency_p95", "value": [30, 1000]}},
]
HYP_IDS = [h["id"] for h in HYPS]
HYP_SQL = {
    "h_long": "turn_count > (SELECT median(turn_count) FROM fv)",
    "h_error": "tool_error_count >= 2 AND NOT (transfer_completed OR session_outcome = 'transferred')",
    "h_rare": "turn_count > 1000", "h_slow": "main_stream_latency_p95 BETWEEN 30 AND 1000",
}
FLAGS = FV + ", flags AS (SELECT session_id, cohort, " + ", ".join(f"{x} AS hyp_{n}" for n, x in HYP_SQL.items()) + " FROM fv)"
RATES = FLAGS + ", rates AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS id, cohort, count(*) FILTER (hyp_{n}) AS support, count(*) AS size FROM flags GROUP BY cohort" for n in HYP_IDS) + ")"


def flagged(spark, sf):
    fv = features(spark, sf, reuse=True)
    med = {"turn_count": C.cohort_median(fv).scalar()}
    return hypothesis_flags(enrich(fv, med), HYPS, med)


@add("i11_enrich", f"""WITH {FV} SELECT session_id, (transfer_completed OR session_outcome = 'transferred')::INT::DOUBLE AS transfer_count,
  (session_outcome IN ('completed', 'payment_success', 'success'))::INT::DOUBLE AS payment_success, (session_outcome IN ('completed', 'payment_success', 'success'))::INT::DOUBLE AS payment_success_rate,
  tool_error_count::DOUBLE AS llm_error_count, interruption_count::DOUBLE AS interruption_count, guardrail_triggered::INT::DOUBLE AS guardrail_triggered,
  (SELECT median(turn_count) FROM fv)::DOUBLE AS median_turn_count FROM fv""")
def _(spark, sf):
    fv = features(spark, sf, reuse=True)
    e = enrich(fv, {"turn_count": C.cohort_median(fv).scalar()})
    return e.select("session_id", "transfer_count", "payment_success", "payment_success_rate", "llm_error_count",
                    "interruption_count", "guardrail_triggered", "median_turn_count")


@add("i12_hypothesis_flags", f"WITH {FLAGS} SELECT * FROM flags")
def _(spark, sf):
    return flagged(spark, sf).select("session_id", "cohort", *[f"hyp_{h}" for h in HYP_IDS])


@add("c8_cohort_matches", f"""WITH {FLAGS}, part AS (SELECT * FROM flags WHERE session_id NOT IN (SELECT session_id FROM fv WHERE transfer_completed)),
  j AS (SELECT f.cohort, s.* EXCLUDE (session_id, cohort) FROM flags f LEFT JOIN part s USING (session_id))
  SELECT id, cohort, support, size, round(support / size, 9) AS rate FROM (""" + " UNION ALL ".join(
    f"SELECT '{n}' AS id, cohort, count(*) FILTER (hyp_{n}) AS support, count(*) AS size FROM j GROUP BY cohort" for n in HYP_IDS) + ")")
def _(spark, sf):
    f = flagged(spark, sf)
    got = C.cohort_matches(f.select("session_id", "cohort"), f.where("NOT transfer_completed"), HYP_IDS)
    return got.withColumn("rate", r("rate", 9))


CHI = "(greatest(abs(b - nb * (b + a) / n) - 0.5, 0) ^ 2 * n * n * n / nullif(nb * na * (b + a) * (n - b - a), 0))"
WIDE = """w AS (SELECT id, max(support) FILTER (cohort = 'before')::DOUBLE AS b, max(size) FILTER (cohort = 'before')::DOUBLE AS nb,
    max(support) FILTER (cohort = 'after')::DOUBLE AS a, max(size) FILTER (cohort = 'after')::DOUBLE AS na, sum(size)::DOUBLE AS n FROM rates GROUP BY id)"""
TAIL = "least(1.0, " + ERFC + ")"


@add("e8_hypothesis_results", f"""WITH {RATES}, {WIDE}
  SELECT id, CASE id WHEN 'h_long' THEN 'Long' WHEN 'h_error' THEN 'Error' WHEN 'h_slow' THEN 'Slow' ELSE id END AS title, b::BIGINT AS before_support, nb::BIGINT AS before_size,
    round(b / nb, 9) AS before_rate, a::BIGINT AS after_support, na::BIGINT AS after_size, round(a / na, 9) AS after_rate, a + b < 30 AS rejected,
    round(coalesce({ERFC}, 1.0), 5) AS p_value, coalesce({ERFC} < 0.05, false) AS significant, CASE WHEN chi IS NULL THEN 'error' ELSE 'chi_square' END AS test
  FROM (SELECT *, 1.0 / (1.0 + 0.3275911 * x) AS t FROM (SELECT *, sqrt(chi / 2) AS x FROM (SELECT *, {CHI} AS chi FROM w)))""")
def _(spark, sf):
    f = flagged(spark, sf)
    h = C.hypothesis_results(f.select("session_id", "cohort"), f, HYPS, digits=False)
    return h.withColumns({"before_rate": r("before_rate", 9), "after_rate": r("after_rate", 9), "p_value": r("p_value", 5)})


@add("e8_hypothesis_results_single", f"""WITH {RATES} SELECT id, CASE id WHEN 'h_long' THEN 'Long' WHEN 'h_error' THEN 'Error' WHEN 'h_slow' THEN 'Slow' ELSE id END AS title,
  sum(support)::BIGINT AS support, round(sum(support) / sum(size), 9) AS rate, sum(support) < 30 OR sum(support) / sum(size) < 0.2 AS rejected FROM rates GROUP BY id""")
def _(spark, sf):
    f = flagged(spark, sf).withColumn("cohort", F.lit("all"))
    h = C.hypothesis_results(f.select("session_id", "cohort"), f, HYPS, comparative=False, min_rate=0.2)
    return h.withColumn("rate", r("rate", 9))


# one 2x2 table per order priority: orders with a high total, first half against second half of the years
TABLES = """t AS (SELECT o_orderpriority AS id, count(*) FILTER (o_totalprice > 250000 AND y)::DOUBLE AS b, count(*) FILTER (y)::DOUBLE AS nb,
    count(*) FILTER (o_totalprice > 250000 AND NOT y)::DOUBLE AS a, count(*) FILTER (NOT y)::DOUBLE AS na, count(*)::DOUBLE AS n
  FROM (SELECT *, year(o_orderdate) < 1996 AS y FROM orders) GROUP BY 1)"""


def _tables(spark, sf, *keys):
    y, big = F.year("o_orderdate") < 1996, F.col("o_totalprice") > 250000
    return table(spark, sf, "orders").groupBy(*keys).agg(
        F.count_if(big & y).alias("b"), F.count_if(y).alias("nb"), F.count_if(big & ~y).alias("a"), F.count_if(~y).alias("na"))


@add("e10_chi_square", f"""WITH {TABLES} SELECT id, round({ERFC}, 6) AS p_value
  FROM (SELECT *, 1.0 / (1.0 + 0.3275911 * x) AS t FROM (SELECT *, sqrt({CHI} / 2) AS x FROM t))""")
def _(spark, sf):
    t = _tables(spark, sf, F.col("o_orderpriority").alias("id"))
    b, nb, a, na = (F.col(c) for c in ("b", "nb", "a", "na"))
    return t.select("id", r(chi_square(b, nb, a, na)).alias("p_value"))


def fisher_sql(t: str) -> str:
    """CTEs up to fp (id, p): the exact test for rows of ``t`` with a side below 5."""
    return f"""fk AS (SELECT *, unnest(range(0, nb::BIGINT + 1)) AS k, a + b AS m FROM {t} WHERE nb < 5 OR na < 5),
  fw AS (SELECT id, b, k, exp(lgamma(nb + 1) - lgamma(k + 1) - lgamma(nb - k + 1) + lgamma(na + 1) - lgamma(m - k + 1) - lgamma(na - m + k + 1)
      - lgamma(nb + na + 1) + lgamma(m + 1) + lgamma(nb + na - m + 1)) AS w FROM fk WHERE k <= m AND m - k <= na),
  fp AS (SELECT id, least(1.0, sum(w) FILTER (w <= seen * (1 + 1e-7)) / sum(w)) AS p
    FROM fw JOIN (SELECT id, w AS seen FROM fw WHERE k = b) USING (id) GROUP BY id)"""


# customers, many with few orders on one side
FISHER = """ft AS (SELECT o_custkey AS id, count(*) FILTER (o_totalprice > 250000 AND y) AS b, count(*) FILTER (y) AS nb,
    count(*) FILTER (o_totalprice > 250000 AND NOT y) AS a, count(*) FILTER (NOT y) AS na
  FROM (SELECT *, year(o_orderdate) < 1996 AS y FROM orders) GROUP BY 1), """ + fisher_sql("ft")


@add("e11_fisher", f"WITH {FISHER} SELECT id, round(p, 6) AS p_value FROM fp")
def _(spark, sf):
    t = _tables(spark, sf, F.col("o_custkey").alias("id")).where("nb < 5 OR na < 5")
    b, nb, a, na = (F.col(c) for c in ("b", "nb", "a", "na"))
    return t.select("id", r(fisher(b, nb, a, na)).alias("p_value"))


@add("e10_e11_rate_test", f"""WITH {FISHER},
  cp AS (SELECT id, {ERFC} AS p FROM (SELECT *, 1.0 / (1.0 + 0.3275911 * x) AS t FROM (SELECT *, sqrt({CHI} / 2) AS x FROM
    (SELECT id, b::DOUBLE AS b, nb::DOUBLE AS nb, a::DOUBLE AS a, na::DOUBLE AS na, (nb + na)::DOUBLE AS n FROM ft WHERE nb >= 5 AND na >= 5))))
  SELECT id, round(p, 6) AS p_value, p < 0.05 AS significant, 'fisher' AS test FROM fp
  UNION ALL SELECT id, round(coalesce(p, 1.0), 6), coalesce(p < 0.05, false), CASE WHEN p IS NULL THEN 'error' ELSE 'chi_square' END FROM cp""")
def _(spark, sf):
    t = _tables(spark, sf, F.col("o_custkey").alias("id"))
    b, nb, a, na = (F.col(c) for c in ("b", "nb", "a", "na"))
    return t.select("id", *rate_test(b, nb, a, na, 0.05, None)).withColumn("p_value", r("p_value"))


Z = """(SELECT *, abs(coalesce(a / nullif(na, 0), 0) - coalesce(b / nullif(nb, 0), 0)) / nullif(sqrt((a + b) / n * (1 - (a + b) / n) * (1 / nullif(nb, 0) + 1 / nullif(na, 0))), 0) / sqrt(2.0) AS x FROM {t})"""


@add("e12_z_test", f"""WITH {TABLES} SELECT id, round(least(1.0, {ERFC}), 6) AS p_value
  FROM (SELECT *, 1.0 / (1.0 + 0.3275911 * x) AS t FROM {Z.format(t='t')})""")
def _(spark, sf):
    t = _tables(spark, sf, F.col("o_orderpriority").alias("id"))
    b, nb, a, na = (F.col(c) for c in ("b", "nb", "a", "na"))
    return t.select("id", r(z_test(b, nb, a, na)).alias("p_value"))


SIMPLE = f"""{EV}, mm AS (SELECT session_id, min(cohort) AS cohort, count(*) FILTER (event_type = 'USER_QUERY') >= 3
    AND count(*) FILTER (event_type = 'TOOL_CALL_RESULT' AND error IS NOT NULL) = 0 AS matched FROM ev GROUP BY session_id)"""


@add("e13_evaluate_simple", f"""WITH {SIMPLE}, q AS (SELECT count(*) FILTER (matched AND cohort = 'before')::DOUBLE AS b, count(*) FILTER (cohort = 'before')::DOUBLE AS nb,
    count(*) FILTER (matched AND cohort = 'after')::DOUBLE AS a, count(*) FILTER (cohort = 'after')::DOUBLE AS na, count(*)::DOUBLE AS n FROM mm)
  SELECT b::BIGINT AS support_before, a::BIGINT AS support_after, round(b * 100 / nb, 6) AS rate_before, round(a * 100 / na, 6) AS rate_after,
    round(least(1.0, {ERFC}), 6) AS p_value, {ERFC} < 0.05 AND a + b >= 30 AS significant, a + b < 30 AS rejected, 30 AS min_support, 'cohort_delta' AS metric
  FROM (SELECT *, 1.0 / (1.0 + 0.3275911 * x) AS t FROM {Z.format(t='q')})""")
def _(spark, sf):
    ev = events(spark, sf)
    m = P.simple_flags(ev, min_turn_count=3, requires_tool_error=False)
    cohort = ev.groupBy("session_id").agg(F.min("cohort").alias("cohort"))
    out = C.evaluate_simple(cohort, m, digits=False)
    return out.withColumns({c: r(c) for c in ("rate_before", "rate_after", "p_value")})


@add("e13_evaluate_simple_discovery", f"""WITH {SIMPLE} SELECT count(*) FILTER (matched) AS support_count, round(count(*) FILTER (matched) * 100.0 / count(*), 6) AS match_rate,
  count(*) FILTER (matched) < 30 AS rejected, 30 AS min_support, 'match_rate' AS metric FROM mm""")
def _(spark, sf):
    ev = events(spark, sf)
    m = P.simple_flags(ev, min_turn_count=3, requires_tool_error=False)
    out = C.evaluate_simple(ev.select("session_id").distinct(), m, comparative=False, digits=False)
    return out.withColumn("match_rate", r("match_rate"))


@add("e14_cohort_median", f"WITH {FV} SELECT median(turn_count)::DOUBLE AS median_turn_count FROM fv")
def _(spark, sf):
    return C.cohort_median(features(spark, sf, reuse=True))


@add("e19_timing_rollup", """SELECT event_type || ':' || (user_id % 5) AS component, round_even(sum(value::DECIMAL(18, 4))::DOUBLE, 2) AS duration_ms FROM events GROUP BY 1""")
def _(spark, sf):
    log = table(spark, sf, "events").select(
        F.col("event_type").alias("phase"), (F.col("user_id") % 5).cast("string").alias("component"), F.col("value").alias("duration_ms"))
    return C.timing_rollup(log)


@add("e20_cohort_stats", f"""WITH {FV} SELECT coalesce(cohort, 'total') AS cohort, count(*) AS raw_count, count(*) FILTER (turn_count >= 3) AS filtered_count
  FROM fv GROUP BY GROUPING SETS ((cohort), ())""")
def _(spark, sf):
    fv = features(spark, sf, reuse=True)
    return C.cohort_stats(fv.select("session_id", "cohort"), fv.where("turn_count >= 3"))


# ---- tables and plot data

@add("a10_per_conversation", f"WITH {FLAGS} SELECT f.session_id, f.cohort, turn_count, session_outcome, hyp_h_long AS h_long, hyp_h_error AS h_error FROM flags f JOIN fv USING (session_id)")
def _(spark, sf):
    rows = A.per_conversation(flagged(spark, sf), HYP_IDS)
    return rows.select("session_id", "cohort", "values.turn_count", "values.session_outcome", "hypotheses.h_long", "hypotheses.h_error")


@add("a11_aspect_table", f"""WITH {LONG}, {MWU}, m AS (SELECT id, coalesce(avg(value) FILTER (cohort = 'before'), 0) AS b, coalesce(avg(value) FILTER (cohort = 'after'), 0) AS a FROM long GROUP BY id)
  SELECT id AS aspect_id, {TITLE} AS name, round(b, 6) AS "before", round(a, 6) AS "after", round(CASE WHEN b = 0 THEN 0 ELSE (a - b) / b * 100 END, 6) AS delta_pct,
    round(coalesce(p, 1.0), 5) AS p_value, coalesce(p < 0.05 AND n1 >= 2 AND n2 >= 2, false) AS significant FROM m LEFT JOIN mw USING (id)""")
def _(spark, sf):
    t = A.aspect_table(C.aspect_results(features(spark, sf, reuse=True), ASPECTS, digits=False))
    return t.withColumns({"before": r("before"), "after": r("after"), "delta_pct": r("delta_pct"), "p_value": r("p_value", 5)})


@add("a12_hypothesis_table", f"""WITH {RATES}, {WIDE} SELECT id AS hypothesis_id, CASE id WHEN 'h_long' THEN 'Long' WHEN 'h_error' THEN 'Error' WHEN 'h_slow' THEN 'Slow' ELSE id END AS title,
    b::BIGINT AS before_support, round_even(b / nb, 4) AS before_rate, a::BIGINT AS after_support, round_even(a / na, 4) AS after_rate, a + b < 30 AS rejected, round_even(coalesce({ERFC}, 1.0), 4) AS p_value
  FROM (SELECT *, 1.0 / (1.0 + 0.3275911 * x) AS t FROM (SELECT *, sqrt(chi / 2) AS x FROM (SELECT *, {CHI} AS chi FROM w)))""")
def _(spark, sf):
    f = flagged(spark, sf)
    return A.hypothesis_table(C.hypothesis_results(f.select("session_id", "cohort"), f, HYPS))


@add("a13_cohort_overview", f"""WITH {FV}, st AS (SELECT session_id, min(us) AS us FROM ev GROUP BY 1)
  SELECT cohort, count(*) AS candidates, count(*) FILTER (turn_count >= 3) AS after_filters, min(us) AS first_us, max(us) AS last_us FROM fv JOIN st USING (session_id) GROUP BY cohort""")
def _(spark, sf):
    start = events(spark, sf).groupBy("session_id").agg(F.min("timestamp").alias("start_time"))
    fv = features(spark, sf).withColumn("passed", F.col("turn_count") >= 3).join(start, "session_id")
    o = A.cohort_overview(fv)
    return o.select("cohort", "candidates", "after_filters", F.unix_micros("first_start").alias("first_us"), F.unix_micros("last_start").alias("last_us"))


@add("a15_histogram", f"""WITH {FV}, x AS (SELECT avg_tool_latency_ms AS v, min(avg_tool_latency_ms) OVER () AS lo, max(avg_tool_latency_ms) OVER () AS hi FROM fv)
  SELECT CAST(least(floor((v - lo) / ((hi - lo) / 30)), 29) AS BIGINT) AS bin, count(*) AS n FROM x GROUP BY 1""")
def _(spark, sf):
    return A.histogram(features(spark, sf, reuse=True), "avg_tool_latency_ms").select("bin", "n")


@add("a16_aspect_plot_data", f"""WITH {LONG}, m AS (SELECT id, coalesce(avg(value) FILTER (cohort = 'before'), 0) AS b, coalesce(avg(value) FILTER (cohort = 'after'), 0) AS a FROM long GROUP BY id)
  SELECT {TITLE} AS label, round(b, 6) AS "before", round(a, 6) AS "after", round(CASE WHEN b = 0 THEN 0 ELSE (a - b) / b * 100 END, 6) AS delta_pct FROM m""")
def _(spark, sf):
    d = A.aspect_plot_data(C.aspect_results(features(spark, sf, reuse=True), ASPECTS, digits=False))
    return d.withColumns({c: r(c) for c in ("before", "after", "delta_pct")})


@add("a16_hypothesis_plot_data", f"""WITH {RATES}, {WIDE} SELECT CASE id WHEN 'h_long' THEN 'Long' WHEN 'h_error' THEN 'Error' WHEN 'h_slow' THEN 'Slow' ELSE id END AS label,
  round(b / nb * 100, 6) AS before_rate_pct, round(a / na * 100, 6) AS after_rate_pct FROM w""")
def _(spark, sf):
    f = flagged(spark, sf)
    d = A.hypothesis_plot_data(C.hypothesis_results(f.select("session_id", "cohort"), f, HYPS))
    return d.withColumns({c: r(c) for c in ("before_rate_pct", "after_rate_pct")})
