"""Per-session measures: one row per session, from one grouped aggregation.

Nearly all measures combine on the map side, so a session of any size reaches
the shuffle as one row per task. The two that need their inputs in order, the
latency p95 and the agent path, collect them into an array for sessions of up
to ``SESSION_ROWS`` events; larger sessions take the sliced operators instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from parley.functions import events as E
from parley.functions.numbers import exclusive_p95, rounded
from parley.functions.text import filled, strip
from parley.operators.ordering import PART_ROWS, LargeKeys, collect_parts, large_keys, quantiles, with_position
from parley.operators.pricing import with_price

SESSION_ROWS = 100_000

# The purposes measured, and the bucket limits.
PURPOSES = ["main_stream", "contextual_query", "router"]
MAIN = "main_stream"
SHORT_TURNS, MEDIUM_TURNS = 4, 10
OUTCOMES = ["transferred", "timeout", "completed"]
GREETING, GREETING_CHARS = "welcome", 40

# The keys that may hold a name of each kind.
HIT_KEYS = {
    "skills": ["skill_name", "skill", "skill_id"],
    "tools": ["tool_name", "tool", "tool_id"],
    "agent_names": ["agent_name"],
    "nodes": ["node_name", "node", "dialog_node"],
    "purposes": ["purpose"],
    "event_types": ["event_type"],
}


def count_of(*types: str) -> Column:
    return F.count_if(E.of_type(*types))


def any_of(test: Column) -> Column:
    return F.coalesce(F.bool_or(test), F.lit(False))


def first_of(value: Column, test: Column) -> Column:
    return F.min_by(value, F.when(test, E.event_order()))


def last_of(value: Column, test: Column) -> Column:
    return F.max_by(value, F.when(test, E.event_order()))


# ---- combinable measures ------------------------------------------------------

def session_duration_ms() -> Column:
    us = E.micros(F.col("timestamp"))
    return F.coalesce(F.floor((F.max(us) - F.min(us)) / 1000), F.lit(0)).cast("long")


def session_outcome() -> Column:
    status = F.lower(F.coalesce(filled(F.col("status")), F.col("end_reason")))
    ended = first_of(status, E.of_type(E.SESSION_END) & (status != ""))
    return (
        F.when(any_of(E.of_type(E.TRANSFER)), "transferred")
        .when(F.contains(ended, F.lit("timeout")), "timeout")
        .when(ended.isNotNull(), ended)
        .when(any_of(E.of_type(E.METRICS)), "completed")
        .otherwise("unknown")
    )


def outcome_bucket(outcome: Column) -> Column:
    return F.when(outcome.isin(OUTCOMES), outcome).otherwise("other")


def length_bucket(turn_count: Column) -> Column:
    return (F.when(turn_count <= SHORT_TURNS, "short")
            .when(turn_count <= MEDIUM_TURNS, "medium").otherwise("long"))


def guardrail_triggered() -> Column:
    flagged = F.coalesce(F.size("flagged_categories") > 0, F.lit(False))
    blocked = F.coalesce(F.col("would_block"), F.lit(False))
    return any_of(E.of_type(E.GUARDRAIL) & (blocked | flagged))


def main_stream_model() -> Column:
    main = F.col("purpose") == MAIN
    configured = last_of(F.col("final_model_id"), E.of_type(E.LLM_CONFIG) & main)
    invoked = last_of(F.col("model_id"), E.of_type(E.LLM_SUCCESS) & main)
    return F.coalesce(filled(configured), invoked)


def main_stream_model_invoked() -> Column:
    return last_of(F.col("model_id"), E.of_type(E.LLM_SUCCESS) & (F.col("purpose") == MAIN))


def estimated_cost_usd(purpose: str) -> Column:
    cost = (F.coalesce("input_tokens", F.lit(0)) * F.col("input_rate")
            + F.coalesce("output_tokens", F.lit(0)) * F.col("output_rate"))
    return F.coalesce(F.sum(F.when(E.of_type(E.TOKENS) & (F.col("purpose") == purpose), cost)), F.lit(0.0))


def tokens_sum(purpose: str, side: str) -> Column:
    used = E.of_type(E.TOKENS) & (F.col("purpose") == purpose)
    return F.coalesce(F.sum(F.when(used, F.col(f"{side}_tokens"))), F.lit(0))


def avg_tool_latency_ms() -> Column:
    timed = E.of_type(E.TOOL_RESULT) & (F.col("latency") != 0)
    return F.coalesce(F.avg(F.when(timed, F.col("latency"))), F.lit(0.0))


def traffic_split_variant() -> Column:
    return first_of(F.col("selected_variant_key"), E.of_type(E.CANARY))


def hits(keys: list[str]) -> Column:
    """Sorted distinct non-empty names under any of ``keys``."""
    names = F.flatten(F.collect_set(F.array_compact(F.array(*[filled(F.col(k)) for k in keys]))))
    return F.sort_array(F.array_distinct(names))


def structured_hits() -> Column:
    return F.struct(*[hits(keys).alias(kind) for kind, keys in HIT_KEYS.items()])


def opening_text() -> Column:
    said = strip(F.col("content"))
    query = E.of_type(E.USER_QUERY)
    greets = F.contains(F.substring(F.lower(said), 1, GREETING_CHARS), F.lit(GREETING))
    real = first_of(said, query & (said != "") & ~greets)
    return F.coalesce(real, first_of(F.col("content"), query & (F.col("content") != "")), F.lit(""))


def agent_ever(name: str) -> Column:
    return any_of(E.of_type(E.RESPONSE_FINAL) & (F.lower("agent_name") == name.lower()))


def measures(cost_digits: int | None = 6, ms_digits: int | None = 2) -> dict[str, Column]:
    """Every measure that is a combining aggregate."""
    out = {
        "turn_count": count_of(E.USER_QUERY),
        "session_duration_ms": session_duration_ms(),
        "session_outcome": session_outcome(),
        "main_stream_model": main_stream_model(),
        "main_stream_model_invoked": main_stream_model_invoked(),
        "tool_invocation_count": count_of(E.TOOL_INVOKED, E.TOOL_RESULT),
        "tool_error_count": count_of(E.TOOL_ERROR),
        "tool_result_error_count": F.count_if(E.of_type(E.TOOL_RESULT) & F.col("error").isNotNull()),
        "avg_tool_latency_ms": rounded(avg_tool_latency_ms(), ms_digits),
        "transfer_completed": any_of(E.of_type(E.TRANSFER)),
        "guardrail_triggered": guardrail_triggered(),
        "interruption_count": count_of(E.INTERRUPTION),
        "traffic_split_variant": traffic_split_variant(),
        "structured_hits": structured_hits(),
        "opening_text": opening_text(),
    }
    for p in PURPOSES:
        out[f"{p}_estimated_cost_usd"] = rounded(estimated_cost_usd(p), cost_digits)
        for side in ("input", "output"):
            out[f"{p}_{side}_tokens_sum"] = tokens_sum(p, side)
    return out


# ---- measures over ordered values ----------------------------------------------

def _timed_call(purpose: str) -> Column:
    return E.of_type(E.LLM_SUCCESS) & (F.col("purpose") == purpose) & (F.col("latency_ms") != 0)


def _p95_collected(purpose: str) -> Column:
    got = F.collect_list(F.when(_timed_call(purpose), F.col("latency_ms")))
    return F.coalesce(exclusive_p95(F.sort_array(got)), F.lit(0.0))


def _named_response() -> Column:
    return E.of_type(E.RESPONSE_FINAL) & filled(F.col("agent_name")).isNotNull()


def _path_collected() -> Column:
    steps = F.collect_list(F.when(_named_response(), F.struct(E.event_order().alias("o"), F.col("agent_name"))))
    names = F.transform(F.sort_array(steps), lambda s: s.agent_name)
    kept = F.filter(names, lambda x, i: (i == 0) | (x != F.get(names, i - 1)))
    return F.array_join(kept, "→")


def latency_p95(ev: DataFrame, purpose: str) -> DataFrame:
    """(session_id, p95) for sessions of any size."""
    return quantiles(ev.where(_timed_call(purpose)), ["session_id"], "latency_ms").select("session_id", "p95")


def agent_changes(ev: DataFrame) -> DataFrame:
    """(session_id, pos, agent_name): responses whose agent differs from the one before."""
    said = with_position(
        ev.where(_named_response()).select("session_id", "timestamp", "event_id", "agent_name"),
        ["session_id"], ["timestamp", "event_id"])
    before = said.select("session_id", (F.col("pos") + 1).alias("pos"), F.col("agent_name").alias("_prev"))
    return (
        said.join(before, ["session_id", "pos"], "left")
        .where(F.col("_prev").isNull() | (F.col("_prev") != F.col("agent_name")))
        .select("session_id", "pos", "agent_name")
    )


def _split(ev: DataFrame, ms_digits: int | None, cost_digits: int | None) -> DataFrame:
    """The measures of very large sessions, ordered parts by slices."""
    out = ev.groupBy("session_id").agg(*[c.alias(n) for n, c in measures(cost_digits, ms_digits).items()])
    for p in PURPOSES:
        p95 = latency_p95(ev, p).withColumnRenamed("p95", "_p95")
        out = out.join(p95, "session_id", "left").withColumn(
            f"{p}_latency_p95", rounded(F.coalesce("_p95", F.lit(0.0)), ms_digits)).drop("_p95")
    path = agent_changes(ev).groupBy("session_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "agent_name"))),
                                 lambda s: s.agent_name), "→").alias("agent_path"))
    return out.join(path, "session_id", "left").withColumn("agent_path", F.coalesce("agent_path", F.lit("")))


def _whole(ev: DataFrame, ms_digits: int | None, cost_digits: int | None) -> DataFrame:
    cols = measures(cost_digits, ms_digits)
    for p in PURPOSES:
        cols[f"{p}_latency_p95"] = rounded(_p95_collected(p), ms_digits)
    cols["agent_path"] = _path_collected()
    return ev.groupBy("session_id").agg(*[c.alias(n) for n, c in cols.items()])


def primitives(ev: DataFrame, price: DataFrame, ms_digits: int | None = 2,
               cost_digits: int | None = 6, limit: int = SESSION_ROWS,
               large: LargeKeys | None = None) -> DataFrame:
    """The feature row of every session in ``ev``.

    Intent columns start as unknown; ``classify_intent`` and ``embed`` fill in
    theirs. The session text is its own table, see ``session_text``.
    """
    if large is None:
        large = large_keys(ev, ["session_id"], limit)
    ev = with_price(E.complete(ev), price)
    if large.n == 0:
        fv = _whole(ev, ms_digits, cost_digits)
    else:
        cold, hot = large.split(ev)
        fv = _whole(cold, ms_digits, cost_digits).unionByName(_split(hot, ms_digits, cost_digits))
    return fv.withColumns({
        "outcome_bucket": outcome_bucket(F.col("session_outcome")),
        "length_bucket": length_bucket(F.col("turn_count")),
        "opening_intent_class": F.lit("unknown"),
        "opening_intent_score": F.lit(0.0),
    })


def primitive(ev: DataFrame, name: str, types: list[str], reducer: str,
              field: str | None = None, where: Column | None = None,
              types_to: list[str] | None = None) -> DataFrame:
    """(session_id, name): one measure from the reducer grammar.

    Sessions without a matching event are absent, as there is nothing to reduce.
    """
    end_types = types_to or types
    test = E.of_type(*types) if where is None else E.of_type(*types) & where
    us = E.micros(F.col("timestamp"))
    if reducer == "time_diff":
        # first event of one kind to last event of the other, in milliseconds
        gap = E.ms_between(F.min(F.when(test, us)), F.max(F.when(E.of_type(*end_types), us)))
        return ev.groupBy("session_id").agg(gap.alias(name))
    rows = ev.where(test)
    if field and field not in ev.columns:
        number = reducer in ("sum", "mean", "max", "min", "p50", "p95")
        rows = rows.withColumn(field, E.event_key(ev, field, "double" if number else "string"))
    if reducer in ("p50", "p95"):
        return quantiles(rows, ["session_id"], field).select("session_id", F.col(reducer).alias(name))
    value = F.col(field) if field else F.lit(1)
    reduce_with = {
        "count": lambda: F.count("*"),
        "exists": lambda: F.count("*") > 0,
        "sum": lambda: F.sum(value),
        "mean": lambda: F.avg(value),
        "max": lambda: F.max(value),
        "min": lambda: F.min(value),
        "distinct_count": lambda: F.count_distinct(value),
        "first": lambda: F.min_by(value, E.event_order()),
        "last": lambda: F.max_by(value, E.event_order()),
    }[reducer]
    return rows.groupBy("session_id").agg(reduce_with().alias(name))


def session_rollup(ev: DataFrame, by: list[str] | None = None) -> DataFrame:
    """First and last time, turns and tool totals per session, in one pass."""
    tool = E.of_type(E.TOOL_RESULT)
    return ev.groupBy(*(by or []), "session_id").agg(
        F.min(E.micros(F.col("timestamp"))).alias("first_us"),
        F.max(E.micros(F.col("timestamp"))).alias("last_us"),
        count_of(E.USER_QUERY).alias("turn_count"),
        count_of(E.TOOL_RESULT).alias("tool_count"),
        F.count_if(tool & F.col("error").isNotNull()).alias("tool_error_count"),
        F.coalesce(F.sum(F.when(tool, F.col("latency"))), F.lit(0.0)).alias("tool_latency_sum"),
    )


def session_queries(ev: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(session_id, part, turn_count, has_tool_error, queries[]).

    A session has one part unless it holds more queries than one array should.
    """
    base = ev.groupBy("session_id").agg(
        count_of(E.USER_QUERY).alias("turn_count"),
        any_of(E.of_type(E.TOOL_RESULT) & F.col("error").isNotNull()).alias("has_tool_error"))
    said = collect_parts(ev.where(E.of_type(E.USER_QUERY) & F.col("content").isNotNull()), ["session_id"],
                         ["timestamp", "event_id"], F.col("content"), "queries", part_rows)
    return base.join(said, "session_id", "left").withColumns({
        "part": F.coalesce("part", F.lit(0)),
        "queries": F.coalesce("queries", F.array().cast("array<string>")),
    })


def simple_flags(ev: DataFrame, min_turn_count: int | None = None,
                 requires_tool_error: bool | None = None, keyword: str | None = None) -> DataFrame:
    """(session_id, matched): the three optional tests over a session's events.

    The keyword must occur in some user query; it is tested event by event, so
    the queries are never gathered.
    """
    said = F.contains(F.lower("content"), F.lit((keyword or "").lower()))
    tests = [F.lit(True)]
    if min_turn_count is not None:
        tests.append(count_of(E.USER_QUERY) >= int(min_turn_count))
    if requires_tool_error is not None:
        failed = any_of(E.of_type(E.TOOL_RESULT) & F.col("error").isNotNull())
        tests.append(failed if requires_tool_error else ~failed)
    if keyword:
        tests.append(any_of(E.of_type(E.USER_QUERY) & said))
    return ev.groupBy("session_id").agg(reduce(Column.__and__, tests).alias("matched"))
