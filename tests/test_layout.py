"""The log stored by session: same results, and no exchange of events."""

import re

import pytest
from pyspark.sql import functions as F

from parley.functions.events import complete
from parley.operators import eventlog, primitives as P, scope
from parley.sources.layout import read_log, write_log
from workload.binding import price

KINDS = ["USER_QUERY", "RESPONSE.FINAL", "SESSION_END", "LLM_INVOCATION_SUCCESS"]
ROWS = [(i, "big" if i % 3 else f"s{i % 14}", KINDS[i % 4], 1000 + i * 7 % 400, f"t{i}") for i in range(300)] + [(900, None, "USER_QUERY", 5, "lost")]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    df = spark.createDataFrame(ROWS, "event_id long, session_id string, event_type string, s long, content string")
    ev = complete(df.withColumn("timestamp", F.timestamp_seconds("s")).drop("s"))
    path = str(tmp_path_factory.mktemp("log")) + "/log"
    write_log(ev, path, 4, limit=50)
    return ev, path


def rows(df, *columns):
    return sorted(map(str, df.select(*columns or sorted(df.columns)).collect()))


def test_measures_are_those_of_the_plain_log(spark, stored):
    ev, path = stored
    log = read_log(spark, path, 4)
    assert rows(log.events, "event_id", "session_id", "content") == rows(ev, "event_id", "session_id", "content")
    assert {r.session_id for r in log.large.select("session_id").distinct().collect()} == {"big", None}
    known = ev.where("session_id IS NOT NULL")
    made = log.primitives(price(spark)).where("session_id IS NOT NULL")
    assert rows(made) == rows(P.primitives(known, price(spark)).select(*made.columns))
    ids = spark.createDataFrame([("s0",), ("big",), ("absent",)], "session_id string")
    assert rows(log.per_session(lambda e: P.session_rollup(scope.events_for(e, ids)))) == rows(P.session_rollup(scope.events_for(ev, ids)))
    # another session finds the buckets by their path
    spark.sql(f"DROP TABLE {read_log.__globals__['_name'](path)}")
    assert rows(read_log(spark, path, 4).ordinary, "event_id") == rows(ev.where("session_id <> 'big'"), "event_id")


def exchanges_above_events(df):
    """Exchanges of the plan whose input is the event scan."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(re.match(r"[\s:+|*\-]*", line)[0])
    found = []
    for k, line in enumerate(lines):
        if re.search(r"\bExchange\b", line):
            inside = []
            for below in lines[k + 1:]:
                if depth(below) <= depth(line):
                    break
                inside.append(below)
            if any("FileScan parquet" in x and "parley_log" in x for x in inside):
                found.append(line)
    return found


def test_work_per_session_exchanges_no_events(spark, stored, monkeypatch):
    ev, path = stored
    ordinary = read_log(spark, path, 4).ordinary
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ids = spark.range(9).select(F.concat(F.lit("s"), F.col("id")).alias("session_id"))
        none = P.LargeKeys(ids.limit(0), 0, 0, 10**6)
        mine = scope.events_for(ordinary, ids)
        for made in (mine, P.session_rollup(ordinary), P.session_rollup(mine), eventlog.fingerprint(ordinary), eventlog.event_counts(ordinary),
                     eventlog.dedupe_session_end(mine)):
            assert exchanges_above_events(made) == []
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")  # prices are few and go to every task
        assert exchanges_above_events(P.primitives(ordinary, price(spark), large=none)) == []
        assert len(exchanges_above_events(ordinary.groupBy("event_type").count())) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
