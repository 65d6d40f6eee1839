"""Scalar functions on the tables they are used for."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import events as E
from parley.functions.numbers import erfc, rounded, to_number
from parley.functions.predicates import MS_PER_MINUTE
from parley.functions.text import has_text, matches, strip
from workload.binding import EV, events, table
from workload.registry import add, joined, r

BLANK = "chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)"


@add("k3_text_slices", f"""SELECT doc_id, contains(lower(text), 'the') AS has_the, substr(lower(text), 1, 40) AS head, length(trim(text, {BLANK})) AS n FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", has_text(F.col("text"), "THE").alias("has_the"), F.substring(F.lower("text"), 1, 40).alias("head"),
        F.length(strip(F.col("text"))).cast("long").alias("n"))


@add("k4_join_strings", "SELECT doc_id, concat_ws('→', lang, source, n_chars) AS s FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat_ws("→", "lang", "source", F.col("n_chars").cast("string")).alias("s"))


@add("k5_regex_search", "SELECT p_partkey, regexp_matches(p_type, '(steel|brass)$', 'i') AS hit FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", matches(F.col("p_type"), "(steel|brass)$").alias("hit"))


@add("k6_parse_time", """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN epoch_us(ts) END AS us FROM events""")
def _(spark, sf):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    bad = F.when(F.col("event_id") % 3 == 0, F.lit("not a time")).otherwise(text)
    return table(spark, sf, "events").select("event_id", F.unix_micros(E.parse_time(bad)).alias("us"))


@add("k7_time_difference", f"""WITH {EV} SELECT session_id, CAST(trunc((min(us) FILTER (event_type = 'USER_QUERY') - max(us)) / 1000.0) AS BIGINT) AS ms,
  round((max(us) - min(us)) / 60000000.0, 9) AS minutes FROM ev GROUP BY session_id""")
def _(spark, sf):
    us = E.micros(F.col("timestamp"))
    return events(spark, sf).groupBy("session_id").agg(
        E.ms_between(F.max(us), F.min(F.when(E.of_type(E.USER_QUERY), us))).alias("ms"),
        r((F.max(us) - F.min(us)) / 60_000_000.0, 9).alias("minutes"))


@add("k8_minutes_to_ms", "SELECT event_id, value * 60000.0 AS ms FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", (F.col("value") * float(MS_PER_MINUTE)).alias("ms"))


@add("k9_rounding", """SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 4, 0) AS q, floor(l_quantity / 4)::BIGINT AS f, ceil(l_quantity / 4)::BIGINT AS c,
  round(sqrt(l_extendedprice), 6) AS s, round(((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-l_discount * l_discount), 6) AS e
  FROM (SELECT *, 1.0 / (1.0 + 0.3275911 * l_discount) AS t FROM lineitem)""")
def _(spark, sf):
    q = F.col("l_quantity") / 4
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", rounded(q, 0).alias("q"), F.floor(q).alias("f"), F.ceil(q).alias("c"),
        r(F.sqrt("l_extendedprice")).alias("s"), r(erfc(F.col("l_discount"))).alias("e"))


@add("k10_to_number", "SELECT doc_id, (quality = 1)::INT::DOUBLE AS b, toxic::DOUBLE AS n, NULL::DOUBLE AS t FROM labels")
def _(spark, sf):
    d = table(spark, sf, "labels").withColumns({"b": F.col("quality") == 1, "t": F.lit("x")})
    types = {f.name: f.dataType for f in d.schema.fields}
    return d.select("doc_id", to_number(F.col("b"), types["b"]).alias("b"), to_number(F.col("toxic"), types["toxic"]).alias("n"),
                    to_number(F.col("t"), types["t"]).alias("t"))


@add("k11_json", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k, '{\"k\":' || regexp_extract(props, '([0-9]+)', 1) || '}' AS js FROM events")
def _(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", E.field(ev, "k", "double", "props").alias("k"), F.to_json(F.parse_json("props")).alias("js"))


@add("k12_arrays", """WITH a AS (SELECT o_custkey, o_orderpriority AS p FROM orders)
  SELECT o_custkey, string_agg(DISTINCT p, '|' ORDER BY p) AS names, bool_or(p = '1-URGENT') AS urgent, coalesce(string_agg(DISTINCT p, '|' ORDER BY p) FILTER (p < '3'), '') AS top FROM a GROUP BY o_custkey""")
def _(spark, sf):
    got = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("p"))
    return got.select("o_custkey", joined("p").alias("names"), F.exists("p", lambda x: x == "1-URGENT").alias("urgent"),
                      joined(F.filter("p", lambda x: x < "3")).alias("top"))
