"""Proposal-table steps on orders, line items and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import proposals as L
from workload.binding import table
from workload.registry import add, joined

RANKS = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3, "5-LOW": 4}


@add("l1_best_per_key", "SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return L.best_per_key(o, "o_custkey", "o_orderpriority", "o_orderkey", RANKS)


@add("l2_first_per_title", """SELECT doc_id FROM (SELECT doc_id, t, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS rn FROM
  (SELECT doc_id, lower(trim(text, chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11))) AS t FROM documents)) WHERE rn = 1 OR t = ''""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("title"))
    return L.first_per_title(d, "title", "doc_id").select("doc_id")


def _evidence(spark, sf):
    """A line item as a proposal with three pieces of evidence, the last one empty."""
    s, q = F.concat(F.lit("s"), (F.col("l_suppkey") % 7).cast("string")), F.concat(F.lit("q"), F.col("l_quantity").cast("int").cast("string"))
    finding = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("f"), (F.col("l_partkey") % 40).cast("string")))
    none = F.lit(None).cast("string")

    def piece(name, summary, ids):
        return F.struct(name.alias("finding_id"), summary.alias("summary"), ids.alias("session_ids"))

    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]).alias("id"),
        F.array(piece(finding, F.concat(F.lit("return "), F.col("l_returnflag")), F.array(s, q)),
                piece(none, F.concat(F.lit("status "), F.col("l_linestatus")), F.array(q, F.col("l_returnflag"), s, F.col("l_linestatus"))),
                piece(none, none, F.lit(None).cast("array<string>")),
                piece(F.lit(""), F.lit(""), F.array(F.lit("s0"), F.lit("t")))).alias("evidence"))


@add("l3_findings", """SELECT CASE WHEN l_partkey % 2 = 0 THEN 'f' || (l_partkey % 40) ELSE 'return ' || l_returnflag END AS finding FROM lineitem
  UNION SELECT 'status ' || l_linestatus FROM lineitem""")
def _(spark, sf):
    return L.findings(_evidence(spark, sf))


@add("l4_evidence_sessions", """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id,
    's' || (l_suppkey % 7) || '|q' || l_quantity::INT || '|' || l_returnflag || '|' || l_linestatus
      || CASE WHEN l_suppkey % 7 = 0 THEN '|t' ELSE '|s0' END AS session_ids
  FROM lineitem""")
def _(spark, sf):
    return L.evidence_sessions(_evidence(spark, sf), 5).withColumn("session_ids", joined("session_ids"))


@add("l5_conflicts", """SELECT o_orderkey, o_custkey::VARCHAR AS target_key FROM orders WHERE o_orderstatus = 'O'
  AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def _(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "applied").otherwise("rejected")
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("target_key"), status.alias("status"))
    return L.conflicts(o).select("o_orderkey", "target_key")
