"""URL filter: rules, and trust spread over the host graph (operator 9).

A rule fits its host and all subdomains where the url's path starts with the rule's; the
longest decides. For other urls the host's standing does. Host edges are the links of the
pages to other hosts, and a lighter edge between a host and its parent domain, both ways.
Personalised PageRank carries trust along the edges from hosts of allowed pages, and
distrust against them from hosts of blocked pages; a host is blocked where distrust,
as a multiple of the mean share, reaches a threshold and exceeds its trust.

Pages of a null url, or one without "://", have an empty host and path; no rule fits, and
the empty host is allowed. Null html has no links. Repeated rows count as often as they
occur. An empty table gives no rows. All of it is built-in column functions and joins; the
iteration runs over hosts, not pages. It adds up what is still pending at the hosts that hold
any, writes every few rounds to the shared folder in place of the table before, and goes on
until what may still come can change no host's verdict.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from parley.llm.common import carried, prepare
from parley.session import discard, stage

DAMPING = 0.85
#: Ranks that differ by no more, in multiples of an equal share, are equal.
TOLERANCE = 1e-6
#: Rounds between two written tables.
WRITTEN = 4
#: Rows of ranks and edges meant for one task.
TASK_ROWS = 200_000
#: Distrust, in multiples of an equal share, that blocks a host.
THRESHOLD = 0.5
#: Weight of the edge between a host and its parent, beside links of weight 1 each.
PARENT_WEIGHT = 0.25

LINK = r"""(?i)(?:href|src)\s*=\s*["']?[a-z][a-z0-9+.-]*://([^/?#"'\s>]+)"""


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The production rules.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path, empty where there are none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    found = F.coalesce(rest, F.lit(""))
    host = lower(F.regexp_extract(found, r"(?s)^([^/?#]*)", 1))
    return host, F.regexp_extract(found, r"(?s)^[^/?#]*(/[^?#]*)", 1)


def decided(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host))):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``row``, host, path, rule and the rule's verdict."""
    host, path = split_url(F.col(f"`{url_col}`"))
    rule, verdict = decided(F.col("host"), F.col("path"), rules)
    return carried(pages, host=host, path=path).withColumns({"rule": rule, "ruled": verdict})


def parent(host: Column) -> Column:
    """The domain above, null above two labels."""
    return F.when(F.size(F.split(host, r"\.")) > 2, F.substr(host, F.instr(host, ".") + 1))


def host_graph(pages: DataFrame, url_col: str = "url", html_col: str = "html", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Hosts (host, allowed, blocked: pages so ruled) and edges (src, dst, weight)."""
    rows = judged(pages, url_col, rules).filter("host <> ''")
    out = F.array_remove(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(f"row.`{html_col}`"), F.lit("")), F.lit(LINK)), lower)), F.col("host"))
    # one pass over the pages: per host its ruled pages, per (host, target) its links
    seen = rows.select("host", "ruled", F.explode_outer(F.concat(F.array(F.lit(None).cast("string")), out)).alias("dst"))
    counted = stage(seen.groupBy("host", "dst").agg(
        F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked")))
    own = counted.filter("dst IS NULL").select("host", "allowed", "blocked")
    links = counted.filter("dst IS NOT NULL").select(F.col("host").alias("src"), "dst", F.col("n").cast("double").alias("weight"))
    named = own.select("host").union(links.select("dst")).distinct()
    # a host of k labels has at most k - 2 domains above it
    labels = F.split("host", r"\.")
    above = named.select(F.explode(F.when(F.size(labels) > 2, F.transform(
        F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array("host"))).alias("host"))
    hosts = above.distinct()
    up = hosts.select(F.col("host").alias("src"), parent(F.col("host")).alias("dst"), F.lit(PARENT_WEIGHT).alias("weight")).filter("dst IS NOT NULL")
    edges = links.union(up).union(up.select("dst", "src", "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return stage(hosts.join(own, "host", "left").fillna(0, ["allowed", "blocked"])), stage(edges)


def _blocked(trust: Column, distrust: Column, threshold: float) -> Column:
    return (distrust >= threshold) & (distrust > trust + TOLERANCE)


def _is_open(ranks: DataFrame, damping: float, threshold: float) -> bool:
    """Whether what is still to come may change a host's verdict.

    What is pending in all can add at most its sum / (1 - damping) to a rank. Mostly a closer bound holds:
    all parts are positive, and the sums over one block of rounds follow from those over the block before
    by one and the same positive linear map, so if no rank's sum is more than r times that of the block
    before, no later one is, and at most r / (1 - r) times the last sum is still to come.
    """
    grown = F.when(F.col("block") > 0, F.coalesce(F.col("block") / F.nullif("last", F.lit(0.0)), F.lit(float("inf"))))
    of = lambda against, c: F.sum(F.when(F.col("against") == against, c).otherwise(0.0))
    r, trust_left, distrust_left = ranks.agg(F.coalesce(F.max(grown), F.lit(0.0)), of(False, F.col("pending")), of(True, F.col("pending"))).first()
    left = F.when(F.col("against"), (distrust_left or 0.0) / (1.0 - damping)).otherwise((trust_left or 0.0) / (1.0 - damping))
    most = F.least(left, F.col("block") * (r / (1.0 - r))) if r < 1.0 else left
    hosts = ranks.groupBy("host").agg(of(False, F.col("value")).alias("t"), of(True, F.col("value")).alias("d"), of(False, most).alias("t_more"), of(True, most).alias("d_more"))
    t, d, t_more, d_more = map(F.col, ("t", "d", "t_more", "d_more"))
    sure = _blocked(t + t_more, d, threshold) | ~((d + d_more >= threshold) & (d + d_more > t + TOLERANCE))
    return not hosts.filter(~sure & (t_more + d_more > TOLERANCE)).isEmpty()


def spread(hosts: DataFrame, edges: DataFrame, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """host, trust and distrust: personalised PageRank from allowed along and from blocked against the edges.

    Both are multiples of an equal share, and one table holds both, so a round is one join
    and one sum. What a host without edges holds goes back to the seeds only through the
    restart. A round adds what is pending at a host to its rank and passes it on; ranks only grow.
    """
    n, allowed, blocked = hosts.agg(F.count("*"), F.sum("allowed"), F.sum("blocked")).first()
    ways = edges.select(F.inline(F.array(
        F.struct(F.lit(False).alias("against"), "src", "dst", "weight"),
        F.struct(F.lit(True).alias("against"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))))
    out = ways.groupBy("against", "src").agg(F.sum("weight").alias("all"))
    few = lambda rows: max(1, -(-rows // TASK_ROWS))
    share = stage(ways.join(out, ["against", "src"]).select("against", "src", "dst", (damping * F.col("weight") / F.col("all")).alias("share")).coalesce(few(2 * edges.count())))
    seeds = lambda seed, total, against: F.struct(F.lit(against).alias("against"), ((1.0 - damping) * F.col(seed) * float(n) / float(max(total or 0, 1))).alias("pending"))
    none = F.lit(0.0)
    ranks = hosts.select("host", F.inline(F.array(seeds("allowed", allowed, False), seeds("blocked", blocked, True)))).select(
        "against", "host", none.alias("value"), "pending", none.alias("block"), none.alias("last"))
    ranks = stage(ranks.coalesce(few(2 * n)))
    while True:
        before = ranks
        ranks = ranks.select("against", "host", "value", "pending", none.alias("block"), F.col("block").alias("last"))
        for _ in range(WRITTEN):
            passed = ranks.filter("pending > 0").withColumnRenamed("host", "src").join(share, ["against", "src"]).select(
                "against", F.col("dst").alias("host"), none.alias("value"), (F.col("pending") * F.col("share")).alias("pending"), none.alias("block"), none.alias("last"))
            taken = ranks.select("against", "host", (F.col("value") + F.col("pending")).alias("value"), none.alias("pending"), (F.col("block") + F.col("pending")).alias("block"), "last")
            ranks = taken.union(passed).groupBy("against", "host").agg(*[F.sum(c).alias(c) for c in ("value", "pending", "block", "last")]).coalesce(few(2 * n))
        ranks = stage(ranks)
        discard(before)
        if not _is_open(ranks, damping, threshold):
            break
    of = lambda against: F.sum(F.when(F.col("against") == against, F.col("value")).otherwise(0.0))
    return ranks.groupBy("host").agg(of(False).alias("trust"), of(True).alias("distrust"))


def standing(hosts: DataFrame, edges: DataFrame, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """host, trust, distrust (multiples of an equal share) and whether the host is blocked."""
    return spread(hosts, edges, damping, threshold).withColumn("bad", _blocked(F.col("trust"), F.col("distrust"), threshold))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple[Rule, ...] = RULES,
                damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every row."""
    prepare(pages.sparkSession)
    hosts, edges = host_graph(pages, url_col, html_col, rules)
    known = standing(hosts, edges, damping, threshold).withColumnRenamed("host", "known")
    rows = judged(pages, url_col, rules).select(F.col(f"row.`{id_col}`").alias("page_id"), "host", "path", "rule", "ruled")
    bad = F.coalesce("bad", F.lit(False))
    return rows.join(known, rows["host"] == known["known"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
