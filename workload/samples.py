"""Vectors, samples, matching and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions.vectors import cosine_distance, normalize
from parley.operators import artifacts as A, digest as D, matching as M, sampling as G, vectors as V
from workload.binding import EV, VEC, cohort_of, events, table, vectors
from workload.registry import add, joined, r
from workload.results import FLAGS, flagged

SEEDED = "md5('parley' || {id})"


@add("h1_normalize", f"WITH {VEC}, o AS (SELECT vec_id, list_transform(embedding, lambda x: x * 2) AS v FROM vec) SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 9) AS x1, round(v[64] / sqrt(list_dot_product(v, v)), 9) AS x64 FROM o")
def _(spark, sf):
    v = vectors(spark, sf).select("vec_id", normalize(F.transform("embedding", lambda x: x * 2)).alias("v"))
    return v.select("vec_id", r(F.get("v", F.lit(0)), 9).alias("x1"), r(F.get("v", F.lit(63)), 9).alias("x64"))


@add("h2_cosine_distance", f"WITH {VEC} SELECT a.vec_id, round(1 - list_dot_product(a.embedding, b.embedding), 9) AS d FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1")
def _(spark, sf):
    v = vectors(spark, sf)
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(nxt, "vec_id").select("vec_id", r(cosine_distance(F.col("embedding"), F.col("other")), 9).alias("d"))


@add("h3_medoid", f"""WITH {VEC}, m AS (SELECT a.label, a.vec_id, round(avg(1 - list_dot_product(a.embedding, b.embedding)), 9) AS d
    FROM vec a JOIN vec b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY ALL)
  SELECT label, vec_id, round(d, 6) AS mean_distance FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS rn FROM m) WHERE rn = 1""")
def _(spark, sf):
    return V.medoid(vectors(spark, sf), "label", "vec_id").withColumn("mean_distance", r("mean_distance"))


@add("h5_centroid", f"WITH {VEC} SELECT label, " + ", ".join(f"round(avg(embedding[{i}]), 9) AS c{i}" for i in (1, 2, 33, 64)) + " FROM vec GROUP BY label")
def _(spark, sf):
    c = V.centroid(vectors(spark, sf), "label")
    return c.select("label", *[r(F.get("centroid", F.lit(i - 1)), 9).alias(f"c{i}") for i in (1, 2, 33, 64)])


def farthest_sql(start: str, pool: str, rounds: int) -> str:
    """CTEs picks0.. from a start (key, id): each round adds the farthest member per key."""
    out = f"picks0 AS (SELECT s.key, s.id, 0 AS pick, p.v FROM ({start}) s JOIN {pool} p USING (key, id))"
    for k in range(1, rounds):
        out += f""", cand{k} AS (SELECT c.key, c.id, c.v, min(round(1 - list_dot_product(c.v, p.v), 12)) AS d FROM {pool} c JOIN picks{k - 1} p USING (key)
    WHERE c.id NOT IN (SELECT id FROM picks{k - 1} q WHERE q.key = c.key) GROUP BY ALL),
  picks{k} AS (SELECT * FROM picks{k - 1} UNION ALL SELECT key, id, {k}, v FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY d DESC, id) AS rn FROM cand{k}) WHERE rn = 1)"""
    return out


MEDOID_SQL = """SELECT key, id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY d, id) AS rn FROM (
    SELECT a.key, a.id, round(avg(1 - list_dot_product(a.v, b.v)), 9) AS d FROM pool a JOIN pool b ON a.key = b.key AND a.id <> b.id GROUP BY ALL)) WHERE rn = 1"""


@add("h4_farthest_points", f"""WITH {VEC}, pool AS (SELECT label AS key, vec_id AS id, embedding AS v FROM vec), {farthest_sql(MEDOID_SQL, 'pool', 5)}
  SELECT key AS label, id AS vec_id, pick FROM picks4""")
def _(spark, sf):
    return V.farthest_points(vectors(spark, sf), "label", "vec_id", k=5)


def _protos(spark, sf):
    v = vectors(spark, sf)
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"))
    return first.select(F.concat(F.lit("p"), F.col("label").cast("string")).alias("id"), F.col("label").alias("ord"), "vector")


@add("h6_nearest_prototype", f"""WITH {VEC}, p AS (SELECT label, arg_min(embedding, vec_id) AS v FROM vec GROUP BY label),
  s AS (SELECT vec_id, p.label, list_dot_product(embedding, v) AS sim FROM vec, p),
  b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS rn FROM s)
  SELECT vec_id, CASE WHEN sim >= 0.35 THEN 'p' || label ELSE 'p' || (SELECT max(label) FROM p) END AS label_id, round(sim, 6) AS similarity FROM b WHERE rn = 1""")
def _(spark, sf):
    out = V.nearest_labelled(vectors(spark, sf), _protos(spark, sf))
    return out.select("vec_id", "label_id", r("similarity").alias("similarity"))


@add("h7_embed", r"SELECT doc_id, 256 AS dim, regexp_matches(text, '[\p{L}\p{N}_]')::INT::DOUBLE AS norm FROM documents")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("opening_text"))
    v = V.embed(docs, dim=256)
    norm = F.aggregate("embedding_opening", F.lit(0.0), lambda s, x: s + x * x)
    return v.select("doc_id", F.size("embedding_opening").alias("dim"), r(norm).alias("norm"))


# ---- random and stratified samples

@add("g1_cap_ids", f"WITH {EV}, i AS (SELECT DISTINCT session_id, cohort FROM ev) SELECT session_id, cohort FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY {SEEDED.format(id='session_id')}, session_id) AS rn FROM i) WHERE rn <= 25")
def _(spark, sf):
    return G.cap_ids(cohort_of(events(spark, sf)), 25, keys=["cohort"]).select("session_id", "cohort")


@add("g2_pilot", f"SELECT doc_id FROM documents ORDER BY {SEEDED.format(id='doc_id')}, doc_id LIMIT 200")
def _(spark, sf):
    return G.pilot(table(spark, sf, "documents").select("doc_id"), 200, "doc_id")


QUOTA = """sz AS (SELECT stratum, count(*) AS size FROM strata GROUP BY 1),
  q0 AS (SELECT *, {n} * size / (SELECT sum(size) FROM sz) AS raw FROM sz),
  q1 AS (SELECT *, CAST(floor(raw) AS BIGINT) AS fl, raw - floor(raw) AS frac FROM q0),
  q2 AS (SELECT *, row_number() OVER (ORDER BY fl >= size, frac DESC, stratum) AS rk, {n} - (SELECT sum(fl) FROM q1) AS rem FROM q1),
  quota AS (SELECT stratum, size, CAST(fl + CASE WHEN fl < size AND rk <= rem THEN 1 ELSE 0 END AS BIGINT) AS quota FROM q2)"""
DOC_STRATA = "strata AS (SELECT doc_id, lang || ':' || source AS stratum FROM documents)"


@add("g4_quotas", f"WITH {DOC_STRATA}, {QUOTA.format(n=137)} SELECT stratum, size, quota FROM quota")
def _(spark, sf):
    d = table(spark, sf, "documents").withColumn("stratum", F.concat_ws(":", "lang", "source"))
    return G.quotas(G.stratum_sizes(d), 137)


@add("g5_stratified_sample", f"""WITH {DOC_STRATA}, {QUOTA.format(n=137)}
  SELECT doc_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {SEEDED.format(id='doc_id')}, doc_id) AS rn FROM strata) JOIN quota USING (stratum) WHERE rn <= quota""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws(":", "lang", "source").alias("stratum"))
    return G.stratified_sample(d, 137, "stratum", "doc_id")


@add("j1_union_cohorts", f"WITH {EV} SELECT DISTINCT session_id, cohort FROM ev UNION ALL SELECT DISTINCT session_id, 'again' FROM ev WHERE cohort = 'before'")
def _(spark, sf):
    c = cohort_of(events(spark, sf))
    return c.unionByName(c.where("cohort = 'before'").withColumn("cohort", F.lit("again")))


@add("j2_top_up", f"""WITH p AS (SELECT doc_id FROM labels WHERE toxic = 1), rest AS (SELECT doc_id, row_number() OVER (ORDER BY {SEEDED.format(id='doc_id')}, doc_id) AS rn FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM p))
  SELECT doc_id FROM p UNION ALL SELECT doc_id FROM rest WHERE rn <= greatest((SELECT count(*) FROM documents) // 2 - (SELECT count(*) FROM p), 0)""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    picked = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return G.top_up(docs, picked, docs.count() // 2, "doc_id")


@add("j3_intersection", f"""WITH {EV} SELECT session_id, coalesce(string_agg(DISTINCT purpose, '|' ORDER BY purpose) FILTER (purpose IN ('router', 'main_stream')), '') AS common FROM ev GROUP BY session_id""")
def _(spark, sf):
    from parley.operators.primitives import hits

    wanted = F.array(F.lit("router"), F.lit("main_stream"))
    h = events(spark, sf).groupBy("session_id").agg(hits(["purpose"]).alias("h"))
    return h.select("session_id", joined(F.array_intersect("h", wanted)).alias("common"))


@add("j4_distinct", f"WITH {EV} SELECT DISTINCT cohort, event_type, purpose FROM ev")
def _(spark, sf):
    return events(spark, sf).select("cohort", "event_type", "purpose").distinct()


# ---- diverse samples

# the vectors as sessions: a stratum per label, before and after by parity
POOL = f"""{VEC}, pool AS (SELECT label || '|completed|short' AS key, vec_id AS id, embedding AS v, vec_id % 11 AS turns FROM vec WHERE {{where}}),
  strata AS (SELECT key AS stratum FROM pool)"""
ROUNDS = 10  # at least the largest quota below


def diverse_sql(n: int, where: str) -> str:
    """CTEs up to chosen (key, size, id, pick): quotas, farthest points, random rest."""
    return f"""{POOL.format(where=where)}, {QUOTA.format(n=n)}, {farthest_sql(MEDOID_SQL, 'pool', ROUNDS)},
  want AS (SELECT stratum AS key, size, quota, least(quota, ceil(sqrt(size)))::BIGINT AS k FROM quota WHERE quota > 0),
  spread AS (SELECT key, size, id, pick FROM picks{ROUNDS - 1} JOIN want USING (key) WHERE size > quota AND pick < k),
  fill AS (SELECT key, size, id, k + rn - 1 AS pick FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY {SEEDED.format(id="id")}, id) AS rn FROM pool JOIN want USING (key)
    WHERE size > quota AND id NOT IN (SELECT id FROM spread)) WHERE rn <= quota - k),
  whole AS (SELECT key, size, id, row_number() OVER (PARTITION BY key ORDER BY id) - 1 AS pick FROM pool JOIN want USING (key) WHERE size <= quota),
  chosen AS (SELECT * FROM spread UNION ALL SELECT * FROM fill UNION ALL SELECT * FROM whole),
  ranked AS (SELECT *, row_number() OVER (ORDER BY size, key, pick) - 1 AS rank FROM chosen)"""


def pairs_sql(n: int) -> str:
    """CTEs up to pairs (rank, before, after, stratum): the greedy choice, one rank a step."""
    return f"""RECURSIVE {diverse_sql(n, "vec_id % 11 >= 2 AND vec_id % 2 = 0")},
  b AS (SELECT rank, id AS before, key, v AS bv, turns AS bt FROM ranked JOIN pool USING (key, id) WHERE rank < {n}),
  a AS (SELECT vec_id AS after, label || '|completed|short' AS ak, embedding AS av, vec_id % 11 AS aturns FROM vec WHERE vec_id % 11 >= 2 AND vec_id % 2 = 1),
  cand AS (SELECT rank, before, after, key AS stratum, row_number() OVER (PARTITION BY rank ORDER BY round(1 - list_dot_product(bv, av), 12), after) AS place
    FROM b JOIN a ON (ak = key OR key NOT IN (SELECT ak FROM a)) AND abs(aturns - bt) <= 3),
  g AS (SELECT -1::BIGINT AS rank, []::BIGINT[] AS used, NULL::BIGINT AS after
    UNION ALL
    SELECT g.rank + 1, CASE WHEN min(c.place) IS NULL THEN g.used ELSE list_append(g.used, arg_min(c.after, c.place)) END, arg_min(c.after, c.place)
    FROM g LEFT JOIN cand c ON c.rank = g.rank + 1 AND NOT list_contains(g.used, c.after)
    WHERE g.rank + 1 < (SELECT count(*) FROM b) GROUP BY g.rank, g.used),
  pairs AS (SELECT g.rank, b.before, g.after, b.key AS stratum FROM g JOIN b USING (rank) WHERE g.after IS NOT NULL)"""


def _vec_features(spark, sf):
    v = vectors(spark, sf)
    return v.select(
        F.col("vec_id").alias("session_id"), F.when(F.col("vec_id") % 2 == 0, "before").otherwise("after").alias("cohort"),
        (F.col("vec_id") % 11).alias("turn_count"), F.lit("completed").alias("outcome_bucket"), F.lit("short").alias("length_bucket"),
        F.col("label").cast("string").alias("opening_intent_class"), F.col("embedding").alias("embedding_opening"))


@add("g6_diverse_pick", f"WITH {diverse_sql(60, 'true')} SELECT key AS stratum, id AS session_id, pick FROM chosen")
def _(spark, sf):
    fv = _vec_features(spark, sf).withColumn("stratum", G.stratum())
    wanted = G.quotas(G.stratum_sizes(fv), 60)
    return G.diverse_pick(fv, wanted).select("stratum", "session_id", "pick")


@add("g7_explore_sample", f"WITH {diverse_sql(40, 'vec_id % 11 >= 2')} SELECT id AS session_id, key AS stratum, rank FROM ranked WHERE rank < 40")
def _(spark, sf):
    return G.explore_sample(_vec_features(spark, sf), 40)


@add("c5_match_pairs", f"WITH {pairs_sql(30)} SELECT rank, before, after, stratum FROM pairs")
def _(spark, sf):
    fv = _vec_features(spark, sf)
    picks = G.ranked_picks(fv.where("cohort = 'before'"), 30).where(F.col("rank") < 30)
    rows = fv.join(picks.select("session_id", "stratum", "rank"), "session_id")
    return M.match_pairs(rows, fv.where("cohort = 'after'"))


@add("g8_explore_pairs", f"WITH {pairs_sql(20)} SELECT rank AS pair_id, before, after, stratum FROM pairs")
def _(spark, sf):
    return M.explore_pairs(_vec_features(spark, sf), 40)


@add("g9_exploration_manifest", f"""WITH {pairs_sql(20)} SELECT rank AS pair_id, 'before' AS cohort, before AS session_id, stratum FROM pairs
  UNION ALL SELECT rank, 'after', after, stratum FROM pairs""")
def _(spark, sf):
    return M.exploration_manifest(_vec_features(spark, sf), "comparative", 40)


@add("c7_label_samples", f"""WITH {EV} SELECT session_id, CASE WHEN count(*) FILTER (event_type = 'USER_QUERY') > 3 THEN min(cohort) ELSE 'all' END AS cohort_label FROM ev GROUP BY session_id""")
def _(spark, sf):
    ev = events(spark, sf)
    per = ev.groupBy("session_id").agg(F.min("cohort").alias("cohort"), F.count_if(F.col("event_type") == "USER_QUERY").alias("n"))
    return D.label_samples(per.where("n > 3").select("session_id", "cohort"), per.select("session_id"))


@add("g11_counter_examples", f"""WITH {VEC}, pool AS (SELECT 'h' AS key, vec_id AS id, embedding AS v FROM vec WHERE vec_id % 11 <= 5),
  {farthest_sql("SELECT key, id FROM pool ORDER BY " + SEEDED.format(id="id") + ", id LIMIT 1", 'pool', 3)}
  SELECT key AS hypothesis_id, id AS session_id, pick FROM picks2""")
def _(spark, sf):
    fv = _vec_features(spark, sf).withColumn("hyp_h", F.col("turn_count") > 5)
    return G.counter_examples(fv, "h", 3)


@add("a14_counter_example_table", f"""WITH {FLAGS} SELECT 'h_long' AS hypothesis_id, session_id, pick FROM (
    SELECT session_id, row_number() OVER (ORDER BY {SEEDED.format(id='session_id')}, session_id) - 1 AS pick FROM flags WHERE NOT hyp_h_long) WHERE pick < 5""")
def _(spark, sf):
    from parley.operators.ordering import with_hash_position

    f = flagged(spark, sf).where("NOT hyp_h_long").select(F.lit("h_long").alias("hypothesis_id"), "session_id")
    return A.counter_example_table(with_hash_position(f, "session_id", G.SEED, ["hypothesis_id"], "pick"))
