"""Samples, picks and matches against brute force."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from parley.operators import matching as M, sampling as G, vectors as V

RNG = random.Random(3)
DIM = 4


def unit():
    v = [RNG.gauss(0, 1) for _ in range(DIM)]
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


def dist(a, b):
    return round(1 - sum(x * y for x, y in zip(a, b)), 12)


@pytest.fixture(scope="module")
def points(spark):
    rows = [("g" if i % 3 else f"h{i % 2}", i, unit() if i != 5 else [0.0] * DIM) for i in range(60)]
    return rows, spark.createDataFrame(rows, "label string, id long, embedding array<double>").cache()


def brute_medoid(vs):
    return min(vs, key=lambda x: (round(sum(dist(x[1], y[1]) for y in vs if y is not x) / max(len(vs) - 1, 1), 9), x[0]))[0]


def brute_far(vs, k, first):
    by_id = dict(vs)
    chosen = [first]
    while len(chosen) < min(k, len(vs)):
        rest = [i for i in sorted(by_id) if i not in chosen]
        chosen.append(max(rest, key=lambda i: (min(dist(by_id[i], by_id[c]) for c in chosen), -i)))
    return chosen


def test_medoid(points):
    rows, df = points
    got = {r.label: r.id for r in V.medoid(df, "label", "id").collect()}
    assert got == {g: brute_medoid([(i, v) for k, i, v in rows if k == g]) for g in {r[0] for r in rows}}


@pytest.mark.parametrize("k", [1, 2, 5, 19, 100])
def test_farthest_points(points, k):
    rows, df = points
    got = V.farthest_points(df, "label", "id", k=k).orderBy("label", "pick").collect()
    for g in {r[0] for r in rows}:
        vs = [(i, v) for key, i, v in rows if key == g]
        assert [r.id for r in got if r.label == g] == brute_far(vs, k, brute_medoid(vs))


def test_farthest_points_from_seed_with_own_quota(points, spark):
    rows, df = points
    seed = df.groupBy("label").agg(F.max("id").alias("id"))
    quota = df.withColumn("k", F.when(F.col("label") == "g", 3).otherwise(2))
    got = V.farthest_points(quota, "label", "id", k="k", seed=seed).orderBy("label", "pick").collect()
    for g in {r[0] for r in rows}:
        vs = [(i, v) for key, i, v in rows if key == g]
        assert [r.id for r in got if r.label == g] == brute_far(vs, 3 if g == "g" else 2, max(i for i, _ in vs))


@pytest.mark.parametrize("total", [0, 4, 10, 25])
def test_quotas(spark, total):
    sizes = {"a": 5, "b": 3, "c": 1, "d": 1}
    df = spark.createDataFrame(list(sizes.items()), "stratum string, size long")
    got = {r.stratum: r.quota for r in G.quotas(df, total).collect()}
    raw = {k: total * n / 10 for k, n in sizes.items()}
    want = {k: math.floor(v) for k, v in raw.items()}
    left = total - sum(want.values())
    for k in sorted(raw, key=lambda k: (-(raw[k] - math.floor(raw[k])), k)):
        if left > 0 and want[k] < sizes[k]:
            want[k] += 1
            left -= 1
    assert got == want
    if total <= 10:
        assert sum(got.values()) == total and all(got[k] <= sizes[k] for k in sizes)


@pytest.mark.parametrize("n", [1, 7, 59, 60, 500])
def test_stratified_sample_size(points, n):
    _, df = points
    got = G.stratified_sample(df, n, "label", "id").collect()
    assert len(got) == min(n, 60) and len({r.id for r in got}) == len(got)


def test_cap_and_top_up(points):
    _, df = points
    assert G.cap_ids(df, None, "id").count() == 60
    capped = G.cap_ids(df, 10, "id").select("id")
    assert capped.count() == 10
    filled = [r.id for r in G.top_up(df, capped, 25, "id").collect()]
    assert len(filled) == 25 == len(set(filled)) and {r.id for r in capped.collect()} <= set(filled)
    assert G.top_up(df, capped, 4, "id").count() == 10


def _sessions(spark, n):
    rows = [(f"s{i:03d}", "before" if i % 2 else "after", RNG.randrange(0, 9), RNG.choice(["completed", "timeout"]),
             RNG.choice(["short", "medium"]), "only_before" if i % 2 and i % 9 == 0 else RNG.choice(["x", "y"]), unit()) for i in range(n)]
    cols = "session_id string, cohort string, turn_count int, outcome_bucket string, length_bucket string, opening_intent_class string, embedding_opening array<double>"
    return rows, spark.createDataFrame(rows, cols).cache()


def brute_pairs(picks, after, tol):
    used, out = set(), []
    for rank, b in enumerate(picks):
        stratum = (b[5], b[3], b[4])
        pool = [a for a in after if (a[5], a[3], a[4]) == stratum] or after
        near = [a for a in pool if a[0] not in used and abs(a[2] - b[2]) <= tol and a[3] == b[3]]
        if near:
            best = min(near, key=lambda a: (dist(a[6], b[6]), a[0]))
            used.add(best[0])
            out.append((rank, b[0], best[0]))
    return out


@pytest.mark.parametrize("n,m,tol", [(120, 40, 3), (40, 20, 1), (60, 30, 9)])
def test_pairs_equal_full_greedy(spark, n, m, tol):
    rows, df = _sessions(spark, n)
    before = [r for r in rows if r[1] == "before"][:m]
    after = [r for r in rows if r[1] == "after" and r[2] >= 2]
    ranks = spark.createDataFrame([(b[0], i) for i, b in enumerate(before)], "session_id string, rank long")
    picks = df.join(ranks, "session_id").withColumn("stratum", G.stratum())
    got = M.match_pairs(picks, df.where("cohort = 'after'"), tol).orderBy("rank").collect()
    assert [(r["rank"], r.before, r.after) for r in got] == brute_pairs(before, after, tol)


def greedy(picks, after, tol):
    """The full greedy choice; rows are (id, stratum parts, bucket, turns, vector), picks in rank order."""
    used, out, strata = set(), [], {a[1] for a in after}
    for rank, (i, s, bucket, turns, v) in enumerate(picks):
        fits = [(dist(v, w), j) for j, t, b, n, w in after if j not in used and b == bucket and abs(n - turns) <= tol and (t == s or s not in strata)]
        if fits:
            used.add(min(fits)[1])
            out.append((rank, i, min(fits)[1]))
    return out


def _match(spark, picks, after, **options):
    schema = "session_id string, opening_intent_class string, outcome_bucket string, length_bucket string, turn_count int, embedding_opening array<double>"
    row = lambda i, s, b, n, v: (i, s, b, "x", n, v)
    p = spark.createDataFrame([(*row(*r), k) for k, r in enumerate(picks)], schema + ", rank int").withColumn("stratum", G.stratum())
    got = M.match_pairs(p, spark.createDataFrame([row(*r) for r in after], schema), 2, **options).collect()
    return sorted((r["rank"], r.before, r.after) for r in got)


@pytest.mark.parametrize("alike,spare", [(False, 16), (True, 16), (True, 1), (False, 0)])
def test_matching_is_the_greedy_choice(spark, alike, spare):
    """Also where all sessions say nothing, so that every pick wants the same candidates."""
    rng = random.Random(9)
    vectors = [[0.0] * DIM] if alike else [unit() for _ in range(40)]
    make = lambda name, n: [(f"{name}{i:03}", rng.choice("st"), rng.choice(["ok", "bad"]), rng.randrange(2, 9), rng.choice(vectors)) for i in range(n)]
    picks, after = make("b", 60), make("a", 50) + [("zz", "other", "ok", 3, vectors[0])]
    picks += [("lone", "nowhere", "ok", 4, vectors[0]), ("none", "s", "gone", 4, vectors[0])]
    # a stratum holds the bucket too
    mine = [(i, (s, b), b, n, v) for i, s, b, n, v in picks]
    theirs = [(i, (s, b), b, n, v) for i, s, b, n, v in after]
    assert _match(spark, picks, after, spare=spare) == greedy(mine, theirs, 2)


def test_matching_of_many_picks(spark):
    """50,000 picks: the greedy choice over all of them, stratum by stratum, without one task for a bucket."""
    rng = random.Random(2)
    corners = [[math.cos(k), math.sin(k)] for k in range(30)]
    make = lambda name, n: [(f"{name}{i:05}", f"s{i % 1000}", "ok", rng.randrange(2, 6), rng.choice(corners)) for i in range(n)]
    picks, after = make("b", 50_000), make("a", 45_000)
    want, per = [], {}
    for r in after:
        per.setdefault(r[1], []).append(r)
    ranked = {}
    for k, r in enumerate(picks):
        ranked.setdefault(r[1], []).append((k, r))
    for s, own in ranked.items():
        # no pick of one stratum competes with another's
        want += [(own[k][0], b, a) for k, b, a in greedy([r for _, r in own], per[s], 2)]
    assert _match(spark, picks, after) == sorted(want)


def test_explore_sample(spark):
    rows, df = _sessions(spark, 90)
    got = G.explore_sample(df, 20).orderBy("rank").collect()
    assert len(got) == 20 == len({r.session_id for r in got}) and [r["rank"] for r in got] == list(range(20))
    turns = {r[0]: r[2] for r in rows}
    assert all(turns[r.session_id] >= 2 for r in got)
    sizes = df.where("turn_count >= 2").groupBy(G.stratum().alias("s")).count().collect()
    size = {r.s: r["count"] for r in sizes}
    assert [size[r.stratum] for r in got] == sorted(size[r.stratum] for r in got)
    everything = G.explore_sample(df, 500)
    assert everything.count() == sum(size.values())


def test_manifest(spark):
    _, df = _sessions(spark, 90)
    m = M.exploration_manifest(df, "comparative", 20).collect()
    assert {r.cohort for r in m} == {"before", "after"} and len(m) % 2 == 0
    assert len({r.session_id for r in m}) == len(m)
    single = M.exploration_manifest(df.withColumn("cohort", F.lit("all")), "single", 12).collect()
    assert len(single) == 12 and {r.cohort for r in single} == {"all"}


def test_counter_examples(spark):
    rows, df = _sessions(spark, 50)
    flagged = df.withColumn("hyp_h", F.when(F.col("turn_count") > 4, True).when(F.col("turn_count") > 2, False))
    got = G.counter_examples(flagged, "h", 3).orderBy("pick").collect()
    vecs = {r[0]: r[6] for r in rows if r[2] <= 4}
    assert [r.session_id for r in got] == brute_far_names(vecs, 3, got[0].session_id)
    assert G.counter_examples(flagged.withColumn("hyp_h", F.lit(True)), "h", 3).count() == 0


def test_random_counter_examples_sort_only_their_head(spark):
    rows = [(f"s{i:05d}", c, i % 3 == 0) for i in range(20_000) for c in ("before", "after")[: 1 + i % 2]]
    values = spark.createDataFrame(rows, "session_id string, cohort string, hyp_a boolean").withColumn("hyp_b", F.lit(None).cast("boolean"))
    df = G.all_counter_examples(values, ["a", "b"], 3)
    got = sorted((r.hypothesis_id, r.pick, r.session_id) for r in df.collect())
    order = lambda ids: sorted(ids, key=lambda s: (hashlib.md5(f"{G.SEED}{s}".encode()).hexdigest(), s))[:3]
    want = {"a": order({r[0] for r in rows if not r[2]}), "b": order({r[0] for r in rows})}
    assert got == [(h, p, s) for h in "ab" for p, s in enumerate(want[h])]
    # no window may have a whole hypothesis in one task
    windows = [x for x in df._jdf.queryExecution().analyzed().toString().splitlines() if "windowspecdefinition" in x]
    assert windows and all("_b#" in x.split("windowspecdefinition", 1)[1] for x in windows)


def brute_far_names(vecs, k, first):
    chosen = [first]
    while len(chosen) < k:
        chosen.append(min((i for i in sorted(vecs) if i not in chosen), key=lambda i: (-min(dist(vecs[i], vecs[c]) for c in chosen), i)))
    return chosen


def test_prototypes(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 1.0],), ([-1.0, 0.0],)], "v array<double>")
    protos = [{"id": "a", "vectors": [[1.0, 0.0]]}, {"id": "b", "vectors": [[0.0, 1.0], [0.6, 0.8]]}, {"id": "rest", "vectors": []}]
    assert [r[0] for r in df.select(V.nearest_prototype(F.col("v"), protos)).collect()] == ["a", "b", "rest"]
    assert [r[0] for r in df.select(V.nearest_prototype(F.col("v"), [])).collect()] == ["other"] * 3
    small = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("z", 1, [0.0, 1.0])], "id string, ord int, vector array<double>")
    assert [r.label_id for r in V.nearest_labelled(df, small, "v").collect()] == ["a", "z", "z"]


def test_embed(spark):
    df = spark.createDataFrame([(1, "pay my bill", None), (2, " ", [1.0, 1.0]), (3, "kept", [0.0, 1.0]), (4, "redo", [0.0, 0.0])],
                               "id int, opening_text string, embedding_opening array<double>")
    got = {r.id: r.embedding_opening for r in V.embed(df, dim=2).collect()}
    assert got[2] == [0.0, 0.0] and got[3] == [0.0, 1.0]
    assert sum(x * x for x in got[1]) == pytest.approx(1) and sum(x * x for x in got[4]) == pytest.approx(1)

    @F.pandas_udf("array<double>")
    def encoder(texts):
        return texts.map(lambda t: [float(len(t)), 0.0])

    assert {r.id: r.embedding_opening for r in V.embed(df, dim=2, encoder=encoder).collect()}[4] == [4.0, 0.0]


def test_prototypes_in_blocks_equal_one_array(spark):
    rows = [(i, unit()) for i in range(40)] + [(40, [0.0] * DIM), (41, None)]
    protos = [(f"p{i % 30}", i, unit()) for i in range(90)] + [("last", 90, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    table = spark.createDataFrame(protos, "id string, ord int, vector array<double>")
    want = {}
    for i, v in rows:
        best = max((round(sum(a * b for a, b in zip(v, p)), 12) if v else 0.0, -o, n) for n, o, p in protos)
        want[i] = best[2] if best[0] >= V.MIN_SIMILARITY else "last"
    for numbers in (V.BROADCAST_NUMBERS, 10 * DIM, DIM):
        got = V.nearest_labelled(df, table, "v", block_numbers=numbers).collect()
        assert {r.id: r.label_id for r in got} == want
    assert [r.label_id for r in V.nearest_labelled(df, table.limit(0), "v").collect()] == [None] * len(rows)


def test_many_prototypes_hold_one_block_at_a_time(spark, monkeypatch):
    """100,000 prototypes: no array of more than the block's numbers is built."""
    protos = spark.range(100_000).select(F.concat(F.lit("p"), F.col("id")).alias("id"), F.col("id").alias("ord"),
                                         F.array(F.cos("id"), F.sin("id")).alias("vector"))
    df = spark.createDataFrame([(k, [math.cos(k), math.sin(k)]) for k in (7, 99_999)], "k int, v array<double>")
    staged = []
    inner = V.stage
    monkeypatch.setattr(V, "stage", lambda d: staged.append(d) or inner(d))
    got = V.nearest_labelled(df, protos, "v", block_numbers=50_000).collect()
    assert {r.k: r.label_id for r in got} == {7: "p7", 99_999: "p99999"} and len(staged) == 4
