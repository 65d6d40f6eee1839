"""Matching each picked before-session to its nearest after-session, one to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from parley.functions.predicates import min_turns
from parley.functions.vectors import cosine_distance
from parley.operators.sampling import MIN_TURNS, N_EXPLORE, SEED, explore_sample, ranked_picks, stratum
from parley.session import discard, stage

TURN_TOLERANCE = 3  # fixed value
BROADCAST_PICKS = 5_000
#: Candidates listed for a pick beyond one for each pick like it, at first.
SPARE = 16


def _listed(classes: DataFrame, after: DataFrame, tol: int, few: bool) -> DataFrame:
    """(class, after, place): the ``want`` nearest candidates of each class of picks."""
    known = classes.select("stratum").distinct().join(after.select(F.col("_as").alias("stratum")), "stratum", "left_semi")
    small = F.broadcast if few else (lambda x: x)
    near = (F.col("_ob") == F.col("outcome_bucket")) & (F.abs(F.col("_at") - F.col("_bt")) <= tol)
    same = after.join(small(classes.join(known, "stratum", "left_semi")), near & (F.col("_as") == F.col("stratum")))
    free = after.join(small(classes.join(known, "stratum", "left_anti")), near)
    scored = same.unionByName(free).select("class", "after", "want", F.round(cosine_distance(F.col("_bv"), F.col("_av")), 12).alias("_d"))
    place = F.row_number().over(W.partitionBy("class").orderBy("_d", "after"))
    most = classes.agg(F.max("want")).first()[0] or 1
    return scored.withColumn("place", place).where(F.col("place") <= most).where(F.col("place") <= F.col("want")).select("class", "after", "place")


def match_pairs(picks: DataFrame, after: DataFrame, tol: int = TURN_TOLERANCE, id_col: str = "session_id",
                vec: str = "embedding_opening", spare: int = SPARE) -> DataFrame:
    """(rank, before, after, stratum) by greedy choice in rank order.

    Candidates share the stratum (any stratum when after-sessions have none of
    it) and the outcome bucket, and differ by at most ``tol`` turns.

    Deferred acceptance, a join and two small aggregates a round: free picks propose to
    their nearest candidates, a candidate keeps the pick of least rank and sets free the one
    it held. As all candidates prefer lesser ranks, what is stable is the greedy choice.
    Picks that differ by nothing that decides form a class with one list; the i-th free one
    of a class proposes to its i-th candidate that is not held by a pick before them all,
    since those in front go to the others or to picks of still lesser rank. Lists
    begin short and are made twice as long for the classes that run out of them.
    """
    alike = ["stratum", "outcome_bucket", "_bt", "_bv"]
    b = picks.select("rank", F.col(id_col).alias("before"), "stratum", "outcome_bucket", F.col("turn_count").alias("_bt"), F.col(vec).alias("_bv"))
    classes = stage(b.groupBy(*alike).agg(F.min("rank").alias("class"), F.collect_list(F.struct("rank", "before")).alias("members")).withColumn(
        "want", F.size("members") + spare))
    few = classes.count() <= BROADCAST_PICKS
    a = after.where(min_turns(MIN_TURNS)).select(
        F.col(id_col).alias("after"), stratum().alias("_as"), F.col("outcome_bucket").alias("_ob"),
        F.col("turn_count").alias("_at"), F.col(vec).alias("_av"))
    members = stage(classes.select("class", "stratum", F.inline("members")))
    classes = classes.drop("members")
    near = stage(_listed(classes, a, tol, few))
    held = stage(near.join(members, "class").select("after", "rank", F.lit(None).cast("long").alias("old")).limit(0))
    while True:
        free = members.join(held.select("rank"), "rank", "left_anti").select(
            "class", "rank", F.row_number().over(W.partitionBy("class").orderBy("rank")).alias("turn"), F.min("rank").over(W.partitionBy("class")).alias("first"))
        heads = free.where("turn = 1").select("class", "first")
        open_ = near.join(heads, "class").join(held.select("after", F.col("rank").alias("holder")), "after", "left").where("holder IS NULL OR holder > first")
        open_ = open_.select("class", "after", "holder", F.row_number().over(W.partitionBy("class").orderBy("place")).alias("turn"))
        asked = free.join(open_, ["class", "turn"]).where("holder IS NULL OR holder > rank").select("after", "rank", F.lit(None).cast("long").alias("old"))
        kept = held.select("after", "rank", F.col("rank").cast("long").alias("old"))
        now = stage(kept.unionByName(asked).groupBy("after").agg(F.min("rank").alias("rank"), F.min("old").alias("old")))
        if not now.where("old IS NULL OR old <> rank").isEmpty():
            discard(held)
            held = now
            continue
        discard(now)
        # no proposal was left to make: longer lists for classes whose free picks have seen all of theirs
        full = near.groupBy("class").agg(F.count("*").alias("n")).join(classes, "class").where("n = want").drop("n")
        short = stage(full.join(heads, "class", "left_semi").withColumn("want", F.col("want") * 2))
        if short.isEmpty():
            break
        classes = stage(classes.join(short, "class", "left_anti").unionByName(short.select(*classes.columns)))
        longer = stage(near.join(short, "class", "left_anti").unionByName(_listed(short, a, tol, few)))
        discard(near)
        near = longer
    return held.join(members, "rank").select("rank", "before", "after", "stratum")


def explore_pairs(fv: DataFrame, n: int = N_EXPLORE, tol: int = TURN_TOLERANCE, id_col: str = "session_id",
                  vec: str = "embedding_opening", seed: str = SEED) -> DataFrame:
    """(pair_id, before, after, stratum): diverse before-sessions and their matches."""
    pairs = max(1, n // 2)
    before, after = fv.where(F.col("cohort") == "before"), fv.where(F.col("cohort") == "after")
    ranked = ranked_picks(before, pairs, id_col, vec, seed).where(F.col("rank") < pairs)
    picks = before.join(ranked.select(id_col, "stratum", "rank"), id_col)
    return match_pairs(picks, after, tol, id_col, vec).withColumnRenamed("rank", "pair_id")


def exploration_manifest(fv: DataFrame, study_type: str, n: int = N_EXPLORE, tol: int = TURN_TOLERANCE,
                         id_col: str = "session_id", vec: str = "embedding_opening", seed: str = SEED) -> DataFrame:
    """(pair_id, cohort, id, stratum): the sessions to explore."""
    if study_type != "comparative":
        one = explore_sample(fv.where(F.col("cohort") == "all"), n, id_col, vec, seed)
        return one.select(F.lit(None).cast("long").alias("pair_id"), F.lit("all").alias("cohort"), id_col, "stratum")
    pairs = explore_pairs(fv, n, tol, id_col, vec, seed)
    sides = F.array(*[F.struct(F.lit(c).alias("cohort"), F.col(c).alias(id_col)) for c in ("before", "after")])
    return pairs.select("pair_id", F.explode(sides).alias("s"), "stratum").select(
        F.col("pair_id").cast("long").alias("pair_id"), "s.cohort", f"s.{id_col}", "stratum")
