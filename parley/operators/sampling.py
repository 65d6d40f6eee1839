"""Random, stratified and diverse samples of sessions, reproducible by seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from parley.functions.predicates import min_turns
from parley.operators.ordering import SLICE_ROWS, first_by_hash, with_place, with_position
from parley.operators.vectors import farthest_points
from parley.session import stage

# Stratum columns with the value each takes when it is missing.
STRATUM = {"opening_intent_class": "unknown", "outcome_bucket": "other", "length_bucket": "medium"}
N_EXPLORE, MIN_TURNS, PILOT = 100, 2, 200
SEED = "parley"


def stratum() -> Column:
    """One string from the three stratum columns."""
    parts = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)) for c, d in STRATUM.items()]
    return F.concat_ws("|", *parts)


def cap_ids(df: DataFrame, n: int | None, id_col: str = "session_id", seed: str = SEED,
            keys: Sequence[str] = ()) -> DataFrame:
    """``n`` random rows (per key); None keeps all."""
    if n is None:
        return df
    return first_by_hash(df, id_col, seed, n, keys, out="_pos").drop("_pos")


def pilot(df: DataFrame, n: int = PILOT, id_col: str = "session_id", seed: str = SEED) -> DataFrame:
    return cap_ids(df, n, id_col, seed)


def quotas(sizes: DataFrame, total: int, key: str = "stratum", size: str = "size") -> DataFrame:
    """(key, size, quota) by largest remainder; ties by key.

    Leftover units go to the largest fractions among strata not yet full, one
    unit each. With ``total`` above the sum of sizes a floor may exceed a size.
    """
    # small, read several times here, and the end of a scan of the whole population
    sizes = stage(sizes.select(key, size))
    grand = sizes.agg(F.sum(size)).scalar()
    raw = F.lit(total) * F.col(size) / grand
    rows = sizes.select(key, size, F.floor(raw).alias("_floor"), (raw - F.floor(raw)).alias("_frac"))
    left = rows.agg(F.lit(total) - F.sum("_floor")).scalar()
    open_ = F.col("_floor") < F.col(size)
    ranked = with_position(
        rows.withColumn("_full", (~open_).cast("int")), [], ["_full", F.desc("_frac"), key], "_rank")
    unit = F.when(open_ & (F.col("_rank") < left), 1).otherwise(0)
    return ranked.select(key, size, (F.col("_floor") + unit).alias("quota"))


def stratum_sizes(df: DataFrame, key: str = "stratum") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("size"))


def not_picked(df: DataFrame, picked: DataFrame, id_col: str = "session_id") -> DataFrame:
    return df.join(picked.select(id_col), id_col, "left_anti")


def top_up(df: DataFrame, picked: DataFrame, n: int, id_col: str = "session_id", seed: str = SEED) -> DataFrame:
    """Ids of ``picked`` and random others of ``df`` up to ``n``."""
    missing = picked.agg(F.greatest(F.lit(n) - F.count("*"), F.lit(0))).scalar()
    rest = first_by_hash(not_picked(df, picked, id_col).select(id_col), id_col, seed, missing, out="_pos")
    return picked.select(id_col).unionByName(rest.select(id_col))


def stratified_sample(fv: DataFrame, n: int, by: str | Column = "stratum", id_col: str = "session_id",
                      seed: str = SEED) -> DataFrame:
    """``n`` rows with quotas per stratum, random within each; all rows if there are no more.

    Below the population size the quotas add up to exactly ``n`` and none exceeds
    its stratum, so no top-up is left to do.
    """
    strata = fv.withColumn("_stratum", by if isinstance(by, Column) else F.col(by))
    sizes = strata.groupBy("_stratum").agg(F.count("*").alias("size"))
    wanted = quotas(sizes, n, "_stratum").select("_stratum", "quota")
    # quotas over the population are floors at or above each size: everything stays
    return first_by_hash(strata, id_col, seed, F.col("quota"), ["_stratum"], wanted, "_pos").select(*fv.columns)


def diverse_pick(fv: DataFrame, wanted: DataFrame, key: str = "stratum", id_col: str = "session_id",
                 vec: str = "embedding_opening", seed: str = SEED, bound: int = SLICE_ROWS + 1) -> DataFrame:
    """(key, id, pick) of each stratum by the quotas in ``wanted`` (key, size, quota).

    ``bound`` is the largest quota where the caller knows it.

    A stratum no larger than its quota is taken whole. Otherwise the medoid and
    the points farthest from it, ceil(sqrt(size)) at most, and random others.
    """
    some = wanted.where(F.col("quota") > 0)
    pool = fv.select(key, id_col, vec).join(some, key)
    whole = pool.where(F.col("size") <= F.col("quota"))
    whole = with_place(whole.select(key, id_col), [key], [id_col], bound, "pick")
    spread_of = F.least("quota", F.ceil(F.sqrt("size"))).cast("int")
    larger = pool.where(F.col("size") > F.col("quota")).withColumn("_spread", spread_of)
    spread = farthest_points(larger, key, id_col, vec, "_spread")
    rest = larger.join(spread.select(key, id_col), [key, id_col], "left_anti")
    # only the head of a stratum's random order is shuffled, not the whole rest
    need = stage(some.where(F.col("size") > F.col("quota")).select(key, spread_of.alias("_spread"), (F.col("quota") - spread_of).alias("_need")))
    filled = first_by_hash(rest.select(key, id_col), id_col, seed, F.col("_need"), [key], need.select(key, "_need"), "_pos")
    filled = filled.join(need, key).select(key, id_col, (F.col("_spread") + F.col("_pos")).alias("pick"))
    picks = whole.withColumn("pick", F.col("pick").cast("long"))
    for part in (spread, filled):
        picks = picks.unionByName(part.withColumn("pick", F.col("pick").cast("long")))
    return picks


def ranked_picks(fv: DataFrame, n: int, id_col: str = "session_id", vec: str = "embedding_opening",
                 seed: str = SEED) -> DataFrame:
    """(id, stratum, rank): picks in order, rare strata first. At most ``n`` and small strata."""
    pool = fv.where(min_turns(MIN_TURNS)).withColumn("stratum", stratum())
    wanted = stage(quotas(stratum_sizes(pool), n))
    picks = diverse_pick(pool, wanted, "stratum", id_col, vec, seed, n + 1).join(wanted, "stratum")
    return with_place(picks.select(id_col, "stratum", "size", "pick"), [], ["size", "stratum", "pick"], n + 1, "rank")


def explore_sample(fv: DataFrame, n: int = N_EXPLORE, id_col: str = "session_id",
                   vec: str = "embedding_opening", seed: str = SEED) -> DataFrame:
    """(id, stratum, rank): a diverse sample of one cohort, rare strata first."""
    return ranked_picks(fv, n, id_col, vec, seed).where(F.col("rank") < n).select(id_col, "stratum", "rank")


def extreme_sessions(digests: DataFrame, id_col: str = "session_id") -> DataFrame:
    """Ids of the shortest, the longest and the most anomalous session, distinct."""
    flags = F.size("anomaly_flags")
    turns = F.coalesce(F.col("turn_count"), F.lit(0))
    first = digests.agg(
        F.min_by(id_col, F.struct(turns, id_col)).alias("a"),
        F.min_by(id_col, F.struct(-turns, id_col)).alias("b"),
        F.min_by(id_col, F.struct(-flags, id_col)).alias("c"))
    return first.select(F.explode(F.array_distinct(F.array("a", "b", "c"))).alias(id_col))


def counter_examples(values: DataFrame, hypothesis: str, k: int = 3, id_col: str = "session_id",
                     vec: str = "embedding_opening", prefix: str = "hyp_", seed: str = SEED) -> DataFrame:
    """(hypothesis_id, id, pick): sessions that do not match, a random one first,
    then the ones farthest from those chosen."""
    missed = values.where(~F.coalesce(F.col(prefix + hypothesis), F.lit(False))).select(
        F.lit(hypothesis).alias("hypothesis_id"), id_col, vec)
    order = F.struct(F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string"))), F.col(id_col))
    start = missed.groupBy("hypothesis_id").agg(F.min_by(id_col, order).alias(id_col))
    return farthest_points(missed, "hypothesis_id", id_col, vec, k, start)


def all_counter_examples(values: DataFrame, hypotheses: list[str], k: int = 3, id_col: str = "session_id",
                         vec: str | None = None, prefix: str = "hyp_", seed: str = SEED) -> DataFrame:
    """(hypothesis_id, id, pick) for all hypotheses at once.

    A session in two cohorts counts once. Without vectors the picks are random.
    """
    missed = F.array_compact(F.array(*[
        F.when(~F.coalesce(F.col(prefix + h), F.lit(False)), F.lit(h)) for h in hypotheses]))
    rows = values.select(F.explode(missed).alias("hypothesis_id"), id_col, *[vec] * bool(vec))
    if vec:
        order = F.struct(F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string"))), F.col(id_col))
        each = rows.groupBy("hypothesis_id", id_col).agg(F.min(vec).alias(vec))
        start = each.groupBy("hypothesis_id").agg(F.min_by(id_col, order).alias(id_col))
        return farthest_points(each, "hypothesis_id", id_col, vec, k, start)
    return first_by_hash(stage(rows.distinct()), id_col, seed, k, ["hypothesis_id"], out="pick").withColumn("pick", F.col("pick").cast("int"))


def sample_transcripts(lines: DataFrame, ids: DataFrame, n: int, id_col: str = "session_id") -> DataFrame:
    """Lines of the first ``n`` ids, as (id, idx, speaker, text)."""
    first = ids.select(id_col).distinct().orderBy(id_col).limit(n)
    return lines.join(first, id_col, "left_semi")
