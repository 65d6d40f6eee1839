"""Vector operators per group: medoid, centroid, farthest points, prototypes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

from parley.functions.text import strip
from parley.functions.vectors import cosine_distance, dot
from parley.operators.ordering import with_position
from parley.session import discard, stage

# The prototype threshold and label without one.
MIN_SIMILARITY, OTHER = 0.35, "other"
PICKS_PER_PASS = 8       # new picks held beside the running distances
BROADCAST_NUMBERS = 4_000_000  # vector components sent to every executor, at most


def centroid(df: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    mean = Summarizer.mean(array_to_vector(F.col(vec)))
    return df.groupBy(key).agg(mean.alias("_m")).select(key, vector_to_array("_m").alias("centroid"))


def medoid(df: DataFrame, key: str, id_col: str, vec: str = "embedding") -> DataFrame:
    """(key, id, mean_distance): the member with the least mean distance to the others.

    The mean distance of v is ((n-1) - v.S + v.v) / (n-1) with S the group's sum,
    so one aggregation and one join replace all pairs.
    """
    df = df.select(key, id_col, vec)
    total = Summarizer.sum(array_to_vector(F.col(vec)))
    sums = df.groupBy(key).agg(total.alias("_s"), F.count("*").alias("_n")).select(
        key, "_n", vector_to_array("_s").alias("_s"))
    v, others = F.col(vec), F.col("_n") - 1
    mean = F.when(others > 0, (others - dot(v, F.col("_s")) + dot(v, v)) / others).otherwise(0.0)
    # sums of the same vectors in another order differ in the last digits
    scored = df.join(sums, key).select(key, id_col, F.round(mean, 12).alias("mean_distance"))
    best = F.min(F.struct("mean_distance", id_col)).alias("_b")
    return scored.groupBy(key).agg(best).select(key, F.col(f"_b.{id_col}"), "_b.mean_distance")


def farthest_points(df: DataFrame, key: str, id_col: str, vec: str = "embedding", k: int | str = 10,
                    seed: DataFrame | None = None) -> DataFrame:
    """(key, id, pick): from the medoid, or ``seed`` (key, id), keep adding the
    member farthest from all picked so far.

    ``k`` is a number or the name of a column constant in a group. All groups
    advance together, a round each: one scan finds the next pick of every group
    with a combining aggregate. Rounds run over a table in the shared folder that
    carries each row's distance to the picks before; the few newest picks ride
    along and are folded in every ``PICKS_PER_PASS`` rounds by writing the table anew.
    """
    quota = F.lit(k) if isinstance(k, int) else F.col(k)
    base = df.select(key, F.col(id_col).alias("_id"), F.col(vec).alias("_v"), quota.alias("_k"))
    sizes = base.groupBy(key).agg(F.least(F.max("_k"), F.count("*")).alias("_k"), F.count("*").alias("_n"))
    rounds, groups = sizes.agg(F.max("_k"), F.count("*")).first()
    state = base.drop("_k").join(sizes, key).withColumn("_d", F.lit(float("inf")))
    state = stage(state)
    start = medoid(state, key, "_id", "_v") if seed is None else seed.withColumnRenamed(id_col, "_id")
    picks = stage(
        state.join(start.select(key, "_id"), [key, "_id"]).where(F.col("_k") > 0)
        .select(key, "_id", "_v", F.lit(0).alias("pick")))
    if not rounds or rounds <= 1:
        return picks.select(key, F.col("_id").alias(id_col), "pick")
    width = picks.agg(F.max(F.size("_v"))).first()[0] or 0
    small = groups * PICKS_PER_PASS * max(width, 1) <= BROADCAST_NUMBERS
    done, fresh = picks, picks
    for turn in range(1, rounds):
        near = fresh.groupBy(key).agg(F.collect_list(F.struct("_id", "_v")).alias("_p"))
        near = F.broadcast(near) if small else near
        # a picked row is at -1 and never chosen again
        to_fresh = F.aggregate(
            "_p", F.col("_d"),
            lambda d, p: F.when(p._id == F.col("_id"), F.lit(-1.0))
            .otherwise(F.least(d, cosine_distance(F.col("_v"), p._v))))
        seen = state.join(near, key, "left").withColumn(
            "_d", F.when(F.col("_p").isNull(), F.col("_d")).otherwise(to_fresh)).drop("_p")
        farthest_first = F.struct(-F.round("_d", 12), F.col("_id"))
        best = seen.where((F.col("_k") > turn) & (F.col("_d") >= 0)).groupBy(key).agg(
            F.min_by(F.struct("_id", "_v"), farthest_first).alias("_b"))
        new = stage(best.select(key, "_b._id", "_b._v", F.lit(turn).alias("pick")))
        done = done.unionByName(new)
        fresh = fresh.unionByName(new)
        if turn % PICKS_PER_PASS == 0 and turn + 1 < rounds:
            state, fresh = stage(seen), new
    return done.select(key, F.col("_id").alias(id_col), "pick")


def nearest_prototype(vec: Column, prototypes: Sequence[Mapping], min_sim: float = MIN_SIMILARITY) -> Column:
    """Label of the most similar prototype phrase, the first listed on ties.

    Below ``min_sim`` it is the id of the last prototype. ``prototypes`` is the
    plan's own list: ``[{id, vectors: [[...]]}]``.
    """
    if not prototypes:
        return F.lit(OTHER)
    sims = []
    for i, p in enumerate(prototypes):
        if p.get("vectors"):
            each = [1 - cosine_distance(vec, F.array(*[F.lit(float(x)) for x in v])) for v in p["vectors"]]
            top = F.array_max(F.array(*each))
            sims.append(F.struct(top.alias("sim"), F.lit(-i).alias("order"), F.lit(p.get("id") or p.get("label") or "match").alias("id")))
    last = prototypes[-1].get("id")
    if not sims:
        return F.lit(last)
    best = F.array_max(F.array(*sims))
    return F.when(best.sim >= min_sim, best.id).otherwise(F.lit(last))


def nearest_labelled(df: DataFrame, protos: DataFrame, vec: str = "embedding",
                     min_sim: float = MIN_SIMILARITY, block_numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """As ``nearest_prototype`` with any number of prototypes in a table (id, ord, vector).

    Prototypes come in blocks of at most ``block_numbers`` vector components. A block is one
    array, read as a scalar subquery, that rows meet where they are, so there is no join; with
    several blocks the best so far is written between them, and a task holds one block at a time.
    """
    n, width, last = protos.agg(F.count("*"), F.max(F.size("vector")), F.max_by("id", "ord")).first()
    per_block = max(1, block_numbers // max(width or 1, 1))
    numbered = with_position(protos.select("ord", "id", "vector"), [], ["ord", "id"], "_n")
    numbered = stage(numbered.withColumn("_block", F.floor(F.col("_n") / per_block))) if n > per_block else numbered.withColumn("_block", F.lit(0))
    nothing = F.lit(None).cast(T.StructType([
        T.StructField("sim", T.DoubleType()), T.StructField("order", T.LongType()), T.StructField("id", protos.schema["id"].dataType)]))
    out, written = df.withColumn("_best", nothing), None
    for k in range(-(-n // per_block)):
        listed = numbered.where(F.col("_block") == k).agg(F.sort_array(F.collect_list(F.struct("ord", "id", "vector")))).scalar()
        scored = F.transform("_protos", lambda p: F.struct(
            (1 - cosine_distance(F.col(vec), p.vector)).alias("sim"), (-p.ord).cast("long").alias("order"), p.id.alias("id")))
        out = out.withColumn("_protos", listed).withColumn("_best", F.greatest("_best", F.array_max(scored))).drop("_protos")
        if (k + 1) * per_block < n:
            before, out = written, stage(out)
            written = out
            if before is not None:
                discard(before)
    label = F.when(F.col("_best.sim") >= min_sim, F.col("_best.id")).otherwise(F.lit(last))
    return out.withColumn("label_id", label).withColumn("similarity", F.col("_best.sim")).drop("_best")


def hashed_text(df: DataFrame, text: str, out: str, dim: int = 1536) -> DataFrame:
    """Unit-length term-hash vector of a text column, computed in the JVM.

    Words are runs of letters, digits and underscores of any script.
    """
    tokens = RegexTokenizer(inputCol=text, outputCol="_tok", pattern="(?U)\\W+").transform(df)
    counts = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim).transform(tokens)
    unit = Normalizer(inputCol="_tf", outputCol="_unit").transform(counts)
    return unit.withColumn(out, vector_to_array("_unit")).drop("_tok", "_tf", "_unit")


def embed(df: DataFrame, text: str = "opening_text", out: str = "embedding_opening", dim: int = 1536,
          encoder: Callable[[Column], Column] | None = None, zero: bool = True) -> DataFrame:
    """Add or complete the vector of a text column.

    Blank text gets the zero vector; a vector already there is kept. ``encoder``
    is the user's pandas UDF (text -> array<double>); only rows that need it
    reach it.
    """
    blank = F.coalesce(strip(F.col(text)) == "", F.lit(True))
    zeros = F.array_repeat(F.lit(0.0), dim)
    if out in df.columns:
        have = F.coalesce((F.size(out) == dim) & F.exists(out, lambda x: x != 0), F.lit(False))
    else:
        df, have = df.withColumn(out, F.lit(None).cast("array<double>")), F.lit(False)
    kept = df.where(blank | have).withColumn(out, F.when(blank, zeros).otherwise(F.col(out)))
    todo = df.where(~(blank | have)).drop(out)
    fresh = todo.withColumn(out, encoder(F.col(text))) if encoder else hashed_text(todo, text, out, dim)
    return kept.unionByName(fresh.select(*kept.columns))
