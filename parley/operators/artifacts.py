"""Result tables and plot data in their published shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BINS, EXAMPLES = 30, 5  # fixed values


def aspect_table(aspects: DataFrame, comparative: bool = True) -> DataFrame:
    name = F.col("id").alias("aspect_id")
    if comparative:
        return aspects.select(name, "name", "before", "after", "delta_pct", "p_value", "significant")
    return aspects.select(name, "name", "value")


def hypothesis_table(hyps: DataFrame, comparative: bool = True) -> DataFrame:
    name = F.col("id").alias("hypothesis_id")
    if comparative:
        return hyps.select(
            name, "title", "before_support", F.bround("before_rate", 4).alias("before_rate"),
            "after_support", F.bround("after_rate", 4).alias("after_rate"), "rejected", "p_value")
    return hyps.select(name, "title", "support", F.bround("rate", 4).alias("rate"), "rejected")


def cohort_overview(scoped: DataFrame) -> DataFrame:
    """Sizes, filter counts and date range per cohort.

    ``scoped`` has a row per session: cohort, start_time, passed.
    """
    return scoped.groupBy("cohort").agg(
        F.count("*").alias("candidates"), F.count_if(F.col("passed")).alias("after_filters"),
        F.min("start_time").alias("first_start"), F.max("start_time").alias("last_start"))


def counter_example_table(examples: DataFrame, max_per: int = EXAMPLES) -> DataFrame:
    w = W.partitionBy("hypothesis_id").orderBy("pick", "session_id")
    return examples.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_per).select(
        "hypothesis_id", "session_id", "pick")


def histogram(fv: DataFrame, metric: str, cohort: str = "all", bins: int = BINS) -> DataFrame:
    """(bin, low, high, n): equal-width counts of one measure, empty bins left out."""
    rows = fv if cohort == "all" else fv.where(F.col("cohort") == cohort)
    values = rows.where(F.col(metric).isNotNull()).select(F.col(metric).cast("double").alias("v"))
    span = values.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    placed = values.withColumn("_s", span)
    lo, hi = F.col("_s.lo"), F.col("_s.hi")
    width = (hi - lo) / bins
    at = F.when(hi == lo, 0).otherwise(F.least(F.floor((F.col("v") - lo) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    return placed.groupBy(at.cast("long").alias("bin"), lo.alias("_lo"), width.alias("_w")).agg(F.count("*").alias("n")).select(
        "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("low"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("high"), "n")


def aspect_plot_data(aspects: DataFrame) -> DataFrame:
    return aspects.select(F.coalesce("name", "id").alias("label"), "before", "after", "delta_pct")


def hypothesis_plot_data(hyps: DataFrame) -> DataFrame:
    def pct(c: str) -> Column:
        return (F.coalesce(F.col(c), F.lit(0.0)) * 100).alias(c + "_pct")

    return hyps.select(F.coalesce("title", "id").alias("label"), pct("before_rate"), pct("after_rate"))


def per_conversation(values: DataFrame, hypotheses: list[str], prefix: str = "hyp_") -> DataFrame:
    """(session_id, cohort, values, hypotheses): the row written per session."""
    flags = [F.col(prefix + h).alias(h) for h in hypotheses]
    rest = [c for c in values.columns if c not in ("session_id", "cohort") and not c.startswith(prefix)]
    return values.select("session_id", "cohort", F.struct(*rest).alias("values"), F.struct(*flags).alias("hypotheses"))
