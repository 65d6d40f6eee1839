"""Set-level steps over a table of change proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parley.functions.text import filled, strip

# The order of confidence, and how much of a summary is shown.
CONFIDENCE = {"high": 0, "medium": 1, "low": 2}
UNRANKED = 9
SUMMARY_CHARS = 120


def best_per_key(df: DataFrame, key: str = "target_key", rank: str = "confidence", seq: str = "seq",
                 ranks: dict[str, int] = CONFIDENCE) -> DataFrame:
    """The row of highest confidence per key, the first on ties; no key, no row.

    A combining aggregate, so a key of any size reaches the shuffle as one row
    per task.
    """
    level = F.lit(UNRANKED)
    for name, value in ranks.items():
        level = F.when(F.coalesce(rank, F.lit("low")) == name, value).otherwise(level)
    best = F.min_by(F.struct(*df.columns), F.struct(level, F.col(seq)))
    keyed = df.where(F.length(F.col(key).cast("string")) > 0)
    return keyed.groupBy(F.col(key).alias("_k")).agg(best.alias("_best")).select("_best.*")


def first_per_title(df: DataFrame, title: str = "title", seq: str = "seq") -> DataFrame:
    """The first row per title, ignoring case and outer blanks; blank titles all stay."""
    named = df.withColumn("_t", F.lower(strip(F.coalesce(title, F.lit("")))))
    first = named.where(F.col("_t") != "").groupBy("_t").agg(
        F.min_by(F.struct(*df.columns), F.col(seq)).alias("_first")).select("_first.*")
    return named.where(F.col("_t") == "").select(*df.columns).unionByName(first)


def findings(df: DataFrame, shown: int = SUMMARY_CHARS) -> DataFrame:
    """Distinct findings: by id, else by the whole summary, of which ``shown`` characters are shown."""
    key = F.struct(filled(F.col("e.finding_id")).alias("id"), F.when(filled(F.col("e.finding_id")).isNull(), filled(F.col("e.summary"))).alias("summary"))
    return (
        df.select(F.explode_outer("evidence").alias("e")).select(key.alias("k")).distinct()
        .withColumn("finding", F.coalesce("k.id", F.substring("k.summary", 1, shown)))
        .where(F.col("finding").isNotNull()).orderBy("finding", "k.summary").select("finding")
    )


def evidence_sessions(df: DataFrame, n: int | None = None) -> DataFrame:
    """(id, session_ids[]): distinct ids of a proposal's evidence in order; all, or the first ``n``."""
    lists = F.transform(F.col("evidence"), lambda e: F.coalesce(e.session_ids, F.array().cast("array<string>")))
    ids = F.array_distinct(F.flatten(lists))
    ids = ids if n is None else F.slice(ids, 1, n)
    return df.select("id", F.coalesce(ids, F.array().cast("array<string>")).alias("session_ids"))


def conflicts(df: DataFrame) -> DataFrame:
    """Pending rows whose key already has an applied row."""
    applied = df.where((F.col("status") == "applied") & (F.length("target_key") > 0)).select("target_key").distinct()
    return df.where(F.col("status") == "pending").join(applied, "target_key", "left_semi")
