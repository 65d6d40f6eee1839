"""A short summary of each explored session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parley.functions import events as E
from parley.functions.text import filled, has_text
from parley.operators.ordering import with_position
from parley.operators.primitives import count_of

# Digest sizes, the words that mark a telling line, the snapshot.
SHORT_LINES, HEAD, MIDDLE, TAIL = 8, 3, 3, 2
TELLING = ("error", "transfer", "sorry")
SNAPSHOT = [
    "turn_count", "main_stream_latency_p95", "main_stream_estimated_cost_usd", "tool_error_count",
    "guardrail_triggered", "opening_intent_class", "session_outcome", "main_stream_model",
]


def primitive_snapshot(fv: DataFrame) -> Column:
    return F.struct(*[c for c in SNAPSHOT if c in fv.columns])


def transcript_digest(lines: DataFrame) -> DataFrame:
    """(session_id, transcript_digest[]): at most eight lines of each transcript.

    Up to eight lines are all kept; else the first three, up to three telling
    ones and the last two, a line possibly twice. ``lines`` has (session_id, idx,
    speaker, text) with idx from 0, so a line's role follows from its own number
    and the transcript's length.
    """
    size = lines.groupBy("session_id").agg((F.max("idx") + 1).alias("_n"))
    tells = [has_text(F.col("text"), w) for w in TELLING]
    telling = with_position(lines.where(tells[0] | tells[1] | tells[2]), ["session_id"], ["idx"], "_hit")
    long = F.col("_n") > SHORT_LINES

    def part(rows: DataFrame, keep: Column, rank: int) -> DataFrame:
        return rows.join(size, "session_id").where(keep).select(
            "session_id", F.struct(F.lit(rank).alias("part"), "idx", "speaker", "text").alias("_l"))

    head = part(lines, ~long | (F.col("idx") < HEAD), 0)
    middle = part(telling, long & (F.col("_hit") < MIDDLE), 1)
    tail = part(lines, long & (F.col("idx") >= F.col("_n") - TAIL), 2)
    return head.unionByName(middle).unionByName(tail).groupBy("session_id").agg(
        F.transform(F.sort_array(F.collect_list("_l")), lambda x: F.struct(
            x.speaker.alias("speaker"), x.text.alias("text"))).alias("transcript_digest"))


def anomaly_flags() -> Column:
    """Sorted distinct anomalies among a session's events, at most five."""
    ended = F.coalesce(filled(F.col("status")), F.col("end_reason"))
    flagged = F.coalesce(F.col("would_block"), F.lit(False)) | F.coalesce(F.size("flagged_categories") > 0, F.lit(False))
    def nothing(c: str) -> Column:
        return F.coalesce(filled(F.col(c)).isin("[]", "{}"), F.lit(False)) | filled(F.col(c)).isNull()

    empty = nothing("result") & nothing("output")
    found = (
        F.when(E.of_type(E.TOOL_ERROR), "tool_call_error")
        .when(E.of_type(E.GUARDRAIL) & flagged, "guardrail_block")
        .when(E.of_type(E.SESSION_END) & has_text(ended, "timeout"), "timeout")
        .when(E.of_type(E.LLM_ERROR), "llm_error")
        .when(E.of_type(E.TOOL_RESULT) & empty, "empty_tool_result")
    )
    return F.sort_array(F.collect_set(found))


def notable_events(tool_errors: Column, transfers: Column, interruptions: Column, model: Column,
                   guardrail: Column) -> Column:
    def counted(n: Column, what: str) -> Column:
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {what}(s)")))

    return F.array_compact(F.array(
        counted(tool_errors, "tool error"), counted(transfers, "transfer"),
        counted(interruptions, "interruption"),
        F.when(filled(model).isNotNull(), F.concat(F.lit("main_stream model="), model)),
        F.when(guardrail, F.lit("guardrail triggered"))))


def notable(ev: DataFrame, fv: DataFrame) -> DataFrame:
    """(session_id, notable_events[], anomaly_flags[])."""
    counts = E.complete(ev).groupBy("session_id").agg(
        count_of(E.TOOL_ERROR).alias("_te"), count_of(E.TRANSFER).alias("_tr"), anomaly_flags().alias("anomaly_flags"))
    both = fv.select("session_id", "interruption_count", "main_stream_model", "guardrail_triggered").join(counts, "session_id", "left")
    return both.select(
        "session_id",
        notable_events(F.coalesce("_te", F.lit(0)), F.coalesce("_tr", F.lit(0)), F.col("interruption_count"),
                       F.col("main_stream_model"), F.coalesce("guardrail_triggered", F.lit(False))).alias("notable_events"),
        F.coalesce("anomaly_flags", F.array().cast("array<string>")).alias("anomaly_flags"))


def _shown(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("None"))


def digests(ev: DataFrame, fv: DataFrame, lines: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One digest per row of ``fv``; ``labels`` adds cohort_label by session."""
    out = fv.select(
        "session_id", F.col("opening_intent_class").alias("opening_intent"), F.col("session_outcome").alias("outcome"),
        "turn_count", F.col("session_duration_ms").alias("duration_ms"), primitive_snapshot(fv).alias("primitive_snapshot"),
        F.array(
            F.concat(F.lit("turns="), _shown("turn_count"), F.lit(" outcome="), _shown("session_outcome")),
            F.concat(F.lit("intent="), _shown("opening_intent_class"), F.lit(" model="), _shown("main_stream_model")),
            F.concat(F.lit("latency_p95="), _shown("main_stream_latency_p95"), F.lit("ms tools="), _shown("tool_invocation_count")),
        ).alias("bullets"),
    )
    out = out.join(notable(ev, fv), "session_id", "left").join(transcript_digest(lines), "session_id", "left")
    if labels is not None:
        out = out.join(labels.select("session_id", F.col("cohort").alias("cohort_label")), "session_id", "left")
    return out


def label_samples(manifest: DataFrame, ids: DataFrame) -> DataFrame:
    """(session_id, cohort_label): the manifest's label, all where it has none."""
    labels = manifest.groupBy("session_id").agg(F.max("cohort").alias("cohort_label"))
    return ids.join(labels, "session_id", "left").withColumn("cohort_label", F.coalesce("cohort_label", F.lit("all")))
