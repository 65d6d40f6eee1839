"""The event log of a session: cleaning, turns, transcripts, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parley.functions import events as E
from parley.functions.predicates import is_reconnect
from parley.functions.text import filled
from parley.operators.ordering import PART_ROWS, SLICE_ROWS, LargeKeys, collect_parts, with_position
from parley.operators.scope import events_for, public_id


def only_types(ev: DataFrame, types: list[str] | None = None) -> DataFrame:
    return ev.where(E.of_type(*(types or E.DISPLAY_TYPES)))


def drop_debug(ev: DataFrame) -> DataFrame:
    return ev.where(F.col("is_debug_event") == F.lit(False))


def dedupe_session_end(ev: DataFrame) -> DataFrame:
    """Keep the first SESSION_END of each session and every other event.

    Only SESSION_END rows are shuffled, one per session and map task; the bulk
    of the log passes through untouched.
    """
    is_end = F.coalesce(E.of_type(E.SESSION_END), F.lit(False))
    first = (
        ev.where(is_end).groupBy("session_id")
        .agg(F.min_by(F.struct(*ev.columns), E.event_order()).alias("_first"))
        .select("_first.*")
    )
    return ev.where(~is_end).unionByName(first)


def dedupe_by_field(ev: DataFrame, field: str = "secs_since_session_start") -> DataFrame:
    """Of events sent again (same session, type and ``field``) keep the first.

    Events without the field are never taken for copies.
    """
    known = F.col(field).isNotNull()
    first = (
        ev.where(known).groupBy("session_id", "event_type", field)
        .agg(F.min_by(F.struct(*ev.columns), E.event_order()).alias("_first"))
        .select("_first.*")
    )
    return ev.where(~known).unionByName(first)


def turns(ev: DataFrame) -> DataFrame:
    """One row per request with a user query or a final response.

    ``started`` is the first event of the request and gives the turn order.
    """
    order = E.event_order()
    user, bot = E.of_type(E.USER_QUERY), E.of_type(E.RESPONSE_FINAL)

    def first(col: str, test) -> Column:
        return F.min_by(F.col(col), F.when(test, order))

    return (
        ev.where(filled(F.col("request_id")).isNotNull())
        .groupBy("session_id", "request_id")
        .agg(F.min(order).alias("started"),
             F.bool_or(user | bot).alias("_any"),
             F.coalesce(first("content", user), F.lit("")).alias("user"),
             F.coalesce(first("content", bot), F.lit("")).alias("bot"),
             first("agent_name", bot).alias("agent_name"))
        .where("_any").drop("_any")
    )


def transcript(turn_rows: DataFrame, grouped: bool = False) -> DataFrame:
    """(session_id, idx, speaker, text): non-empty lines, user before bot in a turn.

    ``grouped`` puts all user lines of a session before all bot lines.
    """
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.lit("User").alias("speaker"), F.col("user").alias("text")),
        F.struct(F.lit(1).alias("side"), F.lit("Bot").alias("speaker"), F.col("bot").alias("text")),
    )
    lines = turn_rows.select(
        "session_id", "started", "request_id",
        F.explode(F.filter(sides, lambda x: x.text != "")).alias("_l"),
    ).select("session_id", "started", "request_id", "_l.*")
    order = ["side", "started", "request_id"] if grouped else ["started", "request_id", "side"]
    return with_position(lines, ["session_id"], order, "idx").select(
        "session_id", "idx", "speaker", "text")


def turn_rows_for(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Turn rows of the given sessions, sorted by time within each session."""
    return events_for(rows, ids).orderBy("session_id", "created_at")


def session_detail(rows: DataFrame, s: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(session_id, part, turn_count, is_reconnect, turns[]) from turn rows."""
    fields = [c for c in rows.columns if c != "session_id"]
    parts = collect_parts(rows, ["session_id"], ["created_at"], F.struct(*fields), "turns", part_rows)
    sizes = rows.groupBy("session_id").agg(F.count("*").alias("turn_count"))
    flags = s.select(public_id().alias("session_id"), is_reconnect().alias("is_reconnect"))
    return (
        parts.join(sizes, "session_id").join(flags, "session_id", "left")
        .withColumn("is_reconnect", F.coalesce("is_reconnect", F.lit(False)))
    )


def session_text(ev: DataFrame, part_rows: int = PART_ROWS, large: LargeKeys | None = None) -> DataFrame:
    """(session_id, part, last, searchable_text, pieces): contents and JSON of all events.

    Lower case, newline between pieces, in event order; ``pieces`` holds them one by one.
    A session of up to ``part_rows`` events has the one part 0; no session's text has to fit
    in one row. Rules search the parts as one text, see ``functions.spans``.
    """
    piece = F.lower(F.concat_ws("\n", filled(F.col("content")),
                                F.nullif(F.col("event_value"), F.lit("{}"))))
    kept = ev.withColumn("_piece", piece).where("_piece <> ''")
    parts = collect_parts(kept, ["session_id"], ["timestamp", "event_id"], F.col("_piece"), "pieces", part_rows,
                          SLICE_ROWS, large, ahead=1)
    return parts.select("session_id", "part", (F.size("following") == 0).alias("last"),
                        F.array_join("pieces", "\n").alias("searchable_text"), "pieces")


def event_counts(ev: DataFrame, include_debug: bool = True, dedup: bool = False,
                 types: list[str] | None = None) -> DataFrame:
    """Audit per session. Span and raw count cover the timeline before the type
    filter and the SESSION_END dedupe.

    One pass: dropping repeated SESSION_END events only lowers a count, so no row
    has to be removed for it. The SESSION_END kept is the first, whose debug flag
    is the one that counts.
    """
    base = ev if include_debug else drop_debug(ev)
    us = E.micros(F.col("timestamp"))
    shown = E.of_type(*types) if types else F.lit(True)
    end = E.of_type(E.SESSION_END)
    debug = F.coalesce("is_debug_event", F.lit(False))
    single = shown & end if dedup else F.lit(False)
    plain = shown & ~single
    first_end_debug = F.coalesce(F.min_by(debug, F.when(single, E.event_order())), F.lit(False))
    return (
        base.groupBy("session_id")
        .agg(
            (F.count_if(plain) + F.coalesce(F.max(single.cast("long")), F.lit(0))).alias("events_shown"),
            F.count("*").alias("raw_event_count"),
            F.count_distinct(F.when(shown, F.col("event_type"))).alias("active_types"),
            F.bround((F.max(us) - F.min(us)) / 60_000_000.0, 1).alias("span_minutes"),
            (F.count_if(plain & debug) + first_end_debug.cast("long")).alias("debug_event_count"),
        )
        .withColumn("non_debug_event_count", F.col("events_shown") - F.col("debug_event_count"))
    )


def type_histogram(ev: DataFrame) -> DataFrame:
    return ev.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


def fingerprint(ev: DataFrame) -> DataFrame:
    """A hash per session that changes when its event log does."""
    us = E.micros(F.col("timestamp"))
    return (
        ev.groupBy("session_id")
        .agg(F.count("*").alias("_n"), F.min(us).alias("_lo"), F.max(us).alias("_hi"),
             F.max_by("event_id", E.event_order()).alias("_last"))
        .select("session_id", F.sha2(F.concat_ws("|", "session_id", "_n", "_lo", "_hi", "_last"), 256)
                .alias("fingerprint"))
    )
