"""Choosing sessions: scope scans, cohorts, id resolution, index rollups."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from parley.functions.predicates import is_reconnect
from parley.functions.text import filled



def channel_is(channel: str) -> Column:
    voice = F.col("voice_session_id").isNotNull()
    if channel == "voice":
        return voice
    if channel == "chat":
        return ~voice & (
            F.col("external_chat_session").isNotNull() | F.col("chat_transport_provider").isNotNull()
        )
    raise ValueError(f"channel must be 'voice' or 'chat', got {channel!r}")


def public_id() -> Column:
    return F.coalesce(filled(F.col("voice_session_id")), F.col("_id").cast("string"))


def scope_filter(tenant: str, origin_id: str, channel: str, start: Any, end: Any,
                 assistant_id: str | None = None) -> Column:
    """Tenant and time first: the columns the index should be partitioned by."""
    test = (
        (F.col("tenant") == tenant)
        & F.col("start_time").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
        & (F.col("assistant_origin_id") == origin_id)
        & channel_is(channel)
    )
    return test & (F.col("assistant_id") == assistant_id) if assistant_id else test


def scope_sessions(s: DataFrame, tenant: str, origin_id: str, channel: str, start: Any, end: Any,
                   assistant_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Public ids of the sessions in scope; both ends of the window count."""
    found = s.where(scope_filter(tenant, origin_id, channel, start, end, assistant_id))
    ids = found.select(public_id().alias("session_id"))
    return ids.limit(limit) if limit else ids


def cohorts(s: DataFrame, study: Mapping[str, Any]) -> DataFrame:
    """(session_id, internal_id, cohort): before and after of a comparative study, else all.

    One scan of the index. Windows may overlap; a session in both counts in both.
    """
    if study.get("study_type") == "comparative":
        windows = {"before": study["date_range_before"], "after": study["date_range_after"]}
    else:
        windows = {"all": study["date_range"]}
    tests = {
        label: scope_filter(study["tenant"], study["assistant_origin_id"], study.get("channel") or "voice",
                            span["start"], span["end"], study.get("assistant_id"))
        for label, span in windows.items()}
    labels = F.array_compact(F.array(*[F.when(test, F.lit(label)) for label, test in tests.items()]))
    return s.where(reduce(Column.__or__, tests.values())).select(
        public_id().alias("session_id"), F.col("_id").cast("string").alias("internal_id"),
        F.explode(labels).alias("cohort"))


def preview_count(s: DataFrame, **scope: Any) -> DataFrame:
    return scope_sessions(s, **scope).agg(F.count("*").alias("session_count"))


def tenants(s: DataFrame, limit: int | None = None) -> DataFrame:
    named = s.where(F.col("tenant").isNotNull() & ~F.col("tenant").isin("", "None"))
    names = named.select("tenant").distinct().orderBy("tenant")
    return names.limit(limit) if limit else names


def assistants(s: DataFrame, tenant: str, limit: int | None = None) -> DataFrame:
    """Session count and last start per assistant, busiest first; all, or the first ``limit``."""
    listed = (
        s.where((F.col("tenant") == tenant) & F.col("assistant_origin_id").isNotNull())
        .groupBy("assistant_origin_id")
        .agg(F.count("*").alias("session_count"), F.max("start_time").alias("last_start"))
        .orderBy(F.desc("session_count"), "assistant_origin_id")
    )
    return listed if limit is None else listed.limit(limit)


def events_for(ev: DataFrame, ids: DataFrame, key: str = "session_id") -> DataFrame:
    return ev.join(ids.select(key), key, "left_semi")


def resolve_ids(ids: DataFrame, s: DataFrame) -> DataFrame:
    """(session_id, internal_id): the index id behind a public id, else itself."""
    known = (
        s.where(F.col("voice_session_id").isNotNull())
        .groupBy(F.col("voice_session_id").alias("session_id"))
        .agg(F.max(F.col("_id").cast("string")).alias("_found"))
    )
    return ids.join(known, "session_id", "left").select(
        *ids.columns, F.coalesce("_found", "session_id").alias("internal_id"))


def resolve_known(ids: DataFrame, s: DataFrame) -> DataFrame:
    """As ``resolve_ids``, but null for an id that is neither public nor internal."""
    names = s.where(F.col("voice_session_id").isNotNull()).select(
        F.col("voice_session_id").alias("session_id"), F.col("_id").cast("string").alias("_found"),
        F.lit(1).alias("_rank")
    ).unionByName(s.select(
        F.col("_id").cast("string").alias("session_id"), F.col("_id").cast("string").alias("_found"),
        F.lit(2).alias("_rank")))
    best = names.groupBy("session_id").agg(F.min_by("_found", F.struct("_rank", "_found")).alias("internal_id"))
    return ids.join(best, "session_id", "left").select(*ids.columns, "internal_id")


def reconnects(s: DataFrame) -> DataFrame:
    return s.select("_id", public_id().alias("session_id"), is_reconnect().alias("is_reconnect"))
