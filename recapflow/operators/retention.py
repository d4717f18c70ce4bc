"""Removing what must not be kept: expired sessions with all their rows, voice data without consent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recapflow.functions import times as TM
from recapflow.operators import consent
from recapflow.params import DEFAULTS, Params

# Longest transcript retention per mode.
MODE_DAYS = {"private": 365, "public": 30}

BY_SESSION = ("segments", "windows", "events", "summaries", "summary_feedback", "ingest_gaps", "plot_beats", "beat_runs")
BY_PARENT = {
    "event_participants": ("events", "event_id"), "attributions": ("segments", "segment_id"),
    "segment_embeddings": ("segments", "segment_id"),
}


def days(p: Params = DEFAULTS) -> int:
    return min(p.transcript_retention_days, MODE_DAYS["public" if p.app_mode == "public" else "private"])


def expired_sessions(sessions: DataFrame, now: Column, p: Params = DEFAULTS) -> DataFrame:
    """Ids of closed sessions that started before the retention limit."""
    age = TM.seconds_between(now, F.col("started_at"))
    return sessions.where(F.col("status").isin(*TM.CLOSED) & (age > max(0, days(p)) * consent.DAY)).select(F.col("id").alias("session_id"))


def cascade(tables: dict[str, DataFrame], expired: DataFrame) -> dict[str, DataFrame]:
    """All given tables without the rows that belong to expired sessions."""
    out = dict(tables)

    def children(parent: str, key: str) -> DataFrame:
        return tables[parent].join(expired, "session_id", "left_semi").select(F.col("id").alias(key))

    for name in BY_SESSION:
        if name in tables:
            out[name] = tables[name].join(expired, "session_id", "left_anti").select(*tables[name].columns)
    for name, (parent, key) in BY_PARENT.items():
        if name in tables and parent in tables:
            out[name] = tables[name].join(children(parent, key), key, "left_anti").select(*tables[name].columns)
    if "beat_events" in tables:
        kept = tables["beat_events"]
        for parent, key in (("events", "event_id"), ("plot_beats", "beat_id")):
            if parent in tables:
                kept = kept.join(children(parent, key), key, "left_anti")
        out["beat_events"] = kept.select(*tables["beat_events"].columns)
    if "entities" in tables:
        ent = tables["entities"]
        gone = expired.select(F.col("session_id").alias("first_seen_session"), F.lit(True).alias("__gone"))
        out["entities"] = ent.join(gone, "first_seen_session", "left").withColumn(
            "first_seen_session", F.when(F.col("__gone").isNull(), F.col("first_seen_session"))
        ).select(*ent.columns)
    if "sessions" in tables:
        out["sessions"] = tables["sessions"].join(expired.select(F.col("session_id").alias("id")), "id", "left_anti").select(*tables["sessions"].columns)
    return out


def enforce(tables: dict[str, DataFrame], now: Column, p: Params = DEFAULTS) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables after retention, one row of removal counts). Embeddings of speakers without active consent go
    whatever their age."""
    expired = expired_sessions(tables["sessions"], now, p)
    out = cascade(tables, expired)
    voices = tables["speaker_embeddings"]
    if p.consent_required:
        bare = tables["speakers"].select(F.col("id").alias("speaker_id")).join(
            consent.active(tables["consents"], now, p).select("speaker_id"), "speaker_id", "left_anti"
        )
        out["speaker_embeddings"] = voices.join(bare, "speaker_id", "left_anti").select(*voices.columns)
        lost = voices.join(bare, "speaker_id", "left_semi")
    else:
        lost = voices.where(F.lit(False))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    counts = expired.select(one.alias("sessions"), zero.alias("embeddings")).unionByName(
        lost.select(zero.alias("sessions"), one.alias("embeddings"))
    )
    return out, counts.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("sessions", "embeddings")])
