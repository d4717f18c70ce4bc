"""Session snapshots for evaluation and export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recapflow.functions.ordered import time_block
from recapflow.params import DEFAULTS, Params


def window_counts(windows: DataFrame) -> DataFrame:
    return windows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(F.col("status") == "done").alias("completed_windows"),
        F.count_if(F.col("status") == "failed").alias("failed_windows"),
    )


def snapshot_counts(sessions: DataFrame, segments: DataFrame, windows: DataFrame, events: DataFrame) -> DataFrame:
    """One row per session: status and row counts."""
    def n(df: DataFrame, out: str) -> DataFrame:
        return df.groupBy("session_id").agg(F.count(F.lit(1)).alias(out))

    return (
        sessions.select(F.col("id").alias("session_id"), "status", "last_error")
        .join(n(segments, "segments"), "session_id", "left").join(window_counts(windows), "session_id", "left")
        .join(n(events, "events"), "session_id", "left")
        .na.fill(0, ["segments", "windows", "completed_windows", "failed_windows", "events"])
    )


def transcript_parts(segments: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(session_id, part, text): the transcript in parts of one stream hour. Joined by blanks in part order
    they give the whole text; no session is ever held in one row."""
    ordered = F.array_sort(F.collect_list(F.struct("t_start", "id", "text")))
    return segments.groupBy("session_id", time_block("t_start", p.chunk_seconds).alias("part")).agg(
        F.array_join(F.transform(ordered, lambda s: s["text"]), " ").alias("text")
    )


def items(windows: DataFrame, events: DataFrame, summaries: DataFrame, entities: DataFrame, threads: DataFrame, sessions: DataFrame) -> DataFrame:
    """The lists of a snapshot as rows (session_id, list, item_id, text)."""
    def rows(df: DataFrame, name: str, text: str) -> DataFrame:
        return df.select("session_id", F.lit(name).alias("list"), F.col("id").alias("item_id"), F.col(text).alias("text"))

    owner = sessions.select(F.col("id").alias("session_id"), "channel_id")
    out = rows(windows.where("window_summary <> ''"), "window_summaries", "window_summary")
    for part in (
        rows(events, "events", "description"), rows(summaries.where("kind = 'rolling'"), "rolling_summaries", "text"),
        rows(entities.where("status <> 'merged'").join(owner, "channel_id"), "entities", "canonical_name"),
        rows(threads.join(owner, "channel_id"), "threads", "title"),
    ):
        out = out.unionByName(part)
    return out
