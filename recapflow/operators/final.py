"""Wrap-up of finished sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recapflow.functions import text as X
from recapflow.functions import times as TM
from recapflow.functions.ordered import top_n
from recapflow.functions.stages import settled
from recapflow.operators import budget, infer
from recapflow.operators.summaries import save
from recapflow.params import DEFAULTS, Params

# Fixed values.
EVENTS = 40
THREADS = 8
PER_TICK = 2
MAX_ATTEMPTS = 3
TOKENS = 320


def pending(sessions: DataFrame, events: DataFrame, now: Column, attempts: DataFrame | None = None,
            limit: int | None = None, p: Params = DEFAULTS) -> DataFrame:
    """Recently finished sessions with events and no wrap-up, tried fewer than three times. A ``limit``, such as
    PER_TICK, keeps the newest."""
    recent = TM.seconds_between(now, F.col("ended_at")) <= p.max_age_hours * TM.HOUR
    rows = sessions.where(TM.is_finished(F.col("status")) & F.col("final_summary").isNull() & recent).join(
        events.select(F.col("session_id").alias("id")), "id", "left_semi"
    )
    if attempts is not None:
        worn = attempts.where(F.col("attempts") >= MAX_ATTEMPTS).select(F.col("session_id").alias("id"))
        rows = rows.join(worn, "id", "left_anti")
    return rows if limit is None else rows.orderBy(F.desc("id")).limit(limit)


def select_events(events: DataFrame) -> DataFrame:
    """40 most important events per session; present by (t_start or 0, id)."""
    return top_n(events, ["session_id"], [F.desc("importance"), F.desc("id")], EVENTS, "__rank").drop("__rank")


def select_threads(threads: DataFrame) -> DataFrame:
    """8 most recently moved storylines per channel, of any status."""
    return top_n(threads, ["channel_id"], [F.desc_nulls_last("last_updated_at"), F.asc("id")], THREADS)


def prompts(sessions: DataFrame, events: DataFrame, threads: DataFrame) -> DataFrame:
    line = F.concat(F.lit("- ["), TM.clock_hms(F.col("t_start")), F.lit(" | importance "), F.col("importance"), F.lit("] "), F.col("description"))
    mine = events.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    listed = select_events(mine).groupBy("session_id").agg(
        X.lines(F.collect_list(F.struct(F.coalesce("t_start", F.lit(0.0)).alias("o"), "id", line.alias("line")))).alias("events")
    )
    story = F.concat(F.lit("- "), F.col("title"), F.lit(" ("), F.col("status"), F.lit("): "), F.coalesce("summary", F.lit("")))
    stories = select_threads(threads).groupBy("channel_id").agg(
        X.lines(F.collect_list(F.struct("rank", story.alias("line")))).alias("stories")
    )
    none = F.lit("(none)")
    head = F.concat(
        F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("Title: "), F.col("title"), F.lit("\n"))).otherwise(""),
        F.when(F.coalesce("category", F.lit("")) != "", F.concat(F.lit("Category: "), F.col("category"), F.lit("\n"))).otherwise(""),
    )
    text = F.concat(head, F.lit("Events in order:\n"), F.coalesce("events", none), F.lit("\n\nStorylines at the end:\n"), F.coalesce("stories", none))
    return (
        sessions.select(F.col("id").alias("session_id"), "channel_id", "title", "category")
        .join(listed, "session_id", "left").join(stories, "channel_id", "left").select("session_id", text.alias("prompt"))
    )


def run(sessions: DataFrame, windows: DataFrame, events: DataFrame, threads: DataFrame, summaries: DataFrame, now: Column,
        model: Callable[[], infer.Model] = infer.StubModel, attempts: DataFrame | None = None, system: str = "",
        limit: int | None = None, p: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(sessions with final_summary filled in, new summary rows)."""
    paused = budget.status(sessions, windows, summaries, TM.month(now), p).where("paused").select(F.col("session_id").alias("id"))
    todo = pending(sessions, events, now, attempts, limit, p).join(paused, "id", "left_anti")
    done = settled(infer.run(prompts(todo, events, threads), model, system=system, max_tokens=TOKENS, p=p)).withColumn("raw", X.strip(F.col("raw")))
    told = done.where("raw <> ''").select(F.col("session_id").alias("id"), F.col("raw").alias("__text"))
    updated = sessions.join(told, "id", "left").withColumn("final_summary", F.coalesce("__text", "final_summary"))
    return updated.select(*sessions.columns), save(done, "final", now, p=p)
