"""Hourly timeline: beats for closed hours, the biggest events for the hours without beats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recapflow.functions import text as X
from recapflow.functions import times as TM
from recapflow.functions.ordered import last_before, top_n
from recapflow.functions.stages import settled
from recapflow.operators import budget, infer
from recapflow.params import DEFAULTS, Params
from recapflow.sources.documents import parse_beats

# Fixed values.
RUN_LABEL = "live"
LIVE_MIN_IMPORTANCE = 2
LIVE_PER_HOUR = 3
BEAT_MIN_IMPORTANCE = 3
EARLIER_HEADLINES = 4
HEADLINE_CHARS = 160
HOURS_PER_TICK = 3
PROMPT_VERSION = "beats-v1"
SKIP_REASON = "no notable events"


def timed_events(sessions: DataFrame, windows: DataFrame, events: DataFrame) -> DataFrame:
    """Events with ``at`` (wall seconds since the session started) and ``hour``."""
    w = windows.select(
        F.col("id").alias("window_id"), F.col("t_start").alias("w_start"), F.col("t_end").alias("w_end"), F.col("created_at").alias("closed_at")
    ).where("closed_at IS NOT NULL")
    s = sessions.where("started_at IS NOT NULL").select(F.col("id").alias("session_id"), "started_at")
    at = TM.elapsed(F.col("closed_at"), F.col("started_at"), F.col("w_start"), F.col("w_end"), F.col("t_start"))
    return (
        events.join(w, "window_id").join(s, "session_id")
        .select("session_id", "id", "importance", "description", at.alias("at"))
        .withColumn("hour", TM.hour_index(F.col("at")))
    )


def closed_hours(sessions: DataFrame, now: Column, p: Params = DEFAULTS) -> DataFrame:
    """Sessions with ``closed_hours``: all hours once ended, else those closed before the grace."""
    open_ = TM.is_running(F.col("status")) | F.col("ended_at").isNull()
    running = F.floor((TM.seconds_between(now, F.col("started_at")) - p.close_grace_seconds) / TM.HOUR)
    ended = F.floor(TM.seconds_between(F.col("ended_at"), F.col("started_at")) / TM.HOUR) + 1
    n = F.when(F.col("started_at").isNull(), 0).when(open_, F.greatest(running, F.lit(0))).otherwise(ended)
    return sessions.withColumn("closed_hours", n.cast("bigint"))


def due_hours(sessions: DataFrame, runs: DataFrame, now: Column, p: Params = DEFAULTS) -> DataFrame:
    """(session_id, hour) closed but without a run yet, for sessions running or ended within a day.

    Hours are many per session, which the planner's estimate of their size leaves out, so they are never broadcast."""
    recent = TM.seconds_between(now, F.col("ended_at")) <= p.max_age_hours * TM.HOUR
    due = (
        closed_hours(sessions.where(TM.is_running(F.col("status")) | recent), now, p).where("closed_hours > 0")
        .select(F.col("id").alias("session_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("closed_hours") - 1)).alias("hour"))
    )
    done = runs.where(F.col("run_label") == RUN_LABEL).select("session_id", F.col("hour_index").alias("hour"))
    return due.hint("merge").join(done, ["session_id", "hour"], "left_anti")


def next_due(due: DataFrame, limit: int = HOURS_PER_TICK) -> DataFrame:
    """The hours handled by one tick."""
    return due.orderBy("session_id", "hour").limit(limit)


def highlights(timed: DataFrame, runs: DataFrame) -> DataFrame:
    """Top events of every hour that has no finished run. An hour marked skipped keeps its highlights."""
    done = runs.where((F.col("run_label") == RUN_LABEL) & (F.col("status") == "done")).select(
        "session_id", F.col("hour_index").alias("hour")
    )
    shown = timed.where(F.col("importance") >= LIVE_MIN_IMPORTANCE).join(done, ["session_id", "hour"], "left_anti")
    return top_n(shown, ["session_id", "hour"], [F.desc("importance"), F.desc("at"), F.asc("id")], LIVE_PER_HOUR)


def timeline(sessions: DataFrame, windows: DataFrame, events: DataFrame, beats: DataFrame, runs: DataFrame) -> DataFrame:
    """Timeline items of all sessions: beats and highlights. Sort by (session_id, at) to present."""
    at = F.coalesce("t_start", F.lit(0.0))
    told = beats.where(F.col("run_label") == RUN_LABEL).select(
        "session_id", at.alias("at"), F.col("hour_index").alias("hour"), "headline", "significance", F.lit("beat").alias("kind")
    )
    shown = highlights(timed_events(sessions, windows, events), runs).select(
        "session_id", "at", "hour", F.col("description").alias("headline"), F.col("importance").alias("significance"), F.lit("event").alias("kind")
    )
    return told.unionByName(shown).withColumn("clock", TM.clock_hm(F.col("at")))


def notable(timed: DataFrame, hours: DataFrame) -> DataFrame:
    return timed.where(F.col("importance") >= BEAT_MIN_IMPORTANCE).join(hours.hint("merge"), ["session_id", "hour"], "left_semi")


def earlier(hours: DataFrame, beats: DataFrame, n: int = EARLIER_HEADLINES) -> DataFrame:
    """Last headlines of the hours before each given hour; ``back`` = 1 is the nearest."""
    left = hours.select("session_id", "hour", F.lit(float("-inf")).alias("at"), F.lit(-1).cast("bigint").alias("id"))
    right = beats.select("session_id", F.col("hour_index").alias("hour"), F.coalesce("t_start", F.lit(float("-inf"))).alias("at"), "id", "headline")
    return last_before(left, right, ["session_id"], ["hour", "at", "id"], n, F.floor(F.col("hour") / 24)).select(
        "session_id", "hour", "back", "headline"
    )


def prompts(timed: DataFrame, hours: DataFrame, beats: DataFrame) -> DataFrame:
    """Prompt per hour: its notable events in order and the headlines already given."""
    line = F.concat(
        F.lit("- id "), F.col("id"), F.lit(" ["), TM.clock_hm(F.col("at")), F.lit(" | importance "), F.col("importance"), F.lit("] "), F.col("description")
    )
    listed = notable(timed, hours).groupBy("session_id", "hour").agg(
        X.lines(F.collect_list(F.struct("at", "id", line.alias("line")))).alias("events")
    )
    before = earlier(hours, beats).groupBy("session_id", "hour").agg(
        X.lines(F.collect_list(F.struct((-F.col("back")).alias("o"), F.concat(F.lit("- "), F.col("headline")).alias("line")))).alias("given")
    )
    text = F.concat(
        F.lit("Stream hour "), F.col("hour") + 1, F.lit("\nEvents in order:\n"), F.col("events"),
        F.when(F.col("given").isNotNull(), F.concat(F.lit("\n\nAlready on the timeline:\n"), F.col("given"))).otherwise(""),
    )
    return listed.join(before, ["session_id", "hour"], "left").select("session_id", "hour", text.alias("prompt"))


def ground(proposals: DataFrame, timed: DataFrame) -> DataFrame:
    """Keep the proposed beats that name at least one notable event of their hour. ``proposals``:
    session_id, hour, proposal (see ``parse_beats``). Adds beat_no, headline, significance, event_ids, t_start, t_end."""
    beats = proposals.select(
        "session_id", "hour", F.posexplode("proposal.beats").alias("beat_no", "b")
    ).select("session_id", "hour", "beat_no", X.strip(F.col("b.headline")).alias("headline"), "b.significance", "b.event_ids")
    cited = beats.where("headline <> ''").withColumn("id", F.explode(F.array_distinct("event_ids"))).drop("event_ids")
    known = timed.where(F.col("importance") >= BEAT_MIN_IMPORTANCE).select("session_id", "hour", "id", "at")
    return (
        cited.join(known, ["session_id", "hour", "id"])
        .groupBy("session_id", "hour", "beat_no", X.cap(F.col("headline"), HEADLINE_CHARS).alias("headline"), "significance")
        .agg(F.array_sort(F.collect_list("id")).alias("event_ids"), F.min("at").alias("t_start"), F.max("at").alias("t_end"))
    )


def generate(sessions: DataFrame, windows: DataFrame, events: DataFrame, summaries: DataFrame, beats: DataFrame,
             runs: DataFrame, now: Column, model: Callable[[], infer.Model] = infer.StubModel, system: str = "",
             limit: int | None = None, p: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(new beats, new runs) for all due hours within budget, or the first ``limit`` of them. Hours without notable
    events are marked skipped; a failed call or an invalid reply leaves no mark, so the hour stays due; a valid reply
    without beats closes the hour."""
    due = due_hours(sessions, runs, now, p)
    due = due if limit is None else next_due(due, limit)
    within = budget.status(sessions, windows, summaries, TM.month(now), p).where(~F.col("paused")).select("session_id")
    hours = due.join(within, "session_id", "left_semi")
    timed = timed_events(sessions, windows, events)
    asked = settled(infer.run(prompts(timed, hours, beats), model, kind="json", system=system, p=p))
    parsed = parse_beats(asked).where("proposal IS NOT NULL")
    made = ground(parsed.select("session_id", "hour", "proposal"), timed).join(
        parsed.select("session_id", "hour", X.approx_tokens(F.col("prompt")).alias("tokens_in")), ["session_id", "hour"]
    ).select(
        "session_id", F.col("hour").alias("hour_index"), F.lit(RUN_LABEL).alias("run_label"), "beat_no", "headline", "significance",
        "event_ids", "t_start", "t_end", F.lit("final").alias("status"), F.lit(PROMPT_VERSION).alias("prompt_version"),
        "tokens_in", X.approx_tokens(F.col("headline")).alias("tokens_out"), now.alias("created_at"),
    )
    def mark(rows: DataFrame, status: str, reason: str | None) -> DataFrame:
        return rows.select("session_id", F.col("hour").alias("hour_index"), F.lit(RUN_LABEL).alias("run_label"),
                           F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"), now.alias("created_at"))

    quiet = hours.hint("merge").join(asked.select("session_id", "hour"), ["session_id", "hour"], "left_anti")
    return made, mark(parsed, "done", None).unionByName(mark(quiet, "skipped", SKIP_REASON))
