"""Catch-up recap and cumulative summary: material-change keys, choice of events, prompts, cache split."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recapflow.functions import text as X
from recapflow.functions import times as TM
from recapflow.functions.ordered import top_n
from recapflow.functions.stages import settled
from recapflow.operators import budget, infer
from recapflow.operators.summaries import latest, save, simplify
from recapflow.operators.transcript import replace_speaker_ids
from recapflow.params import DEFAULTS, Params

# Fixed values.
FULL_VERSION = "session-v4"
NOTABLE = 3
RECENT_EVENTS, CHOSEN_EVENTS = 60, 30
OPEN_THREADS = 6
BEAT_LINES = 120
EARLY_EVENTS = 20
RECAP_WORDS, FULL_WORDS = 100, 200
RECAP_TOKENS, FULL_TOKENS, PREVIEW_TOKENS = 350, 550, 160
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def keys(sessions: DataFrame, events: DataFrame, threads: DataFrame) -> DataFrame:
    """Recap key per session, "<max event id>:<latest storyline change of the channel>"."""
    top = events.groupBy("session_id").agg(F.max("id").alias("max_event"))
    moved = threads.groupBy("channel_id").agg(F.max("last_updated_at").alias("moved"))
    stamp = F.coalesce(F.date_format("moved", STAMP), F.lit(""))
    return (
        sessions.select(F.col("id").alias("session_id"), "channel_id").join(top, "session_id", "left").join(moved, "channel_id", "left")
        .select("session_id", F.concat(F.coalesce("max_event", F.lit(0)), F.lit(":"), stamp).alias("key"))
    )


def full_keys(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Cumulative key: changes with the first event, every third one after it, and any notable one."""
    counted = events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("importance") >= NOTABLE, F.col("id"))).alias("notable")
    )
    n = F.coalesce("n", F.lit(0))
    step = F.when(n > 0, F.floor((n - 1) / 3) + 1).otherwise(0)
    return sessions.select(F.col("id").alias("session_id")).join(counted, "session_id", "left").select(
        "session_id", F.concat_ws(":", F.lit(FULL_VERSION), F.coalesce("notable", F.lit(0)).cast("string"), step.cast("string")).alias("full_key"),
        n.alias("event_count"),
    )


def status(sessions: DataFrame, events: DataFrame, threads: DataFrame) -> DataFrame:
    """Both keys of every session."""
    return keys(sessions, events, threads).join(full_keys(sessions, events), "session_id").drop("event_count")


def select_events(events: DataFrame) -> DataFrame:
    """Per session the most important 30 of the latest 60 events; present by id, newest first."""
    recent = top_n(events, ["session_id"], [F.desc("id")], RECENT_EVENTS, "__recent").drop("__recent")
    return top_n(recent, ["session_id"], [F.desc("importance"), F.desc("id")], CHOSEN_EVENTS, "__rank").drop("__rank")


def mark_new(chosen: DataFrame, summaries: DataFrame) -> DataFrame:
    """Flag events after the one recorded in the previous recap's key; no flags when there is none."""
    before = latest(summaries, "recap").select(
        "session_id", F.coalesce(F.substring_index("cache_key", ":", 1).try_cast("bigint"), F.lit(0)).alias("__seen")
    )
    seen = F.coalesce("__seen", F.lit(0))
    return chosen.join(before, "session_id", "left").withColumn("is_new", (seen != 0) & (F.col("id") > seen)).drop("__seen")


def event_line(full: bool = False) -> Column:
    new = F.lit("") if full else F.when(F.col("is_new"), "[NEW] ").otherwise("")
    return F.concat(F.lit("- "), new, F.lit("["), TM.clock_ms(F.col("t_start")), F.lit(" | importance "), F.col("importance"),
                    F.lit(" | "), F.coalesce("type", F.lit("None")), F.lit("] "), F.col("description"))


def open_threads(threads: DataFrame) -> DataFrame:
    """Six most recently moved unresolved storylines per channel."""
    return top_n(threads.where("status <> 'resolved'"), ["channel_id"], [F.desc_nulls_last("last_updated_at"), F.desc("id")], OPEN_THREADS)


def beat_history(beats: DataFrame) -> DataFrame:
    """First 120 beats of every session, in order."""
    return top_n(beats, ["session_id"], [F.asc("hour_index"), F.asc("id")], BEAT_LINES)


def early_events(events: DataFrame, chosen: DataFrame) -> DataFrame:
    """First 20 events of every session that are not among the chosen ones."""
    first = top_n(events, ["session_id"], [F.asc("id")], EARLY_EVENTS)
    return first.join(chosen.select("session_id", "id"), ["session_id", "id"], "left_anti")


def _block(rows: DataFrame, key: str, order: list[Column], line: Column, out: str) -> DataFrame:
    return rows.groupBy(key).agg(X.lines(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("line")))).alias(out))


def prompts(sessions: DataFrame, events: DataFrame, threads: DataFrame, summaries: DataFrame, feedback: DataFrame,
            names: DataFrame | None = None, max_words: int = RECAP_WORDS) -> DataFrame:
    """Recap prompt per session: open storylines, chosen events newest first with NEW marks, the previous
    recap and a hint for plain style; known speaker ids are replaced by names."""
    chosen = mark_new(select_events(events), summaries)
    listed = _block(chosen, "session_id", [-F.col("id")], event_line(), "events")
    line = F.concat(F.lit("- "), F.col("title"), F.lit(": "), F.coalesce("summary", F.lit("")))
    stories = _block(open_threads(threads), "channel_id", [F.col("rank")], line, "stories")
    before = latest(summaries, "recap").select("session_id", F.col("text").alias("previous"))
    plain = simplify(feedback).where("simplify").select("session_id", F.lit(True).alias("plain"))
    none = F.lit("(none)")
    text = F.concat(
        F.lit("Open storylines:\n"), F.coalesce("stories", none), F.lit("\n\nEvents, newest first:\n"), F.coalesce("events", none),
        F.lit(f"\n\nRecap in at most {max_words} words."),
        F.when(F.coalesce("previous", F.lit("")) != "", F.concat(F.lit("\n\nAlready shown:\n"), F.col("previous"))).otherwise(""),
        F.when(F.col("plain"), "\n\nUse short plain sentences.").otherwise(""),
    )
    out = (
        sessions.select(F.col("id").alias("session_id"), "channel_id")
        .join(listed, "session_id", "left").join(stories, "channel_id", "left")
        .join(before, "session_id", "left").join(plain, "session_id", "left")
        .select("session_id", "channel_id", text.alias("prompt"))
    )
    return out if names is None else replace_speaker_ids(out, names, "session_id", "prompt")


def full_prompts(sessions: DataFrame, events: DataFrame, beats: DataFrame, summaries: DataFrame,
                 names: DataFrame | None = None, max_words: int = FULL_WORDS) -> DataFrame:
    """Cumulative prompt per session: chosen events, the trusted previous text, and earlier history from
    beats, else from the first events. Storylines of the channel are left out on purpose."""
    chosen = select_events(events)
    listed = _block(chosen, "session_id", [-F.col("id")], event_line(full=True), "events")
    trusted = latest(summaries, "full").where(F.col("cache_key").startswith(FULL_VERSION + ":")).select(
        "session_id", F.nullif("text", F.lit("")).alias("previous")
    )
    told = F.concat(F.lit("- Hour "), F.col("hour_index") + 1, F.lit(": "), F.col("headline"))
    history = _block(beat_history(beats), "session_id", [F.col("rank")], told, "history")
    opening = _block(early_events(events, chosen), "session_id", [F.col("rank")], F.concat(F.lit("- "), F.col("description")), "opening")
    early = F.when(F.col("previous").isNull(), F.col("opening"))
    none = F.lit("(none)")
    text = F.concat(
        F.lit("Events, newest first:\n"), F.coalesce("events", none), F.lit("\n\nPrevious overview:\n"), F.coalesce("previous", none),
        F.lit("\n\nEarlier highlights:\n"), F.coalesce("history", early, none), F.lit(f"\n\nOverview in at most {max_words} words."),
    )
    out = (
        sessions.select(F.col("id").alias("session_id"), "channel_id").join(listed, "session_id", "left")
        .join(trusted, "session_id", "left").join(history, "session_id", "left").join(opening, "session_id", "left")
        .select("session_id", "channel_id", text.alias("prompt"))
    )
    return out if names is None else replace_speaker_ids(out, names, "session_id", "prompt")


def split_cached(state: DataFrame, summaries: DataFrame, kind: str, paused: DataFrame) -> DataFrame:
    """(session_id, key) with ``branch``: cached (same key), limited (over budget, an old text exists),
    rejected (over budget, none exists) or build. Adds the stored summary_id and text."""
    stored = latest(summaries, kind).select("session_id", F.col("id").alias("summary_id"), F.col("text").alias("stored"), F.col("cache_key").alias("__k"))
    over = paused.where("paused").select("session_id", F.lit(True).alias("__over"))
    branch = (
        F.when(F.col("__k") == F.col("key"), "cached")
        .when(F.col("__over") & F.col("summary_id").isNotNull(), "limited").when(F.col("__over"), "rejected").otherwise("build")
    )
    return state.join(stored, "session_id", "left").join(over, "session_id", "left").withColumn("branch", branch).drop("__k", "__over")


def recap(sessions: DataFrame, windows: DataFrame, events: DataFrame, threads: DataFrame, summaries: DataFrame,
          feedback: DataFrame, names: DataFrame, now: Column, model: Callable[[], infer.Model] = infer.StubModel,
          system: str = "", p: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(answers, new summary rows): cached text where nothing material changed, new text elsewhere. Only
    sessions in the build branch reach the model."""
    paused = budget.status(sessions, windows, summaries, TM.month(now), p)
    state = settled(split_cached(keys(sessions, events, threads), summaries, "recap", paused))
    build = state.where("branch = 'build'").select("session_id", F.col("key").alias("cache_key"))
    mine = sessions.join(build.select(F.col("session_id").alias("id")), "id", "left_semi")
    asked = infer.run(prompts(mine, events, threads, summaries, feedback, names), model, system=system, max_tokens=RECAP_TOKENS, p=p)
    done = settled(replace_speaker_ids(asked.join(build, "session_id"), names, "session_id", "raw"))
    stored = state.where("branch <> 'build'").select("session_id", "branch", F.col("stored").alias("text"))
    fresh = done.select("session_id", F.when(F.col("raw").isNull(), "unavailable").otherwise("fresh").alias("branch"), F.col("raw").alias("text"))
    return stored.unionByName(fresh), save(done, "recap", now, p=p)


def full(sessions: DataFrame, windows: DataFrame, events: DataFrame, beats: DataFrame, summaries: DataFrame,
         names: DataFrame, now: Column, model: Callable[[], infer.Model] = infer.StubModel, system: str = "",
         p: Params = DEFAULTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, new full rows, new preview rows). Sessions without events have no summary. A preview is
    cached under the same key as its full text; a failed preview never hides the full text."""
    paused = budget.status(sessions, windows, summaries, TM.month(now), p)
    known = full_keys(sessions, events).where("event_count > 0").select("session_id", F.col("full_key").alias("key"))
    state = settled(split_cached(known, summaries, "full", paused))
    build = state.where("branch = 'build'").select("session_id", F.col("key").alias("cache_key"))
    mine = sessions.join(build.select(F.col("session_id").alias("id")), "id", "left_semi")
    asked = infer.run(full_prompts(mine, events, beats, summaries, names), model, system=system, max_tokens=FULL_TOKENS, p=p)
    done = settled(replace_speaker_ids(asked.join(build, "session_id"), names, "session_id", "raw"))
    old = latest(summaries, "full").select("session_id", F.col("text").alias("text"), F.col("cache_key").alias("text_key"))
    texts = (
        state.where("branch IN ('cached', 'limited')").select("session_id", "branch").join(old, "session_id")
        .unionByName(done.where("raw IS NOT NULL").select("session_id", F.lit("fresh").alias("branch"), F.col("raw").alias("text"), F.col("cache_key").alias("text_key")))
    )
    have = latest(summaries, "full-preview").select("session_id", F.col("cache_key").alias("text_key"), F.col("text").alias("preview"))
    matched = texts.join(have, ["session_id", "text_key"], "left")
    free = paused.where(~F.col("paused")).select("session_id")
    missing = matched.where("preview IS NULL").join(free, "session_id", "left_semi").select(
        "session_id", F.col("text").alias("prompt"), F.col("text_key").alias("cache_key")
    )
    short = settled(infer.run(missing, model, system=system, max_tokens=PREVIEW_TOKENS, p=p)).withColumn("raw", X.strip(F.col("raw")))
    made = short.select("session_id", F.nullif("raw", F.lit("")).alias("__new"))
    answers = matched.join(made, "session_id", "left").select(
        "session_id", "branch", "text", F.coalesce("preview", "__new").alias("preview")
    )
    return answers, save(done, "full", now, p=p), save(short, "full-preview", now, p=p)
