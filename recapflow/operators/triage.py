"""Cheap look at a window before the expensive extraction, and routing answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recapflow.functions import text as X
from recapflow.functions.ordered import top_n
from recapflow.functions.stages import settled
from recapflow.operators import infer
from recapflow.params import DEFAULTS, Params
from recapflow.schemas import ANSWERS

# Fixed values.
IDLE_IMPORTANCE = 1
MIN_CONFIDENCE = 0.6
YES = 0.5
KNOWN_PEOPLE = 50
OPEN_THREADS = 20
UNAVAILABLE = "context unavailable"
NO_PEOPLE = "(none known yet)"
NO_THREADS = "(none open yet)"
LEVELS = ("1 - idle banter", "2 - minor", "3 - notable", "4 - major", "5 - pivotal")
NO_CHOICE = "none_of_the_above"


def should_skip(importance: Column, new_character: Column, confidence: Column) -> Column:
    """Idle for sure and nobody new. Missing importance counts as 3, missing confidence as 0."""
    return (
        (F.coalesce(importance, F.lit(3)) <= IDLE_IMPORTANCE)
        & (F.coalesce(confidence, F.lit(0.0)) >= MIN_CONFIDENCE)
        & ~F.coalesce(new_character, F.lit(False))
    )


def _number(c: Column) -> Column:
    return c.try_cast("double")


def _level(score: Column) -> Column:
    """Answer levels count from 0, importance from 1; halves round to even."""
    return F.least(F.greatest(F.bround(score, 0) + 1, F.lit(1.0)), F.lit(5.0)).cast("int")


def answers(raw: Column) -> Column:
    """Answer map of a classifier reply; unreadable replies give an empty map."""
    got = F.from_json(raw, f"STRUCT<answers: {ANSWERS}, model: STRING>")["answers"]
    return F.coalesce(got, F.from_json(F.lit("{}"), ANSWERS))


def verdict(ans: Column) -> Column:
    """Struct of importance, importance_confidence, novelty, new_character, has_storyline."""
    def field(key: str, name: str) -> Column:
        return _number(F.try_element_at(ans, F.lit(key))[name])

    def yes(key: str) -> Column:
        return F.coalesce(field(key, "noul") >= YES, F.lit(False))

    given = F.try_element_at(ans, F.lit("importance"))["confidence"]
    score = field("importance", "score")
    readable = score.isNotNull() & (given.isNull() | _number(given).isNotNull())
    confidence = F.when(readable, F.coalesce(_number(given), F.lit(0.0))).otherwise(0.0)
    return F.struct(
        F.when(readable, _level(score)).alias("importance"), confidence.alias("importance_confidence"),
        field("novelty", "score").alias("novelty"), yes("new_character").alias("new_character"), yes("has_storyline").alias("has_storyline"),
    )


def routing(ans: Column) -> Column:
    """Struct of character, thread, new_character, importance (3 when no score can be read)."""
    def choice(key: str) -> Column:
        return F.try_element_at(ans, F.lit(key))["choice"]

    noul = _number(F.try_element_at(ans, F.lit("new_character"))["noul"])
    score = _number(F.try_element_at(ans, F.lit("importance"))["score"])
    return F.struct(
        choice("character").alias("character"), choice("thread").alias("thread"),
        F.coalesce(noul >= YES, F.lit(False)).alias("new_character"), _level(F.coalesce(score, F.lit(2.0))).alias("importance"),
    )


def parse_text(reply: Column) -> Column:
    """Struct of character, thread, importance from a free-text routing reply."""
    def find(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(reply, pattern, 1), F.lit(""))

    level = F.coalesce(find(r"importance=(\d+)").try_cast("bigint"), F.lit(3))
    return F.struct(
        find(r"character=(\S+)").alias("character"), F.nullif(find(r"thread=(\S+)"), F.lit("NONE")).alias("thread"),
        F.least(F.greatest(level, F.lit(1)), F.lit(5)).cast("int").alias("importance"),
    )


def known_people(entities: DataFrame, n: int = KNOWN_PEOPLE) -> DataFrame:
    """Most mentioned entities per channel."""
    return top_n(entities, ["channel_id"], [F.desc("mention_count"), F.asc("id")], n)


def open_threads(threads: DataFrame, n: int = OPEN_THREADS) -> DataFrame:
    """Most recently moved open storylines per channel."""
    return top_n(threads.where("status = 'open'"), ["channel_id"], [F.desc_nulls_last("last_updated_at"), F.asc("id")], n)


def state_text(people: Column, stories: Column, transcript: Column) -> Column:
    """Text for the classifier from arrays of 'name: text' entries; NULL (no context) differs from empty."""
    def block(items: Column, none: str) -> Column:
        listed = F.array_join(F.transform(items, lambda s: F.concat(F.lit("- "), s)), "\n")
        return F.when(items.isNull(), UNAVAILABLE).when(F.size(items) == 0, none).otherwise(listed)

    return F.concat(
        F.lit("[known_people]\n"), block(people, NO_PEOPLE), F.lit("\n[/known_people]\n[open_storylines]\n"), block(stories, NO_THREADS),
        F.lit("\n[/open_storylines]\n[transcript]\n"), transcript, F.lit("\n[/transcript]"),
    )


def questions() -> Column:
    """Question set of one triage call as JSON."""
    def q(kind: str, ask: str) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(ask).alias("instructions"))

    score = F.struct(F.lit("score").alias("type"), F.lit("Importance of the window for the story").alias("instructions"),
                     F.array(*[F.lit(x) for x in LEVELS]).alias("criteria"))
    return F.to_json(F.struct(
        score.alias("importance"), q("score", "New compared with the known people and storylines").alias("novelty"),
        q("noul", "A person appears who is not among the known people").alias("new_character"),
        q("noul", "A listed storyline moves on").alias("has_storyline"),
    ))


def routing_questions(people: Column, stories: Column) -> Column:
    """Question set of a routing call as JSON; ``people`` and ``stories`` are maps of name to description."""
    def choice(options: Column, ask: str) -> Column:
        none = F.create_map(F.lit(NO_CHOICE), F.lit("Nothing listed applies"))
        return F.struct(F.lit("choice").alias("type"), F.lit(ask).alias("instructions"), F.map_concat(options, none).alias("criteria"))

    score = F.struct(F.lit("score").alias("type"), F.array(*[F.lit(x) for x in LEVELS]).alias("criteria"))
    noul = F.struct(F.lit("noul").alias("type"), F.lit("A person appears who is not listed").alias("instructions"))
    return F.to_json(F.struct(
        choice(people, "Person in focus").alias("character"), choice(stories, "Storyline moved on").alias("thread"),
        noul.alias("new_character"), score.alias("importance"),
    ))


def states(windows: DataFrame, entities: DataFrame, threads: DataFrame) -> DataFrame:
    """Classifier input per window (window_id, channel_id, text)."""
    def listed(rows: DataFrame, name: str, text: str, out: str) -> DataFrame:
        entry = F.struct("rank", F.concat(F.col(name), F.lit(": "), F.coalesce(text, F.lit(""))).alias("line"))
        return rows.groupBy("channel_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["line"]).alias(out))

    people = listed(known_people(entities), "canonical_name", "description", "people")
    stories = listed(open_threads(threads), "title", "summary", "stories")
    none = F.array().cast("array<string>")
    return windows.join(people, "channel_id", "left").join(stories, "channel_id", "left").select(
        "window_id", "channel_id",
        state_text(F.coalesce("people", none), F.coalesce("stories", none), F.col("text")).alias("state"), questions().alias("questions"),
    )


def run(windows: DataFrame, entities: DataFrame, threads: DataFrame, classifier: Callable[[], infer.Classifier] | None, p: Params = DEFAULTS) -> DataFrame:
    """(window_id, importance, ..., idle). Without a classifier, and after any failure, no window is idle."""
    if classifier is None:
        return windows.select("window_id", F.lit(None).cast("int").alias("importance"), F.lit(0.0).alias("importance_confidence"),
                              F.lit(None).cast("double").alias("novelty"), F.lit(False).alias("new_character"),
                              F.lit(False).alias("has_storyline"), F.lit(False).alias("idle"))
    asked = settled(infer.classify(states(windows, entities, threads), classifier, p=p))
    got = asked.select("window_id", "error_type", verdict(answers(F.col("raw"))).alias("v")).select("window_id", "error_type", "v.*")
    idle = F.col("error_type").isNull() & should_skip(F.col("importance"), F.col("new_character"), F.col("importance_confidence"))
    return got.withColumn("idle", idle).drop("error_type")
