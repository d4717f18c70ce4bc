"""Filters and predicates on single utterances, references and proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recapflow.functions import text as X
from recapflow.params import DEFAULTS, Params

# Phrases recognisers invent on silence, and the limits of the guard.
BLOCKLIST = ("thanks for watching", "thanks for watching!", "subscribe for more", "like and subscribe")
MAX_NO_SPEECH = 0.6
MIN_AVG_LOGPROB = -1.0
MIN_DIVERSITY = 0.15

# Accepted enumerations of the extraction document.
KINDS = ("in_character", "out_of_character", "narration", "unclear")
ENTITY_TYPES = ("character", "person", "place", "item", "group", "other")
THREAD_STATUSES = ("open", "resolved", "dormant")
EVENT_TYPES = ("plot", "combat", "dialogue", "decision", "reveal", "game_event", "banter", "other")


def drop_reason(text: Column, avg_logprob: Column, no_speech: Column) -> Column:
    """Why recognised text is to be dropped, '' to keep it; the first matching rule decides."""
    t = X.lower_strip(text)
    tok = X.tokens(t)
    loop = (F.length(t) > 20) & (X.bigram_diversity(t) < MIN_DIVERSITY)
    same = (F.size(tok) > 6) & (F.size(F.array_distinct(tok)) == 1)
    return (
        F.when(t == "", "empty")
        .when(t.isin(*BLOCKLIST), "blocklist")
        .when(no_speech > MAX_NO_SPEECH, "no_speech")
        .when(avg_logprob < MIN_AVG_LOGPROB, "low_logprob")
        .when(loop | same, "repetition")
        .otherwise("")
    )


def should_drop(df: DataFrame, text: str = "text", avg_logprob: str = "avg_logprob", no_speech: str = "no_speech") -> DataFrame:
    return df.withColumn("reason", drop_reason(F.col(text), F.col(avg_logprob), F.col(no_speech))).withColumn(
        "dropped", F.col("reason") != ""
    )


def gate(kind: str, confidence: Column, p: Params = DEFAULTS) -> Column:
    """'applied' or 'quarantined': weak proposals stay in the raw document but change nothing."""
    limits = {
        "entity": p.entity_min_confidence, "thread": p.thread_min_confidence,
        "event": p.event_min_confidence, "attribution": p.attribution_min_confidence,
    }
    return F.when(F.coalesce(confidence, F.lit(0.0)) < limits[kind], "quarantined").otherwise("applied")


def _problem(bad: Column, name: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.lit(name))


def _unit(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(0.0)).between(0.0, 1.0)


def _bad_items(items: Column, bad) -> Column:
    return F.exists(F.coalesce(items, F.array()), lambda x: F.coalesce(bad(x), F.lit(True)))


def problems(ext: Column) -> Column:
    """Names of the parts of an extraction struct that break its rules; empty when it is acceptable."""
    checks = [
        _problem(ext.isNull(), "document"),
        _problem(_bad_items(ext["utterance_attributions"],
                            lambda a: a["segment_id"].isNull() | ~a["kind"].isin(*KINDS) | _unit(a["confidence"])), "attribution"),
        _problem(_bad_items(ext["entity_updates"],
                            lambda e: e["ref"].isNull() | ~e["type"].isin(*ENTITY_TYPES) | _unit(e["confidence"])), "entity"),
        _problem(_bad_items(ext["thread_updates"],
                            lambda t: t["ref"].isNull() | ~t["status"].isin(*THREAD_STATUSES) | _unit(t["confidence"])), "thread"),
        _problem(_bad_items(ext["events"],
                            lambda e: e["t_start"].isNull() | e["t_end"].isNull() | ~e["type"].isin(*EVENT_TYPES)
                            | _unit(e["confidence"]) | ~F.coalesce(e["importance"], F.lit(3)).between(1, 5)), "event"),
    ]
    return F.array_compact(F.array(*checks))


def validate(df: DataFrame, ext: str = "extraction") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) documents; rejected ones carry ``problems``. The checks come out of a generator, as filters on a
    plain column would run them once more."""
    checked = df.drop("problems").select("*", F.explode(F.array(problems(F.col(ext)))).alias("problems"))
    return checked.where(F.size("problems") == 0).drop("problems"), checked.where(F.size("problems") > 0)


def is_empty(ext: Column) -> Column:
    """No summary text and no events, entity or thread updates."""
    def none(c: Column) -> Column:
        return F.coalesce(F.size(c), F.lit(0)) <= 0

    blank = X.strip(F.coalesce(ext["window_summary"], F.lit(""))) == ""
    return blank & none(ext["events"]) & none(ext["entity_updates"]) & none(ext["thread_updates"])


def parse_ref(ref: Column) -> Column:
    """Struct(kind, id, name) of a reference: ``E<digits>``, ``T<digits>``, ``NEW:<name>`` or a bare name."""
    r = X.strip(ref)
    number = F.regexp_extract(r, r"^[ET](\d+)$", 1)
    kind = (
        F.when(r.rlike(r"^E\d+$"), "entity").when(r.rlike(r"^T\d+$"), "thread")
        .when(r.startswith("NEW:"), "new").otherwise("name")
    )
    name = F.when(r.startswith("NEW:"), F.substring(r, 5, 1 << 30)).otherwise(r)
    return F.struct(
        kind.alias("kind"), F.try_to_number(F.nullif(number, F.lit("")), F.lit("9" * 18)).cast("bigint").alias("id"),
        name.alias("name"),
    )


def thread_title(ref: Column) -> Column:
    """Display title of a ``NEW:`` storyline reference."""
    return F.translate(F.substring(ref, 5, 1 << 30), "_", " ")


def enroll_check(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Whether a voice may be enrolled: a consent note is needed unless consent is switched off."""
    given = X.strip(F.coalesce("consent_note", F.lit(""))) != ""
    allowed = given if p.consent_required else F.lit(True)
    message = F.concat(F.lit("consent required to enroll '"), F.col("name"), F.lit("'"))
    return df.withColumn("allowed", allowed).withColumn("reason", F.when(allowed, "").otherwise(message))
