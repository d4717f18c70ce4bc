"""Stored summaries: latest per kind, saving, rolling summary per window, reader feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recapflow.functions import text as X
from recapflow.functions.ordered import top_n
from recapflow.operators import budget
from recapflow.params import DEFAULTS, Params

# Fixed values.
KINDS = ("rolling", "recap")
VOTES = ("yes", "no", "not_sure")
NEGATIVE = ("no", "not_sure")
STALE_KEY = "stale-feedback"
ROLLING_EVENTS = 10
ROLLING_WORDS = 30


def latest(summaries: DataFrame, kind: str | None = None) -> DataFrame:
    """Newest summary per (session, kind) by id."""
    rows = summaries if kind is None else summaries.where(F.col("kind") == kind)
    rest = [c for c in rows.columns if c not in ("session_id", "kind")]
    return rows.groupBy("session_id", "kind").agg(F.max_by(F.struct(*rest), "id").alias("s")).select("session_id", "kind", "s.*")


def save(results: DataFrame, kind: str, now: Column, prompt: str = "prompt", p: Params = DEFAULTS) -> DataFrame:
    """New summary rows (without ids) from model results: session_id, prompt, raw and optional
    covers_t_start, covers_t_end, cache_key, model."""
    def opt(c: str, t: str) -> Column:
        return (F.col(c) if c in results.columns else F.lit(None)).cast(t).alias(c)

    tin, tout = X.approx_tokens(F.col(prompt)), X.approx_tokens(F.col("raw"))
    return results.where(X.strip(F.coalesce("raw", F.lit(""))) != "").select(
        "session_id", F.lit(kind).alias("kind"), opt("covers_t_start", "double"), opt("covers_t_end", "double"),
        F.col("raw").alias("text"), opt("model", "string"), tin.alias("tokens_in"), tout.alias("tokens_out"),
        budget.cost(tin, tout, p).alias("cost_usd"), now.alias("created_at"), opt("cache_key", "string"),
    )


def rolling_prompts(windows: DataFrame, summaries: DataFrame, events: DataFrame) -> DataFrame:
    """Prompt per window: the previous rolling text without old bullet fragments, the window summary and its
    first ten events."""
    prev = latest(summaries, "rolling").select("session_id", X.strip_markdown_tail(F.col("text")).alias("prev"))
    first = top_n(events.where("window_id IS NOT NULL"), ["window_id"], [F.asc("id")], ROLLING_EVENTS)
    lines = first.groupBy("window_id").agg(
        X.lines(F.collect_list(F.struct("id", F.col("description").alias("line")))).alias("new_events")
    )
    text = F.concat(
        F.lit("Previous summary:\n"), F.coalesce("prev", F.lit("")), F.lit("\n\nNew window:\n"), F.coalesce("window_summary", F.lit("")),
        F.lit("\n\nNew events:\n"), F.coalesce("new_events", F.lit("")),
    )
    return (
        windows.select(F.col("id").alias("window_id"), "session_id", "t_start", "t_end", "window_summary")
        .join(prev, "session_id", "left").join(lines, "window_id", "left")
        .select("session_id", "window_id", F.col("t_start").alias("covers_t_start"), F.col("t_end").alias("covers_t_end"), text.alias("prompt"))
    )


def rolling_text(raw: Column) -> Column:
    return X.first_words(raw, ROLLING_WORDS)


def feedback_counts(feedback: DataFrame) -> DataFrame:
    """Votes per session, kind and vote, zero filled, and the total of all rows."""
    def n(kind: str, vote: str) -> Column:
        return F.count_if((F.col("kind") == kind) & (F.col("vote") == vote)).alias(f"{kind}_{vote}")

    return feedback.groupBy("session_id").agg(*[n(k, v) for k in KINDS for v in VOTES], F.count(F.lit(1)).alias("total"))


def simplify(feedback: DataFrame, n: int = 10) -> DataFrame:
    """Sessions with a flag for plain style: of the last ten recap votes two are negative, or all of one or two."""
    last = top_n(feedback.where("kind = 'recap'"), ["session_id"], [F.desc("id")], n)
    counted = last.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("votes"), F.count_if(F.col("vote").isin(*NEGATIVE)).alias("negative")
    )
    flag = (F.col("negative") >= 2) | ((F.col("votes") <= 2) & (F.col("negative") == F.col("votes")))
    return counted.withColumn("simplify", flag)


def apply_feedback(summaries: DataFrame, votes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summaries, accepted votes, rejected votes). A vote needs a known kind and value and, when it names a
    summary, one of its own session and kind. A negative recap vote makes the newest recap stale."""
    owned = summaries.select(F.col("id").alias("summary_id"), F.col("session_id").alias("__s"), F.col("kind").alias("__k"))
    checked = votes.join(owned, "summary_id", "left")
    mine = F.col("summary_id").isNull() | ((F.col("__s") == F.col("session_id")) & (F.col("__k") == F.col("kind")))
    reason = (
        F.when(~F.col("kind").isin(*KINDS), "kind").when(~F.col("vote").isin(*VOTES), "vote")
        .when(~F.coalesce(mine, F.lit(False)), "summary")
    )
    checked = checked.withColumn("reason", reason).drop("__s", "__k")
    good = checked.where("reason IS NULL").drop("reason")
    unhappy = good.where((F.col("kind") == "recap") & F.col("vote").isin(*NEGATIVE)).select("session_id").distinct()
    stale = latest(summaries, "recap").join(unhappy, "session_id", "left_semi").select("id", F.lit(True).alias("__stale"))
    updated = summaries.join(stale, "id", "left").withColumn(
        "cache_key", F.when(F.col("__stale"), STALE_KEY).otherwise(F.col("cache_key"))
    )
    return updated.select(*summaries.columns), good, checked.where("reason IS NOT NULL")
