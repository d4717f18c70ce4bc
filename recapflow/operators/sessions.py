"""Session life cycle: lookup, choice, change log, orphans, cool-down, automatic actions, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recapflow.functions import times as TM
from recapflow.functions.ordered import previous, running_sum, top_n
from recapflow.params import DEFAULTS, Params
from recapflow.sources.channels import auto_channels

# Fixed value: error text of a session whose worker vanished.
ORPHAN_ERROR = "session: worker stopped without closing this session"


def live(sessions: DataFrame, channels: DataFrame) -> DataFrame:
    """Newest session with status live per channel login."""
    latest = (
        sessions.where("status = 'live'").groupBy("channel_id").agg(F.max("id").alias("session_id"))
    )
    logins = channels.select(F.col("id").alias("channel_id"), F.lower("login").alias("login"))
    return latest.join(logins, "channel_id").select("login", "channel_id", "session_id")


def summary_session(sessions: DataFrame, summaries: DataFrame) -> DataFrame:
    """Session to summarise per channel: the newest running live one, else the newest with a summary."""
    broadcasts = sessions.where("source = 'live'").select("id", "channel_id", "status")
    told = summaries.where(F.col("kind").isin("rolling", "full")).select(F.col("session_id").alias("id"))
    running = broadcasts.where(TM.is_running(F.col("status"))).withColumn("live", F.lit(True))
    saved = broadcasts.join(told, "id", "left_semi").withColumn("live", F.lit(False))
    return (
        running.unionByName(saved).groupBy("channel_id")
        .agg(F.max(F.struct("live", "id")).alias("best"))
        .select("channel_id", F.col("best.id").alias("session_id"), F.col("best.live").alias("live"))
    )


def with_any_summary(sessions: DataFrame, summaries: DataFrame) -> DataFrame:
    told = summaries.where(F.col("kind").isin("rolling", "full")).select(F.col("session_id").alias("id"))
    return sessions.join(told, "id", "left_semi")


def choose(viewers: DataFrame, sessions: DataFrame) -> DataFrame:
    """Session shown to each viewer. ``viewers``: viewer_id, channel_id, current_id, picked. A picked or
    running current session stays; else the newest running one, else the current one, else the newest."""
    newest = sessions.groupBy("channel_id").agg(
        F.max("id").alias("newest"), F.max(F.when(TM.is_running(F.col("status")), F.col("id"))).alias("newest_running")
    )
    current = sessions.select(F.col("id").alias("current_id"), F.col("channel_id"), F.col("status").alias("__status"))
    keep = F.col("__status").isNotNull() & (F.col("picked") | TM.is_running(F.col("__status")))
    existing = F.when(F.col("__status").isNotNull(), F.col("current_id"))
    return (
        viewers.join(current, ["channel_id", "current_id"], "left").join(newest, "channel_id", "left")
        .select("viewer_id", F.when(keep, F.col("current_id")).otherwise(
            F.coalesce("newest_running", existing, "newest")).alias("session_id"))
    )


def in_cooldown(sessions: DataFrame, segments: DataFrame, now: Column, p: Params = DEFAULTS) -> DataFrame:
    """Channels whose last live session ended a short while ago without any segment."""
    last = (
        sessions.where("source = 'live'").groupBy("channel_id")
        .agg(F.max_by(F.struct("id", "ended_at"), "id").alias("s")).select("channel_id", "s.*")
    )
    recent = last.where(TM.seconds_between(now, F.col("ended_at")) <= p.cooldown_minutes * 60)
    return recent.join(segments.select(F.col("session_id").alias("id")), "id", "left_anti").select(
        "channel_id", F.col("id").alias("session_id")
    )


def orphans(sessions: DataFrame, leases: DataFrame, now: float, grace: float | None = None, p: Params = DEFAULTS) -> DataFrame:
    """Running sessions that no valid lease covers and whose grace has passed."""
    wait = p.lease_ttl_seconds if grace is None else grace
    valid = leases.where((F.col("expires_at") >= now) & F.col("session_id").isNotNull())
    old = TM.epoch_seconds(F.col("started_at")) <= now - wait if wait > 0 else F.lit(True)
    return (
        sessions.where(TM.is_running(F.col("status")) & F.coalesce(old, F.lit(True)))
        .join(valid.select(F.col("session_id").alias("id")), "id", "left_anti")
    )


def reconcile(sessions: DataFrame, leases: DataFrame, now: float, grace: float | None = None, p: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """New versions of (sessions, leases): orphans become interrupted, expired leases go."""
    gone = orphans(sessions, leases, now, grace, p).select("id", F.lit(True).alias("__orphan"))
    stamp = F.timestamp_micros(F.lit(int(now * 1_000_000)))
    hit = F.col("__orphan").isNotNull()
    updated = sessions.join(gone, "id", "left").withColumns({
        "status": F.when(hit, "interrupted").otherwise(F.col("status")),
        "ended_at": F.when(hit, F.coalesce("ended_at", stamp)).otherwise(F.col("ended_at")),
        "last_error": F.when(hit, ORPHAN_ERROR).otherwise(F.col("last_error")),
        "last_error_at": F.when(hit, stamp).otherwise(F.col("last_error_at")),
    })
    return updated.select(*sessions.columns), leases.where(F.col("expires_at") >= now)


def meta_history(observed: DataFrame, bucket: Column) -> DataFrame:
    """Change log entries: (session_id, at, title, category) where the pair differs from the one before.
    A missing value keeps the old one. ``observed``: session_id, at, title, category."""
    def filled(df: DataFrame, c: str) -> DataFrame:
        # Number the groups that share the last value seen, then spread that value over the group.
        g = f"__{c}_group"
        told = F.when(F.coalesce(F.col(c), F.lit("")) != "", 1).otherwise(0)
        numbered = running_sum(df, ["session_id"], ["at"], told, g, bucket)
        value = numbered.where(told == 1).select("session_id", g, F.col(c).alias("__v"))
        return numbered.drop(c).join(value, ["session_id", g], "left").withColumnRenamed("__v", c).drop(g)

    known = filled(filled(observed.select("session_id", "at", "title", "category"), "title"), "category")
    seen = previous(known, ["session_id"], ["at"], ["title", "category"], "before", bucket)
    same = F.col("title").eqNullSafe(F.col("before.title")) & F.col("category").eqNullSafe(F.col("before.category"))
    return seen.where(~same).select("session_id", "at", "title", "category")


def tick(channels: DataFrame, status: DataFrame, sessions: DataFrame, segments: DataFrame, leases: DataFrame,
         now: Column, p: Params = DEFAULTS) -> DataFrame:
    """One action per automatically monitored channel that is live: update the session that holds a valid
    lease, wait while cooling down, otherwise start. ``status`` comes from ``stream_status``."""
    on_air = auto_channels(channels).select(F.col("id").alias("channel_id"), "login").join(status, "login")
    held = leases.where((F.col("key").startswith("live:")) & (F.col("expires_at") >= TM.epoch_seconds(now))).select(
        F.substring("key", 6, 30).cast("bigint").alias("channel_id"), F.col("session_id").alias("held_session")
    )
    resting = in_cooldown(sessions, segments, now, p).select("channel_id", F.lit(True).alias("resting"))
    action = (
        F.when(F.col("held"), "update").when(F.col("resting"), "cooldown").otherwise("start")
    )
    return (
        on_air.join(held.withColumn("held", F.lit(True)), "channel_id", "left").join(resting, "channel_id", "left")
        .select("channel_id", "login", action.alias("action"), F.col("held_session").alias("session_id"),
                "stream_id", "title", "category")
    )


def set_errors(sessions: DataFrame, reports: DataFrame) -> DataFrame:
    """Apply stage reports (session_id, at, seq, stage, error_type): an error is noted, a success (NULL
    error_type) clears an error of the same stage.

    The last error counts unless a later success of its stage exists."""
    failures = reports.where("error_type IS NOT NULL").groupBy("session_id").agg(
        F.max_by(F.struct("at", "seq", "stage", "error_type"), F.struct("at", "seq")).alias("err")
    )
    last_ok = reports.where("error_type IS NULL").groupBy("session_id", "stage").agg(
        F.max(F.struct("at", "seq")).alias("ok")
    )
    merged = (
        sessions.join(failures, sessions["id"] == failures["session_id"], "left").drop("session_id")
        .withColumn("stage", F.coalesce("err.stage", F.substring_index("last_error", ":", 1)))
        .join(last_ok.withColumnRenamed("session_id", "id"), ["id", "stage"], "left")
    )
    text = F.concat_ws(": ", F.col("err.stage"), F.left(F.col("err.error_type"), F.lit(80)))
    fresh = F.col("err").isNotNull()
    at = F.coalesce(F.struct("err.at", "err.seq"), F.struct(F.col("last_error_at").alias("at"), F.lit(-1).cast("bigint").alias("seq")))
    cleared = F.col("ok").isNotNull() & (F.struct("ok.at", "ok.seq") > at)
    return merged.withColumns({
        "last_error": F.when(cleared, None).when(fresh, text).otherwise(F.col("last_error")),
        "last_error_at": F.when(cleared, None).when(fresh, F.col("err.at")).otherwise(F.col("last_error_at")),
    }).select(*sessions.columns)


def newest(sessions: DataFrame, channels: DataFrame, limit: int = 50) -> DataFrame:
    """Newest sessions with the channel login; ``limit`` is kept between 1 and 200."""
    logins = channels.select(F.col("id").alias("channel_id"), "login")
    top = sessions.select(
        "id", "channel_id", "source", "status", "title", "category", "started_at", "ended_at", "last_error"
    ).join(logins, "channel_id")
    return top.orderBy(F.desc("id")).limit(max(1, min(limit, 200)))


def recent_per_channel(sessions: DataFrame, n: int) -> DataFrame:
    return top_n(sessions, ["channel_id"], [F.desc("id")], n)
