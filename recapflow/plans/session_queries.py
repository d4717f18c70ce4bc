"""Queries over sessions, timelines, recaps, votes and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recapflow.functions import text as X
from recapflow.functions import times as TM
from recapflow.functions.ordered import time_block
from recapflow.operators import budget, context, final, gaps, recap, sessions, summaries, timeline
from recapflow.plans.bindings import EV_NOW, NOW, Tables, ts
from recapflow.plans.registry import query

_AT = 'CAST(round("at", 6) AS DOUBLE) AS "at"'
_CLOCK = """CAST(CAST(floor("at" / 3600) AS BIGINT) AS VARCHAR) || ':' || lpad(CAST(CAST(floor("at") AS BIGINT) % 3600 // 60 AS VARCHAR), 2, '0') AS clock"""


def _timed(t: Tables) -> DataFrame:
    return timeline.timed_events(t.ev_sessions, t.ev_windows, t.ev_events)


@query("timed_events", f"SELECT session_id, id, importance, hour, {_AT} FROM ev_timed", ("ev_timed",))
def timed_events(t: Tables) -> DataFrame:
    return _timed(t).select("session_id", "id", "importance", "hour", F.round("at", 6).alias("at"))


@query("highlights", f"""SELECT session_id, hour, id, description, importance, {_AT}, {_CLOCK}, rank FROM (
    SELECT e.*, row_number() OVER (PARTITION BY session_id, hour ORDER BY importance DESC, "at" DESC, id) AS rank
    FROM ev_timed e WHERE importance >= 2 AND NOT EXISTS (SELECT 1 FROM ev_runs r
        WHERE r.session_id = e.session_id AND r.hour_index = e.hour AND r.status = 'done')) WHERE rank <= 3""", ("ev_timed", "ev_runs"))
def highlights(t: Tables) -> DataFrame:
    return timeline.highlights(_timed(t), t.ev_runs).select(
        "session_id", "hour", "id", "description", "importance", F.round("at", 6).alias("at"),
        TM.clock_hm(F.col("at")).alias("clock"), F.col("rank").cast("bigint").alias("rank"),
    )


@query("timeline", f"""SELECT session_id, hour, headline, significance, kind, {_AT}, {_CLOCK} FROM (
    SELECT session_id, hour_index AS hour, headline, significance, 'beat' AS kind, t_start AS "at" FROM ev_beats
    UNION ALL SELECT session_id, hour, description, importance, 'event', "at" FROM (
    SELECT e.*, row_number() OVER (PARTITION BY session_id, hour ORDER BY importance DESC, "at" DESC, id) AS rank
    FROM ev_timed e WHERE importance >= 2 AND NOT EXISTS (SELECT 1 FROM ev_runs r
        WHERE r.session_id = e.session_id AND r.hour_index = e.hour AND r.status = 'done')) WHERE rank <= 3)""", ("ev_timed", "ev_beats"))
def timeline_(t: Tables) -> DataFrame:
    return timeline.timeline(t.ev_sessions, t.ev_windows, t.ev_events, t.ev_beats, t.ev_runs).withColumn(
        "at", F.round("at", 6)
    ).select("session_id", "hour", "headline", "significance", "kind", "at", "clock").orderBy("session_id", "at")


_CLOSED = f"""closed AS (SELECT id AS session_id, status, CASE WHEN status IN ('live', 'degraded')
    THEN greatest(CAST(floor((epoch(TIMESTAMP '{EV_NOW}') - epoch(started_at) - 180) / 3600) AS BIGINT), 0)
    ELSE CAST(floor((epoch_us(ended_at) - epoch_us(started_at)) / 1e6 / 3600) AS BIGINT) + 1 END AS closed_hours, ended_at FROM ev_sessions)"""


@query("closed_hours", "SELECT session_id, status, closed_hours FROM closed", ("ev_sessions",), _CLOSED)
def closed_hours(t: Tables) -> DataFrame:
    return timeline.closed_hours(t.ev_sessions, ts(EV_NOW)).select(F.col("id").alias("session_id"), "status", "closed_hours")


@query("due_hours", f"""SELECT session_id, hour FROM (SELECT session_id, unnest(range(closed_hours)) AS hour FROM closed
    WHERE status IN ('live', 'degraded') OR ended_at >= TIMESTAMP '{EV_NOW}' - INTERVAL 24 HOUR) d
    WHERE NOT EXISTS (SELECT 1 FROM ev_runs r WHERE r.session_id = d.session_id AND r.hour_index = d.hour)""", ("ev_sessions", "ev_runs"), _CLOSED)
def due_hours(t: Tables) -> DataFrame:
    return timeline.due_hours(t.ev_sessions, t.ev_runs, ts(EV_NOW))


@query("next_due_hours", f"""SELECT session_id, hour FROM (SELECT session_id, unnest(range(closed_hours)) AS hour FROM closed
    WHERE status IN ('live', 'degraded') OR ended_at >= TIMESTAMP '{EV_NOW}' - INTERVAL 24 HOUR) d
    WHERE NOT EXISTS (SELECT 1 FROM ev_runs r WHERE r.session_id = d.session_id AND r.hour_index = d.hour)
    ORDER BY session_id, hour LIMIT 3""", ("ev_sessions", "ev_runs"), _CLOSED)
def next_due_hours(t: Tables) -> DataFrame:
    return timeline.next_due(timeline.due_hours(t.ev_sessions, t.ev_runs, ts(EV_NOW)))


@query("earlier_headlines", """SELECT session_id, hour, back, headline FROM (
    SELECT h.session_id, h.hour, b.headline, row_number() OVER (PARTITION BY h.session_id, h.hour ORDER BY b.hour_index DESC, b.t_start DESC) AS back
    FROM ev_hours h JOIN ev_beats b ON b.session_id = h.session_id AND b.hour_index < h.hour) WHERE back <= 4""", ("ev_hours", "ev_beats"))
def earlier_headlines(t: Tables) -> DataFrame:
    return timeline.earlier(t.ev_hours, t.ev_beats).withColumn("back", F.col("back").cast("bigint"))


@query("hour_prompts", """SELECT session_id, hour, string_agg('- id ' || id || ' [' || CAST(floor("at" / 3600) AS BIGINT) || ':' ||
    lpad(CAST(CAST(floor("at") AS BIGINT) % 3600 // 60 AS VARCHAR), 2, '0') || ' | importance ' || importance || '] ' || description,
    chr(10) ORDER BY "at", id) AS events FROM ev_timed WHERE importance >= 3 GROUP BY session_id, hour""", ("ev_timed",))
def hour_prompts(t: Tables) -> DataFrame:
    asked = timeline.prompts(_timed(t), t.ev_hours, t.ev_beats)
    body = F.split(F.col("prompt"), "\nEvents in order:\n").getItem(1)
    return asked.select("session_id", "hour", F.split(body, "\n\nAlready on the timeline:\n").getItem(0).alias("events"))


@query("ground_beats", """SELECT session_id, hour, CAST(0 AS INTEGER) AS beat_no, 'hour ' || hour AS headline, CAST(count(*) AS BIGINT) AS n_events,
    round(min("at"), 6) AS t_start, round(max("at"), 6) AS t_end FROM ev_timed WHERE importance >= 3 GROUP BY session_id, hour""", ("ev_timed",))
def ground_beats(t: Tables) -> DataFrame:
    """A proposal per hour citing all events of the hour and one of another hour."""
    timed = _timed(t)
    ids = F.concat(F.collect_list("id"), F.array(F.lit(-1).cast("bigint")))
    proposal = F.struct(F.array(
        F.struct(F.concat(F.lit("hour "), F.col("hour")).alias("headline"), F.lit(3).alias("significance"), F.col("ids").alias("event_ids")),
        F.struct(F.lit("nothing").alias("headline"), F.lit(2).alias("significance"), F.array(F.lit(-1).cast("bigint")).alias("event_ids")),
    ).alias("beats"))
    proposals = timed.groupBy("session_id", "hour").agg(ids.alias("ids")).select("session_id", "hour", proposal.alias("proposal"))
    return timeline.ground(proposals, timed).select(
        "session_id", "hour", "beat_no", "headline", F.size("event_ids").cast("bigint").alias("n_events"),
        F.round("t_start", 6).alias("t_start"), F.round("t_end", 6).alias("t_end"),
    )


_CHOSEN = """recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS r1 FROM ev_events) WHERE r1 <= 60),
    chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY importance DESC, id DESC) AS r2 FROM recent) WHERE r2 <= 30)"""


@query("recap_events", """SELECT c.session_id, c.id, c.importance, coalesce(try_cast(split_part(r.cache_key, ':', 1) AS BIGINT), 0) <> 0
    AND c.id > coalesce(try_cast(split_part(r.cache_key, ':', 1) AS BIGINT), 0) AS is_new,
    '- ' || CASE WHEN coalesce(try_cast(split_part(r.cache_key, ':', 1) AS BIGINT), 0) <> 0 AND c.id > try_cast(split_part(r.cache_key, ':', 1) AS BIGINT)
    THEN '[NEW] ' ELSE '' END || '[' || printf('%02d', CAST(floor(c.t_start) AS BIGINT) // 60)
    || ':' || lpad(CAST(CAST(floor(c.t_start) AS BIGINT) % 60 AS VARCHAR), 2, '0') || ' | importance ' || c.importance || ' | ' || c.type || '] ' || c.description AS line
    FROM chosen c LEFT JOIN ev_recaps r ON r.session_id = c.session_id""", ("ev_events", "ev_recaps"), _CHOSEN)
def recap_events(t: Tables) -> DataFrame:
    return recap.mark_new(recap.select_events(t.ev_events), t.ev_recaps).select(
        "session_id", "id", "importance", "is_new", recap.event_line().alias("line")
    )


@query("early_events", """SELECT f.session_id, f.id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) AS r FROM ev_events) f
    WHERE r <= 20 AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.session_id = f.session_id AND c.id = f.id)""", ("ev_events",), _CHOSEN)
def early_events(t: Tables) -> DataFrame:
    return recap.early_events(t.ev_events, recap.select_events(t.ev_events)).select("session_id", "id")


@query("beat_history", """SELECT session_id, id, headline, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY hour_index, id) AS rank FROM ev_beats)
    WHERE rank <= 120""", ("ev_beats",))
def beat_history(t: Tables) -> DataFrame:
    return recap.beat_history(t.ev_beats).select("session_id", "id", "headline", F.col("rank").cast("bigint").alias("rank"))


@query("final_events", """SELECT session_id, id, importance, row_number() OVER (PARTITION BY session_id ORDER BY t_start, id) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY importance DESC, id DESC) AS r FROM ev_events) WHERE r <= 40""", ("ev_events",))
def final_events(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    chosen = final.select_events(t.ev_events)
    w = Window.partitionBy("session_id").orderBy(F.coalesce("t_start", F.lit(0.0)), "id")
    return chosen.select("session_id", "id", "importance", F.row_number().over(w).cast("bigint").alias("place"))


_KEY = """SELECT s.id AS session_id, coalesce(max(e.id), 0) || ':' || coalesce(any_value(t.moved), '') AS key FROM ev_sessions s
    LEFT JOIN ev_events e ON e.session_id = s.id LEFT JOIN (SELECT channel_id, strftime(max(last_updated_at), '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS moved
    FROM threads GROUP BY channel_id) t ON t.channel_id = s.channel_id GROUP BY s.id"""


@query("recap_key", _KEY, ("ev_sessions", "ev_events", "threads"))
def recap_key(t: Tables) -> DataFrame:
    return recap.keys(t.ev_sessions, t.ev_events, t.threads)


_FULL = """SELECT session_id, 'session-v4:' || coalesce(max(id) FILTER (importance >= 3), 0) || ':' || (1 + (count(*) - 1) // 3) AS full_key,
    count(*) AS event_count FROM ev_events GROUP BY session_id"""


@query("full_key", _FULL, ("ev_events",))
def full_key(t: Tables) -> DataFrame:
    return recap.full_keys(t.ev_sessions, t.ev_events)


@query("recap_split", f"""SELECT k.session_id, k.key, CASE WHEN r.cache_key = k.key THEN 'cached' WHEN o.session_id IS NOT NULL AND r.session_id IS NOT NULL THEN 'limited' WHEN o.session_id IS NOT NULL THEN 'rejected' ELSE 'build' END AS branch
    FROM ({_KEY}) k LEFT JOIN saved r ON r.session_id = k.session_id
    LEFT JOIN (SELECT session_id FROM costs GROUP BY session_id HAVING sum(cost_usd) >= 1.5) o ON o.session_id = k.session_id""", ("ev_sessions", "ev_events", "threads", "costs"),
    f"saved AS (SELECT session_id, CASE WHEN session_id % 3 = 0 THEN key ELSE 'old' END AS cache_key FROM ({_KEY}) WHERE session_id % 3 < 2)")
def recap_split(t: Tables) -> DataFrame:
    """Key split with recaps of the present key, of an old one and without any; sessions over 1.5 USD are paused."""
    state = recap.keys(t.ev_sessions, t.ev_events, t.threads)
    kept = F.when(F.col("session_id") % 3 == 0, F.col("key")).otherwise("old")
    saved = state.where("session_id % 3 < 2").select(
        F.col("session_id").alias("id"), "session_id", F.lit("recap").alias("kind"), F.lit("told").alias("text"), kept.alias("cache_key"))
    paused = budget.session_spend(t.cost_windows, t.cost_summaries).withColumn("paused", F.col("session_spend") >= 1.5)
    return recap.split_cached(state, saved, "recap", paused).select("session_id", "key", "branch")


_VOTE_COLS = ", ".join(
    f"CAST(count(*) FILTER (kind = '{k}' AND vote = '{v}') AS BIGINT) AS {k}_{v}" for k in ("rolling", "recap") for v in ("yes", "no", "not_sure")
)


@query("feedback_counts", f"SELECT session_id, {_VOTE_COLS}, count(*) AS total FROM ev_votes GROUP BY session_id", ("ev_votes",))
def feedback_counts(t: Tables) -> DataFrame:
    return summaries.feedback_counts(t.ev_votes)


@query("simplify", """SELECT session_id, count(*) AS votes, CAST(count(*) FILTER (vote IN ('no', 'not_sure')) AS BIGINT) AS negative,
    count(*) FILTER (vote IN ('no', 'not_sure')) >= 2 OR (count(*) <= 2 AND count(*) FILTER (vote IN ('no', 'not_sure')) = count(*)) AS simplify
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS r FROM ev_votes WHERE kind = 'recap') WHERE r <= 10 GROUP BY session_id""", ("ev_votes",))
def simplify(t: Tables) -> DataFrame:
    return summaries.simplify(t.ev_votes)


@query("apply_feedback", """SELECT id, session_id, CASE WHEN session_id IN (SELECT session_id FROM ev_votes WHERE kind = 'recap' AND vote IN ('no', 'not_sure'))
    THEN 'stale-feedback' ELSE cache_key END AS cache_key FROM ev_recaps""", ("ev_recaps", "ev_votes"))
def apply_feedback(t: Tables) -> DataFrame:
    votes = t.ev_votes.withColumn("summary_id", F.lit(None).cast("bigint"))
    return summaries.apply_feedback(t.ev_recaps, votes)[0].select("id", "session_id", "cache_key")


@query("rejected_feedback", """SELECT v.id, CASE WHEN v.vote = 'maybe' THEN 'vote' ELSE 'summary' END AS reason FROM ev_votes v
    LEFT JOIN ev_recaps r ON r.id = v.id % 200 + 1 WHERE v.vote = 'maybe' OR r.id IS NULL OR r.session_id <> v.session_id OR v.kind <> 'recap'""", ("ev_recaps", "ev_votes"))
def rejected_feedback(t: Tables) -> DataFrame:
    votes = t.ev_votes.withColumn("summary_id", F.col("id") % 200 + 1)
    return summaries.apply_feedback(t.ev_recaps, votes)[2].select("id", "reason")


@query("session_gaps", """SELECT session_id, round(before_end, 6) AS t_start, round(t_start, 6) AS t_end, reason FROM (
    SELECT session_id, t_start, lag(t_end) OVER w AS before_end, lag(type) OVER w AS reason FROM ev_events WINDOW w AS (PARTITION BY session_id ORDER BY t_start, t_end))
    WHERE t_start - before_end > 3600""", ("ev_events",))
def session_gaps(t: Tables) -> DataFrame:
    rows = gaps.detect(t.ev_events.withColumn("reason", F.col("type")), 3600.0, 86400.0)
    return rows.select("session_id", F.round("t_start", 6).alias("t_start"), F.round("t_end", 6).alias("t_end"), "reason")


@query("unobserved_gap", f"""SELECT session_id, 0.0::DOUBLE AS t_start, 0.0::DOUBLE AS t_end, 'unobserved worker-down ' || strftime(max(created_at), '%Y-%m-%dT%H:%M:%S')
    || '..2024-01-31T00:00:00' AS reason FROM ev_windows GROUP BY session_id
    HAVING (epoch_us(TIMESTAMP '{EV_NOW}') - epoch_us(max(created_at))) / 1e6 > 180""", ("ev_windows",))
def unobserved_gap(t: Tables) -> DataFrame:
    return gaps.unobserved(t.ev_windows, ts(EV_NOW))


@query("session_islands", """SELECT session_id, count(*) AS islands FROM (SELECT user_id AS session_id, ts,
    lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) WHERE before IS NULL OR ts - before >= INTERVAL 5 MINUTE GROUP BY session_id""")
def session_islands(t: Tables) -> DataFrame:
    """Sessions ended by five minutes without audio, as a batch session window."""
    return t.read("events").groupBy(F.col("user_id").alias("session_id"), F.session_window("ts", "5 minutes")).agg(
        F.count(F.lit(1)).alias("n")).groupBy("session_id").agg(F.count(F.lit(1)).alias("islands"))


@query("change_log", """SELECT session_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS "at", title, category FROM (
    SELECT *, lag(title) OVER w AS pt, lag(category) OVER w AS pc, row_number() OVER w AS rn FROM (
      SELECT user_id AS session_id, ts, last_value(CASE WHEN value >= 40 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts) AS title,
      last_value(CASE WHEN value < 60 THEN 'c' || (event_id % 3) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts) AS category FROM events)
    WINDOW w AS (PARTITION BY session_id ORDER BY ts))
    WHERE (title IS DISTINCT FROM pt OR category IS DISTINCT FROM pc) AND NOT (title IS NULL AND category IS NULL)""")
def change_log(t: Tables) -> DataFrame:
    seen = t.read("events").select(
        F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("at"),
        F.when(F.col("value") >= 40, F.col("event_type")).alias("title"),
        F.when(F.col("value") < 60, F.concat(F.lit("c"), F.col("event_id") % 3)).alias("category"),
    )
    day = F.floor(TM.epoch_seconds(F.col("at")) / 86400)
    return sessions.meta_history(seen, day).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("session_spend", "SELECT session_id, round(sum(cost_usd), 4) AS session_spend FROM costs GROUP BY session_id", ("costs",))
def session_spend(t: Tables) -> DataFrame:
    return budget.session_spend(t.cost_windows, t.cost_summaries).withColumn("session_spend", F.round("session_spend", 4))


@query("monthly_spend", "SELECT strftime(created_at, '%Y-%m') AS month, round(sum(cost_usd), 4) AS month_spend FROM costs GROUP BY 1", ("costs",))
def monthly_spend(t: Tables) -> DataFrame:
    return budget.monthly_spend(t.cost_windows, t.cost_summaries).withColumn("month_spend", F.round("month_spend", 4))


@query("budget_status", """SELECT s.id AS session_id, strftime(s.started_at, '%Y-%m') AS month, coalesce(a.v, 0) >= 5 AS session_exceeded, coalesce(b.v, 0) >= 20 AS monthly_exceeded,
    CASE WHEN coalesce(b.v, 0) >= 20 THEN 'monthly budget exceeded — extraction paused (transcription continues)'
    WHEN coalesce(a.v, 0) >= 5 THEN 'session budget exceeded — extraction paused (transcription continues)' ELSE '' END AS reason
    FROM sessions s LEFT JOIN (SELECT session_id, sum(cost_usd) AS v FROM costs GROUP BY 1) a ON a.session_id = s.id
    LEFT JOIN (SELECT strftime(created_at, '%Y-%m') AS m, sum(cost_usd) AS v FROM costs GROUP BY 1) b ON b.m = strftime(s.started_at, '%Y-%m')""", ("sessions", "costs"))
def budget_status(t: Tables) -> DataFrame:
    return budget.status(t.sessions, t.cost_windows, t.cost_summaries, TM.month(F.col("started_at"))).select(
        "session_id", "month", "session_exceeded", "monthly_exceeded", "reason")


@query("call_cost", """SELECT doc_id, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens,
    round(greatest(1, length(text) // 4) / 1000 * 0.0005 + 100 / 1000 * 0.0015, 8) AS cost_usd FROM documents""")
def call_cost(t: Tables) -> DataFrame:
    tok = X.approx_tokens(F.col("text"))
    return t.read("documents").select("doc_id", tok.alias("tokens"), F.round(budget.cost(tok, F.lit(100)), 8).alias("cost_usd"))


@query("latest_summary", "SELECT session_id, kind, max(id) AS id FROM told GROUP BY session_id, kind", ("told",))
def latest_summary(t: Tables) -> DataFrame:
    return summaries.latest(t.told)


@query("previous_sessions", """SELECT session_id, back, final_summary FROM (SELECT s.id AS session_id, p.final_summary,
    row_number() OVER (PARTITION BY s.id ORDER BY p.id DESC) AS back FROM sessions s JOIN sessions p ON p.channel_id = s.channel_id AND p.id < s.id
    AND p.final_summary IS NOT NULL) WHERE back <= 2""", ("sessions",))
def previous_sessions(t: Tables) -> DataFrame:
    return context.previous(t.sessions).select("session_id", F.col("back").cast("bigint").alias("back"), "final_summary")


@query("dormancy", """SELECT id AS session_id, strftime(cutoff, '%Y-%m-%d') AS cutoff FROM (SELECT id, lag(started_at, 3) OVER (PARTITION BY channel_id ORDER BY id) AS cutoff
    FROM sessions) WHERE cutoff IS NOT NULL""", ("sessions",))
def dormancy(t: Tables) -> DataFrame:
    return context.dormancy_cutoff(t.sessions).select("session_id", F.date_format("cutoff", "yyyy-MM-dd").alias("cutoff"))


@query("pending", f"""SELECT id FROM sessions s WHERE status IN ('ended', 'interrupted') AND final_summary IS NULL
    AND (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ended_at)) / 1e6 <= 86400 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = s.id)
    ORDER BY id DESC LIMIT 2""", ("sessions",))
def pending(t: Tables) -> DataFrame:
    events = t.read("lineitem").select(F.col("l_orderkey").alias("session_id"))
    return final.pending(t.sessions, events, ts(NOW), limit=final.PER_TICK).select("id")


@query("pending_all", f"""SELECT id FROM sessions s WHERE status IN ('ended', 'interrupted') AND final_summary IS NULL
    AND (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ended_at)) / 1e6 <= 86400 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = s.id)""", ("sessions",))
def pending_all(t: Tables) -> DataFrame:
    events = t.read("lineitem").select(F.col("l_orderkey").alias("session_id"))
    return final.pending(t.sessions, events, ts(NOW), limit=None).select("id")


@query("cooldown", f"""SELECT channel_id, id AS session_id FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY id DESC) AS r FROM sessions
    WHERE source = 'live') s WHERE r = 1 AND (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ended_at)) / 1e6 <= 600
    AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = s.id AND l_returnflag = 'A')""", ("sessions",))
def cooldown(t: Tables) -> DataFrame:
    spoken = t.read("lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("session_id"))
    return sessions.in_cooldown(t.sessions, spoken, ts(NOW))


_LEASED = "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber > 4"
_NOW_S = 993988800.0


def _leases(t: Tables) -> DataFrame:
    return t.read("lineitem").select(
        F.concat(F.lit("session:"), F.col("l_orderkey")).alias("key"), F.col("l_orderkey").alias("session_id"),
        F.when(F.col("l_linenumber") > 4, F.lit(_NOW_S + 10)).otherwise(F.lit(_NOW_S - 10)).alias("expires_at"),
    )


@query("orphans", f"SELECT id, channel_id FROM sessions WHERE status = 'live' AND epoch(started_at) <= {_NOW_S} - 30 AND id NOT IN ({_LEASED})", ("sessions",))
def orphans(t: Tables) -> DataFrame:
    return sessions.orphans(t.sessions, _leases(t), _NOW_S).select("id", "channel_id")


@query("reconcile", f"""SELECT id, CASE WHEN o THEN 'interrupted' ELSE status END AS status, strftime(CASE WHEN o THEN coalesce(ended_at, TIMESTAMP '{NOW}')
    ELSE ended_at END, '%Y-%m-%d %H:%M:%S') AS ended_at FROM (SELECT *, status = 'live' AND epoch(started_at) <= {_NOW_S} - 30
    AND id NOT IN ({_LEASED}) AS o FROM sessions)""", ("sessions",))
def reconcile(t: Tables) -> DataFrame:
    base = t.sessions.withColumns({"last_error": F.lit(None).cast("string"), "last_error_at": F.lit(None).cast("timestamp")})
    return sessions.reconcile(base, _leases(t), _NOW_S)[0].select("id", "status", F.date_format("ended_at", "yyyy-MM-dd HH:mm:ss").alias("ended_at"))


@query("summary_session", """SELECT channel_id, id AS session_id, live FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY live DESC, id DESC) AS r FROM (
    SELECT channel_id, id, status = 'live' AS live FROM sessions s WHERE source = 'live' AND (status = 'live'
    OR EXISTS (SELECT 1 FROM told WHERE session_id = s.id AND kind IN ('rolling', 'full'))))) WHERE r = 1""", ("sessions", "told"))
def summary_session(t: Tables) -> DataFrame:
    return sessions.summary_session(t.sessions, t.told)


@query("told_sessions", "SELECT id, status FROM sessions s WHERE EXISTS (SELECT 1 FROM told WHERE session_id = s.id AND kind IN ('rolling', 'full'))", ("sessions", "told"))
def told_sessions(t: Tables) -> DataFrame:
    return sessions.with_any_summary(t.sessions, t.told).select("id", "status")


@query("live_session", """SELECT c.login, s.channel_id, max(s.id) AS session_id FROM sessions s JOIN channels c ON c.id = s.channel_id
    WHERE s.status = 'live' GROUP BY c.login, s.channel_id""", ("sessions", "channels"))
def live_session(t: Tables) -> DataFrame:
    return sessions.live(t.sessions, t.channels)


@query("choose_session", """SELECT c.id AS viewer_id, CASE WHEN k.id IS NOT NULL AND (c.id % 2 = 0 OR k.status = 'live') THEN k.id
    ELSE coalesce(n.running, k.id, n.newest) END AS session_id FROM channels c
    LEFT JOIN sessions k ON k.id = c.id * 7 AND k.channel_id = c.id
    LEFT JOIN (SELECT channel_id, max(id) AS newest, max(id) FILTER (status = 'live') AS running FROM sessions GROUP BY channel_id) n ON n.channel_id = c.id
    WHERE n.newest IS NOT NULL""", ("sessions", "channels"))
def choose_session(t: Tables) -> DataFrame:
    viewers = t.channels.select(
        F.col("id").alias("viewer_id"), F.col("id").alias("channel_id"), (F.col("id") * 7).alias("current_id"), (F.col("id") % 2 == 0).alias("picked")
    )
    return sessions.choose(viewers, t.sessions).where("session_id IS NOT NULL")


@query("newest_sessions", """SELECT s.id, s.channel_id, s.status, c.login FROM sessions s JOIN channels c ON c.id = s.channel_id ORDER BY s.id DESC LIMIT 200""", ("sessions", "channels"))
def newest_sessions(t: Tables) -> DataFrame:
    base = t.sessions.withColumns({"category": F.lit(None).cast("string"), "last_error": F.lit(None).cast("string")})
    return sessions.newest(base, t.channels, 1000).select("id", "channel_id", "status", "login")


@query("session_errors", """SELECT s.id, CASE WHEN f.session_id IS NULL OR k.m > f.m THEN NULL ELSE f.err END AS last_error FROM sessions s
    LEFT JOIN (SELECT l_orderkey AS session_id, max(l_partkey * 10 + l_linenumber) AS m,
       arg_max((CASE WHEN l_linenumber % 2 = 0 THEN 'recap' ELSE 'rolling' END) || ': E' || l_linenumber, l_partkey * 10 + l_linenumber) AS err,
       arg_max(l_linenumber % 2, l_partkey * 10 + l_linenumber) AS st FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) f ON f.session_id = s.id
    LEFT JOIN (SELECT l_orderkey AS session_id, l_linenumber % 2 AS st, max(l_partkey * 10 + l_linenumber) AS m FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2) k
    ON k.session_id = s.id AND k.st = f.st""", ("sessions",))
def session_errors(t: Tables) -> DataFrame:
    reports = t.read("lineitem").select(
        F.col("l_orderkey").alias("session_id"), F.timestamp_seconds(F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("at"),
        F.lit(0).cast("bigint").alias("seq"), F.when(F.col("l_linenumber") % 2 == 0, "recap").otherwise("rolling").alias("stage"),
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("E"), F.col("l_linenumber"))).alias("error_type"),
    )
    base = t.sessions.withColumns({"last_error": F.lit(None).cast("string"), "last_error_at": F.lit(None).cast("timestamp")})
    return sessions.set_errors(base, reports).select("id", "last_error")


@query("recap_threads", """SELECT channel_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY last_updated_at DESC, id DESC) AS rank
    FROM threads WHERE status <> 'resolved') WHERE rank <= 6""", ("threads",))
def recap_threads(t: Tables) -> DataFrame:
    return recap.open_threads(t.threads).select("channel_id", "id", F.col("rank").cast("bigint").alias("rank"))


@query("final_threads", """SELECT channel_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY last_updated_at DESC, id) AS rank
    FROM threads) WHERE rank <= 8""", ("threads",))
def final_threads(t: Tables) -> DataFrame:
    return final.select_threads(t.threads).select("channel_id", "id", F.col("rank").cast("bigint").alias("rank"))


@query("rolling_prompts", """SELECT w.id AS window_id, coalesce(string_agg(e.description, chr(10) ORDER BY e.id) FILTER (r <= 10), '') AS new_events FROM ev_windows w
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY id) AS r FROM ev_events) e ON e.window_id = w.id GROUP BY w.id""", ("ev_windows", "ev_events"))
def rolling_prompts(t: Tables) -> DataFrame:
    asked = summaries.rolling_prompts(t.ev_windows.withColumn("window_summary", F.lit("window")), t.ev_recaps, t.ev_events)
    return asked.select("window_id", F.split("prompt", "\n\nNew events:\n").getItem(1).alias("new_events"))


@query("hours_late", """SELECT session_id, hour, count(*) AS late FROM ev_timed e WHERE EXISTS (SELECT 1 FROM ev_runs r WHERE r.session_id = e.session_id
    AND r.hour_index = e.hour AND r.status = 'done') GROUP BY session_id, hour""", ("ev_timed", "ev_runs"))
def hours_late(t: Tables) -> DataFrame:
    """Events that fall into a finished hour and are therefore not shown."""
    done = t.ev_runs.where("status = 'done'").select("session_id", F.col("hour_index").alias("hour"))
    return _timed(t).join(done, ["session_id", "hour"], "left_semi").groupBy("session_id", "hour").agg(F.count(F.lit(1)).alias("late"))
