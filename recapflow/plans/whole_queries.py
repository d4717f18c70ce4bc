"""Whole runs over the driver tables, from the choice of rows to the stored result. The model hooks are fed plain rules in
place of a model, so that the SQL sees the full prompts."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recapflow.operators import context, evaluation, extract, final, infer, recap, timeline, triage
from recapflow.params import Params
from recapflow.plans.bindings import EV_NOW, Tables, ts
from recapflow.plans.memory_queries import _TEXTS, _texts
from recapflow.plans.registry import query
from recapflow.plans.session_queries import _CHOSEN, _CLOSED, _KEY


class Echo(infer.StubModel):
    """Answers a text request with its prompt."""

    def generate_text(self, prompt: str, system: str = "", max_tokens: int = 500) -> str:
        return prompt


class Beats(infer.StubModel):
    """One beat for all events that the prompt lists."""

    def generate_json(self, prompt: str, system: str = "") -> str:
        ids = [int(x) for x in re.findall(r"^- id (\d+) ", prompt, re.M)]
        return json.dumps({"beats": [{"headline": f"beat of {len(ids)}", "significance": 3, "event_ids": ids}]})


class Moody(infer.StubModel):
    """Answers by the first word of the prompt: an empty document until nudged, unreadable text or an error until asked
    to repair it, unreadable text always, or a good answer at once."""

    def generate_json(self, prompt: str, system: str = "") -> str:
        good = super().generate_json(prompt, system)
        mood, nudged, repair = prompt.split(" ")[0], infer.NUDGE in prompt, infer.REPAIR in prompt
        if mood == "error" and not repair:
            raise TimeoutError
        if mood == "signup" or (mood == "click" and not repair):
            return "no document"
        return good if mood != "view" or nudged or repair else good.replace(infer.STUB_TEXT, " ")


class Reader:
    """Classifies by the length of the text it is given."""

    def ask(self, state: str, questions: str) -> str:
        n = len(state)
        if n % 11 == 0:
            raise TimeoutError
        score, sure, new = n % 3, 0.9 if n % 4 else 0.5, 0.7 if n % 5 == 0 else 0.1
        return json.dumps({"answers": {"importance": {"score": score, "confidence": sure}, "new_character": {"noul": new}}})


def _limits(**more) -> Params:
    return Params(session_budget_usd=70.0, monthly_budget_usd=0.0, model_backoff_seconds=0.0, **more)


def _priced(t: Tables) -> DataFrame:
    """Windows whose calls cost one per event."""
    return t.ev_windows.withColumn("cost_usd", F.col("n").cast("double"))


#: Sessions over their budget.
_OVER = "over AS (SELECT user_id AS session_id FROM ev GROUP BY user_id HAVING count(*) >= 70)"
_LINE = """'[' || printf('%02d', CAST(floor({t}) AS BIGINT) // 60) || ':' || lpad(CAST(CAST(floor({t}) AS BIGINT) % 60 AS VARCHAR), 2, '0') || ' | importance ' || importance || ' | ' || type || '] ' || description"""


def _no_names(t: Tables) -> DataFrame:
    return t.channels.limit(0).select(F.col("id").alias("channel_id"), F.col("login").alias("speaker"), F.col("login").alias("name"))


def _stored(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"created_at": ts(EV_NOW), "cost_usd": F.lit(0.0)})


_RECAP = f"""{_CHOSEN}, {_OVER}, ky AS ({_KEY}),
  saved AS (SELECT k.session_id, CASE WHEN k.session_id % 4 = 0 THEN key ELSE cache_key END AS cache_key FROM ky k JOIN ev_recaps r ON r.session_id = k.session_id WHERE k.session_id % 4 < 3),
  ev_lines AS (SELECT c.session_id, string_agg('- ' || CASE WHEN coalesce(try_cast(split_part(s.cache_key, ':', 1) AS BIGINT), 0) <> 0 AND id > try_cast(split_part(s.cache_key, ':', 1) AS BIGINT)
      THEN '[NEW] ' ELSE '' END || {_LINE.format(t="c.t_start")}, chr(10) ORDER BY id DESC) AS told FROM chosen c LEFT JOIN saved s ON s.session_id = c.session_id GROUP BY c.session_id),
  th_lines AS (SELECT channel_id, string_agg('- ' || title || ': ' || summary, chr(10) ORDER BY r) AS told FROM (
      SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY last_updated_at DESC, id DESC) AS r FROM threads WHERE status <> 'resolved') WHERE r <= 6 GROUP BY channel_id),
  plain AS (SELECT session_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS r FROM ev_votes WHERE kind = 'recap') WHERE r <= 10 GROUP BY session_id
      HAVING count(*) FILTER (vote IN ('no', 'not_sure')) >= 2 OR (count(*) <= 2 AND count(*) FILTER (vote IN ('no', 'not_sure')) = count(*)))"""


@query("recap_run", """SELECT k.session_id, CASE WHEN s.cache_key = k.key THEN 'cached' WHEN o.session_id IS NOT NULL AND s.session_id IS NOT NULL THEN 'limited'
      WHEN o.session_id IS NOT NULL THEN 'rejected' ELSE 'fresh' END AS branch,
    CASE WHEN s.cache_key = k.key OR (o.session_id IS NOT NULL AND s.session_id IS NOT NULL) THEN 'old recap' WHEN o.session_id IS NULL THEN
      'Open storylines:' || chr(10) || coalesce(h.told, '(none)') || chr(10) || chr(10) || 'Events, newest first:' || chr(10) || coalesce(e.told, '(none)') || chr(10) || chr(10) || 'Recap in at most 100 words.'
      || CASE WHEN s.session_id IS NOT NULL THEN chr(10) || chr(10) || 'Already shown:' || chr(10) || 'old recap' ELSE '' END
      || CASE WHEN p.session_id IS NOT NULL THEN chr(10) || chr(10) || 'Use short plain sentences.' ELSE '' END END AS text
    FROM ky k JOIN ev_sessions x ON x.id = k.session_id LEFT JOIN saved s ON s.session_id = k.session_id LEFT JOIN over o ON o.session_id = k.session_id
    LEFT JOIN ev_lines e ON e.session_id = k.session_id LEFT JOIN th_lines h ON h.channel_id = x.channel_id LEFT JOIN plain p ON p.session_id = k.session_id""",
       ("ev_sessions", "ev", "ev_events", "threads", "ev_votes", "ev_recaps"), _RECAP)
def recap_run(t: Tables) -> DataFrame:
    """Recaps of all sessions: stored ones of the present key, of older keys and none; some sessions over budget."""
    state = recap.keys(t.ev_sessions, t.ev_events, t.threads)
    saved = t.ev_recaps.join(state, "session_id").where("session_id % 4 < 3")
    saved = _stored(saved.withColumn("cache_key", F.when(F.col("session_id") % 4 == 0, F.col("key")).otherwise(F.col("cache_key"))))
    answers, _ = recap.recap(
        t.ev_sessions, _priced(t), t.ev_events, t.threads, saved, t.ev_votes, _no_names(t), ts(EV_NOW), Echo, p=_limits()
    )
    return answers.select("session_id", "branch", "text")


_FULL = f"""{_CHOSEN}, {_OVER},
  fk AS (SELECT session_id, 'session-v4:' || coalesce(max(id) FILTER (importance >= 3), 0) || ':' || ((count(*) - 1) // 3 + 1) AS key FROM ev_events GROUP BY session_id),
  saved AS (SELECT session_id, CASE session_id % 4 WHEN 0 THEN key WHEN 1 THEN 'session-v4:0:0' ELSE 'session-v3:1' END AS cache_key,
      CASE session_id % 4 WHEN 0 THEN 'old full' WHEN 1 THEN 'older' ELSE 'oldest' END AS text FROM fk WHERE session_id % 4 < 3),
  ev_lines AS (SELECT session_id, string_agg('- ' || {_LINE.format(t="t_start")}, chr(10) ORDER BY id DESC) AS told FROM chosen GROUP BY session_id),
  hist AS (SELECT session_id, string_agg('- Hour ' || (hour_index + 1) || ': ' || headline, chr(10) ORDER BY hour_index, id) AS told FROM (
      SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY hour_index, id) AS r FROM ev_beats) WHERE r <= 120 GROUP BY session_id),
  early AS (SELECT f.session_id, string_agg('- ' || description, chr(10) ORDER BY id) AS told FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) AS r FROM ev_events) f
      WHERE r <= 20 AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.session_id = f.session_id AND c.id = f.id) GROUP BY f.session_id),
  got AS (SELECT k.session_id, o.session_id IS NOT NULL AS paused, CASE WHEN s.cache_key = k.key THEN 'cached' WHEN o.session_id IS NOT NULL AND s.session_id IS NOT NULL THEN 'limited'
      WHEN o.session_id IS NOT NULL THEN 'rejected' ELSE 'fresh' END AS branch, s.text AS stored,
      'Events, newest first:' || chr(10) || coalesce(e.told, '(none)') || chr(10) || chr(10) || 'Previous overview:' || chr(10) || CASE WHEN k.session_id % 4 < 2 THEN s.text ELSE '(none)' END
      || chr(10) || chr(10) || 'Earlier highlights:' || chr(10) || coalesce(h.told, CASE WHEN k.session_id % 4 >= 2 THEN y.told END, '(none)') || chr(10) || chr(10) || 'Overview in at most 200 words.' AS prompt
    FROM fk k LEFT JOIN saved s ON s.session_id = k.session_id LEFT JOIN over o ON o.session_id = k.session_id LEFT JOIN ev_lines e ON e.session_id = k.session_id
    LEFT JOIN hist h ON h.session_id = k.session_id LEFT JOIN early y ON y.session_id = k.session_id)"""


@query("full_run", """SELECT session_id, branch, text, CASE WHEN branch = 'cached' AND session_id % 8 = 0 THEN 'old preview' WHEN NOT paused THEN text END AS preview FROM (
    SELECT *, CASE WHEN branch = 'fresh' THEN prompt ELSE stored END AS text FROM got WHERE branch <> 'rejected')""", ("ev_sessions", "ev", "ev_events", "ev_beats"), _FULL)
def full_run(t: Tables) -> DataFrame:
    """Cumulative summaries and previews of all sessions: of the present key, of an older and of an untrusted version, and none."""
    k = F.col("session_id") % 4
    known = recap.full_keys(t.ev_sessions, t.ev_events).where(k < 3).withColumn("id", F.col("session_id"))
    key = F.when(k == 0, F.col("full_key")).when(k == 1, "session-v4:0:0").otherwise("session-v3:1")
    text = F.when(k == 0, "old full").when(k == 1, "older").otherwise("oldest")
    full = known.select("id", "session_id", F.lit("full").alias("kind"), text.alias("text"), key.alias("cache_key"))
    short = known.where("session_id % 8 = 0").select(
        (F.col("id") + 10**6).alias("id"), "session_id", F.lit("full-preview").alias("kind"), F.lit("old preview").alias("text"), F.col("full_key").alias("cache_key"))
    answers, _, _ = recap.full(
        t.ev_sessions, _priced(t), t.ev_events, t.ev_beats, _stored(full.unionByName(short)), _no_names(t), ts(EV_NOW), Echo, p=_limits()
    )
    return answers


_FINAL = f"""{_OVER}, ev_lines AS (SELECT session_id, string_agg('- [' || CAST(floor(t_start) AS BIGINT) // 3600 || ':' || lpad(CAST(CAST(floor(t_start) AS BIGINT) % 3600 // 60 AS VARCHAR), 2, '0') || ':'
      || lpad(CAST(CAST(floor(t_start) AS BIGINT) % 60 AS VARCHAR), 2, '0') || ' | importance ' || importance || '] ' || description, chr(10) ORDER BY t_start, id) AS told FROM (
      SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY importance DESC, id DESC) AS r FROM ev_events) WHERE r <= 40 GROUP BY session_id),
  th_lines AS (SELECT channel_id, string_agg('- ' || title || ' (' || status || '): ' || summary, chr(10) ORDER BY r) AS told FROM (
      SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY last_updated_at DESC, id) AS r FROM threads) WHERE r <= 8 GROUP BY channel_id)"""


@query("final_run", f"""SELECT s.id, CASE WHEN s.id % 5 = 0 THEN 'told' WHEN status IN ('ended', 'interrupted') AND (epoch_us(TIMESTAMP '{EV_NOW}') - epoch_us(ended_at)) / 1e6 <= 72 * 3600 AND o.session_id IS NULL
      AND e.session_id IS NOT NULL THEN CASE WHEN s.id % 2 = 0 THEN 'Title: stream ' || s.id || chr(10) ELSE '' END || 'Events in order:' || chr(10) || e.told || chr(10) || chr(10)
      || 'Storylines at the end:' || chr(10) || coalesce(h.told, '(none)') END AS final_summary
    FROM ev_sessions s LEFT JOIN over o ON o.session_id = s.id LEFT JOIN ev_lines e ON e.session_id = s.id LEFT JOIN th_lines h ON h.channel_id = s.channel_id""",
       ("ev_sessions", "ev", "ev_events", "threads"), _FINAL)
def final_run(t: Tables) -> DataFrame:
    """Wrap-ups of the sessions that ended within three days, those told before and those over budget left as they are."""
    title = F.when(F.col("id") % 2 == 0, F.concat(F.lit("stream "), F.col("id"))).otherwise("")
    told = F.when(F.col("id") % 5 == 0, "told")
    sessions = t.ev_sessions.withColumns({"title": title, "category": F.lit(None).cast("string"), "final_summary": told})
    nothing = _stored(t.ev_recaps.limit(0))
    return final.run(sessions, _priced(t), t.ev_events, t.threads, nothing, ts(EV_NOW), Echo, p=_limits(max_age_hours=72.0))[0].select("id", "final_summary")


_BEATS = f"""{_CLOSED}, {_OVER}, due AS (SELECT session_id, hour FROM (SELECT session_id, unnest(range(closed_hours)) AS hour FROM closed
      WHERE status IN ('live', 'degraded') OR ended_at >= TIMESTAMP '{EV_NOW}' - INTERVAL 72 HOUR) d
      WHERE NOT EXISTS (SELECT 1 FROM ev_runs r WHERE r.session_id = d.session_id AND r.hour_index = d.hour) AND session_id NOT IN (SELECT session_id FROM over)),
  listed AS (SELECT session_id, hour, count(*) AS n, min("at") AS t_start, max("at") AS t_end, string_agg('- id ' || id || ' [' || CAST(floor("at" / 3600) AS BIGINT) || ':' ||
      lpad(CAST(CAST(floor("at") AS BIGINT) % 3600 // 60 AS VARCHAR), 2, '0') || ' | importance ' || importance || '] ' || description, chr(10) ORDER BY "at", id) AS told
      FROM ev_timed WHERE importance >= 3 GROUP BY session_id, hour),
  given AS (SELECT session_id, hour, string_agg('- ' || headline, chr(10) ORDER BY back DESC) AS told FROM (
      SELECT d.session_id, d.hour, b.headline, row_number() OVER (PARTITION BY d.session_id, d.hour ORDER BY b.hour_index DESC, b.t_start DESC, b.id DESC) AS back
      FROM due d JOIN ev_beats b ON b.session_id = d.session_id AND b.hour_index < d.hour) WHERE back <= 4 GROUP BY session_id, hour)"""


@query("beats_run", """SELECT d.session_id, d.hour AS hour_index, CASE WHEN l.n IS NULL THEN 'skipped' ELSE 'done' END AS status, CASE WHEN l.n IS NOT NULL THEN 'beat of ' || l.n END AS headline,
      coalesce(l.n, 0) AS n_events, round(l.t_start, 6) AS t_start, round(l.t_end, 6) AS t_end, CAST(length('Stream hour ' || (d.hour + 1) || chr(10) || 'Events in order:' || chr(10) || l.told ||
      CASE WHEN g.told IS NULL THEN '' ELSE chr(10) || chr(10) || 'Already on the timeline:' || chr(10) || g.told END) // 4 AS BIGINT) AS tokens_in
    FROM due d LEFT JOIN listed l ON l.session_id = d.session_id AND l.hour = d.hour LEFT JOIN given g ON g.session_id = d.session_id AND g.hour = d.hour""",
       ("ev_sessions", "ev", "ev_timed", "ev_runs", "ev_beats"), _BEATS)
def beats_run(t: Tables) -> DataFrame:
    """All due hours of all sessions within budget: a beat of the hour's notable events, or a mark that there are none."""
    nothing = _stored(t.ev_recaps.limit(0))
    made, runs = timeline.generate(
        t.ev_sessions, _priced(t), t.ev_events, nothing, t.ev_beats, t.ev_runs, ts(EV_NOW), Beats, p=_limits(max_age_hours=72.0)
    )
    beats = made.select("session_id", "hour_index", "headline", F.size("event_ids").cast("bigint").alias("n"), "t_start", "t_end", "tokens_in")
    return runs.select("session_id", "hour_index", "status").join(beats, ["session_id", "hour_index"], "left").select(
        "session_id", "hour_index", "status", "headline", F.coalesce("n", F.lit(0)).alias("n_events"),
        F.round("t_start", 6).alias("t_start"), F.round("t_end", 6).alias("t_end"), "tokens_in",
    )


_TOKENS_OUT = len(infer.StubModel().generate_json("")) // 4


@query("extract_run", f"""SELECT w.id, CASE WHEN w.id % 3 = 2 THEN 'done' WHEN w.id % 7 = 0 THEN 'skipped-idle' WHEN o.session_id IS NOT NULL THEN 'failed' WHEN mood = 'signup' THEN 'failed' ELSE 'done' END AS status,
    CASE WHEN asked AND mood <> 'signup' THEN '{infer.STUB_TEXT}' END AS window_summary, CASE WHEN asked AND mood <> 'signup' THEN greatest(1, length(prompt) // 4) END AS tokens_in,
    CASE WHEN asked AND mood <> 'signup' THEN {_TOKENS_OUT} END::BIGINT AS tokens_out,
    round(CASE WHEN asked AND mood <> 'signup' THEN greatest(1, length(prompt) // 4) / 1000 * 0.0005::DOUBLE + {_TOKENS_OUT} / 1000 * 0.0015::DOUBLE WHEN w.id % 3 = 2 THEN n END, 8) AS cost_usd,
    w.id % 3 < 2 AND w.id % 7 <> 0 AND o.session_id IS NOT NULL AS refused
    FROM (SELECT w.*, p.prompt, split_part(p.prompt, ' ', 1) AS mood, w.id % 3 < 2 AND w.id % 7 <> 0 AND w.session_id NOT IN (SELECT session_id FROM over) AS asked FROM ev_windows w JOIN pr p ON p.window_id = w.id) w
    LEFT JOIN over o ON o.session_id = w.session_id""", ("ev_sessions", "ev_windows", "ev_events"),
       "over AS (SELECT session_id FROM ev_windows WHERE id % 3 = 2 GROUP BY session_id HAVING sum(n) >= 20), pr AS (SELECT window_id, string_agg(description, ' | ' ORDER BY id) AS prompt FROM ev_events GROUP BY window_id)")
def extract_run(t: Tables) -> DataFrame:
    """Open windows through the budget gate, the idle mark, the model with retries, nudge and repair, and the accounts."""
    lines = F.array_sort(F.collect_list(F.struct("id", "description")))
    prompts = t.ev_events.groupBy("window_id").agg(F.array_join(F.transform(lines, lambda e: e["description"]), " | ").alias("prompt"))
    none = lambda kind: F.lit(None).cast(kind)
    done = F.col("id") % 3 == 2
    windows = t.ev_windows.withColumns({
        "status": F.when(done, "done").otherwise("extracting"), "extraction_json": none("string"), "window_summary": none("string"),
        "latency_ms": none("bigint"), "tokens_in": none("bigint"), "tokens_out": none("bigint"), "cost_usd": F.when(done, F.col("n").cast("double")),
    })
    idle = t.ev_windows.select(F.col("id").alias("window_id"), (F.col("id") % 7 == 0).alias("idle"))
    p = Params(session_budget_usd=20.0, monthly_budget_usd=0.0, model_backoff_seconds=0.0)
    got, _ = extract.run(windows, prompts, t.ev_sessions, _stored(t.ev_recaps.limit(0)), ts(EV_NOW), Moody, idle, p=p)
    return got.select("id", "status", "window_summary", "tokens_in", "tokens_out", F.round("cost_usd", 8).alias("cost_usd"),
                      F.coalesce(F.col("extraction_json").startswith('{"skipped"'), F.lit(False)).alias("refused"))


_STATES = """pp AS (SELECT channel_id, string_agg('- ' || canonical_name || ': ' || description, chr(10) ORDER BY r) AS told FROM (
      SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY mention_count DESC, id) AS r FROM entities) WHERE r <= 50 GROUP BY channel_id),
  st AS (SELECT channel_id, string_agg('- ' || title || ': ' || summary, chr(10) ORDER BY r) AS told FROM (
      SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY last_updated_at DESC, id) AS r FROM threads WHERE status = 'open') WHERE r <= 20 GROUP BY channel_id),
  ln AS (SELECT w.window_id, length('[known_people]' || chr(10) || coalesce(p.told, '(none known yet)') || chr(10) || '[/known_people]' || chr(10) || '[open_storylines]' || chr(10) ||
      coalesce(s.told, '(none open yet)') || chr(10) || '[/open_storylines]' || chr(10) || '[transcript]' || chr(10) || w.text || chr(10) || '[/transcript]') AS n
      FROM (SELECT conv_id * 1000 + turn AS window_id, 9 + conv_id % 9 AS channel_id, text FROM conversations) w LEFT JOIN pp p ON p.channel_id = w.channel_id LEFT JOIN st s ON s.channel_id = w.channel_id)"""


@query("triage_run", """SELECT window_id, CAST(CASE WHEN n % 11 = 0 THEN -1 ELSE n % 3 + 1 END AS INTEGER) AS importance, CASE WHEN n % 11 = 0 THEN 0 WHEN n % 4 > 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence,
    n % 11 <> 0 AND n % 5 = 0 AS new_character, n % 11 <> 0 AND n % 3 = 0 AND n % 4 > 0 AND n % 5 > 0 AS idle FROM ln""", ("entities", "threads"), _STATES)
def triage_run(t: Tables) -> DataFrame:
    """Every turn as a window, classified in view of the people and storylines of its channel; failed calls leave it open."""
    said = t.read("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("window_id"), (F.col("conv_id") % 9 + 9).alias("channel_id"), "text")
    got = triage.run(said, t.entities, t.threads, Reader, _limits(model_retries=0))
    return got.select("window_id", F.coalesce("importance", F.lit(-1)).alias("importance"), F.col("importance_confidence").alias("confidence"), "new_character", "idle")


@query("ab_test", """SELECT count(*) AS rows, round(avg((n % 3 = (n + 1) % 3 OR n % 2 = 0)::INTEGER), 6) AS decision_agreement, round(avg(n % 7), 6) AS mean_ms_a, round(avg(n % 5), 6) AS mean_ms_b
    FROM (SELECT length(text) AS n FROM conversations WHERE (conv_id + turn) % 4 <> 1)""")
def ab_test(t: Tables) -> DataFrame:
    """Two classifiers over the turns; the second has answered fewer and differs on texts of odd length."""
    n = F.length("text").cast("bigint")
    rows = t.read("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), n.alias("n"), ((F.col("conv_id") + F.col("turn")) % 4).alias("k"))
    a = rows.select("id", (F.col("n") % 3).alias("decision"), (F.col("n") % 7).alias("latency_ms"))
    b = rows.where("k <> 1").select("id", F.when(F.col("n") % 2 == 0, F.col("n") % 3).otherwise((F.col("n") + 1) % 3).alias("decision"), (F.col("n") % 5).alias("latency_ms"))
    got = evaluation.ab(a, b, "id", ["decision"])
    return got.select("rows", *[F.round(c, 6).alias(c) for c in ("decision_agreement", "mean_ms_a", "mean_ms_b")])


# ---------------------------------------------------------------- context


@query("extra_context", """SELECT window_id, seq, text FROM (SELECT w.id AS window_id, row_number() OVER (PARTITION BY w.id ORDER BY e.t_start, e.id) AS seq, e.description AS text
    FROM ev_windows w JOIN ev_events e ON e.session_id = w.session_id AND e.t_start < w.t_end AND e.t_end > w.t_start)""", ("ev_windows", "ev_events"))
def extra_context(t: Tables) -> DataFrame:
    """Events as rows of a further source, for the windows whose time they touch."""
    windows = t.ev_windows.select(F.col("id").alias("window_id"), "session_id", "t_start", "t_end")
    return context.extra(windows, t.ev_events.select("session_id", "id", "t_start", "t_end", F.col("description").alias("text")))


_PACKS = _TEXTS + """,
  wn AS (SELECT window_id, window_id AS session_id, channel_id, text FROM tx),
  cs AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY tier, seen DESC, mention_count DESC, id) AS rank FROM (
    SELECT w.window_id, e.*, CASE WHEN e.id = h.s THEN 1 WHEN regexp_matches(lower(w.text), '(^|\\W)' || lower(e.canonical_name) || '(\\W|$)')
      OR EXISTS (SELECT 1 FROM aliases a WHERE a.entity_id = e.id AND regexp_matches(lower(w.text), '(^|\\W)' || lower(a.alias) || '(\\W|$)')) THEN 2 ELSE 3 END AS tier
    FROM wn w JOIN entities e ON e.channel_id = w.channel_id AND e.status <> 'merged'
    LEFT JOIN (SELECT c_custkey AS channel_id, c_custkey * 3 AS s FROM customer WHERE c_custkey % 5 = 0) h ON h.channel_id = w.channel_id)),
  pv AS (SELECT s.id AS session_id, p.started_at, p.title, p.final_summary, row_number() OVER (PARTITION BY s.id ORDER BY p.id DESC) AS back
    FROM sessions s JOIN sessions p ON p.channel_id = s.channel_id AND p.id < s.id AND p.final_summary IS NOT NULL),
  cu AS (SELECT id AS session_id, lag(started_at, 3) OVER (PARTITION BY channel_id ORDER BY id) AS cutoff FROM sessions),
  tr AS (SELECT w.window_id, t.id, t.title, t.summary, row_number() OVER (PARTITION BY w.window_id ORDER BY t.last_updated_at DESC, t.importance DESC, t.id) AS rank
    FROM wn w LEFT JOIN cu c ON c.session_id = w.session_id JOIN threads t ON t.channel_id = w.channel_id AND t.status = 'open' WHERE c.cutoff IS NULL OR t.last_updated_at >= c.cutoff),
  hs AS (SELECT w.window_id, e.id, row_number() OVER (PARTITION BY w.window_id ORDER BY e.id DESC) AS back FROM wn w JOIN ev_windows e ON e.session_id = w.session_id),
  xs AS (SELECT w.window_id, e.description, row_number() OVER (PARTITION BY w.window_id ORDER BY e.t_start, e.id) AS seq FROM wn w JOIN ev_events e ON e.session_id = w.session_id AND e.t_start < 864000 AND e.t_end > 0),
  parts AS (
    SELECT w.window_id, 1 AS block, 0 AS seq, '[meta] title=' || coalesce(s.title, '') || ' category=' || CASE WHEN s.id IS NULL THEN '' ELSE 'shop' END AS text FROM wn w LEFT JOIN sessions s ON s.id = w.session_id
    UNION ALL SELECT w.window_id, 2, 0, '[streamer] ' || CASE WHEN k = 0 THEN c_name ELSE login END || ' (entity E' || CASE WHEN k = 0 THEN (c.id * 3)::VARCHAR ELSE 'None' END || ') aka  | character:  | POV: '
      || CASE WHEN k = 0 AND c.id % 2 = 0 THEN 'observer' ELSE 'participant' END FROM wn w JOIN channels c ON c.id = w.channel_id
    UNION ALL SELECT w.window_id, 3, -back, '[previously ' || strftime(p.started_at, '%Y-%m-%d') || ' ' || p.title || '] ' || p.final_summary FROM wn w JOIN pv p ON p.session_id = w.session_id WHERE back <= 2
    UNION ALL SELECT c.window_id, 4, rank, '[cast] ' || canonical_name || coalesce(' aka ' || a.alias, '') || ' (' || type || ', ' || status || '): ' || description || CASE WHEN tier = 1 THEN ' [STREAMER]' ELSE '' END
      FROM cs c LEFT JOIN aliases a ON a.entity_id = c.id AND lower(a.alias) <> lower(canonical_name) WHERE rank <= 12
    UNION ALL SELECT window_id, 5, rank, '[thread T' || id || '] ' || title || ': ' || summary FROM tr WHERE rank <= 6
    UNION ALL SELECT window_id, 6, -back, '[history] w' || id FROM hs WHERE back <= 3
    UNION ALL SELECT w.window_id, 7, 0, '[rolling] old recap' FROM wn w JOIN ev_recaps r ON r.session_id = w.session_id
    UNION ALL SELECT window_id, 9, seq, description FROM xs),
  run AS (SELECT *, sum(greatest(1, length(text) // 4)) OVER (PARTITION BY window_id ORDER BY block, seq) AS used FROM parts)"""


@query("context_build", "SELECT window_id, string_agg(text, chr(10) ORDER BY block, seq) AS context FROM run WHERE used <= 900 GROUP BY window_id",
       ("entities", "aliases", "sessions", "threads", "channels", "ev_windows", "ev_recaps", "ev_events"), _PACKS)
def context_build(t: Tables) -> DataFrame:
    """Full context pack of the supplier windows, within 900 tokens, events of ten days as a further source."""
    sess = t.sessions.withColumn("category", F.lit("shop"))
    done = t.ev_windows.withColumn("window_summary", F.concat(F.lit("w"), F.col("id"))).withColumn("id", F.col("id") - 10**9)
    told = t.ev_recaps.withColumn("kind", F.lit("rolling"))
    texts = _texts(t)
    spans = texts.select("window_id", "session_id", F.lit(0.0).alias("t_start"), F.lit(864000.0).alias("t_end"))
    more = context.extra(spans, t.ev_events.select("session_id", "id", "t_start", "t_end", F.col("description").alias("text")))
    return context.build(texts, t.channels, sess, t.entities, t.aliases, t.threads, done, told, extra=more, budget=900)
