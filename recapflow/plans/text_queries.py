"""Queries over utterances, texts and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recapflow.functions import text as X
from recapflow.functions import times as TM
from recapflow.functions.ordered import ordinal
from recapflow.operators import audio, context, evaluation, export, guards, infer, mentions, transcript, windows
from recapflow.params import Params
from recapflow.plans.bindings import Tables
from recapflow.plans.registry import query
from recapflow.sources.audio import frame_rms

# The window rule as a recursion over a session's utterances in order.
_WINDOWS = """win AS (
    SELECT session_id, pos, id, t_start, t_end, n_words, 1 AS window_no, t_start AS w0, n_words AS total, FALSE AS closed FROM segments WHERE pos = 1
    UNION ALL
    SELECT session_id, pos, id, t_start, t_end, n_words, CAST(window_no + opens AS INTEGER), CASE WHEN opens = 1 THEN t_start ELSE w0 END,
           CASE WHEN opens = 1 THEN n_words ELSE total + n_words END, opens = 0 AND (t_end - w0 >= 90 OR total + n_words >= 450)
    FROM (SELECT s.session_id, s.pos, s.id, s.t_start, s.t_end, s.n_words, w.window_no, w.w0, w.total,
                 CASE WHEN w.closed OR (w.t_end - w.w0 >= 60 AND s.t_start - w.t_end >= 1.5) OR s.t_end - w.w0 > 90 OR w.total + s.n_words > 450 THEN 1 ELSE 0 END AS opens
          FROM win w JOIN segments s ON s.session_id = w.session_id AND s.pos = w.pos + 1))"""


def _assigned(t: Tables) -> DataFrame:
    return windows.assign(t.segments.select("session_id", "id", "t_start", "t_end", "n_words"))


@query("windows", """SELECT session_id, CAST(window_no AS BIGINT) AS window_no, min(t_start) AS t_start, max(t_end) AS t_end, CAST(sum(n_words) AS BIGINT) AS n_words,
    string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS segment_ids FROM win GROUP BY session_id, window_no""", ("segments",), _WINDOWS)
def windows_(t: Tables) -> DataFrame:
    built = windows.build(_assigned(t))
    return built.withColumn("segment_ids", F.array_join(F.col("segment_ids").cast("array<string>"), ","))


@query("window_assign", "SELECT session_id, id, CAST(window_no AS BIGINT) AS window_no, pos AS position FROM win", ("segments",), _WINDOWS)
def window_assign(t: Tables) -> DataFrame:
    return _assigned(t).select("session_id", "id", "window_no", "position")


@query("window_tail", """SELECT a.session_id, CAST(f.window_no AS BIGINT) AS window_no, a.id, a.window_no <> f.window_no AS carried FROM win a
    JOIN (SELECT session_id, window_no, min(pos) AS first, max(pos) AS last FROM win GROUP BY session_id, window_no) f
    ON f.session_id = a.session_id AND a.pos BETWEEN f.first - 2 AND f.last""", ("segments",), _WINDOWS)
def window_tail(t: Tables) -> DataFrame:
    return windows.with_tail(_assigned(t)).select("session_id", "window_no", "id", "carried")


@query("speaker_labels", """SELECT session_id, window_no, id, CASE WHEN speaker = '2' AND channel_id = 0 THEN 'Host' WHEN speaker = '' THEN 'unknown'
    ELSE 'unidentified speaker ' || (1 + (SELECT count(DISTINCT b.speaker) FROM lab b WHERE b.session_id = a.session_id AND b.window_no = a.window_no
      AND b.first < a.first AND b.speaker <> '' AND NOT (b.speaker = '2' AND b.channel_id = 0))) END AS label FROM lab a""", ("segments",),
    _WINDOWS + """, lab AS (SELECT w.session_id, CAST(w.window_no AS BIGINT) AS window_no, w.id, s.channel_id, s.speaker,
    min(w.pos) OVER (PARTITION BY w.session_id, w.window_no, s.speaker) AS first FROM win w JOIN segments s ON s.id = w.id)""")
def speaker_labels(t: Tables) -> DataFrame:
    people = t.segments.select("channel_id").distinct().select(
        "channel_id", F.lit(2).cast("bigint").alias("id"), F.when(F.col("channel_id") == 0, " Host ").otherwise("speaker_2").alias("name"), F.lit(True).alias("confirmed")
    )
    rows = _assigned(t).join(t.segments.select("id", "channel_id", "speaker"), "id")
    return transcript.label(rows, transcript.speaker_names(people)).select("session_id", "window_no", "id", "label")


@query("transcript_range", "SELECT session_id, id, t_start, t_end, text FROM segments WHERE t_start BETWEEN 20 AND 60", ("segments",))
def transcript_range(t: Tables) -> DataFrame:
    return transcript.range_(t.segments, 20.0, 60.0).select("session_id", "id", "t_start", "t_end", "text")


@query("transcript_latest", """SELECT session_id, id, t_start FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t_start DESC, id DESC) AS r FROM segments)
    WHERE r <= 3""", ("segments",))
def transcript_latest(t: Tables) -> DataFrame:
    return transcript.range_(t.segments, limit=3).select("session_id", "id", "t_start")


@query("utterance_lines", """SELECT id, '[seg ' || id || ' | ' || printf('%.1f', t_start) || '–' || printf('%.1f', t_end) || ' | speaker: ' || role || ' (conf '
    || CASE WHEN speaker_conf IS NULL THEN 'unknown' ELSE printf('%.2f', speaker_conf) END || ')] "' || text || '"' AS line FROM segments""", ("segments",))
def utterance_lines(t: Tables) -> DataFrame:
    s = t.segments
    line = transcript.utterance_line(F.col("id"), F.col("t_start"), F.col("t_end"), F.col("role"), F.col("speaker_conf"), F.col("text"))
    return s.select("id", line.alias("line"))


@query("window_texts", """SELECT w.session_id, CAST(w.window_no AS BIGINT) AS window_no, string_agg(s.text, ' ' ORDER BY w.pos) AS text FROM win w
    JOIN segments s ON s.id = w.id GROUP BY w.session_id, w.window_no""", ("segments",), _WINDOWS)
def window_texts(t: Tables) -> DataFrame:
    return transcript.transcript_text(_assigned(t).join(t.segments.select("id", "text"), "id"))


_GRAMS = "list_transform(range(1, greatest(len(c), 2)), lambda i: c[i] || coalesce(c[i + 1], ''))"
_REASON = f"""CASE WHEN s = '' THEN 'empty' WHEN s IN ('thanks for watching', 'thanks for watching!', 'subscribe for more', 'like and subscribe') THEN 'blocklist'
    WHEN no_speech > 0.6 THEN 'no_speech' WHEN avg_logprob < -1 THEN 'low_logprob'
    WHEN length(s) > 20 AND len(list_distinct({_GRAMS})) / len({_GRAMS}) < 0.15 THEN 'repetition'
    WHEN len(w) > 6 AND len(list_distinct(w)) = 1 THEN 'repetition' ELSE '' END"""


@query("guards", f"""SELECT id, {_REASON} AS reason FROM (SELECT *, list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '') AS w, string_split(s, '') AS c FROM (
    SELECT id, trim(lower(text), ' ' || chr(10) || chr(9) || chr(13)) AS s, (turn % 5) / 5.0 AS no_speech, -(turn % 3) * 0.6 AS avg_logprob FROM segments))""", ("segments",))
def guards_(t: Tables) -> DataFrame:
    rows = t.segments.withColumns({"no_speech": F.col("turn") % 5 / 5.0, "avg_logprob": -(F.col("turn") % 3) * 0.6})
    return guards.should_drop(rows).select("id", "reason")


@query("document_guards", f"""SELECT doc_id, {_REASON} AS reason FROM (SELECT *, list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '') AS w, string_split(s, '') AS c FROM (
    SELECT doc_id, trim(lower(text), ' ' || chr(10) || chr(9) || chr(13)) AS s, 0.0 AS no_speech, 0.0 AS avg_logprob FROM documents))""")
def document_guards(t: Tables) -> DataFrame:
    rows = t.read("documents").withColumns({"no_speech": F.lit(0.0), "avg_logprob": F.lit(0.0)})
    return guards.should_drop(rows).select("doc_id", "reason")


@query("bigram_diversity", f"SELECT doc_id, round(len(list_distinct({_GRAMS})) / len({_GRAMS}), 6) AS diversity FROM (SELECT doc_id, string_split(text, '') AS c FROM documents)")
def bigram_diversity(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", F.round(X.bigram_diversity(F.col("text")), 6).alias("diversity"))


@query("avg_logprob", "SELECT vec_id, round(list_avg(list_transform(embedding, lambda x: ln(greatest(abs(CAST(x AS DOUBLE)), 1e-9)))), 6) AS avg_logprob FROM embeddings")
def avg_logprob(t: Tables) -> DataFrame:
    probs = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return t.read("embeddings").select("vec_id", F.round(X.avg_logprob(probs), 6).alias("avg_logprob"))


@query("snippets", """SELECT doc_id, CASE WHEN length(s) <= 240 THEN s ELSE rtrim(left(s, 80), ws) || ' … ' || ltrim(right(s, 157), ws) END AS snippet FROM (
    SELECT doc_id, trim(text, ws) AS s, ws FROM (SELECT doc_id, text, ' ' || chr(10) || chr(9) || chr(13) AS ws FROM documents))""")
def snippets(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", X.snippet(F.col("text"), 240).alias("snippet"))


@query("append_bounded", """SELECT doc_id, CASE WHEN length(s) <= 2000 THEN s ELSE rtrim(left(s, 400), ws) || ' … ' || ltrim(right(s, 1597), ws) END AS text FROM (
    SELECT doc_id, trim(text || ' ' || source, ws) AS s, ws FROM (SELECT *, ' ' || chr(10) || chr(9) || chr(13) AS ws FROM documents))""")
def append_bounded(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", X.append_bounded(F.col("text"), F.col("source")).alias("text"))


@query("context_pack", """SELECT source, doc_id, CAST(used AS BIGINT) AS used FROM (SELECT source, doc_id, sum(greatest(1, length(text) // 4)) OVER
    (PARTITION BY source, lang ORDER BY doc_id) AS used FROM documents) WHERE used <= 3000""")
def context_pack(t: Tables) -> DataFrame:
    parts = t.read("documents").select("source", "lang", "doc_id", F.lit(1).alias("block"), F.col("doc_id").alias("seq"), "text")
    return context.pack(parts, ["source", "lang"]).select("source", "doc_id", "used")


@query("first_words", r"""SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[1:30], ' ') AS text FROM documents""")
def first_words(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", X.first_words(F.col("text"), 30).alias("text"))


@query("words", r"""SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM (
    SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{M}\p{N}\p{Pc}'']+') AS w FROM documents)""")
def words(t: Tables) -> DataFrame:
    w = X.words(F.col("text"))
    return t.read("documents").select("doc_id", F.size(w).cast("bigint").alias("n_words"), F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"))


@query("markdown_tail", r"""SELECT doc_id, trim(regexp_split_to_array(m, '\*+')[1], ' ' || chr(10) || chr(9) || chr(13)) AS plain, replace(m, '**', '') AS unbold FROM (
    SELECT doc_id, replace(text, ',', ' **') AS m FROM documents)""")
def markdown_tail(t: Tables) -> DataFrame:
    m = F.replace("text", F.lit(","), F.lit(" **"))
    return t.read("documents").select("doc_id", X.strip_markdown_tail(m).alias("plain"), X.clean_bold(m).alias("unbold"))


@query("clocks", """SELECT l_orderkey, l_partkey, printf('%d:%02d', s // 3600, s % 3600 // 60) AS hm, printf('%02d:%02d', s // 60, s % 60) AS ms,
    printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS hms,
    CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS ui
    FROM (SELECT l_orderkey, l_partkey, CAST(floor(l_extendedprice) AS BIGINT) AS s FROM lineitem)""")
def clocks(t: Tables) -> DataFrame:
    s = F.col("l_extendedprice")
    return t.read("lineitem").select(
        "l_orderkey", "l_partkey", TM.clock_hm(s).alias("hm"), TM.clock_ms(s).alias("ms"), TM.clock_hms(s).alias("hms"), TM.clock_ui(s).alias("ui")
    )


@query("parse_iso", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN round(epoch_us(ts) / 1e6, 3) WHEN 1 THEN round(epoch_us(ts) / 1e6 - 3600, 3) ELSE -1 END AS epoch FROM events""")
def parse_iso(t: Tables) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    k = F.col("event_id") % 3
    raw = F.when(k == 0, text).when(k == 1, F.concat(text, F.lit("+01:00"))).otherwise("soon")
    at = TM.parse_iso(raw)
    return t.read("events").select("event_id", F.coalesce(F.round(TM.epoch_seconds(at), 3), F.lit(-1.0)).alias("epoch"))


@query("replace_ids", r"""SELECT id, regexp_replace(regexp_replace(t, '(^|\W)1(\W|$)', '\1Ann\2', 'g'), '(^|\W)2(\W|$)', '\1Bo\2', 'g') AS text FROM (
    SELECT id, speaker || ' said: ' || n_words || ' words by 12 and ' || speaker AS t FROM segments)""", ("segments",))
def replace_ids(t: Tables) -> DataFrame:
    rows = t.segments.select("id", "channel_id", F.concat(
        "speaker", F.lit(" said: "), F.col("n_words"), F.lit(" words by 12 and "), F.col("speaker")).alias("text"))
    one, two = ("1", "Ann"), ("2", "Bo")
    channels = t.segments.select("channel_id").distinct()
    names = channels.select("channel_id", F.explode(F.array(*[F.struct(F.lit(a).alias("speaker"), F.lit(b).alias("name")) for a, b in (one, two)])).alias("n")).select("channel_id", "n.*")
    return transcript.replace_speaker_ids(rows, names, "id", "text").select("id", "text")


@query("mentions", r"""SELECT DISTINCT d.doc_id, nm.name FROM (SELECT *, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}\p{Pc}]+'))) AS w FROM documents) d
    JOIN nm ON nm.w = d.w AND contains(lower(d.text), lower(nm.name)) WHERE regexp_matches(lower(d.text), '(^|[^\p{L}\p{M}\p{N}\p{Pc}])' || regexp_escape(lower(nm.name)) || '([^\p{L}\p{M}\p{N}\p{Pc}]|$)')""", (),
    r"""nm AS (SELECT DISTINCT name, regexp_extract(lower(name), '[\p{L}\p{M}\p{N}\p{Pc}]+') AS w FROM (
    SELECT text AS name FROM benchmark))""")
def mentions_(t: Tables) -> DataFrame:
    """Documents that contain a whole benchmark item."""
    names = t.read("benchmark").select(F.lit(0).alias("channel_id"), F.col("text").alias("name")).distinct().withColumn("who", F.col("name"))
    texts = t.read("documents").select(F.lit(0).alias("channel_id"), "doc_id", "text")
    return mentions.mentions(names, texts, ["channel_id"], "who", "doc_id", "text").select("doc_id", F.col("who").alias("name"))


@query("mentions_words", r"""SELECT DISTINCT c.conv_id * 1000 + c.turn AS id, nm.name FROM (SELECT *, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}\p{Pc}]+'))) AS w
    FROM conversations) c JOIN (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS name FROM benchmark) nm ON nm.name = c.w WHERE length(nm.name) >= 2""")
def mentions_words(t: Tables) -> DataFrame:
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))).alias("name")
    names = t.read("benchmark").select(F.lit(0).alias("channel_id"), word).distinct().withColumn("who", F.col("name"))
    texts = t.segments.select(F.lit(0).alias("channel_id"), "id", "text")
    return mentions.mentions(names, texts, ["channel_id"], "who", "id", "text").select("id", F.col("who").alias("name"))


# Word edit distance as a recursion over the reference words; each step updates one row of distances.
_WER = r"""pair AS (SELECT a.conv_id, a.turn, regexp_extract_all(replace(lower(a.text), 'ß', 'ss'), '[\p{L}\p{M}\p{N}\p{Pc}'']+') AS rw,
      regexp_extract_all(replace(lower(b.text), 'ß', 'ss'), '[\p{L}\p{M}\p{N}\p{Pc}'']+') AS hw
    FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
  dp AS (SELECT conv_id, turn, 0 AS i, j, j AS d, w FROM (SELECT conv_id, turn, unnest(range(0, len(hw) + 1)) AS j, unnest(list_prepend('', hw)) AS w FROM pair)
    UNION ALL
    SELECT conv_id, turn, i + 1, j, CAST(j + min(base - j) OVER (PARTITION BY conv_id, turn ORDER BY j ROWS UNBOUNDED PRECEDING) AS BIGINT), w
    FROM (SELECT dp.conv_id, dp.turn, dp.i, dp.j, dp.w, least(dp.d + 1, coalesce(lag(dp.d) OVER (PARTITION BY dp.conv_id, dp.turn ORDER BY dp.j)
          + CASE WHEN dp.w = p.rw[dp.i + 1] THEN 0 ELSE 1 END, dp.i + 1)) AS base
          FROM dp JOIN pair p ON p.conv_id = dp.conv_id AND p.turn = dp.turn WHERE dp.i < len(p.rw)))"""


def _turn_pairs(t: Tables) -> DataFrame:
    c = t.read("conversations").select("conv_id", "turn", "text")
    answer = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    return c.withColumnRenamed("text", "ref").join(answer, ["conv_id", "turn"])


@query("wer", """SELECT p.conv_id, p.turn, CAST(d.d AS BIGINT) AS errors, CAST(len(p.rw) AS BIGINT) AS ref_words, round(d.d / greatest(len(p.rw), 1), 6) AS wer
    FROM pair p JOIN dp d ON d.conv_id = p.conv_id AND d.turn = p.turn AND d.i = len(p.rw) AND d.j = len(p.hw)""", (), _WER)
def wer(t: Tables) -> DataFrame:
    """Word error rate of every turn against the next one."""
    return evaluation.wer(_turn_pairs(t)).select("conv_id", "turn", "errors", "ref_words", F.round("wer", 6).alias("wer"))


@query("corpus_wer", """SELECT p.conv_id, round(sum(d.d) / greatest(sum(len(p.rw)), 1), 6) AS wer, count(*) AS pairs
    FROM pair p JOIN dp d ON d.conv_id = p.conv_id AND d.turn = p.turn AND d.i = len(p.rw) AND d.j = len(p.hw) GROUP BY p.conv_id""", (), _WER)
def corpus_wer(t: Tables) -> DataFrame:
    return evaluation.corpus_wer(evaluation.wer(_turn_pairs(t)), ["conv_id"]).withColumn("wer", F.round("wer", 6))


@query("accuracy", r"""SELECT conv_id, turn, round(CASE WHEN len(g) = 0 THEN 0 ELSE len(list_filter(range(1, least(len(g), len(p)) + 1), lambda i: g[i] = p[i])) / len(g) END, 6) AS accuracy FROM (
    SELECT a.conv_id, a.turn, list_transform(regexp_split_to_array(a.text, '\s+'), lambda x: length(x)) AS g, list_transform(regexp_split_to_array(b.text, '\s+'), lambda x: length(x)) AS p
    FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)""")
def accuracy(t: Tables) -> DataFrame:
    def lengths(c: str):
        return F.transform(F.split(c, r"\s+"), lambda x: F.length(x))

    return _turn_pairs(t).select("conv_id", "turn", F.round(evaluation.accuracy(lengths("hyp"), lengths("ref")), 6).alias("accuracy"))


@query("fact_recall_strict", r"""SELECT d.doc_id, round(avg(CASE WHEN len(list_filter(f.w, lambda x: NOT list_contains(d.w, x))) = 0 THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS fact_recall
    FROM (SELECT doc_id, doc_id % 40 AS k, list_distinct(regexp_split_to_array(replace(lower(text), 'ß', 'ss'), '\s+')) AS w FROM documents) d
    JOIN (SELECT item_id % 40 AS k, list_distinct(regexp_split_to_array(replace(lower(text), 'ß', 'ss'), '\s+')) AS w FROM benchmark) f ON f.k = d.k GROUP BY d.doc_id""")
def fact_recall_strict(t: Tables) -> DataFrame:
    texts = t.read("documents").select("doc_id", "text", (F.col("doc_id") % 40).alias("k"))
    facts = t.read("benchmark").select((F.col("item_id") % 40).alias("k"), F.col("text").alias("fact"))
    asked = texts.select("doc_id", "k").join(facts, "k").select("doc_id", "fact")
    return evaluation.fact_recall(texts.select("doc_id", "text"), asked, ["doc_id"], strict=True)


@query("fact_recall")
def fact_recall(t: Tables) -> DataFrame:
    texts = t.read("documents").select("doc_id", "text", (F.col("doc_id") % 40).alias("k"))
    facts = t.read("benchmark").select((F.col("item_id") % 40).alias("k"), F.col("text").alias("fact"))
    asked = texts.select("doc_id", "k").join(facts, "k").select("doc_id", "fact")
    return evaluation.fact_recall(texts.select("doc_id", "text"), asked, ["doc_id"])


@query("snapshot_counts", """SELECT s.id AS session_id, s.status, (SELECT count(*) FROM ev_windows w WHERE w.session_id = s.id) AS windows,
    (SELECT count(*) FROM ev_windows w WHERE w.session_id = s.id AND n > 1) AS completed_windows, (SELECT count(*) FROM ev_windows w WHERE w.session_id = s.id AND n = 1) AS failed_windows,
    (SELECT count(*) FROM ev_events e WHERE e.session_id = s.id) AS events FROM ev_sessions s""", ("ev_sessions", "ev_windows", "ev_events"))
def snapshot_counts(t: Tables) -> DataFrame:
    w = t.ev_windows.withColumn("status", F.when(F.col("n") > 1, "done").otherwise("failed"))
    s = t.ev_sessions.withColumn("last_error", F.lit(None).cast("string"))
    return export.snapshot_counts(s, t.segments, w, t.ev_events).select("session_id", "status", "windows", "completed_windows", "failed_windows", "events")


@query("transcript_parts", """SELECT session_id, CAST(floor(t_start / 60) AS BIGINT) AS part, string_agg(text, ' ' ORDER BY t_start, id) AS text FROM segments GROUP BY session_id, part""", ("segments",))
def transcript_parts(t: Tables) -> DataFrame:
    return export.transcript_parts(t.segments, Params(chunk_seconds=60.0))


@query("frame_rms", """SELECT vec_id AS file_id, CAST(0 AS BIGINT) AS frame_no, CAST(len(v) AS INTEGER) AS n_samples, round(sqrt(list_avg(list_transform(v, lambda x: (x / 32768.0::DOUBLE) * (x / 32768.0::DOUBLE))) + 1e-12), 6) AS rms
    FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 20000) AS INTEGER)) AS v FROM embeddings)""")
def frame_rms_(t: Tables) -> DataFrame:
    """Loudness of the embedding values written as 16-bit samples."""
    pcm = _pcm(t.read("embeddings").select(F.col("vec_id").alias("file_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 20000)).alias("v")))
    return frame_rms(pcm).withColumn("rms", F.round("rms", 6))


def _pcm(df: DataFrame) -> DataFrame:
    def two_bytes(x):
        h = F.lpad(F.hex(F.pmod(x.cast("bigint"), F.lit(65536).cast("bigint"))), 4, "0")
        return F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))

    return df.select("file_id", F.unhex(F.array_join(F.transform("v", two_bytes), "")).alias("pcm"))


# The frame rule as a recursion: state is the open piece and its run of silent frames.
_CUTS = """fr AS (SELECT user_id AS file_id, value / 10000 AS rms, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
  cut AS (SELECT file_id, n, n AS first, CASE WHEN rms > 0.02 THEN 0 ELSE 1 END AS silent, FALSE AS closed FROM fr WHERE n = 1
    UNION ALL
    SELECT file_id, n, first, silent, (silent >= 15 AND n - first + 1 >= 10) OR n - first + 1 >= 938 FROM (
      SELECT f.file_id, f.n, CASE WHEN c.closed THEN f.n ELSE c.first END AS first, CASE WHEN f.rms > 0.02 THEN 0 WHEN c.closed THEN 1 ELSE c.silent + 1 END AS silent
      FROM cut c JOIN fr f ON f.file_id = c.file_id AND f.n = c.n + 1))"""


def _frames(t: Tables) -> DataFrame:
    numbered = ordinal(t.read("events"), ["user_id"], ["ts"], "frame_no", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000))
    return numbered.select(F.col("user_id").alias("file_id"), "frame_no", F.lit(512).alias("n_samples"), (F.col("value") / 10000).alias("rms"))


@query("audio_segments", """SELECT file_id, round((first - 1) * 512 / 16000.0::DOUBLE, 6) AS t_start, round(max(n) * 512 / 16000.0::DOUBLE, 6) AS t_end, CAST(max(n) - first + 1 AS BIGINT) AS n_frames FROM cut
    GROUP BY file_id, first HAVING max(n) - first + 1 >= 10""", (), _CUTS)
def audio_segments(t: Tables) -> DataFrame:
    """Every user's event values as a row of frame loudness."""
    return audio.segment(_frames(t)).select("file_id", F.round("t_start", 6).alias("t_start"), F.round("t_end", 6).alias("t_end"), "n_frames")


# The stateful rule as a recursion: begin of the open piece, its run of silent samples, whether speech was heard, and the piece cut last.
_STATEFUL_CUTS = """arr AS MATERIALIZED (SELECT user_id % 5 AS file_id, list(value / (500 + 1500 * (user_id % 5)) ORDER BY ts, event_id) AS a FROM events GROUP BY user_id % 5),
  st AS (SELECT file_id, 0::BIGINT AS n, 1::BIGINT AS b, 0::BIGINT AS silent, FALSE AS speech, 0::BIGINT AS first, 0::BIGINT AS upto, FALSE AS said FROM arr
    UNION ALL
    SELECT file_id, n, CASE WHEN cap THEN q WHEN quiet THEN n + 1 ELSE b END, CASE WHEN cap THEN (n - q + 1) * 512 WHEN quiet THEN 0 ELSE silent END,
           CASE WHEN cap THEN sqrt(list_avg(list_transform(a[q:n], lambda x: x * x))) > 0.02 WHEN quiet THEN FALSE ELSE speech END,
           CASE WHEN cap OR quiet THEN b ELSE 0 END, CASE WHEN cap THEN q - 1 WHEN quiet THEN n ELSE 0 END, speech FROM (
      SELECT *, NOT cap AND silent >= 8000 AS quiet, CASE WHEN cap THEN n - 156 + list_position(a[n - 155:n - 1], list_min(a[n - 155:n - 1])) END AS q FROM (
        SELECT st.file_id, a, st.n + 1 AS n, b, CASE WHEN a[st.n + 1] > 0.02 THEN 0 ELSE silent + 512 END AS silent, speech OR a[st.n + 1] > 0.02 AS speech,
               (st.n + 2 - b) * 512 >= 480000 AS cap FROM st JOIN arr USING (file_id) WHERE st.n < len(a)))),
  piece AS (SELECT file_id, first, upto FROM st WHERE first > 0 AND said
    UNION ALL SELECT st.file_id, b, n FROM st JOIN arr ON arr.file_id = st.file_id AND n = len(a) WHERE speech AND b <= n)"""


@query("audio_segments_stateful", """SELECT CAST(file_id AS BIGINT) AS file_id, round((first - 1) * 512 / 16000.0::DOUBLE, 6) AS t_start, round(upto * 512 / 16000.0::DOUBLE, 6) AS t_end, upto - first + 1 AS n_frames
    FROM piece WHERE upto - first + 1 >= 10""", (), _STATEFUL_CUTS)
def audio_segments_stateful(t: Tables) -> DataFrame:
    """All event values as five long rows of frame loudness, with pauses and with speech beyond the cap."""
    events = t.read("events").select(F.pmod("user_id", F.lit(5)).alias("file_id"), "ts", "event_id", "value")
    numbered = ordinal(events, ["file_id"], ["ts", "event_id"], "frame_no", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000))
    frames = numbered.select("file_id", "frame_no", F.lit(512).alias("n_samples"), (F.col("value") / (500 + 1500 * F.col("file_id"))).alias("rms"))
    cut = audio.segment(frames, "stateful", 60.0)
    return cut.select("file_id", F.round("t_start", 6).alias("t_start"), F.round("t_end", 6).alias("t_end"), "n_frames")


@query("stub_words", """SELECT segment_id, i, 'word' || i AS text, round(i * 0.4::DOUBLE, 6) AS t_start, round(least(i * 0.4::DOUBLE + 0.35, seconds), 6) AS t_end FROM (
    SELECT id AS segment_id, n_words * 4 / 10.0::DOUBLE AS seconds, unnest(range(greatest(1, CAST(floor((n_words * 4 / 10.0::DOUBLE) / 0.4::DOUBLE) AS BIGINT)))) AS i FROM segments WHERE n_words > 0)""", ("segments",))
def stub_words(t: Tables) -> DataFrame:
    spoken = t.segments.select(F.col("id").alias("segment_id"), F.lit(0.0).alias("t_start"), (F.col("n_words") * 4 / F.lit(10.0)).alias("seconds"))
    return infer.stub_words(spoken).select("segment_id", "i", "text", F.round("t_start", 6).alias("t_start"), F.round("t_end", 6).alias("t_end"))
