"""Queries over entities, voices, consent, model answers, memory writing and the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recapflow.functions import text as X
from recapflow.functions import vec
from recapflow.functions.similar import similar_within, token_key
from recapflow.operators import (
    consent, context, corrections, evaluation, extract, guards, infer, memory, quality, resolve, retention, speakers, triage, views,
)
from recapflow.params import Params
from recapflow.plans.bindings import NOW, Tables, ts
from recapflow.plans.registry import query
from recapflow.sources import channels, documents, tables

# ---------------------------------------------------------------- entities

# Token-set score in SQL: the longest common subsequence of the left-over parts grows one character of the
# first part at a time; a row of the table is a list.
_SCORES = """nm AS (SELECT DISTINCT channel_id, array_to_string(list_sort(list_distinct(string_split(lower(canonical_name), ' '))), ' ') AS k FROM entities WHERE status <> 'merged'),
  kp AS (SELECT a, b, array_to_string(list_sort(list_intersect(ta, tb)), ' ') AS c, array_to_string(list_sort(list_filter(ta, lambda x: NOT list_contains(tb, x))), ' ') AS da,
      array_to_string(list_sort(list_filter(tb, lambda x: NOT list_contains(ta, x))), ' ') AS db FROM (
    SELECT DISTINCT x.k AS a, y.k AS b, string_split(x.k, ' ') AS ta, string_split(y.k, ' ') AS tb FROM nm x JOIN nm y ON x.channel_id = y.channel_id AND x.k < y.k)),
  lcs AS (SELECT a, b, 0 AS i, list_transform(range(length(db) + 1), lambda j: CAST(0 AS BIGINT)) AS r FROM kp
    UNION ALL SELECT a, b, i, list_transform(range(1, len(t) + 1), lambda j: list_max(t[1:j])) FROM (
      SELECT l.a, l.b, l.i + 1 AS i, list_prepend(CAST(0 AS BIGINT), list_transform(range(2, len(l.r) + 1), lambda j:
        greatest(l.r[j], l.r[j - 1] + CASE WHEN kp.da[l.i + 1] = kp.db[j - 1] THEN 1 ELSE 0 END))) AS t
      FROM lcs l JOIN kp ON kp.a = l.a AND kp.b = l.b WHERE l.i < length(kp.da))),
  sc AS (SELECT kp.a, kp.b, CASE WHEN c <> '' AND (da = '' OR db = '') THEN 100.0::DOUBLE ELSE
      greatest(100.0::DOUBLE - 100.0::DOUBLE * (length(da) + length(db) - 2 * l.r[len(l.r)]) / (2 * s + length(da) + length(db)),
        CASE WHEN c = '' THEN 0 ELSE 200.0::DOUBLE * length(c) / (length(c) + s + length(da)) END,
        CASE WHEN c = '' THEN 0 ELSE 200.0::DOUBLE * length(c) / (length(c) + s + length(db)) END) END AS score
    FROM (SELECT *, CASE WHEN c = '' THEN 0 ELSE length(c) + 1 END AS s FROM kp) kp JOIN lcs l ON l.a = kp.a AND l.b = kp.b AND l.i = length(kp.da))"""


@query("token_set_ratio", "SELECT a, b, round(score, 4) AS score FROM sc WHERE score >= 70", ("entities",), _SCORES)
def token_set_ratio(t: Tables) -> DataFrame:
    """Pairs of names of one channel that score at least 70."""
    keys = t.entities.where("status <> 'merged'").select("channel_id", token_key(F.lower("canonical_name")).alias("key"))
    close = similar_within(keys, ["channel_id"], 70.0)
    return close.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"), F.round("score", 4).alias("score")).distinct()


_PAIRS = """, ent AS (SELECT *, array_to_string(list_sort(list_distinct(string_split(lower(canonical_name), ' '))), ' ') AS k FROM entities WHERE status <> 'merged'),
  names AS (SELECT channel_id, id, lower(canonical_name) AS n FROM ent UNION SELECT e.channel_id, e.id, lower(a.alias) FROM ent e JOIN aliases a ON a.entity_id = e.id),
  cand AS (SELECT x.channel_id, x.id AS a_id, y.id AS b_id FROM names x JOIN names y ON y.channel_id = x.channel_id AND y.n = x.n AND x.id < y.id
    UNION SELECT x.channel_id, x.id, y.id FROM ent x JOIN ent y ON y.channel_id = x.channel_id AND x.id < y.id
      LEFT JOIN sc ON sc.a = least(x.k, y.k) AND sc.b = greatest(x.k, y.k) WHERE x.k = y.k OR sc.score >= 85),
  first AS (SELECT *, count(*) OVER (PARTITION BY channel_id) AS n FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY a_id, b_id) AS position FROM cand) WHERE position <= 25)"""


@query("candidate_pairs", """SELECT f.channel_id, f.a_id, f.b_id, a.mention_count + b.mention_count AS mentions, row_number() OVER (PARTITION BY f.channel_id
    ORDER BY CASE WHEN n < 25 THEN -(a.mention_count + b.mention_count) ELSE 0 END, position) AS rank
    FROM first f JOIN ent a ON a.id = f.a_id JOIN ent b ON b.id = f.b_id""", ("entities", "aliases"), _SCORES + _PAIRS)
def candidate_pairs(t: Tables) -> DataFrame:
    return resolve.candidate_pairs(t.entities, t.aliases).withColumn("rank", F.col("rank").cast("bigint"))


@query("duplicate_rate", """SELECT e.channel_id, CAST(count(*) AS BIGINT) AS names, round((SELECT sum(CASE WHEN x.k = y.k THEN x.c * (x.c - 1) / 2 ELSE x.c * y.c END)
      FROM kc x JOIN kc y ON y.channel_id = x.channel_id AND x.k <= y.k LEFT JOIN sc ON sc.a = x.k AND sc.b = y.k
      WHERE x.channel_id = e.channel_id AND (x.k = y.k OR sc.score >= 90)) / (count(*) * (count(*) - 1) / 2), 6) AS duplicate_rate
    FROM entities e WHERE status <> 'merged' GROUP BY e.channel_id""", ("entities",), _SCORES + """, kc AS (
    SELECT channel_id, array_to_string(list_sort(list_distinct(string_split(lower(canonical_name), ' '))), ' ') AS k, count(*) AS c FROM entities WHERE status <> 'merged' GROUP BY 1, 2)""")
def duplicate_rate(t: Tables) -> DataFrame:
    named = t.entities.where("status <> 'merged'").select("channel_id", F.col("canonical_name").alias("name"))
    return evaluation.duplicate_rate(named, ["channel_id"]).select("channel_id", "names", F.round("duplicate_rate", 6).alias("duplicate_rate"))


@query("name_sets", """SELECT channel_id, id AS entity_id, array_to_string(list_sort(list_distinct(list_concat([lower(canonical_name)], coalesce((SELECT list(lower(alias)) FROM aliases a WHERE a.entity_id = e.id), [])))), '|') AS names FROM entities e""", ("entities", "aliases"))
def name_sets(t: Tables) -> DataFrame:
    return resolve.name_sets(t.entities, t.aliases).withColumn("names", F.array_join("names", "|"))


@query("aka", "SELECT id AS entity_id, coalesce((SELECT alias FROM aliases a WHERE a.entity_id = e.id), '—') AS aka FROM entities e", ("entities", "aliases"))
def aka(t: Tables) -> DataFrame:
    return resolve.aka(t.entities, t.aliases)


def _refs(t: Tables) -> DataFrame:
    """References by suppliers' line items: ids, exact names, aliases, new names."""
    k = F.col("l_partkey") % 5
    ref = (
        F.when(k == 0, F.concat(F.lit("E"), F.col("l_partkey"))).when(k == 1, F.concat(F.lit("NEW:"), F.upper("p_name")))
        .when(k == 2, F.concat_ws(" ", F.lower("p_type"), F.col("p_size").cast("string"))).when(k == 3, F.reverse("p_name")).otherwise(F.lit("Nobody at all"))
    )
    channel = F.substring_index("p_brand", "#", -1).cast("bigint").alias("channel_id")
    parts = t.read("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_size", "p_brand")
    return t.read("lineitem").join(parts, "l_partkey").select(channel, ref.alias("ref")).distinct()


_REFS = """refs AS (SELECT DISTINCT CAST(split_part(p_brand, '#', 2) AS BIGINT) AS channel_id,
    CASE l_partkey % 5 WHEN 0 THEN 'E' || l_partkey WHEN 1 THEN 'NEW:' || upper(p_name) WHEN 2 THEN lower(p_type) || ' ' || p_size WHEN 3 THEN reverse(p_name) ELSE 'Nobody at all' END AS ref
    FROM lineitem JOIN part ON p_partkey = l_partkey)"""
_EXACT = """SELECT DISTINCT r.channel_id, r.ref, coalesce(i.id, al.id, cn.id) AS entity_id,
    CAST(CASE WHEN i.id IS NOT NULL THEN 1 WHEN al.id IS NOT NULL THEN 2 WHEN cn.id IS NOT NULL THEN 3 ELSE 4 END AS INTEGER) AS tier
    FROM (SELECT *, CASE WHEN ref LIKE 'NEW:%' THEN substr(ref, 5) ELSE ref END AS name FROM refs) r
    LEFT JOIN entities i ON 'E' || i.id = r.ref AND i.channel_id = r.channel_id AND i.status <> 'merged'
    LEFT JOIN (SELECT e.channel_id, lower(a.alias) AS n, min(e.id) AS id FROM aliases a JOIN entities e ON e.id = a.entity_id GROUP BY 1, 2) al ON al.channel_id = r.channel_id AND al.n = lower(r.name)
    LEFT JOIN (SELECT channel_id, lower(canonical_name) AS n, min(id) AS id FROM entities GROUP BY 1, 2) cn ON cn.channel_id = r.channel_id AND cn.n = lower(r.name)"""


@query("resolve_refs", _EXACT, ("entities", "aliases"), _REFS)
def resolve_refs(t: Tables) -> DataFrame:
    """All references: those settled by id or exact name with their entity, the rest (fuzzy or new) as tier 4."""
    out = resolve.resolve(_refs(t), t.entities, t.aliases)
    return out.select("channel_id", "ref", F.when(F.col("tier") <= 3, F.col("entity_id")).alias("entity_id"), F.least("tier", F.lit(4)).alias("tier"))


_KEY = "array_to_string(list_sort(list_distinct(string_split({x}, ' '))), ' ')"
_FUZZY = f""", exact AS MATERIALIZED ({_EXACT}),
  open AS (SELECT *, {_KEY.format(x="lower(name)")} AS k FROM (SELECT channel_id, ref, CASE WHEN ref LIKE 'NEW:%' THEN substr(ref, 5) ELSE ref END AS name FROM exact WHERE tier = 4) WHERE length(name) >= 3),
  every AS (SELECT channel_id, id, {_KEY.format(x="lower(canonical_name)")} AS k FROM entities UNION ALL
    SELECT e.channel_id, e.id, {_KEY.format(x="lower(a.alias)")} FROM aliases a JOIN entities e ON e.id = a.entity_id)"""
# The scores of open references with all names of their channel, instead of those of all pairs of names.
_ASKED = _SCORES[_SCORES.index("kp AS"):].replace(
    "SELECT DISTINCT x.k AS a, y.k AS b, string_split(x.k, ' ') AS ta, string_split(y.k, ' ') AS tb FROM nm x JOIN nm y ON x.channel_id = y.channel_id AND x.k < y.k",
    "SELECT DISTINCT o.k AS a, y.k AS b, string_split(o.k, ' ') AS ta, string_split(y.k, ' ') AS tb FROM open o JOIN every y ON o.channel_id = y.channel_id AND o.k <> y.k")


@query("resolve_fuzzy", """SELECT e.channel_id, e.ref, CASE WHEN e.tier < 4 THEN e.entity_id ELSE f.id END AS entity_id,
    CAST(CASE WHEN e.tier < 4 THEN e.tier WHEN f.id IS NOT NULL THEN 4 ELSE 5 END AS INTEGER) AS tier, e.tier = 4 AND f.id IS NOT NULL AS needs_review
    FROM exact e LEFT JOIN (SELECT channel_id, ref, arg_min(id, (-score) * 1000000 + id) AS id FROM (
        SELECT o.channel_id, o.ref, y.id, CASE WHEN o.k = y.k THEN 100 ELSE sc.score END AS score
        FROM open o JOIN every y ON y.channel_id = o.channel_id LEFT JOIN sc ON sc.a = o.k AND sc.b = y.k) WHERE score >= 90 GROUP BY 1, 2) f
    ON f.channel_id = e.channel_id AND f.ref = e.ref""", ("entities", "aliases"), _REFS + _FUZZY + ", " + _ASKED)
def resolve_fuzzy(t: Tables) -> DataFrame:
    """All references with the tier that settled them, fuzzy and new ones included."""
    return resolve.resolve(_refs(t), t.entities, t.aliases).select("channel_id", "ref", "entity_id", "tier", "needs_review")


@query("parse_refs", """SELECT l_orderkey, l_partkey, l_linenumber, CASE l_partkey % 4 WHEN 0 THEN 'entity' WHEN 1 THEN 'thread' WHEN 2 THEN 'new' ELSE 'name' END AS kind,
    CASE WHEN l_partkey % 4 < 2 THEN l_partkey ELSE -1 END AS id, CASE l_partkey % 4 WHEN 0 THEN 'E' || l_partkey WHEN 1 THEN 'T' || l_partkey WHEN 2 THEN 'some_name' ELSE 'Eve' END AS name,
    CASE WHEN l_partkey % 4 = 2 THEN 'some name' ELSE '' END AS title FROM lineitem""")
def parse_refs(t: Tables) -> DataFrame:
    k, n = F.col("l_partkey") % 4, F.col("l_partkey")
    ref = F.when(k == 0, F.concat(F.lit("E"), n)).when(k == 1, F.concat(F.lit(" T"), n)).when(k == 2, "NEW:some_name").otherwise("Eve")
    rows = t.read("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", ref.alias("ref")).withColumn("p", guards.parse_ref(F.col("ref")))
    title = F.when(F.col("p.kind") == "new", guards.thread_title(F.col("ref"))).otherwise("")
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", "p.kind", F.coalesce("p.id", F.lit(-1)).alias("id"), "p.name", title.alias("title"))


@query("merge_apply", """SELECT id, CASE WHEN into_id IS NOT NULL THEN 'merged' ELSE status END AS status, coalesce(into_id, -1) AS merged_into FROM entities e
    LEFT JOIN (SELECT b.id AS from_id, a.id AS into_id FROM entities a JOIN entities b ON b.id = a.id + 1 AND b.channel_id = a.channel_id AND a.id % 3 = 0) m ON m.from_id = e.id""", ("entities",))
def merge_apply(t: Tables) -> DataFrame:
    merges = t.entities.where("id % 3 = 0").select(F.col("id").alias("into_id"), (F.col("id") + 1).alias("from_id"))
    return resolve.apply_merges(t.entities, merges)[0].select("id", "status", F.coalesce("merged_into", F.lit(-1)).alias("merged_into"))


@query("merge_roots", """SELECT id, CASE WHEN id % 50 = 0 THEN id ELSE (id // 50) * 50 END AS root_id FROM entities""", ("entities",))
def merge_roots(t: Tables) -> DataFrame:
    """Every entity merged into the one before it, in runs of fifty."""
    chained = t.entities.withColumn("merged_into", F.when(F.col("id") % 50 != 0, F.col("id") - 1))
    return resolve.follow_merges(chained)


@query("corrections", """SELECT p_partkey AS target_id, '{"name":"' || p_name || '","description":"' || p_type || '"}' AS before_json,
    '{"name":"' || CASE WHEN p_size % 2 = 0 THEN 'renamed' ELSE p_name END || '","description":"' || CASE WHEN p_size % 3 = 0 THEN 'told' ELSE p_type END || '"}' AS after_json FROM part WHERE p_size > 30""")
def corrections_(t: Tables) -> DataFrame:
    edits = t.read("part").where("p_size > 30").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "renamed").otherwise("").alias("canonical_name"),
        F.when(F.col("p_size") % 3 == 0, "told").alias("description"),
    )
    return corrections.patch_entities(t.entities, edits)[1].select("target_id", "before_json", "after_json")


@query("patch_threads", """SELECT id, CASE WHEN id % 2 = 0 THEN 'resolved' ELSE status END AS status, title FROM threads""", ("threads",))
def patch_threads(t: Tables) -> DataFrame:
    edits = t.threads.where("id % 2 = 0").select("id", F.lit("resolved").alias("status"), F.lit("").alias("title"))
    return corrections.patch_threads(t.threads, edits)[0].select("id", "status", "title")


@query("merge_suggestions", """SELECT f.channel_id, b_id AS from_id, a_id AS into_id, CASE (a_id + b_id) % 3 WHEN 0 THEN 0.82 ELSE 0.6 END::DOUBLE AS noul,
    CASE WHEN (a_id + b_id) % 3 = 0 AND coalesce(c.s, -1) NOT IN (a_id, b_id) THEN 'merge' ELSE 'review' END AS band FROM first f
    LEFT JOIN (SELECT c_custkey AS channel_id, c_custkey * 3 AS s FROM customer WHERE c_custkey % 5 = 0) c ON c.channel_id = f.channel_id WHERE (a_id + b_id) % 3 < 2""", ("entities", "aliases"), _SCORES + _PAIRS)
def merge_suggestions(t: Tables) -> DataFrame:
    pairs = resolve.candidate_pairs(t.entities, t.aliases)
    k = (F.col("a_id") + F.col("b_id")) % 3
    replies = pairs.select("channel_id", "a_id", "b_id", F.when(k == 0, "0.82").when(k == 1, "0.6").otherwise("0.2").alias("noul"))
    return resolve.suggest(pairs, replies, t.entities, t.channels).select("channel_id", "from_id", "into_id", "noul", "band")


@query("known_people", """SELECT channel_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY mention_count DESC, id) AS rank FROM entities) WHERE rank <= 50""", ("entities",))
def known_people(t: Tables) -> DataFrame:
    return triage.known_people(t.entities).select("channel_id", "id", F.col("rank").cast("bigint").alias("rank"))


@query("open_threads", """SELECT channel_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY last_updated_at DESC, id) AS rank FROM threads WHERE status = 'open') WHERE rank <= 20""", ("threads",))
def open_threads(t: Tables) -> DataFrame:
    return triage.open_threads(t.threads).select("channel_id", "id", F.col("rank").cast("bigint").alias("rank"))


def _texts(t: Tables) -> DataFrame:
    """A window per supplier, naming the parts it ships in two channels."""
    lines = t.read("lineitem").select("l_suppkey", "l_partkey").join(
        t.read("part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    text = F.array_join(F.array_sort(F.collect_set("p_name")), ". ")
    return lines.groupBy("l_suppkey").agg(text.alias("text")).select(
        F.col("l_suppkey").alias("window_id"), F.col("l_suppkey").alias("session_id"), (F.col("l_suppkey") % 25 + 1).alias("channel_id"), "text")


_TEXTS = """tx AS (SELECT l_suppkey AS window_id, l_suppkey % 25 + 1 AS channel_id, string_agg(DISTINCT p_name, '. ' ORDER BY p_name) AS text
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey)"""


@query("cast", """SELECT window_id, id, CAST(tier AS INTEGER) AS tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY tier, seen DESC, mention_count DESC, id) AS rank FROM (
    SELECT w.window_id, e.id, e.seen, e.mention_count, CASE WHEN e.id = h.s THEN 1 WHEN regexp_matches(lower(w.text), '(^|\\W)' || lower(e.canonical_name) || '(\\W|$)')
      OR EXISTS (SELECT 1 FROM aliases a WHERE a.entity_id = e.id AND regexp_matches(lower(w.text), '(^|\\W)' || lower(a.alias) || '(\\W|$)')) THEN 2 ELSE 3 END AS tier
    FROM tx w JOIN entities e ON e.channel_id = w.channel_id AND e.status <> 'merged'
    LEFT JOIN (SELECT c_custkey AS channel_id, c_custkey * 3 AS s FROM customer WHERE c_custkey % 5 = 0) h ON h.channel_id = w.channel_id)) WHERE rank <= 12""", ("entities", "aliases"), _TEXTS)
def cast(t: Tables) -> DataFrame:
    return context.cast(_texts(t), t.entities, t.aliases, t.channels).select("window_id", "id", "tier", F.col("rank").cast("bigint").alias("rank"))


@query("context_threads", """SELECT session_id, id, CAST(tier AS INTEGER) AS tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tier, last_updated_at DESC, importance DESC, id) AS rank FROM (
    SELECT s.id AS session_id, t.id, t.last_updated_at, t.importance, CASE WHEN t.id = s.id + 1 THEN 1 ELSE 2 END AS tier FROM (
      SELECT id, channel_id, lag(started_at, 3) OVER (PARTITION BY channel_id ORDER BY id) AS cutoff FROM sessions) s
    JOIN threads t ON t.channel_id = s.channel_id AND t.status = 'open' WHERE t.id = s.id + 1 OR s.cutoff IS NULL OR t.last_updated_at >= s.cutoff)) WHERE rank <= 6""", ("sessions", "threads"))
def context_threads(t: Tables) -> DataFrame:
    """A window per session whose text names the storyline after its own number."""
    w = t.sessions.select(F.col("id").alias("window_id"), F.col("id").alias("session_id"), "channel_id", F.concat(F.lit("So, STORY "), F.col("id") + 1, F.lit("!")).alias("text"))
    return context.threads(w, t.threads, t.sessions).select(F.col("window_id").alias("session_id"), "id", "tier", F.col("rank").cast("bigint").alias("rank"))


@query("history", """SELECT window_id, back, window_summary FROM (SELECT w.id AS window_id, 'w' || p.id AS window_summary, row_number() OVER (PARTITION BY w.id ORDER BY p.id DESC) AS back
    FROM ev_windows w JOIN ev_windows p ON p.session_id = w.session_id AND p.id < w.id AND p.id % 3 <> 0) WHERE back <= 3""", ("ev_windows",))
def history(t: Tables) -> DataFrame:
    done = t.ev_windows.withColumn("window_summary", F.when(F.col("id") % 3 != 0, F.concat(F.lit("w"), F.col("id"))).otherwise(""))
    asked = t.ev_windows.select(F.col("id").alias("window_id"), "session_id")
    return context.history(asked, done).select("window_id", F.col("back").cast("bigint").alias("back"), "window_summary")


# ---------------------------------------------------------------- voices and consent


def _voices(t: Tables) -> DataFrame:
    e = t.read("embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return first.select(F.lit(0).cast("bigint").alias("channel_id"), F.col("label").cast("bigint").alias("speaker_id"), "embedding")


def _vectors(t: Tables) -> DataFrame:
    return t.read("embeddings").select(F.lit(0).cast("bigint").alias("channel_id"), "vec_id", "embedding")


_NEAR = """voice AS (SELECT label AS id, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label),
  near AS (SELECT vec_id, id, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, id DESC) AS rank FROM (
    SELECT e.vec_id, CAST(v.id AS BIGINT) AS id, list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(v.v[i] AS DOUBLE)))
      / (sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(v.v, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) + 1e-9) AS score
    FROM embeddings e CROSS JOIN voice v))"""


@query("nearest_voices", "SELECT vec_id, id AS speaker_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM near WHERE rank <= 2", (), _NEAR)
def nearest_voices(t: Tables) -> DataFrame:
    return speakers.nearest(_vectors(t), _voices(t)).select("vec_id", "speaker_id", F.round("score", 6).alias("score"), "rank")


@query("speaker_match", """SELECT vec_id, CASE WHEN b >= 0.65 AND b - s >= 0.10 THEN 'matched' ELSE 'new' END AS kind, CASE WHEN b >= 0.65 AND b - s >= 0.10 THEN 'speaker:' || id ELSE 'new' END AS ref,
    round(CASE WHEN b >= 0.65 AND b - s >= 0.10 THEN b ELSE greatest(b, 0) END, 6) AS confidence FROM (
    SELECT a.vec_id, a.id, a.score AS b, c.score AS s FROM near a JOIN near c ON c.vec_id = a.vec_id AND c.rank = 2 WHERE a.rank = 1)""", (), _NEAR)
def speaker_match(t: Tables) -> DataFrame:
    return speakers.match(_vectors(t), _voices(t)).select("vec_id", "kind", "ref", F.round("confidence", 6).alias("confidence"))


@query("normalize", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS n, 1.0::DOUBLE AS unit FROM embeddings")
def normalize(t: Tables) -> DataFrame:
    v = F.col("embedding")
    return t.read("embeddings").select("vec_id", F.round(vec.norm(v), 4).alias("n"), F.round(vec.norm(vec.normalize(v)), 4).alias("unit"))


_UNIT = "list_transform({x}, lambda x: x / sqrt(list_dot_product({x}, {x})))"
_DRIFTS = f"""mv AS MATERIALIZED (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, embedding::DOUBLE[] AS v FROM embeddings),
  dr AS (SELECT label, 0::BIGINT AS k, {_UNIT.format(x="v")} AS c FROM mv WHERE k = 1
    UNION ALL
    SELECT label, k, {_UNIT.format(x="raw")} FROM (
      SELECT dr.label, mv.k, list_transform(list_zip(c, v), lambda z: 0.9::DOUBLE * z[1] + 0.1::DOUBLE * z[2]) AS raw FROM dr JOIN mv ON mv.label = dr.label AND mv.k = dr.k + 1))"""


@query("speaker_drift", """SELECT CAST(label AS BIGINT) AS speaker_id, k AS updates, CAST(i - 1 AS INTEGER) AS i, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 5) AS x FROM (
    SELECT label, k, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM dr QUALIFY k = max(k) OVER (PARTITION BY label))""", (), _DRIFTS)
def speaker_drift(t: Tables) -> DataFrame:
    """Centroids of the labels after all their vectors, one row per component."""
    matched = t.read("embeddings").select(F.col("label").cast("bigint").alias("speaker_id"), F.col("vec_id").cast("double").alias("t_start"), F.col("vec_id").alias("segment_id"), "embedding")
    moved = speakers.drift(matched, _voices(t).drop("channel_id"), 16, 8)
    return moved.select("speaker_id", "updates", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round(F.col("x").cast("double"), 5))


@query("identify_voices")
def identify_voices(t: Tables) -> DataFrame:
    """All vectors as segments of four channels against voices of half the labels."""
    ch = (F.col("vec_id") % 4).alias("channel_id")
    heard = t.read("embeddings").select(ch, F.col("vec_id").alias("segment_id"), F.col("vec_id").cast("double").alias("t_start"), ((F.col("vec_id") % 9) / 3.0).alias("seconds"), "embedding")
    known = _voices(t).where("speaker_id % 2 = 0").withColumn("channel_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))))
    return speakers.identify(heard, known).drop("voice", "voice_seconds")


@query("speech_seconds", "SELECT speaker_id, round(sum(greatest(t_end - t_start, 0)), 4) AS speech_seconds FROM segments WHERE speaker_id IS NOT NULL GROUP BY speaker_id", ("segments",))
def speech_seconds(t: Tables) -> DataFrame:
    return speakers.speech_seconds(t.segments).withColumn("speech_seconds", F.round("speech_seconds", 4))


def _consents(t: Tables) -> DataFrame:
    o = t.read("orders")
    at = F.col("o_orderdate").cast("timestamp")
    return o.select(
        F.col("o_orderkey").alias("id"), F.lit(0).cast("bigint").alias("channel_id"), F.col("o_custkey").alias("speaker_id"), F.lit("note").alias("note"),
        F.lit("owner").alias("granted_by"), at.alias("granted_at"), F.when(F.col("o_orderstatus") == "P", at).alias("revoked_at"))


_ACTIVE = f"""act AS (SELECT o_custkey AS speaker_id, o_orderkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders)
    WHERE r = 1 AND o_orderstatus <> 'P' AND (epoch_us(TIMESTAMP '{NOW}') - epoch_us(CAST(o_orderdate AS TIMESTAMP))) / 1e6 <= 365 * 86400)"""


@query("consent_active", "SELECT speaker_id, id FROM act", (), _ACTIVE)
def consent_active(t: Tables) -> DataFrame:
    return consent.active(_consents(t), ts(NOW)).select("speaker_id", "id")


@query("consent_revoke", "SELECT o_orderkey AS id, (o_orderstatus = 'P' OR o_custkey % 2 = 0) AS revoked FROM orders")
def consent_revoke(t: Tables) -> DataFrame:
    gone = t.read("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("speaker_id"))
    return consent.revoke(_consents(t), _voices(t), gone, ts(NOW))[0].select("id", F.col("revoked_at").isNotNull().alias("revoked"))


@query("voice_library", """SELECT l_suppkey AS speaker_id, arg_max(l_partkey, l_orderkey * 1000000 + l_partkey) AS dim_value FROM lineitem
    WHERE l_returnflag = 'A' AND l_suppkey IN (SELECT speaker_id FROM act) GROUP BY l_suppkey""", (), _ACTIVE)
def voice_library(t: Tables) -> DataFrame:
    """Newest voice per supplier among its shipped lines, for suppliers with consent."""
    e = t.read("lineitem").select(
        (F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("id"), F.col("l_suppkey").alias("speaker_id"),
        F.array(F.col("l_partkey").cast("float"), F.lit(1000.0).cast("float")).alias("embedding"), F.lit(2).alias("dim"), F.when(F.col("l_returnflag") == "A", "m").otherwise("n").alias("model"))
    s = t.read("supplier").select(F.col("s_suppkey").alias("id"), F.lit(0).cast("bigint").alias("channel_id"))
    out = speakers.library(e, s, _consents(t), ts(NOW), "m", 2)  # the direction of the chosen vector tells which one it was
    return out.select("speaker_id", F.round(F.col("embedding")[0] / F.col("embedding")[1] * 1000).cast("bigint").alias("dim_value"))


@query("enroll_check", "SELECT s_suppkey, s_acctbal > 0 AS allowed, CASE WHEN s_acctbal > 0 THEN '' ELSE 'consent required to enroll ''' || s_name || '''' END AS reason FROM supplier")
def enroll_check(t: Tables) -> DataFrame:
    note = F.when(F.col("s_acctbal") > 0, "asked").otherwise("  ")
    rows = t.read("supplier").select("s_suppkey", F.col("s_name").alias("name"), note.alias("consent_note"))
    return guards.enroll_check(rows).select("s_suppkey", "allowed", "reason")


@query("clip_expired", f"""SELECT event_id, CASE WHEN event_id % 10 = 0 THEN TRUE ELSE (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 1e6 > 240 * 3600 END AS expired FROM events""")
def clip_expired(t: Tables) -> DataFrame:
    stamp = F.when(F.col("event_id") % 10 == 0, "never").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return t.read("events").select("event_id", consent.expired(stamp, ts("2024-01-31 00:00:00"), 240).alias("expired"))


_EXPIRED = f"""gone AS (SELECT id FROM sessions WHERE status IN ('ended', 'interrupted') AND (epoch_us(TIMESTAMP '{NOW}') - epoch_us(started_at)) / 1e6 > 365 * 86400)"""


@query("retention", """SELECT session_id, count(*) AS kept FROM told WHERE session_id NOT IN (SELECT id FROM gone) GROUP BY session_id""", ("sessions", "told"), _EXPIRED)
def retention_(t: Tables) -> DataFrame:
    kept = retention.cascade({"summaries": t.told}, retention.expired_sessions(t.sessions, ts(NOW)))["summaries"]
    return kept.groupBy("session_id").agg(F.count(F.lit(1)).alias("kept"))


@query("retention_counts", """SELECT (SELECT count(*) FROM gone) AS sessions, (SELECT count(*) FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) AND l_suppkey NOT IN (SELECT speaker_id FROM act)) AS embeddings""",
       ("sessions",), _EXPIRED + ", " + _ACTIVE)
def retention_counts(t: Tables) -> DataFrame:
    e = t.read("lineitem").select(F.col("l_suppkey").alias("speaker_id"), F.col("l_partkey").alias("id"))
    s = t.read("supplier").select(F.col("s_suppkey").alias("id"))
    state = {"sessions": t.sessions, "speakers": s, "consents": _consents(t), "speaker_embeddings": e}
    return retention.enforce(state, ts(NOW))[1]


@query("merge_speakers", """SELECT s.id, CASE WHEN s.speaker_id IN (12, 13) THEN 11 ELSE coalesce(s.speaker_id, -1) END AS speaker_id FROM segments s""", ("segments",))
def merge_speakers(t: Tables) -> DataFrame:
    people = t.segments.where("speaker_id IS NOT NULL").select(F.col("speaker_id").alias("id"), F.lit(0).alias("channel_id")).distinct()
    merges = people.where("id IN (12, 13)").select(F.lit(11).cast("bigint").alias("into_id"), F.col("id").alias("from_id"))
    return speakers.merge(people, t.segments.select("id", "speaker_id"), t.segments, merges)[2].select("id", F.coalesce("speaker_id", F.lit(-1)).alias("speaker_id"))


@query("reassign_speaker", """SELECT id, CASE WHEN turn = 0 AND channel_id <> 1 THEN 900 + channel_id ELSE coalesce(speaker_id, -1) END AS speaker_id FROM segments""", ("segments",))
def reassign_speaker(t: Tables) -> DataFrame:
    """First turns go to the speaker of their channel, but those of channel 1 to a foreign one, which is refused."""
    s = t.segments.select("session_id", F.col("session_id").alias("id"), "channel_id").distinct()
    who = t.segments.select((F.col("channel_id") + 900).alias("id"), "channel_id").distinct()
    edits = t.segments.where("turn = 0").select(F.col("id").alias("segment_id"), F.when(F.col("channel_id") == 1, 900).otherwise(F.col("channel_id") + 900).alias("speaker_id"))
    return speakers.reassign(t.segments, s.drop("session_id"), who, edits).select("id", F.coalesce("speaker_id", F.lit(-1)).alias("speaker_id"))


@query("delete_speaker", "SELECT id, CASE WHEN speaker_id > 10 THEN -1 ELSE coalesce(speaker_id, -1) END AS speaker_id FROM segments", ("segments",))
def delete_speaker(t: Tables) -> DataFrame:
    people = t.segments.where("speaker_id IS NOT NULL").select(F.col("speaker_id").alias("id"), F.lit(0).alias("channel_id")).distinct()
    gone = people.where("id > 10").select("channel_id", F.col("id").alias("speaker_id"))
    return speakers.delete(people, t.segments.select("id", "speaker_id"), t.segments, gone)[2].select("id", F.coalesce("speaker_id", F.lit(-1)).alias("speaker_id"))


@query("speaker_names", """SELECT c_custkey % 7 AS channel_id, CAST(c_custkey AS VARCHAR) AS speaker, c_name AS name FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0""")
def speaker_names(t: Tables) -> DataFrame:
    from recapflow.operators import transcript

    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("Speaker_"), k)).when(k % 5 == 0, "PENDING").when(k % 7 == 0, k.cast("string")).otherwise(F.concat(F.lit(" "), F.col("c_name")))
    people = t.read("customer").select((k % 7).alias("channel_id"), k.alias("id"), name.alias("name"), (k % 2 == 0).alias("confirmed"))
    return transcript.speaker_names(people)


# ---------------------------------------------------------------- channels and sources


@query("channel_config", """SELECT id, CASE WHEN k IN (0, 2) THEN given ELSE '' END AS content_profile, CASE k WHEN 0 THEN id % 2 = 0 WHEN 2 THEN id % 4 = 0 ELSE FALSE END AS auto_monitor FROM channels""", ("channels",))
def channel_config(t: Tables) -> DataFrame:
    return views.channels(t.channels).select("id", F.coalesce("content_profile", F.lit("")).alias("content_profile"), "auto_monitor")


@query("auto_channels", "SELECT id, login FROM channels WHERE (k = 0 AND id % 2 = 0) OR (k = 2 AND id % 4 = 0)", ("channels",))
def auto_channels(t: Tables) -> DataFrame:
    return channels.auto_channels(t.channels).select("id", "login")


@query("streamer", """SELECT id AS channel_id, CASE WHEN k = 0 THEN c_name ELSE login END AS name, CASE WHEN k = 0 THEN id * 3 ELSE -1 END AS entity_id,
    CASE WHEN k = 0 AND id % 2 = 0 THEN 'observer' ELSE 'participant' END AS pov_mode, CASE WHEN k = 0 THEN 'config' ELSE 'fallback' END AS source FROM channels""", ("channels",))
def streamer(t: Tables) -> DataFrame:
    return channels.streamer(t.channels).select("channel_id", "name", F.coalesce("entity_id", F.lit(-1)).alias("entity_id"), "pov_mode", "source")


@query("streamer_entities", """SELECT e.id, coalesce(c_custkey * 3 = e.id, FALSE) AS is_streamer FROM entities e LEFT JOIN customer c ON c.c_custkey = e.channel_id AND c_custkey % 5 = 0""", ("entities",))
def streamer_entities(t: Tables) -> DataFrame:
    return channels.is_streamer(t.entities, t.channels).select("id", "is_streamer")


@query("profiles", """SELECT id AS channel_id, p AS profile, CASE WHEN p = 'mystery' THEN 'roleplay' ELSE p END AS hint, CASE WHEN p = 'just_chatting' THEN 0.15 ELSE 0.1 END::DOUBLE AS duplicate_threshold,
    CAST(CASE WHEN p = 'gaming' THEN 1 ELSE 2 END AS INTEGER) AS min_speakers FROM (SELECT id, CASE WHEN k IN (0, 2) THEN given ELSE 'roleplay' END AS p FROM channels)""", ("channels",))
def profiles(t: Tables) -> DataFrame:
    return channels.focus(channels.profile(t.channels))


@query("set_config", """SELECT id, CASE WHEN id % 2 = 0 THEN TRUE WHEN k = 0 THEN id % 2 = 0 WHEN k = 2 THEN id % 4 = 0 ELSE FALSE END AS auto_monitor FROM channels""", ("channels",))
def set_config(t: Tables) -> DataFrame:
    edits = t.channels.where("id % 2 = 0").select(F.col("id").alias("channel_id"), F.lit(True).alias("auto_monitor"), F.lit(None).cast("string").alias("content_profile"))
    return views.channels(channels.set_config(t.channels, edits)).select("id", "auto_monitor")


@query("new_channels", """SELECT lower(replace(c_name, '#', '_')) AS login, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'gaming' ELSE 'roleplay' END AS profile FROM customer WHERE c_custkey % 3 <> 0""")
def new_channels(t: Tables) -> DataFrame:
    login = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat(F.lit(" "), F.replace("c_name", F.lit("#"), F.lit("_"))))
    asked = t.read("customer").select(login.alias("login"), F.when(F.col("c_mktsegment") == "MACHINERY", "gaming").otherwise("").alias("content_profile"), F.lit(True).alias("auto_monitor"))
    return channels.new_channels(asked).select("login", F.get_json_object("config_json", "$.content_profile").alias("profile"))


@query("stream_status", "SELECT lower(c_name) AS login, CAST(c_custkey AS VARCHAR) AS stream_id FROM customer WHERE c_mktsegment = 'BUILDING'")
def stream_status(t: Tables) -> DataFrame:
    landed = t.read("customer").select(
        F.upper("c_name").alias("login"), F.when(F.col("c_mktsegment") == "BUILDING", "live").otherwise("rerun").alias("type"),
        F.col("c_custkey").cast("string").alias("stream_id"), F.lit("t").alias("title"), F.lit("c").alias("category"))
    return channels.stream_status(landed).select("login", "stream_id")


@query("watch_actions", f"""SELECT c.id AS channel_id, CASE WHEN c.id % 8 = 0 THEN 'update' WHEN l.id IS NOT NULL AND (epoch_us(TIMESTAMP '{NOW}') - epoch_us(l.ended_at)) / 1e6 <= 36000 * 60 AND NOT EXISTS (SELECT 1 FROM segments g WHERE g.session_id = l.id) THEN 'cooldown' ELSE 'start' END AS action
    FROM (SELECT * FROM channels WHERE (k = 0 AND id % 2 = 0) OR (k = 2 AND id % 4 = 0)) c
    LEFT JOIN (SELECT channel_id, arg_max(id, id) AS id, arg_max(coalesce(ended_at, TIMESTAMP '1970-01-01'), id) AS ended_at FROM sessions WHERE source = 'live' GROUP BY channel_id) l ON l.channel_id = c.id
    WHERE c.id % 3 <> 0""", ("channels", "sessions", "segments"))
def watch_actions(t: Tables) -> DataFrame:
    """Actions of one tick; the cool-down is 25 days."""
    from recapflow.operators import sessions

    status = t.channels.where("id % 3 <> 0").select("login", F.lit("s").alias("stream_id"), F.lit("t").alias("title"), F.lit("c").alias("category"))
    leases = t.channels.where("id % 8 = 0").select(F.concat(F.lit("live:"), F.col("id")).alias("key"), F.col("id").alias("session_id"), F.lit(1e12).alias("expires_at"))
    return sessions.tick(t.channels, status, t.sessions, t.segments, leases, ts(NOW), Params(cooldown_minutes=36000.0)).select("channel_id", "action")


@query("schema_conform", "SELECT p_partkey AS id, p_name AS canonical_name, 'none' AS description, CAST(p_size AS BIGINT) AS mention_count FROM part")
def schema_conform(t: Tables) -> DataFrame:
    """Parts stored with an old layout: missing columns appear as NULL."""
    from recapflow.schemas import TABLES

    old = t.read("part").select(F.col("p_partkey").cast("int").alias("id"), F.col("p_name").alias("canonical_name"), F.col("p_size").alias("mention_count"))
    return tables.conform(old, TABLES["entities"]).select("id", "canonical_name", F.coalesce("description", F.lit("none")).alias("description"), "mention_count")


@query("upsert", """SELECT p_partkey AS id, coalesce(l.v, p_retailprice) AS v FROM part LEFT JOIN (SELECT l_partkey, arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber) AS v FROM lineitem GROUP BY 1) l ON l.l_partkey = p_partkey""")
def upsert(t: Tables) -> DataFrame:
    old = t.read("part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("v"))
    new = t.read("lineitem").select(F.col("l_partkey").alias("id"), F.col("l_extendedprice").alias("v"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return tables.upsert(old, new, ["id"], [F.col("o")])


@query("insert_new", """SELECT l_partkey AS id, min(l_orderkey * 10 + l_linenumber) AS o FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25) GROUP BY l_partkey""")
def insert_new(t: Tables) -> DataFrame:
    old = t.read("part").where("p_size < 25").select(F.col("p_partkey").alias("id"))
    new = t.read("lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return tables.insert_new(old, new, ["id"], [F.col("o")])


@query("next_ids", "SELECT event_id, CAST(100 + row_number() OVER (ORDER BY ts) AS BIGINT) AS id FROM events")
def next_ids(t: Tables) -> DataFrame:
    return tables.next_ids(t.read("events"), ["ts"], F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000), 100).select("event_id", "id")


@query("view_entities", "SELECT channel_id, id, canonical_name AS name, type, status FROM entities", ("entities",))
def view_entities(t: Tables) -> DataFrame:
    return views.entities(t.entities)


@query("view_threads", "SELECT channel_id, id, title, status FROM threads", ("threads",))
def view_threads(t: Tables) -> DataFrame:
    return views.threads(t.threads)


@query("view_events", "SELECT session_id, id, round(t_start, 6) AS t_start, description, importance FROM ev_events", ("ev_events",))
def view_events(t: Tables) -> DataFrame:
    rows = views.events(t.ev_events.withColumn("thread_id", F.lit(None).cast("bigint")))
    return rows.drop("thread_id").withColumn("t_start", F.round("t_start", 6)).orderBy("session_id", "t_start")


@query("view_sessions", "SELECT id, status, title, coalesce(final_summary, '') AS final_summary FROM sessions", ("sessions",))
def view_sessions(t: Tables) -> DataFrame:
    base = t.sessions.withColumns({"category": F.lit(None).cast("string"), "last_error": F.lit(None).cast("string"), "last_error_at": F.lit(None).cast("timestamp")})
    return views.session(base).select("id", "status", "title", F.coalesce("final_summary", F.lit("")).alias("final_summary"))


# ---------------------------------------------------------------- model answers and memory


def _extractions(t: Tables) -> DataFrame:
    """One extraction document per stream window, made of its events, as fenced model text."""
    e = t.ev_events.withColumn("confidence", F.least(F.lit(1.0), F.round(F.col("importance") * 0.21 - 0.01, 2)))
    ev = F.struct(
        F.col("t_start"), F.col("t_end"), F.when(F.col("type") == "error", "glitch").otherwise("plot").alias("type"), F.col("description"), F.col("confidence"), F.col("importance"),
        F.array(F.concat(F.lit("NEW:"), F.col("type")), F.lit("E999999999")).alias("participants"), F.concat(F.lit("NEW:"), F.col("type"), F.lit("_case")).alias("thread_ref"), F.upper("type").alias("streamer_role"),
    )
    ent = F.struct(F.concat(F.lit("NEW:"), F.col("type")).alias("ref"), F.lit("person").alias("type"), F.array(F.col("type")).alias("aliases_seen"), F.col("description").alias("description_delta"), F.col("confidence"))
    thr = F.struct(F.concat(F.lit("NEW:"), F.col("type"), F.lit("_case")).alias("ref"), F.lit("open").alias("status"), F.col("description").alias("delta"), F.array(F.lit("E5")).alias("participants"), F.col("confidence"))
    att = F.struct(F.col("id").alias("segment_id"), F.lit("narration").alias("kind"), F.concat(F.lit("NEW:"), F.col("type")).alias("entity_ref"), F.col("confidence"), F.repeat(F.col("description"), F.lit(10)).alias("evidence"))

    def ordered(s):
        return F.transform(F.array_sort(F.collect_list(F.struct("id", s.alias("x")))), lambda r: r["x"])

    doc = e.groupBy("session_id", "window_id").agg(
        ordered(att).alias("utterance_attributions"), ordered(ent).alias("entity_updates"), ordered(thr).alias("thread_updates"), ordered(ev).alias("events"))
    text = F.to_json(F.struct("utterance_attributions", "entity_updates", "thread_updates", "events", F.lit("seen").alias("window_summary"), F.array().cast("array<string>").alias("open_questions")))
    return doc.select("session_id", "window_id", F.concat(F.lit("Here:\n```json\n"), text, F.lit("\n```")).alias("raw"))


@query("extraction_parse", """SELECT window_id, id AS segment_id, round(t_start, 6) AS t_start, description, least(1.0::DOUBLE, round(importance * 0.21::DOUBLE - 0.01, 2)) AS confidence FROM ev_events""", ("ev_events",))
def extraction_parse(t: Tables) -> DataFrame:
    doc = documents.parse_extraction(_extractions(t))
    both = F.arrays_zip(F.col("extraction.utterance_attributions").alias("a"), F.col("extraction.events").alias("e"))
    return doc.select("window_id", F.explode(both).alias("z")).select(
        "window_id", "z.a.segment_id", F.round("z.e.t_start", 6).alias("t_start"), "z.e.description", "z.e.confidence")


@query("validate", """SELECT window_id, bool_or(type = 'error') AS rejected, CASE WHEN bool_or(type = 'error') THEN 'event' ELSE '' END AS problems FROM ev_events GROUP BY window_id""", ("ev_events",))
def validate(t: Tables) -> DataFrame:
    good, bad = guards.validate(documents.parse_extraction(_extractions(t)))
    return good.select("window_id", F.lit(False).alias("rejected"), F.lit("").alias("problems")).unionByName(
        bad.select("window_id", F.lit(True).alias("rejected"), F.array_join("problems", ",").alias("problems")))


@query("empty_extractions", """SELECT doc_id, NOT (quality = 1 OR toxic = 1) AS empty FROM labels""")
def empty_extractions(t: Tables) -> DataFrame:
    summary = F.when(F.col("quality") == 1, '"told"').otherwise('"  "')
    events = F.when(F.col("toxic") == 1, '[{"t_start": 1, "t_end": 2, "type": "plot"}]').otherwise("[]")
    rows = t.read("labels").withColumn("raw", F.concat(F.lit('{"window_summary": '), summary, F.lit(', "events": '), events, F.lit("}")))
    return documents.parse_extraction(rows).select("doc_id", guards.is_empty(F.col("extraction")).alias("empty"))


@query("quarantine", """SELECT kind, outcome, count(*) AS n FROM (SELECT k.kind, CASE WHEN least(1.0::DOUBLE, round(importance * 0.21::DOUBLE - 0.01, 2)) < k.lim THEN 'quarantined' ELSE 'applied' END AS outcome FROM ev_events
    CROSS JOIN (VALUES ('entity', 0.65), ('thread', 0.65), ('event', 0.60), ('attribution', 0.60)) k(kind, lim)) GROUP BY kind, outcome""", ("ev_events",))
def quarantine(t: Tables) -> DataFrame:
    return memory.counters(_batch(t))


def _batch(t: Tables) -> DataFrame:
    doc = documents.parse_extraction(_extractions(t)).select("session_id", "window_id", "extraction")
    return doc.withColumns({"channel_id": F.col("session_id") % 10, "at": F.timestamp_seconds("window_id")})


def _empty_memory(t: Tables) -> memory.Memory:
    from recapflow.schemas import TABLES

    names = ("entities", "entity_aliases", "threads", "events", "event_participants", "attributions")
    return memory.Memory(*[t.spark.createDataFrame([], TABLES[n]) for n in names])


_MEM = """up AS (SELECT *, max(importance) FILTER (conf >= 0.6) OVER (PARTITION BY window_id, type) AS big, coalesce(id = max(id) FILTER (conf >= 0.65) OVER (PARTITION BY window_id, type), FALSE) AS is_last,
    max(conf) OVER (PARTITION BY window_id, type) >= 0.65 AS known FROM (SELECT *, session_id % 10 AS channel_id, row_number() OVER (PARTITION BY window_id ORDER BY id) - 1 AS pos,
    least(1.0::DOUBLE, round(importance * 0.21::DOUBLE - 0.01, 2)) AS conf FROM ev_events))"""


@query("memory_entities", """SELECT channel_id, type AS canonical_name, CAST(count(*) AS BIGINT) AS mention_count, CASE WHEN count(*) >= 2 THEN 'confirmed' ELSE 'provisional' END AS status,
    arg_min(session_id, window_id * 1000 + pos) AS first_seen_session FROM up WHERE conf >= 0.65 GROUP BY channel_id, type""", ("ev_events",), _MEM)
def memory_entities(t: Tables) -> DataFrame:
    out = memory.apply(_batch(t), _empty_memory(t)).entities
    return out.select("channel_id", "canonical_name", "mention_count", "status", "first_seen_session")


@query("memory_threads", """SELECT channel_id, type || ' case' AS title, description AS summary, 'open' AS status, CAST(CASE WHEN is_last THEN greatest(3, big) ELSE 3 END AS INTEGER) AS importance
    FROM up WHERE conf >= 0.65""", ("ev_events",), _MEM)
def memory_threads(t: Tables) -> DataFrame:
    """A repeated new storyline of a window is made twice; its events go to the last one."""
    return memory.apply(_batch(t), _empty_memory(t)).threads.select("channel_id", "title", "summary", "status", "importance")


@query("memory_events", """SELECT session_id, window_id, description, importance, CASE WHEN known THEN type || ' case' ELSE '' END AS thread, 'unknown' AS streamer_role, CAST(CASE WHEN known THEN 1 ELSE 0 END AS BIGINT) AS participants
    FROM up WHERE conf >= 0.6""", ("ev_events",), _MEM)
def memory_events(t: Tables) -> DataFrame:
    """Written events with the storyline and the number of participants found."""
    out = memory.apply(_batch(t), _empty_memory(t))
    n = out.event_participants.groupBy(F.col("event_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    titles = out.threads.select(F.col("id").alias("thread_id"), "title")
    return out.events.join(titles, "thread_id", "left").join(n, "id", "left").select(
        "session_id", "window_id", "description", "importance", F.coalesce("title", F.lit("")).alias("thread"), "streamer_role", F.coalesce("n", F.lit(0)).alias("participants"))


@query("memory_attributions", """SELECT id AS segment_id, CASE WHEN conf >= 0.6 THEN 'narration' ELSE 'unclear' END AS kind, left(repeat(description, 10), 60) AS evidence, conf >= 0.6 AND known AS named FROM up""", ("ev_events",), _MEM)
def memory_attributions(t: Tables) -> DataFrame:
    out = memory.apply(_batch(t), _empty_memory(t)).attributions
    return out.select("segment_id", "kind", "evidence", F.col("entity_id").isNotNull().alias("named"))


_TRI = """tri AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 1 + quality + toxic END AS imp, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE (doc_id % 10) / 10.0::DOUBLE END AS conf, toxic = 1 AS newc FROM labels)"""


@query("triage_skip", "SELECT doc_id, coalesce(imp, 3) <= 1 AND coalesce(conf, 0) >= 0.6 AND NOT newc AS skip FROM tri", (), _TRI)
def triage_skip(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    imp = F.when(d % 5 != 0, 1 + F.col("quality") + F.col("toxic"))
    conf = F.when(d % 7 != 0, (d % 10) / F.lit(10.0))
    return t.read("labels").select("doc_id", triage.should_skip(imp, F.col("toxic") == 1, conf).alias("skip"))


def _answers(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    score = F.when(d % 11 == 0, F.lit('"n/a"')).otherwise(((d % 12) / F.lit(2.0)).cast("string"))
    raw = F.concat(F.lit('{"answers": {"importance": {"score": '), score, F.lit(', "confidence": '), ((d % 10) / F.lit(10.0)).cast("string"),
                   F.lit('}, "new_character": {"noul": '), (F.col("toxic") * 0.7).cast("string"), F.lit('}, "character": {"choice": "c'), d % 3, F.lit('"}}, "model": "m"}'))
    return t.read("labels").select("doc_id", triage.answers(F.when(d % 13 == 0, "oops").otherwise(raw)).alias("a"))


_ANS = """ans AS (SELECT doc_id, doc_id % 13 = 0 AS broken, doc_id % 11 = 0 AS unread, (doc_id % 12) / 2.0::DOUBLE AS score, (doc_id % 10) / 10.0::DOUBLE AS conf, toxic = 1 AS newc FROM labels)"""


@query("verdict", """SELECT doc_id, CAST(CASE WHEN broken OR unread THEN -1 ELSE least(greatest(round_even(score, 0) + 1, 1), 5) END AS INTEGER) AS importance,
    CASE WHEN broken OR unread THEN 0.0::DOUBLE ELSE conf END AS confidence, newc AND NOT broken AS new_character FROM ans""", (), _ANS)
def verdict(t: Tables) -> DataFrame:
    rows = _answers(t).select("doc_id", triage.verdict(F.col("a")).alias("v"))
    return rows.select("doc_id", F.coalesce("v.importance", F.lit(-1)).alias("importance"), F.col("v.importance_confidence").alias("confidence"), "v.new_character")


@query("routing", """SELECT doc_id, CAST(CASE WHEN broken OR unread THEN 3 ELSE least(greatest(round_even(score, 0) + 1, 1), 5) END AS INTEGER) AS importance,
    CASE WHEN broken THEN '' ELSE 'c' || (doc_id % 3) END AS character, newc AND NOT broken AS new_character FROM ans""", (), _ANS)
def routing(t: Tables) -> DataFrame:
    rows = _answers(t).select("doc_id", triage.routing(F.col("a")).alias("v"))
    return rows.select("doc_id", "v.importance", F.coalesce("v.character", F.lit("")).alias("character"), "v.new_character")


@query("routing_text", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS character, CASE WHEN event_id % 2 = 0 THEN '' ELSE 't' || (event_id % 4) END AS thread,
    CAST(CASE WHEN event_id % 5 = 0 THEN 3 ELSE least(greatest(event_id % 8, 1), 5) END AS INTEGER) AS importance FROM events""")
def routing_text(t: Tables) -> DataFrame:
    i = F.col("event_id")
    reply = F.concat(F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("character="), F.col("event_type"))), F.lit(" thread="), F.when(i % 2 == 0, "NONE").otherwise(F.concat(F.lit("t"), i % 4)),
                     F.when(i % 5 == 0, "").otherwise(F.concat(F.lit(" importance="), i % 8)))
    rows = t.read("events").select("event_id", triage.parse_text(reply).alias("v"))
    return rows.select("event_id", F.coalesce("v.character", F.lit("")).alias("character"), F.coalesce("v.thread", F.lit("")).alias("thread"), "v.importance")


@query("triage_states", """SELECT doc_id, '[known_people]' || chr(10) || CASE doc_id % 3 WHEN 0 THEN 'context unavailable' WHEN 1 THEN '(none known yet)' ELSE '- ' || source || ': ' || lang END || chr(10) || '[/known_people]' || chr(10) ||
    '[open_storylines]' || chr(10) || '(none open yet)' || chr(10) || '[/open_storylines]' || chr(10) || '[transcript]' || chr(10) || text || chr(10) || '[/transcript]' AS state FROM documents""")
def triage_states(t: Tables) -> DataFrame:
    k, none = F.col("doc_id") % 3, F.array().cast("array<string>")
    people = F.when(k == 1, none).when(k == 2, F.array(F.concat_ws(": ", "source", "lang")))
    return t.read("documents").select("doc_id", triage.state_text(people, none, F.col("text")).alias("state"))


@query("norm_roles", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'witness' ELSE 'unknown' END AS role FROM events")
def norm_roles(t: Tables) -> DataFrame:
    given = F.when(F.col("event_type").isin("view", "click"), " Witness ").otherwise(F.col("event_type"))
    return t.read("events").select("event_id", X.norm_role(given).alias("role"))


@query("model_requests", """SELECT stage, outcome, CAST(sum(n) AS BIGINT) AS n FROM (SELECT l_shipmode AS stage, 'success' AS outcome, 0 AS n FROM (SELECT 'x' AS l_shipmode) WHERE FALSE
    UNION ALL SELECT l_linestatus, 'success', count(*) FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1
    UNION ALL SELECT l_linestatus, 'error', sum(CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE l_linenumber - 1 END) FROM lineitem GROUP BY 1) GROUP BY stage, outcome""")
def model_requests(t: Tables) -> DataFrame:
    return quality.requests(_results(t))


@query("model_errors", "SELECT l_linestatus AS stage, 'TimeoutError' AS error_type, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def model_errors(t: Tables) -> DataFrame:
    return quality.errors(_results(t))


def _results(t: Tables) -> DataFrame:
    return t.read("lineitem").select(
        F.col("l_linestatus").alias("stage"), F.col("l_linenumber").cast("bigint").alias("attempts"), F.when(F.col("l_returnflag") == "R", "TimeoutError").alias("error_type"))


@query("stub_extract", "SELECT doc_id, 'Stub summary (no LLM configured).' AS window_summary, 'done' AS status FROM documents")
def stub_extract(t: Tables) -> DataFrame:
    """Extraction of every document with the stub model, repair passes included."""
    asked = infer.extract_with_repair(t.read("documents").select("doc_id", F.col("text").alias("prompt")))
    return asked.select("doc_id", "extraction.window_summary", "status")


_MATCHED = """, ent AS (SELECT *, array_to_string(list_sort(list_distinct(string_split(lower(canonical_name), ' '))), ' ') AS k FROM entities WHERE status <> 'merged'),
  gp AS (SELECT channel_id, gold, list(pred ORDER BY score DESC, pred) AS preds, row_number() OVER (PARTITION BY channel_id ORDER BY gold) AS i FROM (
    SELECT x.channel_id, x.id AS gold, y.id AS pred, CASE WHEN x.k = y.k THEN 100 ELSE sc.score END AS score FROM ent x JOIN ent y ON y.channel_id = x.channel_id AND x.id % 2 = 0 AND y.id % 2 = 1
      LEFT JOIN sc ON sc.a = least(x.k, y.k) AND sc.b = greatest(x.k, y.k)) WHERE score >= 72 GROUP BY channel_id, gold),
  mt AS (SELECT DISTINCT channel_id, 0::BIGINT AS i, []::BIGINT[] AS taken FROM gp
    UNION ALL SELECT m.channel_id, g.i, list_concat(taken, list_filter(preds, lambda x: NOT list_contains(taken, x))[1:1]) FROM mt m JOIN gp g ON g.channel_id = m.channel_id AND g.i = m.i + 1)"""


@query("prf", """SELECT session_id, matched, round(matched / n, 4) AS precision, round(matched / k, 4) AS recall, round(CASE WHEN matched = 0 THEN 0 ELSE 2 * (matched / n) * (matched / k) / (matched / n + matched / k) END, 4) AS f1 FROM (
    SELECT e.channel_id AS session_id, count(*) FILTER (id % 2 = 1) AS n, count(*) FILTER (id % 2 = 0) AS k, coalesce((SELECT max(len(taken)) FROM mt WHERE mt.channel_id = e.channel_id), 0) AS matched FROM ent e GROUP BY e.channel_id)""",
       ("entities",), _SCORES + _MATCHED)
def prf(t: Tables) -> DataFrame:
    """Names of a channel, the odd ones as predicted and the even ones as expected names."""
    names = t.entities.where("status <> 'merged'").select(F.col("channel_id").alias("session_id"), F.col("id").alias("no"), F.col("canonical_name").alias("text"))
    return evaluation.prf(names.where("no % 2 = 1"), names.where("no % 2 = 0"), 72.0)
