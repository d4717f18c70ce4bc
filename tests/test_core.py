"""Small seeded cases with known answers."""

import collections
import functools
import itertools
import json
import random
import struct
import tempfile
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recapflow.functions import folds, fuzzy, similar, text as X, times as TM
from recapflow.functions.stages import written
from recapflow.functions.ordered import id_block, last_before, previous, running_sum, top_n
from recapflow.operators import audio as cuts
from recapflow.operators import (
    context, evaluation, extract, final, guards, infer, memory, mentions, recap, resolve, retention, sessions, speakers, summaries, timeline, transcript, triage, windows,
)
from recapflow.params import Params
from recapflow.schemas import TABLES
from recapflow.sources import audio, channels, documents, tables

UTT = "session_id long, id long, t_start double, t_end double, n_words long"


def stamp(text):
    return F.lit(text).cast("timestamp")


def one(df, col):
    return [r[col] for r in df.collect()]


def make(spark, name, rows, fields):
    """Rows of a state table; absent columns are NULL."""
    ddl = {f.split()[0]: f for f in _split(TABLES[name])}
    df = spark.createDataFrame(rows, ", ".join(ddl[f] if "TIMESTAMP" not in ddl[f] else f"{f} STRING" for f in fields))
    return tables.conform(df, TABLES[name])


def _split(ddl):
    out, depth, cur = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*out, cur.strip()]


# ---------------------------------------------------------------- windows


def reference_windows(rows, p):
    out, buf, words = [], [], 0
    for u in rows:
        if buf:
            pause = buf[-1][3] - buf[0][2] >= p.window_min_seconds and u[2] - buf[-1][3] >= p.window_min_silence
            if pause or u[3] - buf[0][2] > p.window_max_seconds or words + u[4] > p.window_max_words:
                out.append(buf)
                buf, words = [], 0
        fresh = not buf
        buf, words = [*buf, u], words + u[4]
        if not fresh and (u[3] - buf[0][2] >= p.window_max_seconds or words >= p.window_max_words):
            out.append(buf)
            buf, words = [], 0
    return out + ([buf] if buf else [])


def built(spark, rows, p):
    df = spark.createDataFrame(rows, UTT)
    return sorted((r.session_id, r.window_no, list(r.segment_ids)) for r in windows.build(windows.assign(df, p)).collect())


def test_window_cases(spark):
    assert built(spark, [(1, 1, 0.0, 1.0, 6), (1, 2, 2.0, 5.0, 6)], Params(window_max_words=10)) == [(1, 1, [1]), (1, 2, [2])]
    assert built(spark, [(1, 1, 0.0, 11.0, 1), (1, 2, 20.0, 21.0, 1)], Params(window_min_seconds=10)) == [(1, 1, [1]), (1, 2, [2])]
    back_to_back = [(1, i, 3.0 * i, 3.0 * i + 3, 1) for i in range(40)]
    assert built(spark, back_to_back, Params())[0] == (1, 1, list(range(30)))
    assert built(spark, [(1, 1, 0.0, 130.0, 1), (1, 2, 130.0, 131.0, 1)], Params()) == [(1, 1, [1]), (1, 2, [2])]


def test_windows_do_not_depend_on_chunks(spark):
    rnd, rows = random.Random(5), []
    for s in range(12):
        t = 0.0
        for i in range(rnd.choice([1, 60, 300])):
            t += 0.0 if s % 3 == 0 else rnd.choice([0.0, 0.2, 1.5, 2.0, 100.0 if rnd.random() < 0.05 else 0.1])
            d = 3.0 if s % 3 == 0 else rnd.choice([1.0, 2.5, 29.0, 130.0 if rnd.random() < 0.05 else 4.0])
            rows.append((s, s * 1000 + i, t, t + d, rnd.choice([5, 12, 100])))
            t += d
    for seconds in (90.0, 200.0, 3600.0):
        p = Params(chunk_seconds=seconds)
        want = [
            (s, n, [u[1] for u in w]) for s in range(12)
            for n, w in enumerate(reference_windows([r for r in rows if r[0] == s], p), 1)
        ]
        assert built(spark, rows, p) == want


# ---------------------------------------------------------------- ordered building blocks


def test_ordered_blocks_match_plain_windows(spark):
    rnd = random.Random(1)
    rows = [(k, t, rnd.randrange(9)) for k in range(3) for t in rnd.sample(range(500), 120)]
    df = spark.createDataFrame(rows, "k long, t long, v long")
    got = {(r.k, r.t): r.s for r in running_sum(df, ["k"], ["t"], F.col("v"), "s", id_block("t", 7)).collect()}
    prev = {(r.k, r.t): r.p and r.p.v for r in previous(df, ["k"], ["t"], ["v"], "p", id_block("t", 7)).collect()}
    for k in range(3):
        total, before = 0, None
        for _, t, v in sorted(r for r in rows if r[0] == k):
            total += v
            assert got[k, t] == total and prev[k, t] == before
            before = v
    right = df.where("v > 4").withColumnRenamed("v", "w")
    found = last_before(df.withColumnRenamed("v", "x"), right, ["k"], ["t"], 2, id_block("t", 7)).collect()
    for k, t, _ in rows:
        want = [w for _, _, w in sorted(((a, b, c) for a, b, c in rows if a == k and b < t and c > 4), reverse=True)[:2]]
        assert [r.w for r in sorted(found, key=lambda r: r.back) if (r.k, r.t) == (k, t)] == want


def test_hot_keys_are_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
    plan = top_n(df, ["k"], [F.desc("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


# ---------------------------------------------------------------- text


def test_text_helpers(spark):
    df = spark.createDataFrame([("a" * 3000, "b", "Größe  l'été\n", "[1] **x** y")], "long string, d string, w string, m string")
    r = df.select(
        X.append_bounded(F.col("long"), F.col("d")).alias("ab"), X.snippet(F.col("long"), 90).alias("sn"), X.words(F.col("w")).alias("w"),
        X.strip_markdown_tail(F.col("m")).alias("tail"), X.clean_bold(F.col("m")).alias("bold"), X.approx_tokens(F.lit("")).alias("tok"),
        X.bigram_diversity(F.lit("aaaa")).alias("div"), TM.clock_hm(F.lit(2550.9)).alias("hm"), TM.clock_ms(F.lit(80.0)).alias("ms"),
        TM.clock_ui(F.lit(3661.0)).alias("ui"), X.avg_logprob(F.array().cast("array<double>")).alias("lp"), X.norm_role(F.lit(" Actor ")).alias("role"),
    ).first()
    assert r.ab == "a" * 400 + " … " + "a" * 1595 + " b" and len(r.sn) == 90
    assert r.w == ["grösse", "l'été"] and r.tail == "[1]" and r.bold == "[1] x y" and r.tok == 1
    assert r.div == pytest.approx(1 / 3) and (r.hm, r.ms, r.ui) == ("0:42", "01:20", "1:01:01") and r.lp is None and r.role == "actor"


def test_guard_reasons(spark):
    rows = [("Thanks for watching", None, None), ("  ", None, None), ("hi", -2.0, None), ("hi", None, 0.7), ("la " * 30, None, None), ("no " * 7, None, None), ("all fine here", -0.5, 0.1)]
    df = spark.createDataFrame(rows, "text string, avg_logprob double, no_speech double")
    assert one(guards.should_drop(df), "reason") == ["blocklist", "empty", "low_logprob", "no_speech", "repetition", "repetition", ""]


def test_fuzzy_scores():
    assert fuzzy.token_set_ratio("marcus", "marcus webb") == 100 and fuzzy.token_set_ratio("", "a") == 0
    assert fuzzy.partial_token_set_ratio("abc", "xxabcxx") == 100 and fuzzy.partial_token_set_ratio("abc", "xyz", 80.0) == 0
    rnd = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 30))) for _ in range(2))
        short, long = sorted((a, b), key=len)
        spans = [long[max(0, e - len(short)):e] for e in range(1, len(long) + len(short))]
        best = max(200 * fuzzy.lcs_length(short, w) / (len(short) + len(w)) for w in spans)
        assert fuzzy._best_window(short, long, 0.0) == pytest.approx(best)
        assert fuzzy._best_window(short, long, 60.0) == pytest.approx(best if best >= 60 else 0)


def test_similar_pairs_are_complete(spark):
    rnd = random.Random(4)
    words = ["kael", "kaell", "marcus", "webb", "marcos", "priya", "officer", "mr", "x", "docks"]
    names = sorted({" ".join(rnd.choice(words) + rnd.choice(["", "", "s", "a"]) for _ in range(rnd.choice([1, 2, 3]))) for _ in range(160)})
    df = spark.createDataFrame([(0, n) for n in names], "g int, name string").select("g", similar.token_key(F.col("name")).alias("key")).distinct()
    keys = one(df, "key")
    for threshold in (50.0, 67.0, 72.0, 80.0, 90.0):
        want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(keys, 2) if fuzzy.token_set_ratio(a, b) >= threshold}
        assert {(r.key_a, r.key_b) for r in similar.similar_within(df, ["g"], threshold).collect()} == want


def test_only_distinct_candidates_are_scored(spark):
    df = spark.createDataFrame([(0, "kael vane"), (0, "kael vance"), (0, "mira sol")], "g int, key string")
    close = similar.similar_within(df, ["g"], 72.0)
    assert one(close, "key_a") == ["kael vance"]
    plan = close._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Aggregate") < plan.index("Union")


def test_packing_cuts_before_the_shuffle(spark):
    parts = spark.range(40).select((F.col("id") % 2).alias("k"), F.lit(0).alias("block"), F.col("id").alias("seq"), F.lit("abcd" * 3).alias("text"))
    out = context.pack(parts, ["k"], 10)
    assert sorted(one(out, "seq")) == [0, 1, 2, 3, 4, 5]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.rindex("WindowGroupLimit") > plan.rindex("Exchange")


def test_few_candidates_in_a_large_channel(spark):
    rnd = random.Random(1)
    syllables = [a + b for a in "bcdfghklmnprstvwz" for b in "aeiou"]
    names = set()
    while len(names) < 20_000:
        names.add(" ".join(sorted("".join(rnd.choices(syllables, k=rnd.choice([2, 3]))) for _ in range(rnd.choice([1, 2, 2, 3])))))
    df = spark.createDataFrame([(0, n) for n in names], "g int, key string").repartition(8).cache()
    for threshold in (85.0, 90.0):
        assert similar.candidates(df, ["g"], threshold).count() <= 0.01 * 20_000 * 19_999 / 2


def test_mentions(spark):
    names = spark.createDataFrame([(1, 1, "Kael"), (1, 2, "Marcus Webb"), (1, 3, "X"), (1, 4, "!!"), (1, 5, "don")], "channel_id int, id int, name string")
    texts = spark.createDataFrame([(1, 1, "kael's plan"), (1, 2, "MARCUS WEBB!! left"), (1, 3, "Kaels x donut"), (2, 4, "Kael")], "channel_id int, w int, text string")
    got = sorted((r.w, r.id) for r in mentions.mentions(names, texts, ["channel_id"], "id", "w", "text").collect())
    assert got == [(1, 1), (2, 2)]


# ---------------------------------------------------------------- entities


ENT = ["id", "channel_id", "type", "canonical_name", "status", "mention_count", "needs_review"]


def test_resolution(spark):
    ents = make(spark, "entities", [(1, 1, "person", "Kael", "confirmed", 3, False), (2, 1, "person", "X", "confirmed", 3, False), (3, 1, "person", "Max", "merged", 1, False)], ENT)
    aliases = make(spark, "entity_aliases", [(2, "xx", "a")], ["entity_id", "alias", "source"])
    refs = spark.createDataFrame([(1, r) for r in ("E1", "E3", "kael", "NEW:XX", "Kael the bold", "Ma", "E9", "max")] + [(2, "Kael")], "channel_id long, ref string")
    got = {(r.channel_id, r.ref): (r.entity_id, r.tier) for r in resolve.resolve(refs, ents, aliases).collect()}
    assert got[1, "E1"] == (1, 1) and got[1, "kael"] == (1, 3) and got[1, "NEW:XX"] == (2, 2) and got[1, "Kael the bold"] == (1, 4)
    assert got[1, "E3"][1] == 5 and got[1, "Ma"] == (None, 5) and got[1, "max"] == (3, 3) and got[2, "Kael"] == (None, 5)


def test_candidates_and_suggestions(spark):
    ents = make(spark, "entities", [(1, 1, "person", "Marcus", "confirmed", 5, False), (2, 1, "person", "Marcus Webb", "confirmed", 1, False), (3, 1, "person", "Priya Nair", "confirmed", 4, False), (4, 1, "person", "Bobby", "confirmed", 1, False)], ENT)
    aliases = make(spark, "entity_aliases", [(4, "marcus", "a")], ["entity_id", "alias", "source"])
    pairs = resolve.candidate_pairs(ents, aliases)
    assert [(r.a_id, r.b_id) for r in pairs.orderBy("rank").collect()] == [(1, 2), (1, 4)]
    answers = spark.createDataFrame([(1, 1, 2, "0.95"), (1, 1, 4, "0.6")], "channel_id long, a_id long, b_id long, noul string")
    plain = make(spark, "channels", [(1, "x", None)], ["id", "login", "config_json"])
    host = make(spark, "channels", [(1, "x", json.dumps({"streamer": {"entity_id": 2}}))], ["id", "login", "config_json"])
    bands = lambda ch: {(r.into_id, r.from_id): r.band for r in resolve.suggest(pairs, answers, ents, ch).collect()}
    assert bands(plain) == {(1, 2): "merge", (1, 4): "review"} and bands(host) == {(1, 2): "review", (1, 4): "review"}


def empty_memory(spark):
    return memory.Memory(*[spark.createDataFrame([], TABLES[n]) for n in ("entities", "entity_aliases", "threads", "events", "event_participants", "attributions")])


def batch(spark, docs):
    rows = [(i + 1, 1, 1, json.dumps(d)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "window_id long, session_id long, channel_id long, raw string").withColumn("at", stamp("2026-01-01 00:00:00"))
    return documents.parse_extraction(df)


def test_memory_quarantine_and_writing(spark):
    low = {
        "entity_updates": [{"ref": "NEW:A", "type": "person", "confidence": 0.3}], "thread_updates": [{"ref": "NEW:T", "status": "open", "confidence": 0.4}],
        "events": [{"t_start": 0, "t_end": 1, "type": "plot", "confidence": 0.2}],
        "utterance_attributions": [{"segment_id": 7, "kind": "narration", "entity_ref": "E1", "confidence": 0.2, "evidence": "e" * 90}],
    }
    out = memory.apply(batch(spark, [low]), empty_memory(spark))
    assert out.entities.count() == out.threads.count() == out.events.count() == 0
    a = out.attributions.first()
    assert (a.kind, a.entity_id, len(a.evidence)) == ("unclear", None, 60)

    entity = {"ref": "NEW:Kael", "type": "person", "aliases_seen": ["K"], "description_delta": "tall", "confidence": 0.9}
    event = {"t_start": 0, "t_end": 1, "type": "plot", "description": "heist", "confidence": 0.9, "importance": 5, "participants": ["NEW:Kael", "E1"], "thread_ref": "NEW:big_job"}
    first = {"entity_updates": [entity], "thread_updates": [{"ref": "NEW:big_job", "status": "open", "delta": "started", "confidence": 0.9}], "events": [event]}
    again = {"entity_updates": [{**entity, "ref": "kael", "description_delta": "brave"}],
             "utterance_attributions": [{"segment_id": 9, "kind": "in_character", "entity_ref": "kael", "confidence": 0.9, "evidence": "hi"}]}
    out = memory.apply(batch(spark, [first, again]), empty_memory(spark))
    e = out.entities.collect()
    assert [(r.canonical_name, r.mention_count, r.status, r.description) for r in e] == [("Kael", 2, "confirmed", "tall brave")]
    t = out.threads.first()
    assert (t.title, t.summary, t.importance) == ("big job", "started", 5)
    assert out.events.first().thread_id == t.id and out.event_participants.count() == 1
    assert sorted(one(out.entity_aliases, "alias")) == ["K", "Kael"] and out.attributions.first().entity_id == e[0].id

    update = {"thread_updates": [{"ref": f"T{t.id}", "status": "resolved", "delta": "over", "confidence": 0.68}]}
    later = memory.apply(batch(spark, [update]), memory.Memory(out.entities, out.entity_aliases, out.threads, out.events, out.event_participants, out.attributions))
    assert [(r.status, r.summary) for r in later.threads.collect()] == [("open", "started over")]


def test_batches_do_not_change_memory(spark):
    """One batch gives what writing window by window gives, on stored state with merged rows and repeated mentions."""
    parts = ["Kael", "Vane", "Blade", "Runner", "Mirelle", "Ash", "Mira"]

    def documents_of(seed, n):
        r = random.Random(seed)
        name = lambda: " ".join(r.sample(parts, r.choice([1, 1, 2, 3])))
        docs = []
        for k in range(n):
            ups = [{
                "ref": r.choice(["NEW:", "NEW:", ""]) + name() if r.random() < 0.85 else f"E{r.randrange(1, 5)}", "type": "person", "confidence": r.choice([0.9, 0.9, 0.1]),
                "description_delta": f"d{k}.{j} " + "x" * r.choice([0, 0, 900]), "aliases_seen": [name() for _ in range(r.choice([0, 0, 1, 2]))],
            } for j in range(r.randrange(5))]
            docs.append({
                "entity_updates": ups, "thread_updates": [{"ref": r.choice(["T1", "NEW:a_b"]), "status": r.choice(["open", "resolved"]), "delta": f"t{k}", "confidence": 0.9}],
                "events": [{"t_start": 0, "t_end": 1, "type": "plot", "confidence": 0.9, "importance": r.randrange(1, 6), "thread_ref": "T1", "participants": [u["ref"] for u in ups]}],
            })
        return docs

    stored = empty_memory(spark)
    stored.entities = make(spark, "entities", [(1, 1, "Kael Vane", "confirmed", 3, "old"), (2, 1, "Ash", "merged", 1, None), (3, 2, "Blade", "confirmed", 1, None)],
                           ["id", "channel_id", "canonical_name", "status", "mention_count", "description"]).na.fill(False, ["needs_review"])
    stored.entity_aliases = make(spark, "entity_aliases", [(1, "The Blade"), (2, "Runner")], ["entity_id", "alias"])
    stored.threads = make(spark, "threads", [(1, 1, "story", "open", "so far")], ["id", "channel_id", "title", "status", "summary"])

    def shown(m):
        who = sorted((r.id, r.canonical_name, r.mention_count, r.status, r.description or "", bool(r.needs_review)) for r in m.entities.collect())
        also = sorted((r.entity_id, r.alias) for r in m.entity_aliases.collect())
        told = sorted((r.id, r.title, r.status, r.summary, r.importance) for r in m.threads.collect())
        return who, also, told, sorted((r.event_id, r.entity_id) for r in m.event_participants.collect())

    ext = batch(spark, documents_of(2, 10)).cache()
    m = stored
    for part in ("window_id <= 3", "window_id BETWEEN 4 AND 7", "window_id >= 8"):
        m = memory.apply(ext.where(part), m)
        m = memory.Memory(*[written(x) for x in vars(m).values()])
    whole = shown(memory.apply(ext, stored))
    assert whole == shown(m) and any(r[2] > 3 for r in whole[0])


@pytest.mark.parametrize("seed", [7, 8, 9])
def test_order_of_names_one_by_one(spark, seed):
    """The rounds over names against a plain loop over all references."""
    r = random.Random(seed)
    parts = ["Kael", "Vane", "Blade", "Runner", "Mirelle", "Ash", "Mira", "Blades"]
    name = lambda: " ".join(r.sample(parts, r.choice([1, 1, 2, 3])))
    rows = [(1 + k % 2, k // 3, k % 3, r.choice(["NEW:", ""]) + name(), [name() for _ in range(r.choice([0, 0, 1, 2]))]) for k in range(120)]
    stored = [(1, 1, "Kael Vane"), (2, 1, "Ash"), (3, 2, "Blade")]
    also = [(1, "The Blade"), (2, "Runner")]
    ents = make(spark, "entities", [(*x, "confirmed") for x in stored], ["id", "channel_id", "canonical_name", "status"])
    df = spark.createDataFrame(rows, "channel_id long, window_id long, pos int, ref string, aliases_seen array<string>")
    got = {(x.channel_id, x.window_id, x.pos): (x.entity_id, x.made_window, x.made_pos, x.tier) for x in
           resolve.resolve_in_order(df, ents, make(spark, "entity_aliases", also, ["entity_id", "alias"])).collect()}
    alias, canon = collections.defaultdict(list), collections.defaultdict(list)
    for i, c, n in stored:
        canon[c, n.lower()].append((0, i, 0))
        for e, a in also:
            if e == i:
                alias[c, a.lower()].append((0, i, 0))
    want = {}
    for c, w, p, ref, seen in sorted(rows, key=lambda x: (x[1], x[2])):
        n = ref.removeprefix("NEW:").lower()
        if alias[c, n] or canon[c, n]:
            e, tier = (min(alias[c, n]), 2) if alias[c, n] else (min(canon[c, n]), 3)
        else:
            scored = [(-fuzzy.token_set_ratio(n, k), x) for d in (alias, canon) for (ch, k), v in list(d.items()) if ch == c for x in v]
            close = [x for x in scored if -x[0] >= 90]
            e, tier = (min(close)[1], 4) if close else ((1, w, p), 5)
            if tier == 5:
                alias[c, n].append(e)
        for a in seen:
            alias[c, a.lower()].append(e)
        want[c, w, p] = (*((e[1], None, None) if e[0] == 0 else (None, *e[1:])), tier)
    assert got == want and {2, 4, 5} <= {x[3] for x in want.values()}


def test_names_in_a_row_and_hot_names(spark):
    """An entity that travels from alias to alias, and two names that half of all updates tell of each other."""
    chain = [f"{chr(97 + k) * 5} {chr(98 + k) * 5}" for k in range(12)]
    rows = [(1, k, 0, chain[k], [chain[k + 1]]) for k in range(11)] + [(1, 20, 0, chain[11], [])]
    hot = ["Xylophone", "Quartz Umbrella"]
    rows += [(2, k, 0, hot[k % 2], [hot[1 - k % 2], hot[k % 2]]) for k in range(600)] + [(2, k, 1, f"{k}th {k * 7919 % 1000} other", []) for k in range(600)]
    df = spark.createDataFrame(rows, "channel_id long, window_id long, pos int, ref string, aliases_seen array<string>")
    none = make(spark, "entities", [], ["id", "channel_id", "canonical_name", "status"])
    got = resolve.resolve_in_order(df, none, make(spark, "entity_aliases", [], ["entity_id", "alias"])).collect()
    assert {(r.made_window, r.made_pos) for r in got if r.channel_id == 1} == {(0, 0)}
    assert {(r.made_window, r.made_pos) for r in got if r.channel_id == 2 and r.pos == 0} == {(0, 0)}
    assert [r.tier for r in got if r.channel_id == 2 and r.pos == 0].count(5) == 1


def test_names_of_a_batch_are_matched(spark):
    names = ["NEW:Kael Vane", "NEW:Blade", "NEW:Kael"]
    docs = [{"entity_updates": [{"ref": n, "type": "person", "aliases_seen": ["Blade"] if k == 0 else [], "confidence": 0.9}]} for k, n in enumerate(names)]
    out = memory.apply(batch(spark, docs), empty_memory(spark)).entities.collect()
    assert [(r.canonical_name, r.mention_count) for r in out] == [("Kael Vane", 3)]


# ---------------------------------------------------------------- timeline, recap, context


def test_timeline_rules(spark):
    s = make(spark, "sessions", [(1, 1, "live", "2026-09-21 18:00:00")], ["id", "channel_id", "status", "started_at"])
    minutes = [(5, 3), (10, 4), (20, 4), (30, 4), (40, 5)]
    w = make(spark, "windows", [(i, 1, 0.0, 60.0, f"2026-09-21 18:{m + 1:02d}:00") for i, (m, _) in enumerate(minutes, 1)], ["id", "session_id", "t_start", "t_end", "created_at"])
    e = make(spark, "events", [(i, 1, i, 30.0, "d", imp) for i, (_, imp) in enumerate(minutes, 1)], ["id", "session_id", "window_id", "t_start", "description", "importance"])
    runs = make(spark, "beat_runs", [], ["session_id", "hour_index", "run_label", "status"])
    beats = make(spark, "plot_beats", [], ["id", "session_id", "hour_index", "run_label", "headline"])
    items = timeline.timeline(s, w, e, beats, runs).orderBy("at").collect()
    assert [r.clock for r in items] == ["0:20", "0:30", "0:40"]
    done = make(spark, "beat_runs", [(1, 0, "live", "done")], ["session_id", "hour_index", "run_label", "status"])
    skipped = make(spark, "beat_runs", [(1, 0, "live", "skipped")], ["session_id", "hour_index", "run_label", "status"])
    assert timeline.timeline(s, w, e, beats, done).count() == 0 and timeline.timeline(s, w, e, beats, skipped).count() == 3

    def closed(status, now, end=None):
        rows = make(spark, "sessions", [(1, status, "2026-09-21 18:00:00", end)], ["id", "status", "started_at", "ended_at"])
        return one(timeline.closed_hours(rows, stamp(now)), "closed_hours")[0]

    assert closed("live", "2026-09-21 20:02:00") == 1 and closed("live", "2026-09-21 20:04:00") == 2
    assert closed("ended", "2026-09-22 20:00:00", "2026-09-21 20:05:00") == 3 and closed("ended", "2026-09-22 20:00:00", "2026-09-21 20:00:00") == 3


def test_recap_keys_marks_and_branches(spark):
    s = make(spark, "sessions", [(1, 1, "live")], ["id", "channel_id", "status"])

    def key(imps):
        e = make(spark, "events", [(i, 1, v) for i, v in enumerate(imps, 1)], ["id", "session_id", "importance"])
        return one(recap.full_keys(s, e), "full_key")[0]

    assert [key([1] * n) for n in (0, 1, 2, 3, 4)] == ["session-v4:0:0", "session-v4:0:1", "session-v4:0:1", "session-v4:0:1", "session-v4:0:2"]
    assert key([1, 1, 1, 1, 4]) == "session-v4:5:2"
    e = make(spark, "events", [(1, 1, 20.0, "plot", "old event", 3), (2, 1, 80.0, "reveal", "new event", 5)], ["id", "session_id", "t_start", "type", "description", "importance"])
    sums = make(spark, "summaries", [(5, 1, "recap", "before", "1:stamp")], ["id", "session_id", "kind", "text", "cache_key"])
    votes = make(spark, "summary_feedback", [(1, 1, "recap", "no")], ["id", "session_id", "kind", "vote"])
    threads = make(spark, "threads", [], ["id", "channel_id", "title", "status"])
    names = spark.createDataFrame([], "channel_id long, speaker string, name string")
    prompt = one(recap.prompts(s, e, threads, sums, votes, names), "prompt")[0]
    assert "- [NEW] [01:20 | importance 5 | reveal] new event\n- [00:20 | importance 3 | plot] old event" in prompt
    assert "before" in prompt and "plain sentences" in prompt
    windows_ = make(spark, "windows", [], ["id", "session_id", "cost_usd", "created_at"])
    answers, new = recap.recap(s, windows_, e, threads, sums, votes, names, stamp("2026-01-01 00:00:00"))
    assert [(r.branch, r.text) for r in answers.collect()] == [("fresh", infer.STUB_TEXT)] and one(new, "cache_key") == ["2:"]
    saved = tables.conform(new.withColumn("id", F.lit(6)), TABLES["summaries"]).unionByName(sums)
    answers, new = recap.recap(s, windows_, e, threads, saved, votes, names, stamp("2026-01-01 00:00:00"))
    assert one(answers, "branch") == ["cached"] and new.count() == 0
    beats = make(spark, "plot_beats", [], ["id", "session_id", "hour_index", "headline"])
    full, rows, previews = recap.full(s, windows_, e, beats, sums, names, stamp("2026-01-01 00:00:00"))
    assert [(r.branch, r.preview) for r in full.collect()] == [("fresh", infer.STUB_TEXT)]
    assert one(rows, "cache_key") == one(previews, "cache_key") == ["session-v4:2:1"]


def test_context_selection(spark):
    cast = [(i, 1, "person", f"Regular {chr(65 + i)}", "confirmed", 100, "2026-01-02 00:00:00") for i in range(1, 20)]
    cast += [(30, 1, "person", "Sam", "confirmed", 1, "2025-01-01 00:00:00"), (31, 1, "person", "Kael", "confirmed", 1, "2025-01-01 00:00:00"), (32, 1, "person", "Gone", "merged", 900, "2026-02-01 00:00:00")]
    ents = make(spark, "entities", cast, ["id", "channel_id", "type", "canonical_name", "status", "mention_count", "last_seen_at"])
    aliases = make(spark, "entity_aliases", [], ["entity_id", "alias"])
    ch = make(spark, "channels", [(1, "sam", json.dumps({"streamer": {"name": "Sam", "entity_id": 30}}))], ["id", "login", "config_json"])
    w = spark.createDataFrame([(1, 4, 1, "and then Kael spoke")], "window_id long, session_id long, channel_id long, text string")
    ids = one(context.cast(w, ents, aliases, ch).orderBy("rank"), "id")
    assert ids[:2] == [30, 31] and len(ids) == 12 and 32 not in ids
    s = make(spark, "sessions", [(i, 1, f"2026-01-0{i} 00:00:00", "told" if i < 4 else None) for i in (1, 2, 3, 4)], ["id", "channel_id", "started_at", "final_summary"])
    threads = make(spark, "threads", [(1, 1, "Old feud", "open", 5, "2025-12-01 00:00:00"), (2, 1, "Bank job", "open", 3, "2026-01-02 00:00:00"), (3, 1, "Done", "resolved", 3, "2026-01-03 00:00:00")],
                   ["id", "channel_id", "title", "status", "importance", "last_updated_at"])
    assert one(context.threads(w, threads, s), "title") == ["Bank job"]
    named = w.withColumn("text", F.lit("that old feud again"))
    assert one(context.threads(named, threads, s).orderBy("rank"), "title") == ["Old feud", "Bank job"]
    done = make(spark, "windows", [(0, 4, "w0")], ["id", "session_id", "window_summary"])
    sums = make(spark, "summaries", [(1, 4, "rolling", "so far")], ["id", "session_id", "kind", "text"])
    said = spark.createDataFrame([(1, 1, "Sam")], "window_id long, position long, label string")
    text = one(context.build(w, ch, s, ents, aliases, threads, done, sums, said), "context")[0].split("\n")
    kinds = [line.split("]")[0].split(" ")[0].lstrip("[") for line in text]
    assert kinds == ["meta", "streamer", "previously", "previously"] + ["cast"] * 12 + ["thread", "history", "rolling", "speakers"]


def test_extraction_run(spark):
    class Model:
        def generate_json(self, prompt, system=""):
            if "boom" in prompt and "valid JSON" not in prompt:
                raise ValueError("x")
            if "bad" in prompt:
                return "not json"
            if "quiet" in prompt and "last answer" not in prompt:
                return "{}"
            return '{"window_summary": "ok"}'

    w = make(spark, "windows", [(i, i, "extracting") for i in (1, 2, 3, 4, 5, 6)], ["id", "session_id", "status"])
    s = make(spark, "sessions", [(i, 1) for i in range(1, 7)], ["id", "channel_id"])
    spent = make(spark, "summaries", [(1, 5, 9.0)], ["id", "session_id", "cost_usd"])
    idle = spark.createDataFrame([(6, True)], "window_id long, idle boolean")
    asked = spark.createDataFrame([(1, "fine"), (2, "boom"), (3, "bad"), (4, "quiet"), (5, "x"), (6, "x")], "window_id long, prompt string")
    p = Params(model_retries=1, model_backoff_seconds=0.0)
    out, ext = extract.run(w, asked, s, spent, stamp("2026-01-01 00:00:00"), Model, idle, p=p)
    assert {r.id: r.status for r in out.collect()} == {1: "done", 2: "done", 3: "failed", 4: "done", 5: "failed", 6: "skipped-idle"}
    assert sorted(one(ext, "window_id")) == [1, 2, 4]
    rows = spark.createDataFrame([(1, 1, 1, 5, 0.0, 1.0, "A", None, "hi 7")], "channel_id long, window_id long, position long, id long, t_start double, t_end double, label string, speaker_conf double, text string")
    ctx = spark.createDataFrame([(1, "7 and 77")], "window_id long, context string")
    names = spark.createDataFrame([(1, "7", "Ann")], "channel_id long, speaker string, name string")
    assert one(extract.prompts(rows, ctx, names), "prompt") == ['<context>\nAnn and 77\n</context>\n<transcript>\n[seg 5 | 0.0–1.0 | speaker: A (conf unknown)] "hi 7"\n</transcript>']


def test_final_and_triage_runs(spark):
    s = make(spark, "sessions", [(1, 1, "ended", "2026-01-01 10:00:00"), (2, 1, "ended", "2026-01-01 11:00:00"), (3, 1, "live", None)], ["id", "channel_id", "status", "ended_at"])
    e = make(spark, "events", [(1, 1, 5.0, 3, "a"), (2, 3, 5.0, 3, "b")], ["id", "session_id", "t_start", "importance", "description"])
    none = {n: make(spark, n, [], ["id"]) for n in ("windows", "threads", "summaries")}
    out, rows = final.run(s, none["windows"], e, none["threads"], none["summaries"], stamp("2026-01-01 12:00:00"))
    assert {r.id: r.final_summary for r in out.collect()} == {1: infer.STUB_TEXT, 2: None, 3: None} and rows.count() == 1

    class Jury:
        def ask(self, state, questions):
            if "fail" in state:
                raise RuntimeError("down")
            return json.dumps({"answers": {"importance": {"score": 0.2, "confidence": 0.9}, "new_character": {"noul": 0.9 if "new" in state.split("[transcript]")[1] else 0.1}}})

    w = spark.createDataFrame([(1, 1, "calm"), (2, 1, "new one"), (3, 1, "fail")], "window_id long, channel_id long, text string")
    ents = make(spark, "entities", [(1, 1, "person", "K", "confirmed", 1, False)], ENT)
    got = triage.run(w, ents, none["threads"], Jury, Params(model_retries=0))
    assert {r.window_id: r.idle for r in got.collect()} == {1: True, 2: False, 3: False}


# ---------------------------------------------------------------- voices, retention, evaluation


def test_fact_recall_of_many_facts(spark):
    """More facts than fit into a pack, repeated and missing ones, and facts that only an alignment finds."""
    text = "The harbourmaster unlocked seventeen warehouses"
    facts = ["harbourmastr", "harbourmastr", "seventen", "qqqq", "the end", None] + [f"zz{i}vv" for i in range(150)]
    f = spark.createDataFrame([(1, x) for x in facts] + [(2, "a")], "session_id long, fact string")
    t = spark.createDataFrame([(1, text), (2, None), (3, "x")], "session_id long, text string")
    known = [x for x in facts if x]
    hits = sum(fuzzy.partial_token_set_ratio(x, text.lower(), evaluation.FACT_SCORE) >= evaluation.FACT_SCORE for x in known)
    got = {r.session_id: r.fact_recall for r in evaluation.fact_recall(t, f).collect()}
    assert hits == 4 and got == {1: round(hits / len(known), 4), 2: 1.0, 3: 1.0}


def _cloud(spark, rng, centres, spread, counts, item):
    at = np.repeat(np.arange(len(counts)), counts)
    x = (centres[at] + rng.normal(size=(len(at), centres.shape[1])) * spread).astype("float32")
    rows = pa.table({"channel_id": np.ones(len(at), "int64"), item: np.arange(len(at)), "embedding": pa.array(list(x), pa.list_(pa.float32()))})
    return x.astype("float64"), spark.createDataFrame(rows)


def _plain_nearest(x, y, n):
    score = x @ y.T / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :] + 1e-9)
    order = np.lexsort((np.broadcast_to(-np.arange(len(y)), score.shape), -score), axis=1)[:, :n]
    return {(i, int(j), k + 1): round(float(score[i, j]), 9) for i, row in enumerate(order) for k, j in enumerate(row)}


@pytest.mark.parametrize("spread, seed", [(0.1, 1), (0.4, 2), (5.0, 3)])
def test_nearest_voices_match_all_pairs(spark, monkeypatch, spread, seed):
    """Tight groups, loose groups and no groups at all, with a zero vector, equal voices and a hot group on both sides."""
    for name, size in (("VOICES_PER_PIVOT", 16), ("VECTORS_PER_TASK", 50), ("VOICES_PER_TASK", 20), ("ROWS_PER_BLOCK", 7)):
        monkeypatch.setattr(speakers, name, size)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 12))
    centres[5] = 0
    y, voices = _cloud(spark, rng, centres, spread, [120, 30, 30, 30, 30, 0], "speaker_id")
    x, vectors = _cloud(spark, rng, centres, spread, [100, 10, 10, 10, 10, 5], "vec_id")
    more = [(1, 1000 + i, [0.0] * 12) for i in range(2)] + [(1, 1100 + i, y[3].tolist()) for i in range(3)] + [(2, 2000, [1.0] * 12)]
    y = np.vstack([y, np.zeros((2, 12)), np.repeat(y[3:4], 3, axis=0)])
    number = {**{1000 + i: 240 + i for i in range(2)}, **{1100 + i: 242 + i for i in range(3)}}
    voices = voices.union(spark.createDataFrame(more, voices.schema))
    vectors = vectors.union(spark.createDataFrame([(1, 145, [0.0] * 12), (3, 999, [1.0] * 12)], vectors.schema))
    x = np.vstack([x, np.zeros((1, 12))])
    got = {(r.vec_id, number.get(r.speaker_id, r.speaker_id), r["rank"]): round(r.score, 9) for r in speakers.nearest(vectors, voices, 3).collect()}
    assert got == pytest.approx(_plain_nearest(x, y, 3), abs=1e-8)


def test_nearest_voices_skip_far_groups(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 64))
    _, voices = _cloud(spark, rng, centres, 0.1, [1000] * 20, "speaker_id")
    _, vectors = _cloud(spark, rng, centres, 0.1, [100] * 20, "vec_id")
    r = speakers.multiplied(vectors, voices).first()
    assert r.all_pairs == 2000 * 20000 and r.pairs < 0.1 * r.all_pairs


def test_speaker_match_rules(spark):
    v = spark.createDataFrame([(1, 1, [1.0, 0.0, 0.0]), (1, 2, [1.0, 1.0, 0.0]), (1, 3, [0.0, 0.0, 1.0]), (2, 4, [1.0, 0.0, 0.0])], "channel_id long, vec_id long, embedding array<float>")
    lib = spark.createDataFrame([(1, 10, [1.0, 0.0, 0.0]), (1, 11, [0.0, 1.0, 0.0])], "channel_id long, speaker_id long, embedding array<float>")
    unknown = spark.createDataFrame([(1, 5, [0.0, 0.1, 1.0])], "channel_id long, cluster_id long, embedding array<float>")
    assert {r.vec_id: r.ref for r in speakers.match(v, lib, unknown).collect()} == {1: "speaker:10", 2: "new", 3: "unknown:5", 4: "new"}
    same = v.where("vec_id = 1").select("channel_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("segment_id"), F.lit(2.0).alias("seconds"), "embedding").withColumn("t_start", F.col("segment_id"))
    flags = [r.flag for r in speakers.identify(same, lib.where("speaker_id < 0")).orderBy("segment_id").collect()]
    assert flags == ["provisional", "provisional", "consent-required", "consent-required"]
    free = speakers.identify(same, lib.where("speaker_id < 0"), Params(consent_required=False)).orderBy("segment_id")
    assert [(r.speaker_id, r.flag) for r in free.collect()] == [(None, "provisional"), (None, "provisional"), (-1, ""), (-1, "")]
    stored = make(spark, "speakers", [(30, 1, "old")], ["id", "channel_id", "name"]), make(spark, "speaker_embeddings", [(7, 30)], ["id", "speaker_id"])
    told, who, voices = speakers.promote(free, *stored, "m", stamp("2026-01-01 00:00:00"))
    assert [r.speaker_id for r in told.orderBy("segment_id").collect()] == [None, None, 31, 31]
    assert {(r.id, r.name) for r in who.collect()} == {(30, "old"), (31, "speaker_31")}
    new = voices.where("speaker_id = 31").first()
    assert new.id == 8 and list(new.embedding) == [1.0, 0.0, 0.0] and new.seconds == 6.0 and new.source == "pipeline"


def test_edits_keep_foreign_config_keys(spark):
    docs = [(1, '{"content_profile":"gaming","poll":7,"streamer":{"name":"x","extra":[1,"a",null]}}'), (2, "nonsense"), (3, None), (4, '{"auto_monitor":true}')]
    edits = spark.createDataFrame([(1, True, None), (2, False, 'p"q'), (3, None, "z"), (99, True, None)], "channel_id long, auto_monitor boolean, content_profile string")
    got = {r.id: r.config_json for r in channels.set_config(spark.createDataFrame(docs, "id long, config_json string"), edits).collect()}
    assert {k: json.loads(v) for k, v in got.items()} == {
        1: {"content_profile": "gaming", "poll": 7, "streamer": {"name": "x", "extra": [1, "a", None]}, "auto_monitor": True},
        2: {"auto_monitor": False, "content_profile": 'p"q'}, 3: {"content_profile": "z"}, 4: {"auto_monitor": True},
    }


def test_beats_replies_are_checked(spark):
    beat = {"headline": "h", "significance": 3, "event_ids": [1]}
    replies = {
        "ok": {"beats": [beat] * 4}, "none": {}, "long": {"beats": [beat] * 5}, "low": {"beats": [{**beat, "significance": 0}]},
        "high": {"beats": [{**beat, "significance": 6}]}, "bare": {"beats": [{"headline": "h", "significance": 3}]},
    }
    rows = [(k, json.dumps(v)) for k, v in replies.items()] + [("bad", "no json"), ("null", None)]
    got = documents.parse_beats(spark.createDataFrame(rows, "k string, raw string")).where("proposal IS NOT NULL")
    assert sorted(one(got, "k")) == ["none", "ok"]


def test_all_due_work_is_done_by_default(spark):
    s = make(spark, "sessions", [(i, 1, "ended", "2026-01-01 00:00:00", "2026-01-01 00:30:00") for i in range(5)], ["id", "channel_id", "status", "started_at", "ended_at"])
    events = make(spark, "events", [(i, i, 1, 3) for i in range(5)], ["id", "session_id", "window_id", "importance"])
    assert final.pending(s, events, stamp("2026-01-01 01:00:00")).count() == 5
    assert final.pending(s, events, stamp("2026-01-01 01:00:00"), limit=2).count() == 2


def test_retention_counts(spark):
    s = make(spark, "sessions", [(1, 1, "ended", "2026-01-01 00:00:00"), (2, 1, "live", "2026-01-01 00:00:00")], ["id", "channel_id", "status", "started_at"])
    state = {
        "sessions": s, "speakers": make(spark, "speakers", [(1, 1)], ["id", "channel_id"]), "consents": make(spark, "consents", [], ["id", "speaker_id"]),
        "speaker_embeddings": make(spark, "speaker_embeddings", [(1, 1)], ["id", "speaker_id"]), "segments": make(spark, "segments", [(1, 1), (2, 2)], ["id", "session_id"]),
        "attributions": make(spark, "attributions", [(1, "x"), (2, "x")], ["segment_id", "kind"]),
        "entities": make(spark, "entities", [(1, 1, 1)], ["id", "channel_id", "first_seen_session"]),
    }
    out, counts = retention.enforce(state, stamp("2026-01-11 00:00:00"), Params(transcript_retention_days=1))
    assert tuple(counts.first()) == (1, 1) and one(out["segments"], "id") == [2] and one(out["attributions"], "segment_id") == [2]
    assert one(out["entities"], "first_seen_session") == [None] and out["speaker_embeddings"].count() == 0


def test_metrics(spark):
    pairs = spark.createDataFrame([("a b c", "a x c"), ("a b", "a"), ("a", ""), ("", "a")], "ref string, hyp string")
    assert [round(x, 4) for x in one(evaluation.wer(pairs), "wer")] == [0.3333, 0.5, 1.0, 1.0]
    pred = spark.createDataFrame([(1, 0, "Kael robs the bank"), (1, 1, "unrelated words here")], "session_id long, no long, text string")
    gold = spark.createDataFrame([(1, 0, "Kael robs the bank")], "session_id long, no long, text string")
    r = evaluation.prf(pred, gold, 85.0).first()
    assert (r.precision, r.recall, r.f1, r.matched) == (0.5, 1.0, 0.6667, 1)
    lists = spark.createDataFrame([(1, "events", 1, "Morgan leaves"), (1, "entities", 1, "Morgan"), (1, "window_summaries", 1, "Morgan left")], "session_id long, list string, item_id long, text string")
    texts = spark.createDataFrame([(1, "hello there")], "session_id long, text string")
    wanted = spark.createDataFrame([(1, "hello there", ["Morgan leaves"], ["Morgan"], None, ["Morgan left"])],
                                   "session_id long, transcript string, events array<string>, entities array<string>, threads array<string>, summary_facts array<string>")
    m = evaluation.evaluate(texts, lists, wanted).first()
    assert (m.wer, m.events_f1, m.entities_f1, m.threads_f1, m.summary_fact_recall, m.entity_duplicate_rate) == (0.0, 1.0, 1.0, None, 1.0, 0.0)


def test_session_lookup(spark):
    s = make(spark, "sessions", [(1, 1, "live", "ended"), (2, 1, "live", "live"), (3, 1, "replay", "live")], ["id", "channel_id", "source", "status"])
    told = make(spark, "summaries", [(1, 1, "rolling")], ["id", "session_id", "kind"])
    assert tuple(sessions.summary_session(s, told).first()) == (1, 2, True)
    assert tuple(sessions.summary_session(s.where("id <> 2"), told).first()) == (1, 1, False)


def test_wav_source(spark):
    root = tempfile.mkdtemp(prefix="recapflow-wav-")
    for name, rate, seconds in (("ok", 8000, 1.0), ("short", 16000, 0.1), ("long", 8000, 90.0)):
        with wave.open(f"{root}/{name}.wav", "wb") as f:
            f.setnchannels(1)
            f.setsampwidth(2)
            f.setframerate(rate)
            f.writeframes(struct.pack("<h", 16384) * int(rate * seconds))
    with open(f"{root}/bad.wav", "wb") as f:
        f.write(b"no sound")
    files = audio.wav_status(spark, root)
    got = {r.file.rsplit("/", 1)[1]: (r.status, r.seconds) for r in audio.enrolment_check(files).collect()}
    assert got == {"ok.wav": ("ok", 1.0), "short.wav": ("duration", 0.1), "long.wav": ("duration", 90.0), "bad.wav": ("unreadable", 0.0)}
    assert sorted(one(files, "status")) == ["ok", "ok", "ok", "unreadable"]
    frames = audio.wav_frames(spark, root).cache()
    assert frames.count() == 32 + 4 + 2813 and one(frames, "rms")[0] == pytest.approx(0.5)


def test_tables_round_trip(spark):
    root = tempfile.mkdtemp(prefix="recapflow-tables-")
    rows = make(spark, "segments", [(i, i % 2, float(i), i + 1.0, "t") for i in range(50)], ["id", "session_id", "t_start", "t_end", "text"])
    tables.write_table(rows, root, "segments")
    back = tables.read_table(spark, root, "segments")
    assert back.count() == 50 and back.schema.fieldNames() == rows.schema.fieldNames()
    ids = tables.next_ids(rows.select("t_start"), ["t_start"], F.floor(F.col("t_start") / 7), 100)
    assert sorted(one(ids, "id")) == list(range(101, 151))


def test_audio_cuts(spark):
    loud, quiet = [0.5] * 20, [0.001] * 20
    rows = [(1, i, 512, r) for i, r in enumerate(loud + quiet + loud)] + [(2, i, 512, 0.001) for i in range(40)]
    rows += [(3, i, 512, 0.1 if i == 900 else 0.5) for i in range(1000)]
    df = spark.createDataFrame(rows, "file_id long, frame_no long, n_samples int, rms double")
    simple = sorted((r.file_id, r.n_frames) for r in cuts.segment(df).collect())
    assert simple == [(1, 25), (1, 35), (2, 10), (2, 15), (2, 15), (3, 62), (3, 938)]
    # 500 ms are 16 frames; silence alone is dropped; the 30 s cut falls on the quietest frame.
    stateful = sorted((r.file_id, r.n_frames) for r in cuts.segment(df, "stateful").collect())
    assert stateful == [(1, 24), (1, 36), (3, 100), (3, 900)]


def test_voice_drift(spark):
    import numpy as np

    rnd = np.random.default_rng(3)
    vectors = [rnd.normal(size=4).astype("float32") for _ in range(6)]
    voices = spark.createDataFrame([(1, vectors[0].tolist())], "speaker_id long, embedding array<float>")
    rows = [(1, float(i), i, v.tolist()) for i, v in enumerate(vectors[1:], 1)]
    moved = spark.createDataFrame(rows, "speaker_id long, t_start double, segment_id long, embedding array<float>")
    c = vectors[0] / np.linalg.norm(vectors[0])
    for v in vectors[1:]:
        c = 0.9 * c + 0.1 * v
        c = c / np.linalg.norm(c)
    got = speakers.drift(moved.repartition(3), voices).first()
    assert got.updates == 5 and np.allclose(got.embedding, c, atol=1e-5)

def test_voice_drift_forgets(spark):
    """The same for every length of the chunks, also where vectors keep cancelling the centroid."""
    import numpy as np

    rnd = np.random.default_rng(5)
    rows, want = [], {}
    for who in (1, 2, 3):
        c = np.array([1.0, 0.0, 0.0, 0.0])
        for k in range(400):
            v = (rnd.normal(size=4) if who < 3 else -9.0 * c + 0.01 * rnd.normal(size=4)).astype("float32")
            rows.append((who, float(k), k, v.tolist()))
            c = 0.9 * c + 0.1 * v.astype("float64")
            c = c / np.linalg.norm(c)
        want[who] = c
    voices = spark.createDataFrame([(w, [1.0, 0.0, 0.0, 0.0]) for w in (1, 2, 3, 4)], "speaker_id long, embedding array<float>")
    moved = spark.createDataFrame(rows, "speaker_id long, t_start double, segment_id long, embedding array<float>").repartition(4)
    for chunk, halo in ((100, 40), (64, 64), (1000, 10)):
        got = {r.speaker_id: r for r in speakers.drift(moved, voices, chunk, halo).collect()}
        assert sorted(got) == [1, 2, 3, 4] and [got[w].updates for w in (1, 4)] == [400, 0]
        assert all(np.allclose(got[w].embedding, c, atol=1e-6) for w, c in want.items() if w < 3 or chunk == 1000)


def test_gold_items_take_predictions_in_order(spark):
    """Rounds over joins against the loop, with ties, chains of displacement and equal names."""
    r = random.Random(6)
    rows = [(s, g, p, -float(r.choice([80, 90, 100]))) for s in range(4) for g in range(25) for p in range(20) if r.random() < 0.3]
    rows += [(9, g, p, -100.0) for g in range(30) for p in range(30)]
    want = set()
    for s in {x[0] for x in rows}:
        taken = set()
        for g in sorted({x[1] for x in rows if x[0] == s}):
            free = sorted((c, p) for q, h, p, c in rows if (q, h) == (s, g) and p not in taken)
            if free:
                taken.add(free[0][1])
                want.add((s, g, free[0][1]))
    df = spark.createDataFrame(rows, "session_id long, gold_no long, pred_no long, cost double").repartition(6)
    assert {tuple(x) for x in evaluation.assign(df.where("session_id < 9 OR pred_no >= gold_no")).collect()} == want
    names = lambda n: spark.createDataFrame([(1, k, "Kael Vane") for k in range(n)], "session_id long, no long, text string")
    assert evaluation.matches(names(300), names(200), 85.0).first().matched == 200


class _PlainCuts:
    """The cutting rules frame by frame."""

    def __init__(self, mode):
        self.mode, self.begin, self.held, self.silent, self.speech, self.out = mode, 0, [], 0, False, []

    def emit(self, upto):
        n = sum(k for k, _ in self.held[:upto])
        if n >= 4800 and (self.mode == "simple" or self.speech):
            self.out.append((self.begin / 16000, (self.begin + n) / 16000, upto))
        self.begin, self.held = self.begin + n, self.held[upto:]

    def run(self, frames):
        for n, rms in frames:
            self.held.append((n, rms))
            total = sum(k for k, _ in self.held)
            if self.mode == "simple":
                self.silent = 0 if rms > 0.02 else self.silent + 1
                if (self.silent >= 15 and total >= 4800) or total >= 480000:
                    self.emit(len(self.held))
                    self.silent = 0
                continue
            self.speech, self.silent = self.speech or rms > 0.02, 0 if rms > 0.02 else self.silent + n
            if total >= 480000:
                last = len(self.held) - 1
                self.emit(min(range(last - 155, last), key=lambda i: self.held[i][1]))
            elif self.silent >= 8000:
                self.emit(len(self.held))
            else:
                continue
            self.silent = sum(k for k, _ in self.held)
            self.speech = bool(self.held) and (sum(k * r * r for k, r in self.held) / self.silent) ** 0.5 > 0.02
        if self.held:
            self.emit(len(self.held))
        return self.out


@pytest.mark.parametrize("mode", ["simple", "stateful"])
def test_audio_cuts_do_not_depend_on_chunks(spark, mode):
    """Files of pauses and of speech without any, with a short frame now and then, against the plain rule."""
    r = random.Random(11)
    files = {}
    for f in range(5):
        rows, loud = [], True
        for _ in range([9000, 6000, 5200, 40, 1][f]):
            if r.random() < [0.02, 0.002, 0.2, 0.1, 0][f]:
                loud = not loud
            rms = r.choice([0.03, 0.05, 0.3]) if loud or f == 1 and r.random() < 0.9 else r.choice([0.001, 0.01, 0.02])
            rows.append((r.choice([200, 511]) if r.random() < 0.02 else 512, rms))
        files[f] = rows
    rows = [(f, k + 3, n, rms) for f, x in files.items() for k, (n, rms) in enumerate(x)]
    df = spark.createDataFrame(rows, "file_id long, frame_no long, n_samples int, rms double").repartition(5).cache()
    want = sorted((f, *map(lambda v: round(v, 6), p[:2]), p[2]) for f, x in files.items() for p in _PlainCuts(mode).run(x))
    for seconds in (41.0, 100.0, 600.0):
        got = cuts.segment(df, mode, seconds).collect()
        assert sorted((g.file_id, round(g.t_start, 6), round(g.t_end, 6), g.n_frames) for g in got) == want
    assert len(want) > 50 and {f for f, *_ in want} >= {0, 1, 2}


def test_gold_files_and_vector_hooks(spark, tmp_path):
    """Gold documents, and the hooks for recognisers and voice models with plain rules behind them."""
    import pandas as pd

    gold = {"transcript": "hello there", "events": ["one"], "entities": [], "threads": None, "summary_facts": ["a fact"]}
    (tmp_path / "s1.json").write_text(json.dumps(gold, indent=1))
    (tmp_path / "s2.json").write_text("{}")
    got = {r.file.rsplit("/", 1)[1]: r for r in documents.read_gold(spark, str(tmp_path)).collect()}
    assert (got["s1.json"].transcript, got["s1.json"].events, got["s1.json"].summary_facts) == ("hello there", ["one"], ["a fact"])
    assert got["s1.json"].threads is None and got["s2.json"].transcript is None

    df = spark.createDataFrame([(1, 2.0, [0.5, -0.5]), (2, 3.0, [1.0])], "segment_id long, t_start double, samples array<float>").cache()
    doubled = infer.map_vectors(df, lambda s: pd.Series([[2 * v for v in x] for x in s]), "samples").collect()
    assert {r.segment_id: r.embedding for r in doubled} == {1: [1.0, -1.0], 2: [2.0]}
    stub = {r.segment_id: r.e for r in df.select("segment_id", infer.stub_embedding(F.col("samples")).alias("e")).collect()}
    assert all(len(v) == infer.STUB_DIM and abs(sum(x * x for x in v) - 1) < 1e-4 for v in stub.values()) and stub[1] != stub[2]

    class Recogniser:
        def transcribe(self, samples, t_start):
            return [(f"w{k}", t_start + k, t_start + k + 1, 0.5) for k in range(len(samples))]

    words = sorted((r.segment_id, r.text, r.t_start, r.prob) for r in infer.transcribe(df, Recogniser).collect())
    assert words == [(1, "w0", 2.0, 0.5), (1, "w1", 3.0, 0.5), (2, "w0", 3.0, 0.5)]


def _joins(df):
    """Names of the joins in the plan, whatever the sizes of small tables suggest."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {k for k in ("SortMergeJoin", "BroadcastHashJoin", "BroadcastNestedLoopJoin") if k in plan}


def test_hours_are_not_broadcast(spark):
    """A session of many hours looks small to the planner, which would send all its hours to the driver."""
    s = make(spark, "sessions", [(i, 1, "live", "2026-01-01 00:00:00", None) for i in range(3)], ["id", "channel_id", "status", "started_at", "ended_at"])
    runs = spark.createDataFrame([(1, 0, "live"), (2, 5, "other")], "session_id long, hour_index long, run_label string")
    due = timeline.due_hours(s, runs, stamp("2026-01-01 05:30:00"))
    assert _joins(due) == {"SortMergeJoin"}
    assert sorted((r.session_id, r.hour) for r in due.collect()) == [(s, h) for s in range(3) for h in range(5) if (s, h) != (1, 0)]
    timed = spark.createDataFrame([(1, 1, 3), (1, 0, 3), (2, 4, 1)], "session_id long, hour long, importance int")
    hours = spark.createDataFrame([(1, 1), (2, 4)], "session_id long, hour long")
    shown = timeline.notable(timed, hours)
    assert _joins(shown) == {"SortMergeJoin"} and [tuple(r) for r in shown.collect()] == [(1, 1, 3)]
    told = last_before(hours, hours.withColumn("x", F.col("hour") * 2), ["session_id"], ["hour"], 2, id_block("hour"))
    assert "SortMergeJoin" in _joins(told)


def test_further_sources_of_any_length(spark):
    """Rows far longer than a bucket, points, reversed and missing times, against all pairs."""
    r = random.Random(9)
    def span(k):
        a = r.choice([0.0, r.random() * 50, r.random() * 1e6])
        return a, None if k == 7 else a + r.choice([0.0, 0.01, 5.0, 3000.0, 1e6, -4.0])

    w = [(k, k % 3, *span(k)) for k in range(60)]
    n = [(k % 3, k, *span(k), f"n{k}") for k in range(60)]
    want = set()
    for k, s, a, b in w:
        hits = [(x, i, text) for t, i, x, y, text in n if t == s and None not in (b, y) and x < b and (y > a or x == y == a)]
        want |= {(k, seq, text) for seq, (_, _, text) in enumerate(sorted(hits), 1)}
    wins = spark.createDataFrame(w, "window_id long, session_id long, t_start double, t_end double")
    notes = spark.createDataFrame(n, "session_id long, id long, t_start double, t_end double, text string")
    for seconds in (1e-3, 10.0, 300.0):
        got = context.extra(wins, notes, seconds)
        assert {tuple(x) for x in got.collect()} == want and len(want) > 100
    assert _joins(got) == {"SortMergeJoin"}


def test_names_of_many_owners(spark):
    """A name that a whole channel shares gives each text its first owners alone; the cast is that of all owners."""
    r = random.Random(11)
    ents = [(k, k % 2, "person", r.choice(["Al", "Bo Rand", "Cy", "Di"]), "confirmed", r.choice([None, 1, 5, 9]), False) for k in range(300)]
    ents += [(k, k % 2, "person", "Di", "confirmed", 7, False) for k in (4, 5, 4)]
    entities = make(spark, "entities", ents, ENT).withColumn("last_seen_at", F.when(F.col("id") % 7 < 5, F.timestamp_seconds(F.col("id") % 7)))
    aliases = spark.createDataFrame([(k, "Ed") for k in range(0, 300, 3)], "entity_id long, alias string")
    texts = {k: " and ".join(r.sample(["al", "BO RAND", "cy", "di", "ed", "fay"], r.randrange(4))) for k in range(40)}
    w = spark.createDataFrame([(k, k % 2, t) for k, t in texts.items()], "window_id long, channel_id long, text string")
    hosts = make(spark, "channels", [(1, "one", '{"streamer":{"entity_id":21}}'), (0, "two", None)], ["id", "login", "config_json"])
    stored = [(e.id, e.channel_id, e.canonical_name.lower(), e.mention_count, e.last_seen_at) for e in entities.collect()]
    want = set()
    for k, t in texts.items():
        said = t.lower().split(" and ")
        called = {i for i, c, name, _, _ in stored if name in said or ("ed" in said and i < 300 and i % 3 == 0)}
        rows = sorted((1 if (i, k % 2) == (21, 1) else 2 if i in called else 3, at is None, -(at.timestamp() if at else 0), n is None, -(n or 0), i)
                      for i, c, _, n, at in stored if c == k % 2)
        want |= {(k, row[-1], row[0], rank) for rank, row in enumerate(rows[:12], 1)}
    got = context.cast(w, entities, aliases, hosts)
    assert {(x.window_id, x.id, x.tier, x["rank"]) for x in got.collect()} == want
    own = [(1, i, "Al", i % 50) for i in range(2000)] + [(1, 9000 + i, "Bo", 100) for i in range(3)]
    names = spark.createDataFrame(own, "g long, who long, name string, best long")
    said = spark.createDataFrame([(1, 1, "al, bo"), (1, 2, "al"), (1, 3, "")], "g long, k long, text string")
    first = mentions.mentions(names, said, ["g"], "who", "k", "text", "best", 4)
    assert sorted((x.k, x.who) for x in first.collect()) == [(1, 49), (1, 9000), (1, 9001), (1, 9002), (2, 49), (2, 99), (2, 149), (2, 199)]


def test_matches_follow_the_loop(spark, monkeypatch):
    """Shared and repeated names, ties, displacement across names and an item under two names, against the loop; the pairs of
    equal names are never formed, so no table of the rounds grows with their product."""
    r = random.Random(4)
    words = ["Kael Vane", "Kael Vance", "Vane Kael", "Kael Vanes", "Mira Sol", "Mira Sole", "Kal Vane"]
    gold = [(s, k, r.choice(words)) for s in range(3) for k in range(60)] + [(1, 5, "Mira Sol"), (1, 5, "Mira Sol"), (1, 6, "Kael Vane")]
    pred = [(s, k, r.choice(words)) for s in range(3) for k in range(50)] + [(2, 3, "Mira Sole"), (0, 4, "Kal Vane")]
    score = lambda a, b: fuzzy.token_set_ratio(" ".join(sorted(set(a.lower().split()))), " ".join(sorted(set(b.lower().split()))))
    want = {}
    for s in range(3):
        taken = set()
        for k in sorted({g for t, g, _ in gold if t == s}):
            names = [x for t, g, x in gold if (t, g) == (s, k)]
            fits = sorted((-score(x, y), n) for x in names for t, n, y in pred if t == s and n not in taken and score(x, y) >= 80.0)
            if fits:
                taken.add(fits[0][1])
        want[s] = len(taken)
    table = lambda rows: spark.createDataFrame(rows, "session_id long, no long, text string").repartition(3)
    sizes = []
    monkeypatch.setattr(evaluation, "written", lambda df: sizes.append((t := written(df)).count()) or t)
    assert {x.session_id: x.matched for x in evaluation.matches(table(pred), table(gold), 80.0).collect()} == want
    sizes.clear()
    many = lambda n, f: table([(1, k, "Kael Vane" if k % 2 else "Kael Vanes") for k in range(0, n * f, f)])
    assert evaluation.matches(many(600, 1), many(500, 3), 85.0).first().matched == 500 and max(sizes) <= 2000


def test_matches_take_one_pass(spark, monkeypatch):
    """Displacement across many names, ties, blank and missing values: as the loop, and without rounds over the items."""
    r = random.Random(8)
    words = [f"{a} {b}" for a in ("Kael", "Kaela", "Mira", "Mirat") for b in ("Vane", "Vance", "Vale", "Sol")]
    gold = [(s, k, r.choice(words)) for s in range(2) for k in range(200)] + [(None, 1, "Kael Vane"), (0, None, "Kael Vane"), (0, 900, "  "), (0, 901, None)]
    pred = [(s, k, r.choice(words)) for s in range(2) for k in range(150)] + [(None, 1, "Kael Vane"), (0, None, "Kael Vane"), (0, 900, ""), (0, 901, None), (0, 7, "Mirat Sol")]
    score = functools.cache(lambda a, b: fuzzy.token_set_ratio(*(" ".join(sorted(x.lower().split())) for x in (a, b))))
    want = {}
    for s in range(2):
        taken = set()
        for k in range(200):
            names = [x for t, g, x in gold if (t, g) == (s, k)]
            fits = sorted((-score(x, y), n) for x in names for t, n, y in pred if t == s and n is not None and y and n not in taken and score(x, y) >= 72.0)
            if fits:
                taken.add(fits[0][1])
        want[s] = len(taken)
    passes = []
    monkeypatch.setattr(evaluation, "fold_sorted", lambda *a: passes.append(a) or folds.fold_sorted(*a))
    table = lambda rows: spark.createDataFrame(rows, "session_id long, no long, text string").repartition(3)
    assert {x.session_id: x.matched for x in evaluation.matches(table(pred), table(gold), 72.0).collect()} == want
    assert len(passes) == 1


def test_windows_that_share_few_bigrams_are_passed_over():
    """The best window is that of all windows, and texts of other words are settled without trying any."""
    r = random.Random(2)
    for _ in range(400):
        long = "".join(r.choice("abc é") for _ in range(r.randrange(1, 40)))
        short = "".join(r.choice("abc é") if r.random() < 0.15 else x for x in long[r.randrange(len(long)):][:r.randrange(1, 14)])
        n = len(short)
        cut = [long[max(0, end - n):end] for end in range(1, len(long) + n)]
        scores = [200 * fuzzy.lcs_length(short, x) / (n + len(x)) for x in cut]
        for floor in (50.0, 80.0):
            best = max(scores, default=0.0)
            assert fuzzy._best_window(short, long, floor) == pytest.approx(best if best >= floor else 0.0)
    assert len(fuzzy._ends("abcdefghij", "jihgfedcba" * 50, 80.0)) == 0


def test_drift_sends_no_vectors_to_the_driver(spark):
    """The tables of centroids meet by merging."""
    voices = spark.createDataFrame([(1, [1.0, 0.0])], "speaker_id long, embedding array<float>")
    moved = spark.createDataFrame([(1, float(k), k, [0.0, 1.0]) for k in range(9)], "speaker_id long, t_start double, segment_id long, embedding array<float>")
    assert "SortMergeJoin" in _joins(speakers.drift(moved, voices, 4, 2))


def test_drift_replays_runs_of_growing_length(spark, monkeypatch):
    """Vectors that never let a centroid forget need rounds by the logarithm of the chunks, and no table is broadcast."""
    rnd = np.random.default_rng(7)
    c, rows = np.eye(32)[0], []
    for k in range(600):
        v = np.round(rnd.normal(size=32) * 0.1, 4)
        rows.append((1, float(k), k, v.tolist()))
        raw = 0.9 * c + 0.1 * v
        c = raw / np.linalg.norm(raw)
    voices = spark.createDataFrame([(1, np.eye(32)[0].tolist())], "speaker_id long, embedding array<float>")
    moved = spark.createDataFrame(rows, "speaker_id long, t_start double, segment_id long, embedding array<double>").repartition(3)
    tables = []
    monkeypatch.setattr(speakers, "written", lambda df: tables.append(df) or written(df))
    got = speakers.drift(moved, voices, 4, 2).first()
    assert got.updates == 600 and np.allclose(got.embedding, c, atol=1e-5)
    assert len(tables) <= 3 + 2 * 9


def test_look_back_moves_rows_once(spark):
    """One join of small carried rows, whatever the buckets; missing keys and times never meet, repeated ones do."""
    r = random.Random(3)
    asked = [(r.choice([0, 1, 2, None]), r.choice([None, *range(120)]), i) for i in range(200)]
    given = [(r.choice([0, 1, 2, None]), t, r.choice([None, f"w{t}"])) for t in r.sample(range(120), 70)]
    told = last_before(
        spark.createDataFrame(asked, "k long, t int, x long"), spark.createDataFrame(given, "k long, t long, w string"), ["k"], ["t"], 3, id_block("t", 7))
    assert told._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    found = collections.defaultdict(list)
    for row in sorted(told.collect(), key=lambda row: row.back):
        found[row.k, row.t, row.x].append((row.back, row.w))
    for k, t, x in asked:
        want = [] if k is None or t is None else [w for _, w in sorted(((b, w) for a, b, w in given if a == k and b < t), key=lambda z: -z[0])[:3]]
        assert found[k, t, x] == [*enumerate(want, 1)]


def test_look_back_for_the_sessions_asked(spark):
    s = make(spark, "sessions", [(i, i % 3, f"2026-01-{i + 1:02d} 00:00:00", f"told {i}" if i % 2 else None) for i in range(20)], ["id", "channel_id", "started_at", "final_summary"])
    asked = spark.createDataFrame([(19,), (19,), (10,), (None,), (77,)], "session_id long")
    for step in (context.previous, context.dormancy_cutoff):
        every = [tuple(r) for r in step(s).collect() if r.session_id in (10, 19)]
        assert every and sorted(map(repr, every)) == sorted(repr(tuple(r)) for r in step(s, asked=asked).collect())


def test_documents_are_parsed_once(spark, monkeypatch):
    """Neither checks nor filters repeat the parsing or each other, and every answer of a model is settled parsed."""
    df = spark.createDataFrame([(1, '{"window_summary": "a"}'), (2, "broken"), (3, None), (4, '{"events": [{"type": "plot"}]}')], "id long, raw string")
    parsed = documents.parse_extraction(df)
    good, bad = guards.validate(parsed)
    for side in (good, bad):
        plan = side._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1 and plan.count("array_compact(") + plan.count("filter(array(CASE WHEN") <= 1
    assert [one(good, "id"), sorted(one(bad, "id"))] == [[1], [2, 3, 4]] and parsed.columns == ["id", "raw", "extraction"]
    again = documents.parse_extraction(parsed)
    assert again.columns == parsed.columns and one(again, "id") == [1, 2, 3, 4]
    seen, settle = [], infer.settled
    monkeypatch.setattr(infer, "settled", lambda d: seen.append(d.columns) or settle(d))
    got = infer.extract_with_repair(spark.createDataFrame([(1, "p")], "id long, prompt string"))
    assert one(got, "status") == ["done"] and len(seen) == 3 and all("extraction" in c for c in seen)


def test_recap_state_is_settled_before_it_is_split(spark):
    """The branches, of which three tables are made, are worked out once."""
    s = make(spark, "sessions", [(1, 1), (2, 1)], ["id", "channel_id"])
    e = make(spark, "events", [(1, 1, 20.0, "plot", "an event", 3), (2, 2, 20.0, "plot", "an event", 3)], ["id", "session_id", "t_start", "type", "description", "importance"])
    sums = make(spark, "summaries", [(5, 1, "recap", "before", "1:")], ["id", "session_id", "kind", "text", "cache_key"])
    empty = lambda name, *fields: make(spark, name, [], list(fields))
    names = spark.createDataFrame([], "channel_id long, speaker string, name string")
    answers, _ = recap.recap(
        s, empty("windows", "id", "session_id", "cost_usd", "created_at"), e, empty("threads", "id", "channel_id", "title", "status"), sums,
        empty("summary_feedback", "id", "session_id", "kind", "vote"), names, stamp("2026-01-01 00:00:00"))
    assert _joins(answers) == set() and sorted((r.session_id, r.branch) for r in answers.collect()) == [(1, "cached"), (2, "fresh")]
