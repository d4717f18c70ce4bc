"""Decontamination, mixing, sharding, quality rules and chat formatting."""

import collections
import math
import random

import brute
import pytest
from brute import SCHEMA, prose
from pyspark.sql import functions as F

from recapflow.llm import chat, decontaminate, mixing, quality_rules, sharding

def items(spark, rows):
    picks = [(1, rows[5][1]), (2, " ".join((rows[9][1] or "").split()[:30])), (3, "one"), (4, None), (5, ""), (6, prose(3, 60)), (6, rows[7][1]), (6, rows[5][1]), (None, rows[5][1]),
             (7, " ".join(prose(2003, 40).split()[5:25])), (8, "never seen in any of these documents at all"), (10, " ".join(rows[5][1].split()[3:6])), (10, " ".join(rows[5][1].split()[3:6])), (11, "Two wordsneverseen")]
    return spark.createDataFrame(picks, "item_id bigint, text string"), picks


def test_leaks_match_brute_force(spark, rows, wide, joins):
    df, picks = items(spark, rows)
    got = collections.Counter(tuple(r)[:4] for r in decontaminate.search(wide, df).collect())
    pairs = {((rows[d][:2], picks[i]), n, k) for d, i, n, k in brute.leaks(rows, picks)}
    want = collections.Counter((x[0][0], x[1][0], n, k) for x, n, k in pairs)
    assert got == want and len(want) >= 8 and any(r[1] == 10 for r in want)


def test_short_items_inside_documents(spark):
    docs = spark.createDataFrame([(1, "so What  is\nDNA? it asked"), (2, "what is dna?x"), (3, "DNA?"), (4, "what is"), (5, "a what is dna?")], "doc_id int, text string")
    df = spark.createDataFrame([(1, "What is DNA?"), (2, "dna?"), (3, "so what is dna? it")], "item_id int, text string")
    got = {(r[0], r[1]) for r in decontaminate.search(docs, df).collect()}
    assert got == {(1, 1), (5, 1), (1, 2), (3, 2), (5, 2), (1, 3)}
    assert [r[0] for r in decontaminate.keep_clean(docs, df).orderBy("doc_id").collect()] == [2, 4]


def test_items_of_one_id_are_judged_apart(spark):
    a, b = prose(71, 30), prose(72, 30)
    docs = spark.createDataFrame([(1, f"x {a} y"), (2, f"{b} {a}"), (3, prose(73, 30))], "doc_id int, text string")
    for id in (5, None):
        df = spark.createDataFrame([(id, a), (id, b), (id, b)], "item_id int, text string")
        got = collections.Counter((r[0], r[1]) for r in decontaminate.search(docs, df).collect())
        assert got == {(1, id): 1, (2, id): 2}


def test_sketch_makes_the_pairs(spark):
    """Documents that share two shingles with an item are candidates only if one of them is sketched."""
    item = prose(91, 60).split()
    texts = [" ".join(item)] + [" ".join(item[k:k + 6]) for k in range(54)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    shingles = decontaminate.item_shingles(spark.createDataFrame([(1, " ".join(item))], "item_id int, text string")).cache()
    keep = [F.col("doc_id").alias("doc"), decontaminate._own("text").alias("own")]
    hits = decontaminate._document_hits(docs, keep, "text", decontaminate._bitmap(shingles), [5])
    pairs = {r["doc"] for r in decontaminate.candidates(hits, shingles).collect()}
    sketched = {r["shingle"] for r in shingles.where("sketched").collect()}
    assert pairs == {k for k, t in enumerate(texts) if {" ".join(x) for x in brute.shingles(t)} & sketched} and 0 in pairs and len(pairs) < len(texts)


def test_sketch_can_not_miss(spark):
    """Whichever fifth of an item is missing, one of its sketched shingles is left."""
    df = spark.createDataFrame([(k, prose(k, 6 + k)) for k in range(40)], "item_id bigint, text string")
    by = collections.defaultdict(list)
    for r in decontaminate.item_shingles(df).collect():
        by[r["item"]].append(r["sketched"])
    for s in by.values():
        assert sum(s) > len(s) - math.ceil(0.8 * len(s))


def test_clean_documents_stay(spark, rows, wide):
    df, picks = items(spark, rows)
    kept = decontaminate.keep_clean(wide, df)
    assert kept.columns == wide.columns
    bad = {x[0] for x in brute.leaks(rows, picks)}
    assert collections.Counter((r[0], r[1]) for r in kept.collect()) == collections.Counter((r[0], r[1]) for k, r in enumerate(rows) if k not in bad)


def test_decontamination_of_empty_tables(spark, docs, none):
    no_items = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.search(none, no_items).count() == 0
    assert decontaminate.search(docs, no_items).count() == 0
    assert decontaminate.keep_clean(docs, no_items).count() == docs.count()


def test_mix_matches_sorting(rows, wide, joins):
    copies, size, total, goal = brute.mix(rows)
    want = collections.Counter((r[0], r[3], n, total[r[3]], round(goal[r[3]], 3), c * n) for r, n, c in zip(rows, size, copies, strict=True))
    got = collections.Counter((r["doc_id"], r["source"], r["size"], r["source_size"], round(r["target"], 3), r["taken"]) for r in mixing.mix(wide).collect())
    assert got == want


def test_mixed_rows_and_nesting(rows, wide, none):
    copies, *_ = brute.mix(rows)
    out = mixing.materialise(wide)
    assert out.columns == wide.columns
    want = collections.Counter()
    for r, c in zip(rows, copies, strict=True):
        want[(r[0], r[1])] += c
    assert collections.Counter((r[0], r[1]) for r in out.collect()) == +want
    assert mixing.mix(none).count() == 0 and mixing.materialise(none).count() == 0


def test_targets_fill_up(spark):
    for seed in range(6):
        r = random.Random(seed)
        sizes = {f"s{k}": r.choice([0, 1, 10, 1000, 100_000]) for k in range(r.randrange(1, 9))} | {None: 5}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        want = brute.targets(sizes)
        assert {r["source"]: pytest.approx(want[r["source"]]) for r in mixing.targets(df).collect()} == {k: pytest.approx(v) for k, v in want.items()} or all(
            r["target"] == pytest.approx(want[r["source"]]) for r in mixing.targets(df).collect()
        )


def test_shards_are_exact_and_gapless(rows, wide):
    got = sharding.assign(wide, shards=7, blocks=16, pieces=3).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert sorted(by) == list(range(7)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    import zlib

    want = collections.Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_shards_do_not_depend_on_partitions(docs, none):
    one = lambda df: sorted(map(tuple, sharding.assign(df, shards=5).collect()), key=repr)
    assert one(docs) == one(docs.repartition(3, "text")) and one(none) == []


def test_few_rows_in_many_shards(spark):
    got = sharding.assign(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")).collect()
    assert [(r["shard"], r["slot"]) for r in got] and all(r["slot"] == 0 for r in got) and {r["shard"] for r in got} == {0, 1}


def test_written_shards(spark, wide, rows, tmp_path):
    sharding.write_shards(wide, f"file://{tmp_path}/s", shards=4)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert back.count() == len(rows) and back.select("shard_no", "slot_no").distinct().count() == len(rows)


def test_hypergeometric_law():
    """Frequencies against the exact probabilities, and the support."""
    rng = random.Random(3)
    for good, bad, n in ((5, 7, 4), (30, 2, 20), (0, 5, 3), (6, 0, 4), (400, 600, 50)):
        seen = collections.Counter(sharding.hypergeometric(rng, good, bad, n) for _ in range(6000))
        for k in range(max(0, n - bad), min(n, good) + 1):
            p = math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n)
            assert abs(seen[k] / 6000 - p) < 5 * math.sqrt(p * (1 - p) / 6000) + 1e-9, (good, bad, n, k)
        assert sum(seen.values()) == 6000


def test_matrix_sums():
    rng = random.Random(1)
    rows, cols = [5, 0, 900, 31], [300, 0, 636]
    m = sharding.matrix(rng, rows, cols)
    assert [sum(x) for x in m] == rows and [sum(x) for x in zip(*m, strict=True)] == cols


def test_places_are_uniform(spark):
    """Over seeds, a given row is in every shard about equally often."""
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    seen = collections.Counter()
    for seed in range(12):
        seen.update(r["shard"] for r in sharding.assign(df, shards=4, seed=seed, blocks=4, pieces=2).where("doc_id < 10").collect())
    assert sum(seen.values()) == 120 and all(12 <= seen[s] <= 50 for s in range(4))


def test_copies_of_a_row_are_shuffled(spark):
    """Copies land in one shard, and next to each other, about as often as any two rows of the table do."""
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    by = collections.defaultdict(list)
    for r in sharding.assign(df, shards=4, blocks=4, pieces=2).collect():
        by[r["doc_id"]].append((r["shard"], r["slot"]))
    together = [(a, b) for a, b in by.values() if a[0] == b[0]]
    assert len(by) == 2000 and 400 <= len(together) <= 600
    assert sum(abs(a[1] - b[1]) == 1 for a, b in together) <= 8


def test_equal_rows_beyond_a_run(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    df = spark.range(45).select(F.lit(None).cast("bigint").alias("doc_id"), F.when(F.col("id") < 43, "x").alias("text"))
    got = sharding.assign(df, shards=4, blocks=4, pieces=2).collect()
    assert collections.Counter(r["size"] for r in got) == {9: 43, 8: 2} and len({(r["shard"], r["slot"]) for r in got}) == 45
    assert len({r["shard"] for r in got if r["size"] == 9}) == 4


def test_quality_counts_and_posteriors(rows, wide):
    got = quality_rules.score(wide).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert collections.Counter((r["doc_id"], *[r[n] for n in names]) for r in got) == collections.Counter((r[0], *brute.base_counts(r[1])) for r in rows)
    votes = [tuple(r[f"vote_{k}"] for k in quality_rules.RULES) for r in got]
    for r, p in zip(got, brute.em(votes), strict=True):
        assert r["p_quality"] == pytest.approx(p, abs=2e-6)
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and p >= 0.5)


def test_quality_keeps_prose(spark, sf, wide, none):
    kept = quality_rules.keep(wide)
    assert kept.columns == wide.columns
    want = collections.Counter(r["doc_id"] for r in quality_rules.score(wide).where("kept").collect())
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == want
    assert quality_rules.score(none).count() == 0 and quality_rules.keep(none).count() == 0
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_rules.score(docs).where("NOT base_failed").join(labels, "doc_id").select("kept", "quality").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in judged) >= 0.93 * len(judged)


def test_quality_keeps_prose_of_any_language(spark):
    """Prose in capitals, in any language and script stays, whatever share of the corpus it is; runs of symbols go."""
    r = random.Random(8)
    made = lambda common_, n: " ".join(r.choice(common_) if r.random() < 0.4 else "".join(r.choices("bdgklmprst", k=6)) for _ in range(n))
    polish, rare = "w nie się że jest jak ale".split(), "ne hogy nem egy és".split()
    rows = [(k, made("the and of to in is".split(), 100), "en") for k in range(200)]
    rows += [(1000 + k, made("the and of to in is".split(), 100).upper(), "en") for k in range(10)]
    rows += [(2000 + k, made(polish, 100), "pl") for k in range(30)] + [(3000 + k, made(rare, 100), "hu") for k in range(3)]
    rows += [(4000 + k, made(["###", "$$", "zzzzzzzzzzzzzzzz"], 100), "en" if k % 5 else "pl") for k in range(20)]
    rows += [(5000 + k, made(polish, 100), None) for k in range(3)]
    rows += [(6000 + k, made("и в не на что с по".split(), 100).replace("b", "б").replace("k", "к"), "ru") for k in range(2)]
    rows += [(7000, " ".join(["यह", "एक", "वाक्य", "है।"] + [f"शब्द{'क' * k}" for k in range(60)]), "hi")]
    for part in (rows, [x for x in rows if x[0] < 1005 or x[0] >= 3000]):  # the same verdict in another corpus
        df = spark.createDataFrame(part, "doc_id bigint, text string, lang string")
        want = {x[0] for x in part if not 4000 <= x[0] < 5000}
        assert {x["doc_id"] for x in quality_rules.keep(df).collect()} == want
        assert {x["doc_id"] for x in quality_rules.score(df).where("kept").collect()} == want


def test_odd_words_match_plain_count(spark):
    texts = ["plain words", "x### 12 --- a|b | it's e-mail", "", None, "Ünï, «ça» 你好。 ١٢", "a@b.c C++ _x_ 3rd"]
    got = quality_rules.features(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), [F.col("doc_id")]).collect()
    odd = lambda x: not any(c.isalpha() for c in x) or any(c in "#$%&*+<=>@\\^_`{|}~" for c in x)
    assert {r["doc_id"]: r["__n_odd"] for r in got} == {k: sum(map(odd, brute.words(t))) for k, t in enumerate(texts)}


def test_trees(spark):
    rows = []
    r = random.Random(2)
    for conv in (1, 2, None):
        for m in range(30):
            rows.append((conv, m, r.randrange(m) if m and r.random() < 0.95 else None, r.choice(["user", "assistant"]), f"t{m}", r.choice([None, 0.0, 1.0, 2.5])))
    rows += [(9, k, k - 1 if k else None, "user", str(k), 1.0) for k in range(37)]  # a long chain
    rows += [(8, 1, 2, "user", "a", 1.0), (8, 2, 1, "user", "b", 1.0), (8, 3, 2, "user", "c", 1.0), (8, 4, 99, "user", "parent is missing", 1.0)]
    rows += [(7, 1, None, "user", "twice", 1.0), (7, 1, None, "user", "again", 1.0)]
    df = spark.createDataFrame(rows, "conv bigint, msg bigint, parent bigint, role string, text string, score double")
    got = collections.defaultdict(list)
    for x in sorted(chat.branches(df, 2).collect(), key=lambda x: x["depth"]):
        got[(x["conv"], x["branch"])].append(x["text"])
    by = {}
    for x in sorted(rows, key=lambda x: x[4]):
        by.setdefault((x[0], x[1]), x)
    want = {}
    for conv in {x[0] for x in rows}:
        mine = {m: x for (c, m), x in by.items() if c == conv}
        paths = []
        for leaf in mine:
            if any(x[2] == leaf for x in mine.values()):
                continue
            path, at = [], leaf
            while at is not None and at in mine and at not in path:
                path.append(at)
                at = mine[at][2]
            if at in path:
                continue
            score = sum(mine[m][5] or 0.0 for m in path) / len(path)
            paths.append((-score, -len(path), leaf, [mine[m][4] for m in path[::-1]]))
        for k, p in enumerate(sorted(paths)[:2]):
            want[(conv, k + 1)] = p[3]
    assert dict(got) == want


def test_control_strings_come_back(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x", "<", "|", "<<|", "", None, "a\nb", "<|nl|>", "ü<|😀|>", "<\\\\\\|<|"]
    rows = [(k, t, "assistant" if t_ % 2 else "user\n<|x|>", x) for k in range(2) for t_, (t, x) in enumerate(enumerate(texts))]
    rows += [(None, 1, None, "x"), (None, None, "assistant", "y"), (5, 1, "assistant", "x"), (5, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("score", F.lit("clash"))
    made = chat.format(chat.linear(df))
    back = {r["conv"]: r for r in chat.read(made).collect()}
    for conv in (0, 1):
        assert [(t["role"], t["text"]) for t in back[conv]["turns"]] == [(r, t or "") for c, _, r, t in rows if c == conv]
        assert [x for x in back[conv]["losses"]] == [(t or "") if r == "assistant" else "" for c, _, r, t in rows if c == conv]
        text = back[conv]["formatted"]
        assert text.count("<|im_start|>") == text.count("<|im_end|>") == len(texts)
    assert [t["text"] for t in back[None]["turns"]] == ["y", "x"] and len(back[5]["turns"]) == 2
    assert chat.digests(chat.format(chat.linear(df.limit(0)))).count() == 0


def test_schema_is_the_one_of_documents(spark, sf):
    assert [f.name for f in spark.read.parquet(f"{sf}/documents.parquet").schema] == [x.split()[0] for x in SCHEMA.split(", ")]
