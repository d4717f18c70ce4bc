"""The pipeline against plain versions of its stages, each judged on its own input."""

import collections

import brute
import pytest
from brute import SCHEMA

import corpus_pipeline
from recapflow.llm import quality_rules


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    extra = [(300 + k, brute.prose(300 + k, 90) + (" " + ITEM if k % 4 == 0 else ""), "en", "a" if k % 3 else "b", 1) for k in range(40)]
    spark.createDataFrame([*rows, *extra], SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, "short one"), (3, None)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


ITEM = brute.prose(4242, 25)


def test_stages_match_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, folder)
        after = [tuple(r) for r in out.collect()]
        if name != "sharding":
            assert out.columns == docs.columns
        if name == "quality_rules":
            kept = {(r["doc_id"], r["n_words"]) for r in quality_rules.score(docs).where("kept").collect()}
            want = collections.Counter(r for r in before if (r[0], len(brute.words(r[1]))) in kept)
            assert collections.Counter(after) == want and 0 < len(after) < len(before)
        if name == "near_duplicates":
            found, tops = brute.components(before)
            assert len(after) == len(set(tops)) and collections.Counter(r[0] for r in after) == collections.Counter(
                {t: c for t, (_, c) in zip(tops, found, strict=True)}.values()
            )
        if name == "decontamination":
            bad = {x[0] for x in brute.leaks(before, [(1, ITEM), (2, "short one"), (3, None)])}
            assert collections.Counter(after) == collections.Counter(r for k, r in enumerate(before) if k not in bad) and bad
        if name == "mixing":
            copies, *_ = brute.mix(before)
            want = collections.Counter()
            for r, c in zip(before, copies, strict=True):
                want[r] += c
            assert collections.Counter(after) == +want
        if name == "sharding":
            assert collections.Counter(r[0] for r in after) == collections.Counter(r[0] for r in before)
            by = collections.defaultdict(list)
            for r in out.collect():
                by[r["shard"]].append(r["slot"])
            assert all(sorted(v) == list(range(len(v))) for v in by.values())
            return
        out.write.parquet(f"{folder}/stage-{k}")
        docs = spark.read.parquet(f"{folder}/stage-{k}")


def test_run_gives_the_same(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    got = corpus_pipeline.run(spark, folder).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r["doc_id"] for r in docs.collect())


def test_stages_on_empty_and_wide_tables(spark, folder, none, wide):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
        assert stage(spark, wide, folder).count() > 0


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
