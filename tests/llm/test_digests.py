"""Line dedup, the Merkle manifest and vector codes against plain versions."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from brute import SCHEMA
from pyspark.sql import functions as F

from recapflow.llm import line_dedup, merkle, queries, vector_codes

SPACE = " \t\n\x0b\x0c\r"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def first(x):
    """NULL is before every id."""
    return (x is not None, x or 0)


def line_key(line):
    return lower(line.strip(SPACE))


def deduped(rows, min_chars=20, min_docs=3):
    holders = collections.defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(line_key(line)) >= min_chars:
                holders[line_key(line)].add(r[0])
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        gone = [len(holders[line_key(x)]) >= min_docs and r[0] != max(holders[line_key(x)], key=first) if len(line_key(x)) >= min_chars else False for x in lines]
        out.append((r[0], len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return collections.Counter(out)


def line_rows(n=300, seed=4):
    r = random.Random(seed)
    common = [f"Shared passage number {k} of all the documents" for k in range(12)] + ["  Ärger mit ÜBERLANGEN Zeilen und Umlauten\t", "ſhort s and K sign lines are no ASCII K"]
    rows = []
    for k in range(n):
        lines = [r.choice(common) if r.random() < 0.5 else f"own line {k} {j} " + "x" * r.randrange(25) for j in range(r.randrange(9))]
        lines = [x.upper() if r.random() < 0.1 else x + " " * r.randrange(3) for x in lines]
        if k % 3 == 0:
            lines.append("the line that every third document ends with")
        rows.append((k, "\n".join(lines), "en", "a", 1))
    rows += [(None, "the line that every third document ends with", None, None, None), (None, rows[0][1], "en", "b", 1), rows[3], rows[3], (3, rows[6][1], "de", "b", 2)]
    rows += [(900, None, "en", "a", 0), (901, "", "en", "a", 0), (902, "\n\n", "en", "a", 2), (903, "x" * 19 + "\n" + "y" * 20, "en", "a", 0)]
    rows += [(k, "y" * 20 + "\n" + "x" * 19, "en", "a", 0) for k in (904, 905)]
    return rows + [(910, "\n".join(f"line {j % 5000} of one very long document" for j in range(20_000)), "en", "a", 0)]


@pytest.mark.parametrize("piece_rows", [1000, 10])
def test_lines_match_plain_version(spark, monkeypatch, piece_rows):
    """With and without cut hash ranges; a line of a third of all documents is cut into pieces when these are small."""
    monkeypatch.setattr(line_dedup, "PIECE_ROWS", piece_rows)
    rows = line_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    wide = docs.withColumns({n: F.lit(1) for n in "id version pos range piece key line h1 h2 nth bits row gone n_docs __id __text __version".split()})
    got = line_dedup.kept(wide)
    assert collections.Counter((r.row.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == deduped(rows)
    if piece_rows == 10:
        assert line_dedup._large_ranges(line_dedup.occurrences(docs)).count() > 0
        assert line_dedup.apply(wide).columns == wide.columns


def test_lines_bounds_and_empty_tables(spark, none):
    rows = line_rows(60, 9)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = line_dedup.kept(docs, min_chars=25, min_docs=5)
    assert collections.Counter((r.row.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == deduped(rows, 25, 5)
    applied = line_dedup.apply(docs)
    assert [r.text for r in applied.where("doc_id = 900").collect()] == [None]
    assert line_dedup.apply(none).collect() == [] and line_dedup.kept(none).collect() == []


def test_bitmaps_are_sparse(spark):
    rows = [(k, "\n".join(f"{k} {j} a line of its own in this text" for j in range(300)) + "\na line that all of these texts share", "en", "a", 1) for k in range(4)]
    got = line_dedup.bitmaps(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.id for r in got) == [0, 1, 2]
    assert all([(b.word, b.drop) for b in r.bits] == [(300 // 64, 1 << (300 % 64))] for r in got)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def climb(leaves):
    """Levels of a tree, leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[k:k + 16])) for k in range(0, len(now), 16)])
    return levels


def proof(levels, pos):
    out = []
    for level in levels[:-1]:
        start = pos - pos % 16
        run = level[start:start + 16]
        out.append((pos % 16, "".join(run[:pos % 16] + run[pos % 16 + 1:])))
        pos //= 16
    return out


def manifest(rows):
    cells = collections.defaultdict(list)
    for d, t, lang, source, n in rows:
        cells[source].append((first(d), leaf((d, source, lang, n, t)), d))
    order = sorted(cells, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[1] for x in sorted(cells[s])]) for s in order}
    crown = climb([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for pos, (_, digest, d) in enumerate(sorted(cells[s])):
            out.append((d, s, digest, trees[s][-1][0], crown[-1][0], tuple(proof(trees[s], pos) + proof(crown, k))))
    return collections.Counter(out)


def docs_of(sizes, seed=1):
    r = random.Random(seed)
    rows = [(k * 7 % 100_003, f"Text {k} " + "é" * r.randrange(3), r.choice(["en", None]), s, r.choice([1, None])) for s, n in sizes.items() for k in range(n)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("heights", [1, 2, 3])
def test_manifest_matches_plain_version(spark, monkeypatch, heights):
    """Trees of one leaf, of whole and of broken runs, one of which holds most rows; NULLs, ties and equal rows."""
    from recapflow.llm import common

    monkeypatch.setattr(merkle, "HEIGHTS", heights)
    monkeypatch.setattr(common, "SMALL_ROWS", 100_000 if heights == 3 else 0)
    rows = docs_of({"a": 1, "b": 16, "c": 17, None: 4100, "Z": 257, "é": 2, "ﬁ": 1, "𝄞": 1, **{f"s{k}": 1 for k in range(20)}})
    rows += [(None, None, None, None, None), (None, "no id", "en", "b", 1), rows[0], rows[0], (rows[0][0], "other text", "en", rows[0][3], 2), (5, "", "en", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    wide = docs.withColumns({n: F.lit(1) for n in "id tree pos size left row proof leaf root __id __leaf".split()})
    got = merkle.manifest(wide, FIELDS, also={"same": F.col("text"), "folded": F.lit(1)})
    found = got.withColumn("back", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    assert collections.Counter((r.doc_id, r.source, r.leaf, r.subroot, r.root, tuple((x.place, x.siblings) for x in r.proof)) for r in found) == manifest(rows)
    assert all(r.back == r.root for r in found)


def test_manifest_of_few_rows(spark, none):
    assert merkle.manifest(none, FIELDS).collect() == []
    one = [(1, "only", "en", "a", 4)]
    got = merkle.manifest(spark.createDataFrame(one, SCHEMA), FIELDS).first()
    assert (got.leaf, got.subroot, got.root, got.proof) == (leaf((1, "a", "en", 4, "only")),) * 3 + ([],)
    two = [(1, "x", "en", "b", 1), (2, "y", "en", "a", 1)]
    assert {r.root for r in merkle.manifest(spark.createDataFrame(two, SCHEMA), FIELDS).collect()} == {sha(leaf((2, "a", "en", 1, "y")) + leaf((1, "b", "en", 1, "x")))}


def test_tampering_is_found(spark, tmp_path):
    rows = [(k, "Capitals" if k % 2 else "small", "en", "a", 1) for k in range(40)] + [(40, None, "en", "a", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    import zlib

    for r in queries.QUERIES["op12_merkle_manifest"](spark, str(tmp_path)).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 5 != 0 or r.doc_id % 2 == 0 or r.doc_id == 40)


def compressed(rows):
    kept = [(i, [math.floor(1024 * x) for x in v], b) for i, v, b in rows if v is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return collections.Counter()
    size = len(kept[0][1])
    width = -(-size // 4)
    kept = [(i, v + [0] * (4 * width - size), b) for i, v, b in kept if len(v) == size]
    part = lambda v, p: v[p * width:(p + 1) * width]
    books = [[part(v, p) for _, v, _ in kept[:256]] for p in range(4)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(4):
        for p in range(4):
            groups = collections.defaultdict(list)
            for _, v, _ in kept:
                groups[near(part(v, p), books[p])[1]].append(part(v, p))
            for e, vs in groups.items():
                books[p][e] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, [near(part(v, p), books[p]) for p in range(4)], b) for i, v, b in kept]
    total = collections.Counter()
    for _, n, b in found:
        total[b] += sum(x[0] for x in n)
    digest = sha(",".join(str(x) for book in books for c in book for x in c))
    return collections.Counter((i, "".join(f"{x[1]:02x}" for x in n), sum(x[0] for x in n), total[b], digest) for i, n, b in found)


VECTORS = "vec_id bigint, embedding array<float>, label int"


def vectors(n, size, seed=2):
    r = np.random.default_rng(seed)
    values = (r.normal(size=(n, size)) * 0.1).astype(np.float32)
    rows = [(k * 13 % 9973, [float(x) for x in v], int(r.integers(3))) for k, v in enumerate(values)]
    return rows[:-1] + [(rows[-1][0], rows[-1][1], None)]


@pytest.mark.parametrize("n, size", [(400, 8), (30, 6), (1, 4)])
def test_codes_match_plain_version(spark, n, size):
    """More and fewer vectors than entries, lengths that four divides and one that it does not."""
    rows = vectors(n, size)
    odd = [
        (-5, None, 1), (-4, [], 1), (-3, [None] * size, 1), (-2, [float("nan")] * size, 2), (-1, [0.1] * (size - 1) + [float("inf")], None),
        (10**6, [0.2] * (size + 1), 1), (None, [0.3] * size, None), rows[0], rows[0], (rows[0][0], [-1.5] * size, 1), (10**6 + 1, [12.0] * size, 0),
    ]
    df = spark.createDataFrame(rows + odd, VECTORS).repartition(5)
    wide = df.withColumns({c: F.lit(1) for c in "id row v code error n part entry at sums label_error".split()})
    got = collections.Counter(tuple(r) for r in vector_codes.compress(wide).collect())
    assert got == compressed(rows + odd)


def test_codes_of_wide_values_and_empty_tables(spark, monkeypatch):
    """Distances that need 64 bits, dictionaries of scattered values, salted joins, components beyond the bound."""
    from recapflow.llm import common

    monkeypatch.setattr(common, "SMALL_ROWS", 0)
    r = random.Random(3)
    rows = [(k, [float(np.float32(r.uniform(-9000, 9000))) for _ in range(8)], k % 2) for k in range(300)]
    got = vector_codes.compress(spark.createDataFrame(rows, VECTORS).repartition(3))
    assert collections.Counter(tuple(x) for x in got.collect()) == compressed(rows)
    huge = [(1, [3e38, -3e38, 0.0, 1.0], 1), (2, [2.0**15] * 4, 1)]
    assert [x.error for x in vector_codes.compress(spark.createDataFrame(huge, VECTORS)).collect()] == [0, 0]
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).collect() == []


def test_nearest_takes_the_lower_entry():
    books = np.array([[[1, 1], [3, 1], [1, 1]]] * 4)
    code, error = vector_codes.nearest(np.array([[2, 1] * 4, [3, 2] * 4], np.int32), books)
    assert code.tolist() == [[0] * 4, [1] * 4] and error.tolist() == [[1] * 4, [1] * 4]
