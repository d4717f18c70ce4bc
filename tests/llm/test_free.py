"""Near-duplicate groups, token counts, secrets, the quality classifier and token files."""

import base64
import collections
import hashlib
import json
import random
import re
import zlib

import brute
import numpy as np
import pytest
from brute import prose

from recapflow.functions import groups as components
from recapflow.llm import ngram_join, quality_classifier, queries, secrets, token_counts, token_files


def counted(df, *cols):
    return collections.Counter(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("rare", [0, 2, 32])
def test_groups_match_brute_force(rows, wide, joins, monkeypatch, rare):
    """All rows in blocks, some of them, and none."""
    monkeypatch.setattr(ngram_join, "RARE", rare)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    found, _ = brute.components(rows)
    want = collections.Counter((r[0], n, c) for r, (n, c) in zip(rows, found, strict=True))
    assert counted(ngram_join.join(wide), "doc_id", "n_shingles", "component_id") == want


def near_copies(seed, groups, size):
    r, out = random.Random(seed), []
    for g in range(groups):
        base = prose(seed * 100 + g, 120).split()
        for _ in range(size):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 4])):
                w[r.randrange(len(w))] = f"w{r.random()}"
            if r.random() < 0.3:
                w = w[: r.randrange(90, 120)]
            out.append(" ".join(w))
    return [(k, t) for k, t in enumerate(out)]


@pytest.mark.parametrize("rare", [3, 32])
def test_large_groups_lose_no_link(spark, monkeypatch, rare):
    monkeypatch.setattr(ngram_join, "RARE", rare)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rows = near_copies(rare, 3, 60)
    found, _ = brute.components(rows)
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6))
    assert counted(got, "doc_id", "component_id") == collections.Counter((r[0], c) for r, (_, c) in zip(rows, found, strict=True))


def test_one_of_each_group_stays(rows, wide, none):
    kept = ngram_join.keep_one(wide)
    assert kept.columns == wide.columns
    found, tops = brute.components(rows)
    got = kept.select("doc_id", "text").collect()
    assert sum(1 for r in got if not brute.words(r[1])) == len({(r[0], r[1] or "") for r in rows if not brute.words(r[1])})
    full = [r for r in got if brute.words(r[1])]
    assert len(full) == len({t for t, (n, _) in zip(tops, found, strict=True) if n})
    top = {(r[0], r[1]): t for r, t in zip(rows, tops, strict=True)}
    assert len({top[(r[0], r[1])] for r in full}) == len(full)
    low = {(r[0], r[1]): c for r, (_, c) in zip(rows, found, strict=True)}
    assert all(low[(r[0], r[1])] == r[0] for r in full)
    assert ngram_join.keep_one(none).count() == 0 and ngram_join.join(none).count() == 0


def test_overlap_counts():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 300, r.integers(0, 120)).astype(np.uint64)) for _ in range(40)]
    got = ngram_join.overlaps(sets[:25], sets[25:], width=32)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[25:]] for a in sets[:25]]


def test_components_of_chains_and_hubs(spark):
    r = random.Random(1)
    name = [r.getrandbits(60) for _ in range(400)]
    links = [(name[k], name[k + 1]) for k in range(150)] + [(name[200], name[k]) for k in range(201, 300)] + [(name[310], name[310])]
    got = components.connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    by = collections.defaultdict(set)
    for x in got:
        by[x["root"]].add(x["node"])
    assert sorted(map(sorted, by.values())) == sorted([sorted(name[:151]), sorted(name[200:300])])
    assert components.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


EDGES = ["", " ", "  a  b", "\n\t x", "日本語 テスト 😀😀 x", "▁a", "a▁b  ", "<0x41> <s> </s>", "é́", "a" * 5000, "\x00", "﷽"]


def test_token_counts_are_the_librarys(spark, sf, wide, rows, none):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = queries.tokenizer("piece_bpe_32k.model")
    model = Tokenizer(models.Unigram([("<unk>", 0.0), *token_counts.sentencepiece_vocabulary(path)], 0, True))
    model.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    n = lambda t: len(model.encode(t or "", add_special_tokens=False).ids)
    texts = [(k, t) for k, t in enumerate(EDGES)] + [(1000 + r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = token_counts.count(spark.createDataFrame(texts, "doc_id bigint, text string"), path)
    assert counted(got, "doc_id", "n_tokens") == collections.Counter((k, n(t)) for k, t in texts)
    assert counted(token_counts.count(wide, path), "doc_id", "n_chars", "n_tokens") == collections.Counter((r[0], len(r[1] or ""), n(r[1])) for r in rows)
    assert token_counts.count(none, path).count() == 0


@pytest.mark.parametrize("fallback", [True, False])
def test_ties_and_unknown_characters(fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    for seed in range(30):
        r = random.Random(seed)
        vocab = {"".join(r.choice("ab▁") for _ in range(r.randrange(1, 4))): float(-r.randrange(4)) for _ in range(8)}
        vocab = [(p, s) for p, s in vocab.items() if "▁" not in p[1:]]
        if fallback:
            vocab += [(f"<0x{i:02X}>", -9.0) for i in range(256)]
        model = Tokenizer(models.Unigram([("<unk>", -3.0), *vocab], 0, fallback))
        model.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
        mine = token_counts.Counter([("<unk>", -3.0), *vocab], fallback)
        for _ in range(40):
            t = "".join(r.choice("aab bcé") for _ in range(r.randrange(12)))
            assert mine.text(t) == len(model.encode(t, add_special_tokens=False).ids), (vocab, t)


def test_long_words_need_little_memory():
    """A text without a space equals the count of the plain tables, and takes memory for little more than itself."""
    import tracemalloc

    r = random.Random(12)
    vocab = [(c, -r.random() * 9) for c in "abc中文字\U0001f600"] + [("".join(r.choice("abc中文") for _ in range(r.randrange(2, 9))), -r.random() * 12) for _ in range(300)]
    for fallback in (True, False):
        pieces = vocab + [(f"<0x{i:02X}>", -20.0) for i in range(256)] * fallback
        mine = token_counts.Counter(pieces, fallback)
        for _ in range(40):
            word = "".join(r.choice("abc中文字dé\U0001f600x") for _ in range(r.randrange(1, 400)))
            assert mine._long(word) == mine.word(word)
    text = "".join(r.choice("abc中文d") for _ in range(1000)) * 250
    tracemalloc.start()
    assert mine.text(text) > 0 and mine.text(text + " abc") > 0
    assert tracemalloc.get_traced_memory()[1] < 8_000_000 and len(mine._known) == 1
    tracemalloc.stop()


def plain_secrets(text):
    """The base rules as they are worded."""
    out = []
    name = re.compile(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    for kind, pattern, ok in (
        ("assign", name, lambda m: len(m[1]) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ):
        at = 0
        while m := pattern.search(text, at):
            if ok(m):
                out.append((m.start(), ["assign", "access", "hex"].index(kind), f"{kind}:{m.start()}:{m.end()}"))
            at = m.end()
    return [x[2] for x in sorted(out)]


def tlv(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (len(x := n.to_bytes((n.bit_length() + 7) // 8, "big")))]) + x
    return bytes([tag]) + size + body


def keys():
    r = random.Random(4)
    number = lambda n: tlv(2, b"\x01" + r.randbytes(n))
    algorithm = tlv(0x30, tlv(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01") + tlv(5, b""))
    pkcs1 = tlv(0x30, tlv(2, b"\0") + b"".join(number(64) for _ in range(8)))
    pkcs8 = tlv(0x30, tlv(2, b"\0") + algorithm + tlv(4, pkcs1))
    sec1 = tlv(0x30, tlv(2, b"\1") + tlv(4, r.randbytes(32)) + tlv(0xA0, tlv(6, b"\x2b\x81\x04\x00\x0a")))
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(r.randbytes(51)) + field(r.randbytes(136))
    return {"pkcs1": pkcs1, "pkcs8": pkcs8, "sec1": sec1, "ssh": ssh}


def jwt(header):
    b = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    return f"{b(header)}.{b(json.dumps({'sub': 'me'}).encode())}.{b(b'0123456789abcdef')}"


def test_structure_confirms_keys():
    for name, k in keys().items():
        flat = base64.b64encode(k).decode()
        lines = "\n".join(flat[i:i + 64] for i in range(0, len(flat), 64))
        kind = "ssh_key" if name == "ssh" else "private_key"
        for body in (flat, lines):
            for text in (f"é😀 key: {body} and so on", f"-----BEGIN PRIVATE KEY-----\n{body}\n-----END PRIVATE KEY-----", f"{body}\nNext line of words"):
                found = secrets.structural_spans(text)
                assert [(text[a:b], x) for a, b, x in found] == [(body, kind)], (name, text[:60])
        dump = k.hex()
        colons = ":".join(dump[i:i + 2] for i in range(0, len(dump), 2))
        for body in (dump, dump.upper(), "\n".join(dump[i:i + 32] for i in range(0, len(dump), 32)), colons, ":\n    ".join(colons[i:i + 44] for i in range(0, len(colons), 45))):
            for before in ("x ", "0x", "key=ab", "a"):
                text = f"{before}{body} y"
                assert [(text[a:b], x) for a, b, x in secrets.structural_spans(text)] == [(body, kind)], (name, text[:60])
        broken = bytearray(k)
        broken[len(k) // 2:] = b""
        assert secrets.structural_spans("key " + base64.b64encode(bytes(broken)).decode()) == []
    assert [x[2] for x in secrets.structural_spans("t " + jwt(b'{"alg":"HS256","typ":"JWT"}') + " x")] == ["signed_token"]
    for head in (b'{"typ":"JWT"}', b'{"alg":1}', b'{"alg":"x"', b"\xff\xfe{}", b"[1]"):
        assert secrets.structural_spans(jwt(head)) == []
    assert secrets.structural_spans("MIIB" + "A" * 400 + " " + "eyJ" + "a" * 90) == []


def test_keys_in_other_wrappings():
    small = {"short sec1": tlv(0x30, tlv(2, b"\1") + tlv(4, bytes(range(32)))), "public": tlv(0x30, tlv(0x30, tlv(6, b"\x2b\x65\x70")) + tlv(3, b"\0" + bytes(range(200, 232))))}
    for name, k in (keys() | small).items():
        kind, flat = {"ssh": "ssh_key", "public": "public_key"}.get(name, "private_key"), base64.b64encode(k).decode()
        wrapped = [flat[i:i + 64] for i in range(0, len(flat), 64)]
        for end in ("\\n", "\\r\\n", "\\\\n", "\n    ", "\r\n\t", " \n  "):
            body = end.join(wrapped)
            text = f'é {{"key": "-----BEGIN PRIVATE KEY-----{end}{body}{end}-----END PRIVATE KEY-----{end}"}}'
            assert [(text[a:b], x) for a, b, x in secrets.structural_spans(text)] == [(body, kind)], (name, end)
        url = base64.urlsafe_b64encode(k).decode().rstrip("=")
        for before in ("", "x", "QUJD/", "n" * 41):
            text = f"at {before}{url} and"
            assert [(text[a:b], x) for a, b, x in secrets.structural_spans(text)] == [(url, kind)], (name, before)
    assert [x[2] for x in secrets.structural_spans(f"x {small['short sec1'].hex()} y")] == ["private_key"]
    pair = base64.b64encode(keys()["sec1"]).decode().rstrip("=") + "\n" + base64.b64encode(keys()["pkcs8"]).decode()
    assert [x[2] for x in secrets.structural_spans(pair)] == ["private_key", "private_key"]
    certificate = tlv(0x30, tlv(0x30, tlv(2, b"\1\1\1\1") + small["public"]) + tlv(0x30, tlv(6, b"\x2b\x65\x70")) + tlv(3, b"\0" * 65))
    assert secrets.structural_spans("c " + base64.b64encode(certificate).decode()) == []


def test_keys_at_any_width():
    for name, k in keys().items():
        kind, flat = "ssh_key" if name == "ssh" else "private_key", base64.b64encode(k).decode()
        for width in (16, 32, 40, 61):
            wrapped = [flat[i:i + width] for i in range(0, len(flat), width)]
            for end in ("\n", "\n# ", "\r\n * ", '" +\n    "', '\\n"\n  + "', "' \\\n '", '" "', "\n> "):
                body = end.join(wrapped)
                text = f"# 'é {{ \"{body}\" }}"
                assert [(text[a:b], x) for a, b, x in secrets.structural_spans(text)] == [(body, kind)], (name, width, end)


def test_structures_that_are_no_keys():
    """Signatures, digests, certificates' parts and random structures, in base64 and hex."""
    r = random.Random(8)
    number = lambda n: tlv(2, bytes([r.randrange(1, 128)]) + r.randbytes(n - 1))
    digest = tlv(0x30, tlv(0x30, tlv(6, b"\x60\x86\x48\x01\x65\x03\x04\x02\x01") + tlv(5, b"")) + tlv(4, r.randbytes(32)))
    signatures = [tlv(0x30, number(a) + number(b)) for a, b in ((32, 32), (33, 32), (20, 20), (48, 48), (66, 66), (66, 65))]

    def structure(depth):
        kind = r.choice([2, 4, 5, 6, 3, 0x0C, 0x13] + [0x30] * 3 * (depth > 0))
        return tlv(0x30, b"".join(structure(depth - 1) for _ in range(r.randrange(1, 5)))) if kind == 0x30 else tlv(kind, b"" if kind == 5 else r.randbytes(r.randrange(1, 60)))

    others = [tlv(0x30, b"".join(structure(3) for _ in range(r.randrange(1, 6)))) for _ in range(10_000)]
    for data in [digest, *signatures, *others]:
        assert secrets.der_kind(data) is None, data.hex()
    for data in [digest, *signatures, *others[:200]]:
        for text in (base64.b64encode(data).decode(), data.hex()):
            assert secrets.structural_spans(f"signed {text} .") == []
    modulus, exponent = tlv(2, b"\0\xc1" + r.randbytes(126) + b"\x01"), tlv(2, b"\1\0\1")
    assert secrets.der_kind(tlv(0x30, modulus + exponent)) == "public_key"
    dsa = tlv(0x30, tlv(2, b"\0") + number(128) + number(20) + number(128) + number(128) + number(20))
    assert secrets.der_kind(dsa) == "private_key"


def test_token_headers_with_white_space():
    for head in (b'{ "alg":"HS256"}', b'{\n  "alg": "none"\n}', b'{\r\n"alg":"x"}', b'{\t"alg":"x"}', b' {"alg":"x"}', b'\n{"alg":"x"}'):
        token = jwt(head)
        for text in (f"t {token} x", f"ey.{token}", f"Ceyword.other.{token}."):
            assert [text[a:b] for a, b, k in secrets.structural_spans(text) if k == "signed_token"] == [token], (head, text)


def test_secrets_match_the_wording(spark, sf, wide, rows, none):
    made = [
        "PassWord = 'abcdef'", "password: abc", "token=aaa token=bbbbbbbb", "api_key==abcdefg", "APIKEY : \"a.b-c_d/e+f=\"", "paſſword=abcdefgh", "toKen=abcdefgh",
        "AKIA" + "A" * 16, "AKIA" + "A" * 15, "AKIAAKIA" + "Z" * 12 + "a", "é" * 7 + "f" * 23, "😀" + "0123456789abcdef" * 2, "0123456789abcdef" * 2 + "G", "secret\n=abcdefg", "secret  =  'x",
        "token=" + "ab" * 20 + " AKIA" + "B" * 20, "", None,
    ]
    texts = [(k, t) for k, t in enumerate(made)] + [(1000 + r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for df, data in ((spark.createDataFrame(texts, "doc_id bigint, text string"), texts), (wide, rows)):
        want = collections.Counter()
        for r in data:
            base = plain_secrets(r[1] or "")
            n = collections.Counter(x.split(":")[0] for x in base)
            want[(r[0], n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(base))] += 1
        got = counted(secrets.scan(df), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
        assert got == want
    pem = "token = abcdefgh " + base64.b64encode(keys()["pkcs8"]).decode()
    row = secrets.scan(spark.createDataFrame([(1, pem)], "doc_id bigint, text string")).first()
    assert row["n_structural"] == 1 and row["spans"].split(",")[0] == "assign:0:16" and row["spans"].split(",")[1].startswith("private_key:17:")
    assert secrets.scan(none).count() == 0


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    shown, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    out = quality_classifier.score(docs, shown).join(held, "doc_id").select("kept", "quality").collect()
    assert len(out) > 150 and sum(r["kept"] == (r["quality"] == 1) for r in out) >= 0.95 * len(out)


def test_sparse_sites_are_shrunk(spark):
    """Equal texts: a good site's rate helps, and a site of one row says nearly what its host says."""
    good, bad = prose(1, 200), "### $$$ ||| %%% " * 60
    rows, labels = [], []
    for k in range(600):
        host = f"h{k % 6}"
        junk = k % 6 < 3 and k % 10 < 9 or k % 6 >= 3 and k % 10 == 0
        rows.append((k, bad + str(k) if junk else good + f" w{k}", f"p{k % 2}", host))
        labels.append((k, int(not junk)))
    rows += [(1000, good, "only here", "h0"), (1001, good, "only here", "h5"), (1002, good, "x", "new host")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality_classifier.score(df, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()}
    assert got[1000]["p_site"] < 0.35 and got[1001]["p_site"] > 0.65 and 0.35 < got[1002]["p_site"] < 0.65
    assert got[1000]["p_document"] == got[1001]["p_document"] == got[1002]["p_document"]
    assert got[1000]["p_quality"] < got[1002]["p_quality"] < got[1001]["p_quality"]


def test_classifier_edges(spark, wide, rows, none, joins):
    some = [(k, k % 2) for k in range(0, 60)] + [(3, None), (None, 1), (99999, 1), (5, 1), (5, 1)]
    labels = spark.createDataFrame(some, "doc_id bigint, quality int")
    assert counted(quality_classifier.score(wide, labels), "doc_id") == collections.Counter((r[0],) for r in rows)
    for none_known in (labels.limit(0), labels.where("quality = 1")):
        out = quality_classifier.score(wide, none_known).collect()
        assert len(out) == len(rows) and all(0 <= r["p_quality"] <= 1 for r in out)
    assert quality_classifier.score(none, labels).count() == 0


def test_wavelet_matrix_answers():
    r = np.random.default_rng(2)
    for ids in (r.integers(0, 50_000, 3000), r.integers(0, 3, 1000), np.array([7]), np.zeros(130, int), r.integers(0, 1 << 20, 500)):
        ids = ids.astype("<u4")
        w = token_files.WaveletMatrix.from_bytes(token_files.WaveletMatrix.build(ids).to_bytes())
        assert (w.ids() == ids).all()
        for i in r.integers(0, len(ids), 40):
            x = int(ids[i])
            assert w.access(int(i)) == x and w.rank(x, int(i)) == int((ids[:i] == x).sum())
            nth = int((ids[:i] == x).sum())
            assert w.select(x, nth) == i and w.count(x) == int((ids == x).sum())
        assert w.count(1 << 25) == 0 and w.rank(int(ids[0]), len(ids) + 5) == w.count(int(ids[0]))
        with pytest.raises(IndexError):
            w.select(int(ids[0]), w.count(int(ids[0])))


@pytest.mark.parametrize("shard_ids", [400, 1 << 20])
def test_token_files_round_trip(spark, wide, rows, none, tmp_path, joins, shard_ids):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    extra = [(500 + k, x, None, None, 0) for k, x in enumerate([*EDGES, "a<|endoftext|>b", "x\r\ny z w\x0bq", "ΟΔΟΣ ΟΔΟΣ", "don't 'Re 12 3!!"])]
    df = wide.select("doc_id", "text").union(spark.createDataFrame(extra, brute.SCHEMA).select("doc_id", "text"))
    token_files.write(df, f"file://{tmp_path}/t", path, shard_ids=shard_ids)
    got = token_files.read(spark, f"file://{tmp_path}/t").collect()
    order = sorted([*rows, *extra], key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, at, end = collections.Counter(), 0, 0
    for r in order:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want[(r[0], at, len(ids), zlib.crc32(ids.tobytes()))] += 1
        at, end = at + len(ids), end + 1
    assert collections.Counter(map(tuple, got)) == want
    ones = token_files.occurrences(spark, f"file://{tmp_path}/t", 1).agg({"n": "sum"}).first()[0]
    assert ones == end
    token_files.write(none, f"file://{tmp_path}/none", path)
    assert token_files.read(spark, f"file://{tmp_path}/none").count() == 0
