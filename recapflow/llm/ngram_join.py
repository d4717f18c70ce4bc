"""N-gram Jaccard join as a blocked sparse matrix product.

Documents are rows and 5-word shingles columns of a 0/1 matrix ``A``; overlaps of pairs are entries of ``A * A'``. The
product is never formed whole:

* Rows with equal sets become one row (a class). Copies need no pairs.
* A row can only have a partner if enough of its low-hash columns also occur in other rows (bounds that follow from its
  size alone). Rows below the bound go before any pair is formed.
* The remaining matrix is cut into row blocks and column ranges to count how often each column occurs. Columns in
  ascending order of that count, a row meets each partner in one of its first ``n - ceil(0.8 n) + 1`` columns, so only
  these are multiplied.
* Columns of up to ``RARE`` rows are multiplied as pairs: overlap counts are accumulated per pair, and pairs whose
  count and remaining sizes cannot reach 80 % are discarded; the others are compared exactly.
* Rows that meet in a more frequent column are multiplied block by block: a task holds two blocks of bounded size,
  blocks of sizes too far apart are skipped, and a task returns a spanning forest of its links, not all of them.

Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recapflow.functions.groups import connected
from recapflow.llm import common

N = 5
#: Columns that occur in more rows than this are multiplied in blocks of up to BLOCK rows.
RARE, BLOCK = 32, 512
#: Entries that one group of a column range holds, and rows of a row block.
RANGE_ENTRIES, ROW_BLOCK = 250_000, 512
_CACHED_WORDS = 400_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_WORD_HASH: dict[bytes, int] = {}


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; a text of fewer words is one shingle, none has none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not w:
        return np.empty(0, np.uint64)
    if len(_WORD_HASH) > _CACHED_WORDS:
        _WORD_HASH.clear()
    for x in set(w).difference(_WORD_HASH):
        _WORD_HASH[x] = xxhash.xxh3_64_intdigest(x)
    at = np.fromiter(map(_WORD_HASH.__getitem__, w), np.uint64, len(w))
    n = max(1, len(at) - N + 1)
    h = np.full(n, min(len(at), N), np.uint64)
    for k in range(min(N, len(at))):
        h ^= at[k:k + n] * _MIX[k]
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def least_overlap(n):
    """Shingles a partner must share with a set of n: ceil(0.8 n)."""
    return (4 * n + 4) // 5


def _sketch_length(n: int) -> int:
    return n - int(least_overlap(n)) + n // 10 + 1


def _u64(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


def _sets(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, own, n, key, sketch) per row; own is a hash of the text, key identifies the set, sketch holds its lowest
    hashes where the task meets the set for the first time."""
    schema = T.StructType([
        T.StructField("id", docs.schema[id].dataType), T.StructField("own", T.LongType()), T.StructField("n", T.LongType()), T.StructField("key", T.LongType()),
        T.StructField("sketch", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for b in batches:
            n, keys, sketches = [], [], []
            for t in b.column(1):
                s = shingles(t.as_py())
                key = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)
                n.append(len(s))
                keys.append(key)
                sketches.append(None if key in met or not len(s) else s[:_sketch_length(len(s))].tobytes())
                if len(met) > 1_000_000:
                    met.clear()
                met.add(key)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(sketches, pa.binary())], names=schema.names,
            )

    own = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("own")
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text"), own).mapInArrow(run, schema)


def _by_range(at: np.ndarray, ranges: int) -> Iterator[tuple[int, slice]]:
    """Pieces of sorted hashes by leading bits; ``ranges`` is a power of two."""
    cut = np.searchsorted(at, np.arange(1, ranges, dtype=np.uint64) << np.uint64(64 - ranges.bit_length() + 1))
    ends = [0, *cut.tolist(), len(at)]
    return ((r, slice(a, b)) for r, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if a < b)


def _ranges(entries: int) -> int:
    return 1 << max(8, int(np.ceil(np.log2(max(1, entries / RANGE_ENTRIES)))))


def _with_partners(sketched: DataFrame, ranges: int) -> DataFrame:
    """(key, shared): how many sketch hashes of each set occur in other sets.

    A task settles hashes that several of its own sets hold by itself and sends one entry for them, so that a hash of
    very many sets travels once per batch."""
    bits = "r int, h binary, k binary, c binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            sets = [_u64(x) for x in first.values()]
            h = np.concatenate([*sets, np.empty(0, np.uint64)])
            k = np.repeat(np.array(list(first), np.int64), [len(s) for s in sets])
            order = np.argsort(h, kind="stable")
            h, k = h[order], k[order]
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
            size = np.diff(np.r_[starts, len(h)])
            own, own_n = np.unique(k[np.repeat(size > 1, size)], return_counts=True)
            h, k, many = h[starts], k[starts], (size > 1).astype(np.uint8)
            out = [(r, h[p].tobytes(), k[p].tobytes(), many[p].tobytes()) for r, p in _by_range(h, ranges)]
            if len(own):
                out.append((int(own[0]) % ranges, None, own.tobytes(), own_n.astype(np.int64).tobytes()))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["r", "h", "k", "c"])

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        done, sent = rows[rows["h"].isna()], rows[rows["h"].notna()]
        keys = [np.frombuffer(x, np.int64) for x in done["k"]]
        counts = [np.frombuffer(x, np.int64) for x in done["c"]]
        if len(sent):
            h, k = _u64(b"".join(sent["h"])), np.frombuffer(b"".join(sent["k"]), np.int64)
            many = np.frombuffer(b"".join(sent["c"]), np.uint8)
            order = np.lexsort((many, k, h))
            h, k, many = h[order], k[order], many[order]
            again = np.r_[False, (h[1:] == h[:-1]) & (k[1:] == k[:-1])]  # a set that two tasks met
            start = np.r_[True, h[1:] != h[:-1]]
            group = np.cumsum(start) - 1
            n = np.bincount(group, weights=~again) + np.bincount(group, weights=many)
            hit, hits = np.unique(k[(n[group] > 1) & ~again & (many == 0)], return_counts=True)
            keys.append(hit)
            counts.append(hits)
        return pd.DataFrame({"key": np.concatenate([*keys, np.empty(0, np.int64)]), "shared": np.concatenate([*counts, np.empty(0, np.int64)])})

    sent = sketched.select("key", "sketch").where("sketch IS NOT NULL").mapInArrow(send, bits)
    return sent.groupBy("r").applyInPandas(count, "key bigint, shared bigint").groupBy("key").agg(F.sum("shared").alias("shared"))


def _members(docs: DataFrame, chosen: DataFrame, id: str, text: str) -> DataFrame:
    """(key, n, cols): the full sets of the chosen (id, key)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(1)]
            own = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets]
            keep = [i for i, (a, k) in enumerate(zip(own, b.column(0).to_pylist(), strict=True)) if a == k]
            yield pa.RecordBatch.from_arrays(
                [pa.array([own[i] for i in keep], pa.int64()), pa.array([len(sets[i]) for i in keep], pa.int64()), pa.array([sets[i].tobytes() for i in keep], pa.binary())],
                names=["key", "n", "cols"],
            )

    wanted = chosen.select(F.col("id").alias("__id"), F.col("key"))
    if chosen.count() <= common.SMALL_ROWS:
        wanted = F.broadcast(wanted)
    met = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(wanted, F.col("id").eqNullSafe(F.col("__id")))
    return met.select("key", "text").mapInArrow(run, "key bigint, n bigint, cols binary").groupBy("key", "n").agg(F.min("cols").alias("cols"))


def _ordered(members: DataFrame, rows: int) -> DataFrame:
    """(key, n, cols, first, df): of each set the columns that other sets have too, and those of its prefix in
    ascending order of their counts with these counts. Sets whose prefix has no such column have no partner and go."""
    blocks = max(16, -(-rows // ROW_BLOCK))
    blocked = common.settled(members.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")))
    entries = blocked.agg(F.sum("n")).first()[0] or 0
    ranges = _ranges(entries)

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        h, n = np.unique(_u64(b"".join(rows["cols"])), return_counts=True)
        block = int(rows["block"].iloc[0])
        out = [(r, block, h[p].tobytes(), n[p].astype(np.int64).tobytes()) for r, p in _by_range(h, ranges)]
        return pd.DataFrame(out, columns=["r", "block", "h", "c"])

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [_u64(x) for x in rows["h"]]
        h, at = np.unique(np.concatenate(parts), return_inverse=True)
        n = np.bincount(at, weights=np.frombuffer(b"".join(rows["c"]), np.int64)).astype(np.int64)
        out, place = [], 0
        for block, part in zip(rows["block"], parts, strict=True):
            own = n[at[place:place + len(part)]]
            place += len(part)
            if (own > 1).any():
                out.append((block, part[own > 1].tobytes(), own[own > 1].tobytes()))
        return pd.DataFrame(out, columns=["block", "h", "c"])

    def order(rows: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        h, df = _u64(b"".join(back["h"])), np.frombuffer(b"".join(back["c"]), np.int64)
        by = np.argsort(h)
        h, df = h[by], df[by]
        out = []
        for key, n, blob in zip(rows["key"], rows["n"], rows["cols"], strict=True):
            s = _u64(blob)
            at = np.searchsorted(h, s)
            known = at < len(h)
            known[known] = h[at[known]] == s[known]
            s, at = s[known], at[known]
            room = n - int(least_overlap(n)) + 1 - (n - len(s))
            if room > 0 and len(s):
                first = np.lexsort((s, df[at]))[:room]
                out.append((key, n, s.tobytes(), s[first].tobytes(), df[at][first].tobytes()))
        return pd.DataFrame(out, columns=["key", "n", "cols", "first", "df"])

    counts = blocked.groupBy("block").applyInPandas(count, "r int, block int, h binary, c binary")
    back = counts.groupBy("r").applyInPandas(total, "block int, h binary, c binary")
    out = blocked.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(order, "key bigint, n bigint, cols binary, first binary, df binary")
    return common.settled(out)


def _postings(rows: DataFrame) -> DataFrame:
    """(h, df, key, n, shared, place) per prefix column of each set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, n, shared, first, df = (b.column(i).to_pylist() for i in range(5))
            size = [len(x) // 8 for x in first]
            place = np.concatenate([np.arange(s) for s in size] + [np.empty(0, np.int64)]) + np.repeat(np.array(n, np.int64) - np.array(shared, np.int64), size)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.frombuffer(b"".join(first), np.int64)), pa.array(np.frombuffer(b"".join(df), np.int64)),
                *[pa.array(np.repeat(np.array(x, np.int64), size)) for x in (key, n, shared)], pa.array(place.astype(np.int64)),
            ], names=["h", "df", "key", "n", "shared", "place"])

    shared = (F.length("cols") / 8).cast("bigint").alias("shared")
    return rows.select("key", "n", shared, "first", "df").mapInArrow(run, "h bigint, df bigint, key bigint, n bigint, shared bigint, place bigint")


def _required(a, b):
    """Overlap that sizes a and b need: the least o with 100 o >= 80 (a + b - o)."""
    return -(-4 * (a + b) // 9)


def _rare_pairs(postings: DataFrame, entries: int) -> DataFrame:
    """Pairs (a, b) that meet in a rare column and that the bounds leave."""
    groups = max(64, entries // 20_000)

    def multiply(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "key"], kind="stable")
        h = rows["h"].to_numpy()
        key, n, shared, place = (rows[c].to_numpy() for c in ("key", "n", "shared", "place"))
        cut = np.r_[np.flatnonzero(np.r_[True, h[1:] != h[:-1]]), len(h)]
        size = np.diff(cut)
        left, right = [], []
        for m in np.unique(size[size > 1]):
            start = cut[:-1][size == m]
            i, j = np.triu_indices(m, 1)
            left.append((start[:, None] + i).ravel())
            right.append((start[:, None] + j).ravel())
        a, b = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (left, right))
        need = _required(n[a], n[b])
        ok = (np.minimum(n[a], n[b]) >= least_overlap(np.maximum(n[a], n[b]))) & (np.minimum(shared[a], shared[b]) >= need)
        a, b = a[ok], b[ok]
        met = pd.DataFrame({"a": key[a], "b": key[b], "na": n[a], "nb": n[b], "ia": place[a], "ib": place[b]})
        return met.groupby(["a", "b", "na", "nb"], as_index=False).agg(met=("ia", "size"), ia=("ia", "max"), ib=("ib", "max"))

    dealt = postings.where(F.col("df") <= RARE).withColumn("r", F.pmod(F.xxhash64("h"), F.lit(groups)).cast("int"))
    schema = "a bigint, b bigint, na bigint, nb bigint, met bigint, ia bigint, ib bigint"
    sums = dealt.groupBy("r").applyInPandas(multiply, schema).groupBy("a", "b", "na", "nb").agg(
        F.sum("met").alias("met"), F.max("ia").alias("ia"), F.max("ib").alias("ib"),
    )
    # all common columns up to the last one met here are counted; those after it are bounded by what is left of each set
    most = F.col("met") + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) - 1
    return sums.where(9 * most >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")


def _compare(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs that are links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            a, b, na, nb, x, y = (t.column(i).to_pylist() for i in range(6))
            keep = [i for i in range(len(a)) if len(np.intersect1d(_u64(x[i]), _u64(y[i]), assume_unique=True)) >= _required(na[i], nb[i])]
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for i in keep], pa.int64()) for v in (a, b)], names=["a", "b"])

    side = lambda k: rows.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("cols").alias(f"c{k}"))
    met = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "ca", "cb")
    return met.mapInArrow(run, "a bigint, b bigint")


def _forest(a: np.ndarray, b: np.ndarray, linked: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Links that span the components of a bipartite (or, with ``same``, one-sided) link matrix."""
    at = np.arange(len(a) + (0 if same else len(b)))
    shift, out = 0 if same else len(a), []

    def top(v: int) -> int:
        while at[v] != v:
            at[v] = at[at[v]]
            v = at[v]
        return v

    for i in range(len(a)):
        for j in np.flatnonzero(linked[i]):
            p, q = top(i), top(j + shift)
            if p != q:
                at[max(p, q)] = min(p, q)
                out.append((int(a[i]), int(b[j])))
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Overlap counts of two blocks of rows, a range of columns at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    sides = [np.concatenate([*s, np.empty(0, np.uint64)]) for s in (left, right)]
    common_cols = np.intersect1d(*[np.unique(s) for s in sides], assume_unique=True)
    at = []
    for s, flat in zip((left, right), sides, strict=True):
        row = np.repeat(np.arange(len(s)), [len(x) for x in s])
        col = np.searchsorted(common_cols, flat)
        known = col < len(common_cols)
        known[known] = common_cols[col[known]] == flat[known]
        order = np.argsort(col[known], kind="stable")
        at.append((row[known][order], col[known][order]))
    for c in range(0, len(common_cols), width):
        dense = []
        for (row, col), s in zip(at, (left, right), strict=True):
            a, b = np.searchsorted(col, [c, c + width])
            part = np.zeros((len(s), min(width, len(common_cols) - c)), np.float32)
            part[row[a:b], col[a:b] - c] = 1
            dense.append(part)
        out += dense[0] @ dense[1].T
    return out


def _block_links(postings: DataFrame, rows: DataFrame) -> DataFrame:
    """Links between rows that meet in a frequent column."""
    often = common.settled(postings.where(F.col("df") > RARE).select("h", "key"))
    hubs = common.settled(often.groupBy("h").agg(F.min("key").alias("hub")))
    star = common.join_small(often, hubs, ["h"], hubs.count(), F.col("key")).select(F.col("hub").alias("a"), F.col("key").alias("b"))
    group = connected(star)
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int")  # partners are at most one class apart
    placed = common.settled(rows.join(group.withColumnRenamed("node", "key"), "key").select("key", "n", "cols", "root", size_class.alias("s")))
    count = placed.groupBy("root", "s").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = lambda by, name: count.select("root", (F.col("s") + by).alias("s"), F.col("blocks").alias(name))
    around = common.settled(count.join(blocks(1, "below"), ["root", "s"], "left").join(blocks(-1, "above"), ["root", "s"], "left"))
    known = common.join_small(placed, around, ["root", "s"], around.count(), F.col("key")).withColumn("j", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    each = lambda n, f: F.when(F.coalesce(n, F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array())
    task = lambda s, i, t, j, side: F.struct(s.alias("s"), i.alias("i"), t.alias("t"), j.alias("j"), F.lit(side).alias("side"))
    s, j = F.col("s"), F.col("j")
    tasks = F.concat(
        each(F.col("blocks"), lambda o: task(s, F.least(j, o), s, F.greatest(j, o), 0).withField("side", F.when(j <= o, 0).otherwise(1))),
        each(F.col("above"), lambda o: task(s, j, s + 1, o, 0)),
        each(F.col("below"), lambda o: task(s - 1, o, s, j, 1)),
    )
    sent = known.select("root", "key", "n", "cols", F.explode(tasks).alias("task")).select("root", "key", "n", "cols", "task.*")

    def multiply(part: pd.DataFrame) -> pd.DataFrame:
        x = part.iloc[0]
        same = x["s"] == x["t"] and x["i"] == x["j"]
        sides = [part, part] if same else [part[part["side"] == k] for k in (0, 1)]
        if not all(len(p) for p in sides):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        keys, n = [p["key"].to_numpy() for p in sides], [p["n"].to_numpy() for p in sides]
        sets = [[_u64(c) for c in p["cols"]] for p in sides]
        linked = overlaps(*sets) >= _required(n[0][:, None], n[1][None, :])
        if same:
            linked = np.triu(linked, 1)
        return pd.DataFrame(_forest(keys[0], keys[1], linked, same), columns=["a", "b"]).astype("int64")

    return sent.groupBy("root", "s", "i", "t", "j").applyInPandas(multiply, "a bigint, b bigint")


def groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, key (equal for equal sets) and component (the smallest id its links reach).

    NULL, empty and blank texts have no shingles, are linked with nothing and are their own component. Rows that repeat
    an id or a text are listed each; NULL ids are ignored in the smallest id, which is NULL only if all are. An empty
    table gives an empty table."""
    sets = common.settled(_sets(docs, id, text))
    sized = sets.where("n > 0")
    classes = sized.groupBy("key", "n").agg(
        F.min("id").alias("id"), F.count("*").alias("copies"),
    )
    entries = sets.agg(F.sum(F.length("sketch"))).first()[0] or 0
    shared = _with_partners(sets, _ranges(entries // 8))
    # a set with a partner shares so many of its sketch hashes at least; the partner may have 0.8 n only
    chosen = common.settled(classes.join(shared, "key").where(F.col("shared") >= F.floor(F.floor((4 * F.col("n") + 4) / 5) / 10) + 1).select("id", "key"))
    rows = chosen.count()
    table = _ordered(_members(docs, chosen, id, text), rows)
    postings = common.settled(_postings(table))
    rare = _compare(_rare_pairs(postings, postings.count()), table)
    links = common.settled(rare.union(_block_links(postings, table)))
    roots = connected(links).withColumnRenamed("node", "key")
    grouped = classes.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    smallest = roots.join(classes, "key").groupBy("root").agg(F.min("id").alias("smallest"))
    # only sets with copies or links need a look-up; any other document is its own component
    named = common.settled(
        grouped.join(smallest, "root", "left").select("key", F.coalesce("smallest", "id").alias("component"), "root", "copies")
        .join(roots.select("key", F.lit(True).alias("linked")), "key", "left").where("copies > 1 OR linked").drop("copies", "linked")
    )
    out = common.join_small(sets.drop("sketch"), named, ["key"], named.count(), F.xxhash64("id"), "left")
    return out.select(
        F.col("id").alias(id), "own", F.col("n").alias("n_shingles"), "key", F.coalesce("root", "key").alias("root"),
        F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"),
    )


def join(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, component_id per document; see ``groups``."""
    return groups(docs, id, text).select(id, "n_shingles", F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group with all its columns: one with the smallest id. Documents without words all stay;
    rows that repeat an id and text are one document. A group without any id keeps one document, too."""
    found = groups(docs, id, text)
    named = lambda c: F.xxhash64(c.isNull(), c).alias("__id")
    leaders = found.where("n_shingles > 0").where(F.col(id).eqNullSafe(F.col("component")))
    leaders = leaders.groupBy("root").agg(F.min(F.struct(named(F.col(id)), F.col("own").alias("__own"))).alias("x")).select("x.*")
    wanted = leaders.union(found.where("n_shingles = 0").select(named(F.col(id)), "own").distinct())
    row = docs.select(F.struct("*").alias("row"), named(F.col(id)), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__own"))
    nth = F.row_number().over(Window.partitionBy("__id", "__own").orderBy(F.lit(0)))
    return row.join(wanted, ["__id", "__own"]).withColumn("nth", nth).where("nth = 1").select("row.*")
