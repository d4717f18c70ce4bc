"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A short item inside a long document has a tiny Jaccard similarity to it, so whole-document sketches miss it. Here the
sketch is taken of the item alone: items are partitioned by size, and each keeps its shingles of smallest hash (a
bottom-k MinHash). A document that holds at least 80 % of an item's n shingles misses at most 0.2 n of them, so with
k = floor(0.2 n) + 1 it must hold at least one of the sketch; a size class takes the k of its largest size. The search
therefore loses nothing. Only the pairs it gives are verified, by the exact number of shared shingles.

Items of fewer than five words form the classes of their own lengths: their one shingle is all their words, which a
document holds if they follow each other anywhere in it.

Documents are read once. A bitmap of fixed size over the hashes of all item shingles lets through the few shingles that
can belong to an item; those alone leave the document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recapflow.llm import common

N = 5
PERCENT = 80
#: The bitmap has 2 ** BITMAP_BITS bits (128 KB), whatever the number of items.
BITMAP_BITS = 20


def _windows(w: Column, n: int) -> Column:
    """Starts of the windows of ``n`` words of a word array."""
    return F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))


def _hash_at(w: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(w, i + k) for k in range(n)])


def _text_at(w: Column, i: Column, n: int) -> Column:
    return F.array_join(F.slice(w, i + 1, n), " ")


def _own(text: str) -> Column:
    """Digest of a text, by which rows that share an id are told apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def item_shingles(items: DataFrame, id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, which, n, length, shingle, h, sketched) per distinct shingle of each item; ``which`` is the digest of the
    item's text and ``length`` the words of its shingles. Rows of equal id and text are one item, rows that share
    only the id (NULL included) are several; items without words have no shingles."""
    def cut(w: Column) -> Column:
        out = F.transform(_windows(w, N), lambda i: F.struct(F.lit(N).alias("length"), _text_at(w, i, N).alias("shingle"), _hash_at(w, i, N).alias("h")))
        for n in range(1, N):
            out = F.when(F.size(w) == n, F.array(F.struct(F.lit(n).alias("length"), F.array_join(w, " ").alias("shingle"), _hash_at(w, F.lit(0), n).alias("h")))).otherwise(out)
        return out

    made = common.let(common.words(common.ascii_lower(F.col(text))), cut)
    one = items.select(F.col(id).alias("item"), _own(text).alias("which"), F.explode_outer(made).alias("s")).where("s IS NOT NULL").select("item", "which", "s.*").distinct()
    sets = one.groupBy("item", "which", "length").agg(F.array_sort(F.collect_set(F.struct("h", "shingle"))).alias("s"))
    n = F.size("s")
    largest = F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double"))))
    k = F.least(n, F.floor(largest * (100 - PERCENT) / 100).cast("int") + 1)
    return sets.select("item", "which", "length", n.alias("n"), k.alias("k"), F.posexplode("s").alias("at", "x")).select(
        "item", "which", "length", "n", "x.shingle", "x.h", (F.col("at") < F.col("k")).alias("sketched"),
    )


def _bitmap(shingles: DataFrame) -> Column:
    """Bit per leading hash bits, as an array of 2 ** (BITMAP_BITS - 6) longs."""
    slot = F.shiftrightunsigned("h", 64 - BITMAP_BITS)
    words_ = shingles.select(F.shiftright(slot, 6).cast("int").alias("at"), slot.bitwiseAND(63).cast("int").alias("bit")).distinct()
    set_bits = words_.groupBy("at").agg(F.collect_set("bit").alias("bits")).collect()  # at most 2 ** (BITMAP_BITS - 6) rows
    longs = [0] * (1 << (BITMAP_BITS - 6))
    for r in set_bits:
        v = sum(1 << b for b in r["bits"])
        longs[r["at"]] = v - (1 << 64) if v >> 63 else v
    return F.lit(np.array(longs, dtype="int64"))  # one literal; an expression would be evaluated per shingle


def _document_hits(docs: DataFrame, keep: list[Column], text: str, bitmap: Column, lengths: list[int]) -> DataFrame:
    """The ``keep`` columns and ``hits``, the distinct shingles of each text that the bitmap lets through, of the texts
    that have any."""
    def known(h: Column) -> Column:
        slot = F.shiftrightunsigned(h, 64 - BITMAP_BITS)
        return F.bit_get(F.get(bitmap, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(63).cast("int")) == 1

    def of_length(w: Column, n: int) -> Column:
        at = F.filter(_windows(w, n), lambda i: known(_hash_at(w, i, n)))
        return F.transform(at, lambda i: _text_at(w, i, n))

    def hits(w: Column) -> Column:
        return F.array_distinct(F.concat(F.array().cast("array<string>"), *[of_length(w, n) for n in lengths]))

    found = common.let(common.words(common.ascii_lower(F.col(text))), hits)
    return common.computed(docs.select(*keep, found.alias("hits"))).where(F.size("hits") > 0)


def candidates(hits: DataFrame, shingles: DataFrame) -> DataFrame:
    """Pairs (doc, own, item, which) of a document and an item of whose sketch it holds a shingle."""
    sketch = shingles.where("sketched").select("item", "which", "shingle")
    met = common.join_small(hits.select("doc", "own", F.explode("hits").alias("shingle")), sketch, ["shingle"], sketch.count(), F.col("own"))
    return met.select("doc", "own", "item", "which").distinct()


def search(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Pairs (id, item_id, n_item_shingles, n_shared, containment) with containment of at least 80 %, with the digests
    ``own`` of the document's and ``which`` of the item's text.

    Words are compared in ASCII lower case. Items of fewer than five words are one shingle and are found wherever their
    words follow each other. NULL, empty and blank texts hold nothing and are found nowhere; rows that repeat an id and
    text, on either side, give one pair, rows that share only the id (NULL included) are judged each for itself. An
    empty side gives an empty result."""
    shingles = common.settled(item_shingles(items, item_id, item_text))
    lengths = sorted(r["length"] for r in shingles.select("length").distinct().collect())  # at most N rows
    found = _document_hits(docs, [F.col(id).alias("doc"), _own(text).alias("own")], text, _bitmap(shingles), lengths)
    hits = common.settled(found.groupBy("doc", "own").agg(F.first("hits").alias("hits")))
    whole = shingles.groupBy("item", "which").agg(F.first("n").alias("n"), F.collect_list("shingle").alias("shingles"))
    same = F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("own") == F.col("__own"))
    pairs = candidates(hits, shingles).join(hits.select(F.col("doc").alias("__doc"), F.col("own").alias("__own"), "hits"), same)
    # broadcast by the number of shingles, whose five words bound a row, and not by the number of items
    met = common.join_small(pairs, whole, ["item", "which"], shingles.count(), F.col("own"))
    shared = F.size(F.array_intersect("hits", "shingles"))
    counts = common.computed(met.select("doc", "own", "item", "which", "n", shared.alias("n_shared")))
    return counts.where(100 * F.col("n_shared") >= PERCENT * F.col("n")).select(
        F.col("doc").alias(id), F.col("item").alias(item_id), F.col("n").cast("bigint").alias("n_item_shingles"),
        F.col("n_shared").cast("bigint").alias("n_shared"), F.round(F.col("n_shared") / F.col("n"), 6).alias("containment"), "own", "which",
    )


def keep_clean(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without a leak, with all their columns; NULL ids are kept or dropped by their own text."""
    leaks = search(docs, items, id, text).select(F.col(id).alias("__doc"), F.col("own").alias("__own")).distinct()
    row = docs.select(F.struct("*").alias("row"), F.col(id).alias("__id"), _own(text).alias("__text"))
    same = F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__text") == F.col("__own"))
    return row.join(leaks, same, "left_anti").select("row.*")
