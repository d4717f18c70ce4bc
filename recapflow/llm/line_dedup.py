"""Line dedup: lines found in many documents stay in the one with the largest id; the others get keep bitmaps.

The first pass over the texts sends one row of hashes, id and position per line. These are
dealt by ranges of the hash and sorted within by key, document and position, so that one stream over a partition sees
the documents of a key one after the other and knows the first at once. Dropped positions come back as sparse bitmaps, 64 lines
to a word, words without a dropped line left out, and the second pass applies them to the texts.

The hash space is cut into 2**RANGE_BITS equal ranges. Where a key holds a large share of all lines its range is larger
than the rest; such ranges are cut into pieces, each piece streams on its own, and the few first documents of its keys
settle what the pieces have in common.

NULL and empty texts are one empty line. The rows of one id are one document, NULL is an id before all others, and a line stays in every row
with the largest id. Repeated rows and repeated lines of a document count once and are treated alike. Long texts are cut into lines inside
the task that reads them. A table without rows gives none. Only the id and text columns are looked at; others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recapflow.llm import common

MIN_CHARS = 20
MIN_DOCS = 3
RANGE_BITS = 16
#: A range is cut when it holds four times as many rows as the mean range and this many have together.
PIECE_ROWS = 1000


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(common.SPACE))
    # Text of one byte per character has no other capitals, and lower() is much faster than translate().
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(common.ascii_lower(bare))


def occurrences(docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, version, pos, h1, h2, range) per line whose key has ``min_chars`` code points. The two hashes are the key;
    ``version`` tells rows of one id apart by their text."""
    line = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("version"), F.posexplode(lines(F.col(text))).alias("pos", "line"))
    found = line.where(F.char_length(F.btrim("line", F.lit(common.SPACE))) >= min_chars).withColumn("key", key(F.col("line")))
    hashed = found.select("id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))
    return hashed.withColumn("range", F.shiftrightunsigned("h1", 64 - RANGE_BITS).cast("int"))


def _large_ranges(found: DataFrame) -> DataFrame:
    """(range, pieces) of the ranges to cut: less than a quarter of all ranges, whatever the input."""
    sizes = common.written(found.groupBy("range").agg(F.count("*").alias("n")))
    mean = (sizes.agg(F.sum("n")).first()[0] or 0) / 2**RANGE_BITS + PIECE_ROWS
    return common.written(sizes.where(F.col("n") > 4 * mean).select("range", F.ceil(F.col("n") / mean).alias("pieces")))


def dropped(docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, version, pos) of the lines to drop."""
    found = common.written(occurrences(docs, id, text, min_chars))
    large = _large_ranges(found)
    cut = not large.isEmpty()
    if cut:
        found = found.join(F.broadcast(large), "range", "left")
        piece = F.when(F.col("pieces").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("id", "version", "pos"), "pieces"))
        found = found.withColumn("piece", piece).drop("pieces")
    else:
        found = found.withColumn("piece", F.lit(0).cast("bigint"))
    group = ["range", "piece", "h1", "h2"]
    ordered = found.repartitionByRange("range", "piece").sortWithinPartitions(*group, F.col("id").desc_nulls_last(), "version", "pos")
    same = Window.partitionBy(*group)
    seen = ordered.withColumn("nth", F.dense_rank().over(same.orderBy(F.col("id").desc_nulls_last())))
    seen = seen.withColumn("n_docs", F.max("nth").over(same))
    out = ["id", "version", "pos"]
    drop = seen.where((F.col("piece") == 0) & (F.col("nth") > 1) & (F.col("n_docs") >= min_docs)).select(*out)
    if not cut:
        return drop
    parts = common.written(seen.where("piece > 0").select(*group, *out, "nth"))
    heads = common.written(parts.where(F.col("nth") <= min_docs).select(*group, "id").distinct())
    last = (
        heads.select("h1", "h2", "id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("id").alias("last"))
        .where(F.col("n_docs") >= min_docs)
    )
    settled = heads.select(*group).distinct().join(last, ["h1", "h2"])
    more = parts.join(settled, group).where(~F.col("id").eqNullSafe(F.col("last"))).select(*out)
    return drop.unionByName(more)


def bitmaps(docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, version, bits) per document that loses lines: ``bits`` holds (word, drop) for every 64 lines of which some
    go, with a bit set for each that does. All other lines stay."""
    word = dropped(docs, id, text, min_chars, min_docs).groupBy(
        "id", "version", F.shiftright("pos", 6).alias("word")
    ).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("pos").bitwiseAND(63))).alias("drop"))
    return word.groupBy("id", "version").agg(F.array_sort(F.collect_list(F.struct("word", "drop"))).alias("bits"))


def _positions(bits: Column) -> Column:
    def of_word(b: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", b["drop"], i) == 1)
        return F.transform(at, lambda i: b["word"] * 64 + i)

    return F.flatten(F.transform(bits, of_word))


def kept(
    docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """(row, n_lines, n_dropped, kept_text): the row as it was and its text without the dropped lines."""
    # Bitmaps grow with the documents, so they are not broadcast; as the hashed side they spare the texts a sort.
    bits = common.written(bitmaps(docs, id, text, min_chars, min_docs)).hint("shuffle_hash")
    left = docs.select(F.struct("*").alias("row"), F.col(id).alias("__id"), F.xxhash64(text).alias("__version"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    met = left.join(bits, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__version") == F.col("version")), "left")
    gone = F.when(F.col("bits").isNull(), F.array().cast("array<int>")).otherwise(_positions(F.col("bits")))

    def rest(line: Column) -> Column:
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(line) - 1), F.col("gone")), lambda i: F.get(line, i)), "\n")

    split = F.split("__text", "\n")
    return met.select("row", "__text", gone.alias("gone")).select(
        "row", F.size(split).cast("bigint").alias("n_lines"), F.size("gone").cast("bigint").alias("n_dropped"),
        F.when(F.size("gone") == 0, F.col("__text")).otherwise(common.let(split, rest)).alias("kept_text"),
    )


def apply(docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the lines dropped from their texts; NULL texts stay NULL."""
    cells = [
        F.when(F.col("row")[text].isNotNull(), F.col("kept_text")).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns
    ]
    return kept(docs, id, text, min_chars, min_docs).select(*cells)
