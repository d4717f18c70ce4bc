"""Uniform sharding with exact shard sizes by a communication matrix.

Rows sit in blocks (by a hash of id, text and a number among equal rows). How many rows each block sends to each piece of each shard is drawn from the
multivariate hypergeometric law, the law these counts have in a uniformly random permutation. Every block permutes its
rows and deals them out by its line of the matrix, and every piece permutes what it got: together a uniformly random
order of all rows, in which each shard has its exact size, without a global sort. Only ids and keys move.

The matrix has ``BLOCKS * shards * PIECES`` cells, which does not grow with the table.
"""

from __future__ import annotations

import bisect
import itertools
import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recapflow.llm import common

SHARDS = 24
#: Equal rows are numbered in runs of this length.
RUN = 4096
#: Blocks that deal rows out, and pieces per shard that receive them; a task sorts about rows / BLOCKS ids at a time.
BLOCKS, PIECES = 512, 16


def hypergeometric(rng: random.Random, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good. The distribution function is inverted from the mode
    outwards, which takes steps in proportion to the standard deviation."""
    low, high = max(0, n - bad), min(n, good)
    if low >= high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    log_c = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    p = math.exp(log_c(good, mode) + log_c(bad, n - mode) - log_c(good + bad, n))
    u = rng.random() - p
    if u <= 0:
        return mode
    up = down = mode
    p_up = p_down = p
    while True:
        moved = False
        if up < high:
            p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up, moved = up + 1, True
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down, moved = down - 1, True
            u -= p_down
            if u <= 0:
                return down
        if not moved:
            return mode


def matrix(rng: random.Random, rows: list[int], columns: list[int]) -> list[list[int]]:
    """A random table with these line and column sums, as a uniformly random matching of rows to places gives it."""
    left, out = list(columns), []
    rest = sum(columns)
    for size in rows:
        line, want, others = [], size, rest
        for have in left:
            others -= have
            got = hypergeometric(rng, have, others, want) if want else 0
            line.append(got)
            want -= got
        left = [a - b for a, b in zip(left, line, strict=True)]
        rest -= size
        out.append(line)
    return out


def piece_sizes(total: int, shards: int, pieces: int) -> list[list[int]]:
    """Sizes of each shard's pieces: shards differ by one row at most, and so do the pieces of a shard."""
    shard = [total // shards + (s < total % shards) for s in range(shards)]
    return [[n // pieces + (p < n % pieces) for p in range(pieces)] for n in shard]


def _dealt(counts: dict[int, int], shards: int, blocks: int, pieces: int, seed: int) -> list[dict]:
    sizes = piece_sizes(sum(counts.values()), shards, pieces)
    starts = [[0, *itertools.accumulate(s[:-1])] for s in sizes]
    table = matrix(random.Random(seed), [counts.get(b, 0) for b in range(blocks)], [n for s in sizes for n in s])
    lines = []
    for b, line in enumerate(table):
        ends, cells = [], []
        for s in range(shards):
            base, run = (ends[-1] if ends else 0), []
            for n in line[s * pieces:(s + 1) * pieces]:
                base += n
                run.append(base)
            ends.append(base)
            cells.append(run)
        lines.append({"block": b, "shard_ends": ends, "piece_ends": cells, "piece_starts": starts})
    return lines


def place(line: dict, rank: int) -> tuple[int, int]:
    """(shard, piece) of the row with this rank in a block; what the plan below computes, for tests."""
    s = bisect.bisect_right(line["shard_ends"], rank)
    return s, bisect.bisect_right(line["piece_ends"][s], rank)


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows with a number ``__n`` (0, 1, ...) among equal ones. They are counted and made again from the count, so
    a row that occurs very often meets no others before its counts of the map tasks are summed, and nothing is sorted."""
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__count"))
    runs = counted.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(__count - 1) div {RUN}"))))
    first = F.col("__run") * RUN
    return runs.select(*rows.columns, F.explode(F.sequence(first, F.least(first + RUN, F.col("__count")) - 1)).alias("__n"))


def assign(
    docs: DataFrame, shards: int = SHARDS, id: str = "doc_id", text: str = "text", seed: int = 7,
    blocks: int = BLOCKS, pieces: int = PIECES,
) -> DataFrame:
    """One row per document: id, size (UTF-8 bytes plus 8), text_crc32, shard and slot (0, 1, ... inside the shard).

    NULL texts have no bytes. Rows that repeat an id or a text, copies of a row included, each have a place of their
    own. NULL ids are one more id. An empty table gives an empty table. The order depends on ids, texts and ``seed``
    only, not on partitioning."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = common.settled(_numbered(docs.select(
        F.col(id).alias("id"), (F.length(raw) + 8).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"),
    )).withColumn("__h", F.xxhash64(F.lit(seed), "id", "text_crc32", "size", "__n"))
        .withColumn("__block", F.pmod("__h", F.lit(blocks)).cast("int")))
    counts = {r["__block"]: r["count"] for r in rows.groupBy("__block").count().collect()}  # one number per block
    lines = _dealt(counts, shards, blocks, pieces, seed)
    spark = docs.sparkSession
    shape = "array<struct<block:int,shard_ends:array<bigint>,piece_ends:array<array<bigint>>,piece_starts:array<array<bigint>>>>"
    table = F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(lines)), shape))))  # blocks * shards * pieces numbers
    order = [F.xxhash64(F.lit("first"), "__h", "id"), "__h", "id", "size", "text_crc32", "__n"]
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("__block").orderBy(*order)) - 1)
    passed = lambda ends: F.size(F.filter(ends, lambda e: e <= F.col("__rank")))
    sent = (
        ranked.join(table, F.col("__block") == F.col("block")).withColumn("shard", passed(F.col("shard_ends")))
        .withColumn("__piece", passed(F.get(F.col("piece_ends"), F.col("shard"))))
        .withColumn("__start", F.get(F.get("piece_starts", F.col("shard")), F.col("__piece")))
        .select("id", "size", "text_crc32", "__n", "__h", "shard", "__piece", "__start")
    )
    again = [F.xxhash64(F.lit("second"), "__h", "id"), "__h", "id", "size", "text_crc32", "__n"]
    slot = F.row_number().over(Window.partitionBy("shard", "__piece").orderBy(*again)) - 1
    return sent.withColumn("slot", slot + F.col("__start")).select(
        F.col("id").alias(id), "size", "text_crc32", "shard", F.col("slot").cast("bigint").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id: str = "doc_id", text: str = "text", seed: int = 7) -> None:
    """Write the documents with their shard and slot, one folder per shard. Repeated rows are told apart by counting
    them, so each gets a slot of its own."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    key = [F.col(id).alias("__id"), F.crc32(raw).alias("__crc"), (F.length(raw) + 8).cast("bigint").alias("__size")]
    nth = lambda *by: F.row_number().over(Window.partitionBy("__id", "__crc", "__size").orderBy(*by))
    left = docs.select(F.struct("*").alias("row"), *key).withColumn("__n", nth(F.lit(0)))
    right = assign(docs, shards, id, text, seed).select(
        F.col(id).alias("__id"), F.col("text_crc32").alias("__crc"), F.col("size").alias("__size"), "shard", "slot",
    ).withColumn("__n", nth("shard", "slot"))
    same = [left[c].eqNullSafe(right[c]) for c in ("__id", "__crc", "__size", "__n")]
    left.join(right, same).select("row.*", F.col("shard").alias("shard_no"), F.col("slot").alias("slot_no")).write.partitionBy("shard_no").parquet(path)
