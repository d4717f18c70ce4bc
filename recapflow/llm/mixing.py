"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a fixed hash of its id. Sizes are summed by source and leading hash bits; the running sums show in
which bucket a source's budget ends, only that bucket is split by the next bits, and so on. The budget becomes one hash
threshold per source, and a filter on it picks the documents: nothing is sorted, and a smaller budget always picks a
subset of a larger one. Budgets above the source's size add whole passes over it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recapflow.llm import common

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Bits of the hash that one histogram resolves, and bits of the hash in all.
LEVEL_BITS, HASH_BITS = 12, 60


def document_hash(id: Column, seed: str = "mix") -> Column:
    """The leading 60 bits of an md5 of the id, the same in every run and at every partitioning."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Target per source from a table (source, source_size), one row per source.

    Sources in code-point order, NULL last, weigh ``weights`` in turn and share the sum of all sizes. A target stops
    at ``max_epochs`` times its source's size; the excess goes to the others by weight until none is above. That is a
    common level ``x`` with target = min(cap, x * weight); sources in order of cap / weight are capped as long as the
    level of the rest exceeds theirs. The ordering windows hold one small row per source."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    caps = sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(max_epochs)).alias("cap"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    held = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    level = (F.sum(F.col("source_size").cast("double")).over(everything) - held("cap")) / (F.sum("weight").over(everything) - held("weight"))
    leveled = caps.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    # the first source that is not capped sets the level of all the rest
    stop = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("level").alias("x")))).over(everything)
    return leveled.withColumn("x", stop["x"]).select(
        "source", "source_size",
        F.when(F.col("x").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("x") * F.col("weight"))).alias("target"),
    )


def _bits(level: int) -> Column:
    return F.shiftright("h", HASH_BITS - LEVEL_BITS * level)


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source the whole passes and the hash below which documents are taken once more: (source, passes, upto).

    ``sized`` has source, h and size; ``goals`` what ``targets`` returns. Each level sums the open bucket of the level
    before by its next bits; the last one meets single hashes and cuts before or after the one at which the budget
    ends, whichever comes nearer (before, if both are as near)."""
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    state = common.settled(goals.select(
        "source", "source_size", "target", passes.alias("passes"),
        (F.col("target") - passes * F.col("source_size")).alias("rest"),
        F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("done"),
    ))
    sources, levels = state.count(), HASH_BITS // LEVEL_BITS
    inside = sized.where("size > 0").select("source", "size", "h")
    for level in range(1, levels + 1):
        open_ = common.join_small(inside.withColumn("prefix", _bits(level - 1)), state, ["source", "prefix"], sources, F.col("h"))
        sums = open_.groupBy("source", "rest", "done", _bits(level).alias("bucket")).agg(F.sum("size").alias("size"))
        upto = Window.partitionBy("source").orderBy("bucket")
        run = sums.withColumn("after", F.col("done") + F.sum("size").over(upto)).withColumn("before", F.col("after") - F.col("size"))
        ends = run.where((F.col("before") <= F.col("rest")) & (F.col("after") > F.col("rest")))
        step = ends.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.col("before"), F.col("after"))
        both = state.join(step, F.col("source").eqNullSafe(F.col("s")), "left")
        if level < levels:
            state = common.settled(both.select(
                "source", "source_size", "target", "passes", "rest", F.coalesce("b", "prefix").alias("prefix"),
                F.coalesce("before", "done").alias("done"),
            ))
    cut = F.when(F.col("after") - F.col("rest") < F.col("rest") - F.col("before"), F.col("b") + 1).otherwise(F.col("b"))
    return both.select("source", "source_size", "target", "passes", F.coalesce(cut, F.lit(0).cast("bigint")).alias("upto"))


def plan(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(sizes per document, thresholds per source), both settled."""
    sized = common.settled(docs.select(
        F.col(id).alias("id"), F.col(source).alias("source"), F.size(common.words(F.col(text))).cast("bigint").alias("size"),
        document_hash(F.col(id), seed).alias("h"),
    ))
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    return sized, common.settled(thresholds(sized, goals))


def copies() -> Column:
    return (F.col("passes") + F.when(F.col("h") < F.col("upto"), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """One row per document: id, source, size, its source's size and target, ``copies`` and ``taken`` words.

    NULL texts have size 0, NULL sources form one source that comes last, NULL ids share one hash, rows that repeat an
    id are taken or left together. An empty table, and sources without words, give targets of 0."""
    sized, cuts = plan(docs, id, text, source, seed)
    out = common.join_small(sized, cuts, ["source"], cuts.count(), F.col("h"))
    return out.select(
        F.col("id").alias(id), F.col("source").alias(source), "size", "source_size", "target", copies().alias("copies"),
        (F.col("size") * copies()).alias("taken"),
    )


def materialise(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """The mixed documents, each as often as it is taken, with all their columns."""
    _, cuts = plan(docs, id, text, source, seed)
    row = docs.select(F.struct("*").alias("row"), F.col(source).alias("source"), document_hash(F.col(id), seed).alias("h"))
    out = common.join_small(row, cuts, ["source"], cuts.count(), F.col("h"))
    return out.select("row", F.explode(F.array_repeat(F.lit(1), copies())).alias("copy")).select("row.*")
