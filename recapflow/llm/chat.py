"""Chat formatting of reply trees.

Messages name their parent. Self-joins that double the distance each round give every message its depth and the score
of its branch, the best branches of a conversation are chosen, and the same doubled jumps walk back from the chosen
leaves to the root: a chain of n replies takes about log2(n) joins. Each chosen branch becomes one text with a loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recapflow.llm import common

START, END, LINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"


def escape(text: Column) -> Column:
    """No control string is left in the result: ``<|`` becomes ``<\\|``, and one more backslash goes in where there are some."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE))


def _unrole(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(LINE), F.lit("\n")))


def linear(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages (conv, msg, parent, role, text, score) of conversations without branches: each row answers the row before."""
    n = F.row_number().over(Window.partitionBy(conv).orderBy(turn, role, text))
    return turns.select(
        F.col(conv).alias("conv"), n.alias("msg"), F.when(n > 1, n - 1).alias("parent"), F.col(role).alias("role"),
        F.col(text).alias("text"), F.lit(0.0).alias("score"),
    )


def branches(messages: DataFrame, best: int = 1) -> DataFrame:
    """(conv, branch, depth, role, text): the messages of the ``best`` branches of each conversation, depth 1 first.

    A branch is a path from a root to a leaf and scores the mean of its messages' scores (NULL counts as 0); equal
    scores prefer longer branches, then smaller leaf ids. A message whose parent is missing is a root. Of rows that
    repeat a message id the smallest (parent, score, role, text) counts; messages on a cycle have no root and are left
    out. NULL conversation ids form one conversation."""
    node = F.struct("conv", "msg")
    once = common.settled(
        messages.groupBy("conv", "msg").agg(F.min(F.struct("parent", "score", "role", "text")).alias("m")).select(
            node.alias("node"), F.when(F.col("m.parent").isNotNull(), F.struct("conv", F.col("m.parent").alias("msg"))).alias("parent"),
            F.coalesce("m.score", F.lit(0.0)).cast("double").alias("score"), F.coalesce("m.role", F.lit("")).alias("role"),
            F.coalesce("m.text", F.lit("")).alias("text"),
        )
    )
    known = once.select(F.col("node").alias("up"))
    jump = common.written(
        once.select("node", F.col("parent").alias("up"), "score").join(known.withColumn("there", F.lit(True)), "up", "left")
        .select("node", F.when(F.col("there"), F.col("up")).alias("up"), "score", F.lit(1).cast("bigint").alias("depth"))
    )
    jumps, open_ = [jump.select("node", "up")], jump.where("up IS NOT NULL").count()
    while open_:
        far = jump.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("score").alias("more"), F.col("depth").alias("deeper"))
        further = jump.join(far, "up").select(  # only messages that have not met their root
            "node", F.col("next").alias("up"), (F.col("score") + F.col("more")).alias("score"), (F.col("depth") + F.col("deeper")).alias("depth"),
        )
        jump = common.written(jump.where("up IS NULL").select("node", "up", "score", "depth").union(further))
        was, open_ = open_, jump.where("up IS NOT NULL").count()
        if open_ == was:  # only cycles are left
            break
        jumps.append(jump.select("node", "up"))
    rooted = jump.where("up IS NULL").select("node", "score", "depth")
    leaves = rooted.join(jumps[0].select(F.col("up").alias("node")), "node", "left_anti")
    rank = Window.partitionBy("node.conv").orderBy((F.col("score") / F.col("depth")).desc(), F.col("depth").desc(), "node.msg")
    chosen = leaves.withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= best).select("node", "branch")
    for step in reversed(jumps):
        up = chosen.join(step, "node").where("up IS NOT NULL").select(F.col("up").alias("node"), "branch")
        chosen = common.written(chosen.union(up))
    return chosen.join(rooted.select("node", "depth"), "node").join(once.select("node", "role", "text"), "node").select(
        F.col("node.conv").alias("conv"), "branch", "depth", "role", "text",
    )


def format(messages: DataFrame, best: int = 1, learn_from: str = "assistant") -> DataFrame:
    """(conv, branch, formatted, mask): each chosen branch as one text. ``mask`` has for every turn the places, counted
    from the turn's start marker, between which the loss applies; they are equal for other roles."""
    turns = branches(messages, best).groupBy("conv", "branch").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("t"))
    head = lambda t: F.concat(F.lit(START), _role(t["role"]), F.lit("\n"))
    block = lambda t: F.concat(head(t), escape(t["text"]), F.lit(END))
    span = lambda t: F.struct(
        F.length(head(t)).alias("start"),
        (F.length(head(t)) + F.when(t["role"] == learn_from, F.length(escape(t["text"]))).otherwise(0)).alias("end"),
    )
    return turns.select("conv", "branch", F.array_join(F.transform("t", block), "").alias("formatted"), F.transform("t", span).alias("mask"))


def read(formatted: DataFrame) -> DataFrame:
    """(conv, branch, turns, losses) from formatted texts: turns as (role, text), losses the texts under the mask."""
    parts = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 2**31 - 1)
    bound = formatted.withColumn("parts", parts)
    role = lambda p: F.substring_index(p, "\n", 1)
    body = lambda p: p.substr(F.length(role(p)) + 2, F.length(p) - F.length(role(p)) - 1 - len(END))
    turn = lambda p: F.struct(_unrole(role(p)).alias("role"), unescape(body(p)).alias("text"))
    under = lambda p, m: F.when(m["end"] > m["start"], unescape(p.substr(m["start"] - len(START) + 1, m["end"] - m["start"]))).otherwise("")
    return bound.select("conv", "branch", "formatted", F.transform("parts", turn).alias("turns"), F.zip_with("parts", "mask", under).alias("losses"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per formatted conversation, read back: n_turns, digests of the turns and of the text under the mask, and lengths."""
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return read(formatted).select(
        "conv", "branch", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
