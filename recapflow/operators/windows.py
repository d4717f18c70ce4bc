"""Analysis windows: cutting a session's utterances where silence, duration or word count demands it.

Where a window may close depends on where it began, so the rule is a fold. It is nevertheless run in
parallel inside a session: a session is split into chunks of stream time, every chunk works out, for each
utterance at which a window could begin first, where the first window after the chunk begins (``steps``),
these few steps are chained chunk by chunk, and each chunk then marks its own window starts from its now
known entry point. A window never spans more than ``window_max_seconds``, so a chunk needs to look only
that far into the next one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recapflow.functions import text as X
from recapflow.functions.folds import fold_sorted
from recapflow.params import DEFAULTS, Params

_STEP = "ARRAY<STRUCT<upto_t: DOUBLE, upto_id: BIGINT, exit_t: DOUBLE, exit_id: BIGINT>>"


def word_count(text: Column, words: Column | None = None) -> Column:
    """Given word count, or white-space tokens where it is missing or 0."""
    counted = F.size(X.tokens(text)).cast("bigint")
    return counted if words is None else F.when(F.coalesce(words, F.lit(0)) > 0, words.cast("bigint")).otherwise(counted)


def window_end(i: int, start: list, end: list, words: list, p: Params) -> int:
    """Index one past the window that begins at ``i``; ``len(start)`` when the rows do not close it."""
    total = words[i]
    for u in range(i + 1, len(start)):
        pause = end[u - 1] - start[i] >= p.window_min_seconds and start[u] - end[u - 1] >= p.window_min_silence
        span, total = end[u] - start[i], total + words[u]
        if pause or span > p.window_max_seconds or total > p.window_max_words:
            return u
        if span >= p.window_max_seconds or total >= p.window_max_words:
            return u + 1
    return len(start)


class _Rows:
    """Rows of one chunk, gathered across Arrow batches; a chunk is bounded by its time span."""

    def __init__(self) -> None:
        self.rows: dict[str, list] = {}

    def feed(self, rows: dict[str, list]) -> list[tuple]:
        for c, values in rows.items():
            self.rows.setdefault(c, []).extend(values)
        return []


def _steps(p: Params):
    class Steps(_Rows):
        def finish(self) -> list[tuple]:
            rows = self.rows
            own = rows["halo"].count(False)
            if own == 0:
                return []
            session, chunk = rows["session_id"][0], rows["chunk"][0]
            ids, start, end, words = (rows[c] for c in ("id", "t_start", "t_end", "n_words"))
            begin = chunk * p.chunk_seconds
            beyond = (begin + p.chunk_seconds + p.window_max_seconds, -1)
            first_after = next((i for i in range(own) if start[i] >= begin + p.window_max_seconds), own - 1)
            exits: dict[int, int] = {}

            def leave(i: int) -> int:
                path = []
                while i < own and i not in exits:
                    path.append(i)
                    i = window_end(i, start, end, words, p)
                to = exits.get(i, i)
                for j in path:
                    exits[j] = to
                return to

            steps: list[tuple] = []
            for i in range(first_after + 1):
                to = leave(i)
                out = (start[to], ids[to]) if to < len(ids) else beyond
                if steps and steps[-1][2:] == out:
                    steps.pop()
                steps.append((start[i], ids[i], *out))
            keys = ("upto_t", "upto_id", "exit_t", "exit_id")
            return [(session, chunk, [dict(zip(keys, s)) for s in steps])]

    return Steps


def _starts(p: Params):
    class Starts(_Rows):
        def finish(self) -> list[tuple]:
            rows = self.rows
            ids, start, end, words = (rows[c] for c in ("id", "t_start", "t_end", "n_words"))
            entry_t, entry_id = rows["entry_t"][0], rows["entry_id"][0]
            begins = set()
            if not pd.isna(entry_t):
                i = next((j for j in range(len(ids)) if (start[j], ids[j]) >= (entry_t, entry_id)), len(ids))
                while i < len(ids):
                    begins.add(i)
                    i = window_end(i, start, end, words, p)
            session, chunk = rows["session_id"][0], rows["chunk"][0]
            out, seen = [], 0
            for i, row_id in enumerate(ids):
                seen += i in begins
                out.append((session, chunk, row_id, start[i], end[i], words[i], seen, i + 1))
            return out

    return Starts


def assign(utterances: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(session_id, id, t_start, t_end, n_words, window_no, position) for every utterance.

    ``utterances``: session_id, id, t_start, t_end, n_words."""
    if p.chunk_seconds < p.window_max_seconds:
        raise ValueError("chunk_seconds must not be shorter than window_max_seconds")
    cols = ["session_id", "chunk", "id", "t_start", "t_end", "n_words"]
    chunk = F.floor(F.col("t_start") / p.chunk_seconds)
    rows = utterances.select(
        F.col("session_id").cast("bigint"), chunk.alias("chunk"), F.col("id").cast("bigint"),
        F.col("t_start").cast("double"), F.col("t_end").cast("double"), F.col("n_words").cast("bigint"),
    )
    reaches_back = F.col("t_start") < F.col("chunk") * p.chunk_seconds + p.window_max_seconds
    own = F.struct(F.col("chunk").alias("chunk"), F.lit(False).alias("halo"))
    copy = F.struct((F.col("chunk") - 1).alias("chunk"), F.lit(True).alias("halo"))
    with_halo = rows.withColumn(
        "__c", F.explode(F.when(reaches_back, F.array(own, copy)).otherwise(F.array(own)))
    ).select("session_id", "__c.chunk", "__c.halo", "id", "t_start", "t_end", "n_words")

    steps = fold_sorted(
        with_halo, ["session_id", "chunk"], ["t_start", "id"], _steps(p),
        f"session_id BIGINT, chunk BIGINT, steps {_STEP}",
    )
    entries = _chain(steps)
    marked = fold_sorted(
        rows.join(entries, ["session_id", "chunk"], "left"), ["session_id", "chunk"], ["t_start", "id"], _starts(p),
        "session_id BIGINT, chunk BIGINT, id BIGINT, t_start DOUBLE, t_end DOUBLE, n_words BIGINT, "
        "local_no BIGINT, local_position BIGINT",
    )
    earlier = Window.partitionBy("session_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marked.groupBy("session_id", "chunk")
        .agg(F.max("local_no").alias("n"), F.max("local_position").alias("m"))
        .select("session_id", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"),
                F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("m0"))
    )
    return marked.join(offsets, ["session_id", "chunk"]).select(
        *[c for c in cols if c != "chunk"],
        (F.col("local_no") + F.col("n0")).alias("window_no"),
        (F.col("local_position") + F.col("m0")).alias("position"),
    )


def _chain(steps: DataFrame) -> DataFrame:
    """Entry point of every chunk: follow the steps chunk by chunk (a few rows per session hour)."""
    def follow(acc: Column, c: Column) -> Column:
        here = F.struct(acc["t"], acc["i"])
        hit = F.try_element_at(F.filter(c["steps"], lambda s: F.struct(s["upto_t"], s["upto_id"]) >= here), F.lit(1))
        entry = F.struct(c["chunk"].alias("chunk"), acc["t"].alias("t"), acc["i"].alias("i"))
        return F.when(hit.isNull(), acc).otherwise(
            F.struct(hit["exit_t"].alias("t"), hit["exit_id"].alias("i"),
                     F.concat(acc["out"], F.array(entry)).alias("out"))
        )

    begin = F.struct(
        F.lit(float("-inf")).alias("t"), F.lit(-1).cast("bigint").alias("i"),
        F.array().cast("array<struct<chunk: bigint, t: double, i: bigint>>").alias("out"),
    )
    chunks = F.array_sort(F.collect_list(F.struct("chunk", "steps")))
    return (
        steps.groupBy("session_id").agg(chunks.alias("chunks"))
        .select("session_id", F.explode(F.aggregate("chunks", begin, follow, lambda a: a["out"])).alias("e"))
        .select("session_id", "e.chunk", F.col("e.t").alias("entry_t"), F.col("e.i").alias("entry_id"))
    )


def build(assigned: DataFrame) -> DataFrame:
    """One row per window from ``assign``: bounds, word count and its segment ids in order."""
    return assigned.groupBy("session_id", "window_no").agg(
        F.min("t_start").alias("t_start"),
        F.max_by("t_end", F.struct("t_start", "id")).alias("t_end"),
        F.sum("n_words").alias("n_words"),
        F.transform(F.array_sort(F.collect_list(F.struct("t_start", "id"))), lambda s: s["id"]).alias("segment_ids"),
    )


def with_tail(assigned: DataFrame, n: int = 2) -> DataFrame:
    """Rows each window is analysed with: its own and the last ``n`` of the session before it."""
    firsts = assigned.groupBy("session_id", "window_no").agg(F.min("position").alias("first"))
    carried = (
        assigned.drop("window_no")
        .withColumn("first", F.explode(F.sequence(F.col("position") + 1, F.col("position") + n)))
        .join(firsts, ["session_id", "first"])
        .drop("first")
        .withColumn("carried", F.lit(True))
    )
    return assigned.withColumn("carried", F.lit(False)).unionByName(carried)
