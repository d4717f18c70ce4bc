"""What a window is analysed with: streamer, earlier streams, cast, storylines, history - most relevant
first, cut to a token budget. Everything is chosen for all windows at once.

``windows`` here: window_id, session_id, channel_id, window_no, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recapflow.functions import text as X
from recapflow.functions.ordered import id_block, last_before, top_n
from recapflow.operators.mentions import mentions
from recapflow.operators.resolve import names as entity_names
from recapflow.operators.summaries import latest
from recapflow.sources.channels import streamer as streamer_of

# Fixed values.
CAST = 12
THREADS = 6
PREVIOUS = 2
HISTORY = 3
SPEAKERS = 12
DORMANT_AFTER = 3
TOKEN_BUDGET = 3000
#: Seconds of stream time that windows and rows of a further source are laid out by, and the step to the next larger size.
EXTRA_BUCKET, EXTRA_FACTOR = 300.0, 32
PREVIOUS_CHARS, CAST_CHARS, AKA_CHARS, THREAD_CHARS, HISTORY_CHARS = 500, 240, 120, 200, 250


def _looking_back(sessions: DataFrame, rows: DataFrame, asked: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(sessions, rows) that meet each other: all, or the sessions ``asked`` for by session_id and the ``rows`` of their
    channels. A batch of windows belongs to few of all sessions; the others are neither sorted nor moved for it."""
    left = sessions.select("channel_id", "id", F.col("id").alias("session_id"))
    if asked is None:
        return left, rows
    left = left.join(asked.select("session_id").distinct(), "session_id", "left_semi")
    return left, rows.join(left.select("channel_id").distinct(), "channel_id", "left_semi")


def dormancy_cutoff(sessions: DataFrame, n: int = DORMANT_AFTER, asked: DataFrame | None = None) -> DataFrame:
    """(session_id, cutoff): start of the ``n``-th most recent earlier session of the channel; no row for
    sessions with fewer earlier ones. ``asked``: the sessions wanted (session_id), all without it."""
    started = sessions.where("started_at IS NOT NULL").select("channel_id", "id", "started_at")
    left, started = _looking_back(sessions, started, asked)
    back = last_before(left, started, ["channel_id"], ["id"], n, id_block("id"))
    return back.where(F.col("back") == n).select("session_id", F.col("started_at").alias("cutoff"))


def previous(sessions: DataFrame, n: int = PREVIOUS, asked: DataFrame | None = None) -> DataFrame:
    """Last ``n`` earlier sessions of the channel that have a wrap-up; ``back`` = 1 is the nearest. ``asked`` as above."""
    told = sessions.where("final_summary IS NOT NULL").select("channel_id", "id", "started_at", "title", "final_summary")
    left, told = _looking_back(sessions, told, asked)
    return last_before(left, told, ["channel_id"], ["id"], n, id_block("id")).drop("channel_id", "id")


def _named(windows: DataFrame, names: DataFrame, rows: DataFrame, by: list[str], limit: int) -> DataFrame:
    """(channel_id, window_id, id): the first ``limit`` named in each window's text, greatest ``by`` first. A window keeps no
    more, and those that come after them come after them in every ranking by tier, ``by`` and id. ``names``: channel_id, id, name."""
    best = rows.groupBy("channel_id", "id").agg(F.max(F.struct(*by)).alias("best"))
    return mentions(names.join(best, ["channel_id", "id"]), windows, ["channel_id"], "id", "window_id", "text", "best", limit)


def threads(windows: DataFrame, open_threads: DataFrame, sessions: DataFrame, limit: int = THREADS) -> DataFrame:
    """Open storylines per window: those named in its text first, then the ones not dormant, by latest
    change and importance. ``open_threads`` is the threads table; other statuses are ignored."""
    live = open_threads.where("status = 'open'")
    order = [F.desc_nulls_last("last_updated_at"), F.desc("importance"), F.asc("id")]
    titles = live.select("channel_id", "id", F.col("title").alias("name"))
    named = _named(windows, titles, live, ["last_updated_at", "importance"], limit).withColumn("tier", F.lit(1))
    keys = windows.select("window_id", "session_id", "channel_id").join(dormancy_cutoff(sessions, asked=windows), "session_id", "left")
    # Ranking by latest change puts all active storylines first, so the newest few serve every window.
    fresh = top_n(live, ["channel_id"], order, limit, "__r").select("channel_id", "id", "last_updated_at")
    active = keys.join(fresh, "channel_id").where(
        F.col("cutoff").isNull() | (F.col("last_updated_at") >= F.col("cutoff"))
    ).select("channel_id", "window_id", "id", F.lit(2).alias("tier"))
    picked = named.unionByName(active).groupBy("channel_id", "window_id", "id").agg(F.min("tier").alias("tier"))
    return top_n(picked.join(live, ["channel_id", "id"]), ["window_id"], [F.asc("tier"), *order], limit)


def cast(windows: DataFrame, entities: DataFrame, aliases: DataFrame, channels: DataFrame, limit: int = CAST) -> DataFrame:
    """Entities per window: the streamer, those named in its text, then the most recently seen."""
    live = entities.where("status <> 'merged'")
    order = [F.desc_nulls_last("last_seen_at"), F.desc("mention_count"), F.asc("id")]
    keys = windows.select("window_id", "channel_id")
    called = entity_names(live, aliases).select("channel_id", F.col("entity_id").alias("id"), "name")
    named = _named(windows, called, live, ["last_seen_at", "mention_count"], limit).withColumn("tier", F.lit(2))
    host = streamer_of(channels).where("entity_id IS NOT NULL").select("channel_id", F.col("entity_id").alias("id"))
    first = keys.join(host, "channel_id").withColumn("tier", F.lit(1))
    recent = keys.join(top_n(live, ["channel_id"], order, limit, "__r").select("channel_id", "id"), "channel_id").withColumn("tier", F.lit(3))
    cols = ["channel_id", "window_id", "id", "tier"]
    picked = first.select(*cols).unionByName(named.select(*cols)).unionByName(recent.select(*cols))
    best = picked.groupBy("channel_id", "window_id", "id").agg(F.min("tier").alias("tier"))
    return top_n(best.join(live, ["channel_id", "id"]), ["window_id"], [F.asc("tier"), *order], limit)


def history(windows: DataFrame, done: DataFrame, n: int = HISTORY) -> DataFrame:
    """Last ``n`` non-empty window summaries before each window. ``done``: the windows table."""
    right = done.where("window_summary IS NOT NULL AND window_summary <> ''").select("session_id", "id", "window_summary")
    left = windows.select("session_id", F.col("window_id").alias("id"), "window_id")
    return last_before(left, right, ["session_id"], ["id"], n, id_block("id")).select("window_id", "back", "window_summary")


def pack(parts: DataFrame, keys: list[str], budget: int = TOKEN_BUDGET) -> DataFrame:
    """Keep the leading parts (keys, block, seq, text) until the token budget is first exceeded. A part costs at least
    one token, so no more than ``budget`` parts of a key can stay; the others go before the shuffle."""
    w = Window.partitionBy(*keys).orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, 0)
    first = top_n(parts, keys, [F.asc("block"), F.asc("seq")], budget, "__rank").drop("__rank")
    counted = first.withColumn("tokens", X.approx_tokens(F.col("text"))).withColumn("used", F.sum("tokens").over(w))
    return counted.where(F.col("used") <= budget)


def _aka(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    own = entities.select(F.col("id").alias("entity_id"), "canonical_name")
    other = aliases.join(own, "entity_id").where(~X.ieq(F.col("alias"), F.col("canonical_name")))
    return other.groupBy(F.col("entity_id").alias("id")).agg(
        X.cap(F.array_join(F.array_sort(F.collect_set("alias")), ", "), AKA_CHARS).alias("aka")
    )


def extra(windows: DataFrame, notes: DataFrame, bucket_seconds: float = EXTRA_BUCKET) -> DataFrame:
    """(window_id, seq, text): rows of a further source for every window whose time they touch, in order of time.
    ``windows``: window_id, session_id, t_start, t_end; ``notes``: session_id, id, t_start, t_end, text. A row that ends as it starts is
    a point in time; a window includes its start, not its end.

    Both sides are laid out on time buckets and meet by (session, bucket), so a session with a large share of all rows
    is spread over its time. Buckets come in sizes, each EXTRA_FACTOR times the one before; a row's own size is the first
    that it fits into, and a pair meets at the larger of its two sizes, in the first bucket both share. So a row is laid
    out a few times per size of the other side, however long it is."""
    def sized(df: DataFrame) -> DataFrame:
        long = F.abs(F.col("t_end") - F.col("t_start")) / bucket_seconds
        return df.withColumn("__size", F.greatest(F.lit(0.0), F.ceil(F.log(float(EXTRA_FACTOR), long)).cast("double")))

    def laid(df: DataFrame, other: DataFrame) -> DataFrame:
        # The sizes in use are few: one row each.
        sizes = F.array(*[F.lit(r[0]) for r in sorted(other.select("__size").distinct().collect())]).cast("array<double>")
        met = df.withColumn("__at", F.explode(F.array_distinct(F.transform(sizes, lambda x: F.greatest(x, "__size")))))
        first, last = (F.floor(F.col(c) / (bucket_seconds * F.pow(F.lit(float(EXTRA_FACTOR)), F.col("__at")))) for c in ("t_start", "t_end"))
        # The planner takes rows before they are laid out for their number after it, and would broadcast them.
        return met.withColumn("__first", first).withColumn("__bucket", F.explode(F.sequence(first, last))).hint("merge")

    left, right = sized(windows.select("window_id", "session_id", "t_start", "t_end")), sized(notes.select("session_id", "id", "t_start", "t_end", "text"))
    apart = {"t_start": "n_start", "t_end": "n_end", "__first": "__n_first", "__size": "__n_size"}
    left, right = laid(left, right), laid(right, left).withColumnsRenamed(apart)
    meets = (F.col("n_start") < F.col("t_end")) & ((F.col("n_end") > F.col("t_start")) | ((F.col("n_start") == F.col("n_end")) & (F.col("n_start") == F.col("t_start"))))
    once = (F.col("__at") == F.greatest("__size", "__n_size")) & (F.col("__bucket") == F.greatest("__first", "__n_first"))
    met = left.join(right, ["session_id", "__at", "__bucket"]).where(meets & once)
    order = Window.partitionBy("window_id").orderBy("n_start", "id")
    return met.select("window_id", F.row_number().over(order).cast("bigint").alias("seq"), "text")


def build(windows: DataFrame, channels: DataFrame, sessions: DataFrame, entities: DataFrame, aliases: DataFrame,
          thread_table: DataFrame, done: DataFrame, summaries: DataFrame, speakers: DataFrame | None = None,
          extra: DataFrame | None = None, budget: int = TOKEN_BUDGET) -> DataFrame:
    """(window_id, context): the blocks in fixed order within the token budget. ``speakers``: window_id,
    position, label. ``extra``: optional rows (window_id, seq, text) of further sources, such as the function of that name gives."""
    keys = windows.select("window_id", "session_id", "channel_id")

    def part(df: DataFrame, block: int, seq: Column, text: Column) -> DataFrame:
        return df.select("window_id", F.lit(block).alias("block"), seq.cast("bigint").alias("seq"), text.alias("text"))

    zero, blank = F.lit(0), F.lit("")
    meta = keys.join(sessions.select(F.col("id").alias("session_id"), "title", "category"), "session_id", "left")
    parts = [part(meta, 1, zero, F.concat(F.lit("[meta] title="), F.coalesce("title", blank), F.lit(" category="), F.coalesce("category", blank)))]
    host = keys.join(streamer_of(channels), "channel_id")
    parts.append(part(host, 2, zero, F.concat(
        F.lit("[streamer] "), F.col("name"), F.lit(" (entity E"), F.coalesce(F.col("entity_id").cast("string"), F.lit("None")), F.lit(") aka "),
        F.array_join("aliases", ", "), F.lit(" | character: "), F.array_join("characters", ", "), F.lit(" | POV: "), F.col("pov_mode"))))
    day = F.coalesce(F.date_format("started_at", "yyyy-MM-dd"), blank)
    label = F.when(F.coalesce("title", blank) != "", F.concat(day, F.lit(" "), F.col("title"))).otherwise(day)
    parts.append(part(keys.join(previous(sessions, asked=windows), "session_id"), 3, -F.col("back"), F.concat(
        F.lit("[previously "), label, F.lit("] "), X.snippet(F.col("final_summary"), PREVIOUS_CHARS))))
    chosen = cast(windows, entities, aliases, channels).join(_aka(entities, aliases), "id", "left")
    also = F.when(F.coalesce("aka", blank) != "", F.concat(F.lit(" aka "), F.col("aka"))).otherwise("")
    parts.append(part(chosen, 4, F.col("rank"), F.concat(
        F.lit("[cast] "), F.col("canonical_name"), also, F.lit(" ("), F.col("type"), F.lit(", "), F.col("status"), F.lit("): "),
        X.snippet(F.col("description"), CAST_CHARS), F.when(F.col("tier") == 1, " [STREAMER]").otherwise(""))))
    parts.append(part(threads(windows, thread_table, sessions), 5, F.col("rank"), F.concat(
        F.lit("[thread T"), F.col("id"), F.lit("] "), F.col("title"), F.lit(": "), X.snippet(F.col("summary"), THREAD_CHARS))))
    parts.append(part(history(windows, done), 6, -F.col("back"), F.concat(F.lit("[history] "), X.cap(F.col("window_summary"), HISTORY_CHARS))))
    rolling = keys.join(latest(summaries, "rolling").select("session_id", "text"), "session_id").where("text <> ''")
    parts.append(part(rolling, 7, zero, F.concat(F.lit("[rolling] "), X.cap(F.col("text"), HISTORY_CHARS))))
    if speakers is not None:
        said = speakers.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct("position", "label"))).alias("s"))
        parts.append(part(said, 8, zero, F.concat(
            F.lit("[speakers] "), F.array_join(F.transform(F.slice("s", 1, SPEAKERS), lambda e: e["label"]), ", "))))
    if extra is not None:
        parts.append(part(extra, 9, F.col("seq"), F.col("text")))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return pack(every, ["window_id"], budget).groupBy("window_id").agg(
        X.lines(F.collect_list(F.struct("block", "seq", F.col("text").alias("line")))).alias("context")
    )
