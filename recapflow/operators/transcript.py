"""Reading transcripts: ranges, the latest rows, lines and speaker labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recapflow.functions import text as X
from recapflow.functions.ordered import top_n

# Fixed value: names that do not identify a speaker.
PLACEHOLDER_NAME = r"(?i)^(?:(?:speaker[_ -]?)?\d+|pending|unknown)$"


def range_(segments: DataFrame, lo: float | None = None, hi: float | None = None, limit: int | None = None) -> DataFrame:
    """Segments with ``lo <= t_start <= hi`` (both included, None is open); ``limit`` keeps the latest rows per session."""
    inside = segments if lo is None else segments.where(F.col("t_start") >= lo)
    inside = inside if hi is None else inside.where(F.col("t_start") <= hi)
    if limit is None:
        return inside
    latest = [F.desc("t_start"), F.desc("id")]
    return top_n(inside, ["session_id"], latest, max(1, limit), "__rank").drop("__rank")


def utterance_line(seg_id: Column, t0: Column, t1: Column, speaker: Column, conf: Column, text: Column) -> Column:
    confidence = F.coalesce(F.format_string("%.2f", conf), F.lit("unknown"))
    shown = F.when(conf.isNull(), F.lit("unknown")).otherwise(confidence)
    return F.concat(
        F.format_string("[seg %d | %.1f–%.1f | speaker: ", seg_id, t0, t1), F.coalesce(speaker, F.lit("?")),
        F.lit(" (conf "), shown, F.lit(')] "'), text, F.lit('"'),
    )


def speaker_names(speakers: DataFrame) -> DataFrame:
    """(channel_id, speaker, name) of confirmed speakers with a usable name; ``speaker`` is the id as text."""
    name = X.strip(F.col("name"))
    return speakers.where(
        F.col("confirmed") & (F.coalesce(F.col("name"), F.lit("")) != "") & ~name.rlike(PLACEHOLDER_NAME)
    ).select("channel_id", F.col("id").cast("string").alias("speaker"), name.alias("name"))


def label(rows: DataFrame, names: DataFrame, order: str = "position") -> DataFrame:
    """Speaker labels inside each window: known ids by name, other numeric ids numbered by first
    appearance, other text as it is, blank as unknown. ``rows``: channel_id, session_id, window_no, speaker."""
    key = ["session_id", "window_no"]
    clean = rows.withColumn("speaker", X.strip(F.coalesce("speaker", F.lit(""))))
    known = clean.join(names, ["channel_id", "speaker"], "left")
    unnamed = F.col("name").isNull() & F.col("speaker").rlike(r"^\d+$")
    mine = Window.partitionBy(*key, "speaker")
    # A window is limited to a few hundred words, so its rows are few.
    first = known.withColumn("__first", F.when(unnamed, F.min(order).over(mine)))
    rank = F.dense_rank().over(Window.partitionBy(*key).orderBy(F.asc_nulls_last("__first")))
    return first.withColumn("__rank", rank).withColumn(
        "label",
        F.coalesce("name", F.when(unnamed, F.concat(F.lit("unidentified speaker "), F.col("__rank")))
                   .when(F.col("speaker") == "", "unknown").otherwise(F.col("speaker"))),
    ).drop("__first", "__rank", "name")


def names_for_texts(texts: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """Texts with ``names``: the ordered (id, name) pairs whose id occurs as a whole word in the text, or
    in the name of such a pair. ``texts``: channel_id, key, text."""
    def ids_in(c: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)(?<!\w)\d+(?!\w)"), F.lit(0)))

    named = names.withColumnRenamed("name", "__name")
    ids = texts.select("channel_id", key, F.explode(ids_in(F.col(text))).alias("speaker"))
    direct = ids.join(named, ["channel_id", "speaker"])
    nested = direct.select("channel_id", key, F.explode(ids_in(F.col("__name"))).alias("speaker")).join(
        named, ["channel_id", "speaker"]
    )
    pair = F.struct(F.col("speaker").cast("bigint").alias("n"), F.col("speaker").alias("id"), F.col("__name").alias("name"))
    maps = direct.unionByName(nested).groupBy("channel_id", key).agg(
        F.array_sort(F.collect_set(pair)).alias("names")
    )
    return texts.join(maps, ["channel_id", key], "left")


def replace_speaker_ids(texts: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """Replace known speaker ids in a text column by names."""
    found = names_for_texts(texts, names, key, text)
    return found.withColumn(text, X.replace_ids(F.col(text), F.col("names"))).drop("names")


def transcript_text(assigned: DataFrame) -> DataFrame:
    """Text of every window, in utterance order. ``assigned``: session_id, window_no, position, text."""
    ordered = F.array_sort(F.collect_list(F.struct("position", F.col("text").alias("line"))))
    return assigned.groupBy("session_id", "window_no").agg(
        F.array_join(F.transform(ordered, lambda e: e["line"]), " ").alias("text")
    )
