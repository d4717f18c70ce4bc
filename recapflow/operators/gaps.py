"""Holes in the recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recapflow.functions import times as TM
from recapflow.functions.ordered import previous, time_block
from recapflow.params import DEFAULTS, Params


def detect(pieces: DataFrame, min_gap: float = 0.0, chunk_seconds: float = 3600.0) -> DataFrame:
    """Gap rows between consecutive pieces (session_id, t_start, t_end, reason) of a session."""
    rows = previous(pieces, ["session_id"], ["t_start", "t_end"], ["t_end", "reason"], "before", time_block("t_start", chunk_seconds))
    return rows.where(F.col("t_start") - F.col("before.t_end") > min_gap).select(
        "session_id", F.col("before.t_end").alias("t_start"), F.col("t_start").alias("t_end"),
        F.col("before.reason").alias("reason"),
    )


def unobserved(windows: DataFrame, now: Column, p: Params = DEFAULTS) -> DataFrame:
    """Sessions whose last window closed longer ago than the threshold."""
    last = windows.groupBy("session_id").agg(F.max("created_at").alias("last"))
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    return last.where(TM.seconds_between(now, F.col("last")) > p.unobserved_gap_seconds).select(
        "session_id", F.lit(0.0).alias("t_start"), F.lit(0.0).alias("t_end"),
        F.concat(F.lit("unobserved worker-down "), F.date_format("last", iso), F.lit(".."), F.date_format(now, iso)).alias("reason"),
    )
