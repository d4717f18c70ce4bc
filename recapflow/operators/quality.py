"""Counters over model calls and memory updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def updates(proposals: DataFrame) -> DataFrame:
    """Proposals (kind, outcome) per kind and outcome."""
    return proposals.groupBy("kind", "outcome").agg(F.count(F.lit(1)).alias("n"))


def requests(results: DataFrame) -> DataFrame:
    """Attempts per stage and outcome from result rows (stage, attempts, error_type): every attempt before
    the last one failed, the last one failed when an error is left."""
    failed = F.col("error_type").isNotNull()
    errors = F.col("attempts") - F.when(failed, 0).otherwise(1)
    pair = F.array(
        F.struct(F.lit("success").alias("outcome"), F.when(failed, 0).otherwise(1).alias("n")),
        F.struct(F.lit("error").alias("outcome"), errors.alias("n")),
    )
    return results.select("stage", F.explode(pair).alias("c")).groupBy("stage", "c.outcome").agg(F.sum("c.n").alias("n")).where("n > 0")


def errors(results: DataFrame) -> DataFrame:
    """Failed calls per stage and error type."""
    return results.where("error_type IS NOT NULL").groupBy("stage", "error_type").agg(F.count(F.lit(1)).alias("n"))
