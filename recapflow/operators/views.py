"""Plain projections offered to readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recapflow.sources.channels import channel_config


def entities(df: DataFrame) -> DataFrame:
    return df.select("channel_id", "id", F.col("canonical_name").alias("name"), "type", "status")


def threads(df: DataFrame) -> DataFrame:
    return df.select("channel_id", "id", "title", "status")


def channels(df: DataFrame) -> DataFrame:
    return channel_config(df).select(
        "id", "login", F.col("config.content_profile").alias("content_profile"), F.coalesce("config.auto_monitor", F.lit(False)).alias("auto_monitor")
    )


def events(df: DataFrame) -> DataFrame:
    """Sort by (session_id, t_start) to present."""
    return df.select("session_id", "id", "t_start", "description", "importance", "thread_id")


def session(df: DataFrame) -> DataFrame:
    return df.select("id", "status", "title", "category", "last_error", "last_error_at", "started_at", "ended_at", "final_summary")
