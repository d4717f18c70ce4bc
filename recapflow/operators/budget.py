"""Model spending per session and month, caps and the decision to pause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recapflow.functions import times as TM
from recapflow.params import DEFAULTS, Params

# Reasons reported when extraction is paused.
MONTHLY_REASON = "monthly budget exceeded — extraction paused (transcription continues)"
SESSION_REASON = "session budget exceeded — extraction paused (transcription continues)"


def cost(tokens_in: Column, tokens_out: Column, p: Params = DEFAULTS) -> Column:
    return tokens_in / 1000 * p.cost_per_1k_in + tokens_out / 1000 * p.cost_per_1k_out


def costs(windows: DataFrame, summaries: DataFrame) -> DataFrame:
    """All priced calls: (session_id, created_at, cost_usd)."""
    cols = ["session_id", "created_at", "cost_usd"]
    return windows.select(*cols).unionByName(summaries.select(*cols))


def session_spend(windows: DataFrame, summaries: DataFrame) -> DataFrame:
    return costs(windows, summaries).groupBy("session_id").agg(
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("session_spend")
    )


def monthly_spend(windows: DataFrame, summaries: DataFrame) -> DataFrame:
    return (
        costs(windows, summaries)
        .groupBy(TM.month(F.col("created_at")).alias("month"))
        .agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("month_spend"))
    )


def status(sessions: DataFrame, windows: DataFrame, summaries: DataFrame, month: Column, p: Params = DEFAULTS) -> DataFrame:
    """Budget state of every session in its ``month``; a session cap of 0 is always reached, a monthly
    cap of 0 never."""
    by_month = monthly_spend(windows, summaries)
    spent = (
        sessions.select(F.col("id").alias("session_id"), month.alias("month"))
        .join(session_spend(windows, summaries), "session_id", "left")
        .join(by_month, "month", "left")
        .na.fill(0.0, ["session_spend", "month_spend"])
    )
    capped = F.lit(p.monthly_budget_usd > 0) & (F.col("month_spend") >= p.monthly_budget_usd)
    return skip(
        spent.withColumn("session_exceeded", F.col("session_spend") >= p.session_budget_usd).withColumn(
            "monthly_exceeded", capped
        )
    )


def skip(state: DataFrame) -> DataFrame:
    """Whether to pause, and why; the monthly reason comes first."""
    reason = F.when(F.col("monthly_exceeded"), MONTHLY_REASON).when(F.col("session_exceeded"), SESSION_REASON).otherwise("")
    return state.withColumn("reason", reason).withColumn("paused", F.col("reason") != "")
