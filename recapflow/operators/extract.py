"""Extraction of one batch of windows: budget gate, triage, context, prompt, model, accounting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recapflow.functions import text as X
from recapflow.functions import times as TM
from recapflow.operators import budget, infer
from recapflow.operators.transcript import replace_speaker_ids, utterance_line
from recapflow.params import DEFAULTS, Params


def prompts(rows: DataFrame, context: DataFrame, names: DataFrame) -> DataFrame:
    """Prompt per window from labelled rows (channel_id, window_id, position, id, t_start, t_end, label,
    speaker_conf, text) and the context; speaker ids in the context become names."""
    line = utterance_line(F.col("id"), F.col("t_start"), F.col("t_end"), F.col("label"), F.col("speaker_conf"), F.col("text"))
    spoken = rows.groupBy("channel_id", "window_id").agg(
        X.lines(F.collect_list(F.struct("position", line.alias("line")))).alias("transcript")
    )
    known = replace_speaker_ids(spoken.select("channel_id", "window_id").join(context, "window_id"), names, "window_id", "context")
    text = F.concat(F.lit("<context>\n"), F.col("context"), F.lit("\n</context>\n<transcript>\n"), F.col("transcript"), F.lit("\n</transcript>"))
    return spoken.join(known.drop("channel_id"), "window_id").select("window_id", text.alias("prompt"))


def run(windows: DataFrame, prompt_rows: DataFrame, sessions: DataFrame, summaries: DataFrame, now: Column,
        model: Callable[[], infer.Model] = infer.StubModel, idle: DataFrame | None = None, system: str = "",
        p: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(windows with results, accepted extractions (window_id, extraction)). Idle windows are marked
    skipped-idle, windows over budget failed with the reason; the model sees only the rest.

    ``windows`` is the windows table; those with status 'extracting' are handled."""
    todo = windows.where("status = 'extracting'").select(F.col("id").alias("window_id"), "session_id")
    paused = budget.status(sessions, windows, summaries, TM.month(now), p).where("paused").select("session_id", "reason")
    skipped = None if idle is None else idle.where("idle").select("window_id")
    left = todo if skipped is None else todo.join(skipped, "window_id", "left_anti")
    over = left.join(paused, "session_id").select("window_id", "reason")
    asked = infer.extract_with_repair(
        prompt_rows.join(left.join(paused, "session_id", "left_anti").select("window_id"), "window_id", "left_semi"), model, system, p
    )
    tin, tout = X.approx_tokens(F.col("prompt")), X.approx_tokens(F.coalesce("raw", F.lit("")))
    ok = F.col("status") == "done"
    results = asked.select(
        F.col("window_id").alias("id"), F.col("status").alias("r_status"), F.when(ok, F.col("raw")).alias("r_json"),
        F.when(ok, F.col("extraction.window_summary")).alias("r_summary"), F.when(ok, F.col("latency_ms")).alias("r_ms"),
        F.when(ok, tin).alias("r_in"), F.when(ok, tout).alias("r_out"), F.when(ok, budget.cost(tin, tout, p)).alias("r_cost"),
    )
    refused = over.select(F.col("window_id").alias("id"), F.lit("failed").alias("r_status"), F.to_json(F.struct(F.col("reason").alias("skipped"))).alias("r_json"))
    marks = results.unionByName(refused, allowMissingColumns=True)
    if skipped is not None:
        quiet = todo.join(skipped, "window_id", "left_semi").select(F.col("window_id").alias("id"), F.lit("skipped-idle").alias("r_status"))
        marks = marks.unionByName(quiet, allowMissingColumns=True)
    updated = windows.join(marks, "id", "left").withColumns({
        "status": F.coalesce("r_status", "status"), "extraction_json": F.coalesce("r_json", "extraction_json"),
        "window_summary": F.coalesce("r_summary", "window_summary"), "latency_ms": F.coalesce("r_ms", "latency_ms"),
        "tokens_in": F.coalesce("r_in", "tokens_in"), "tokens_out": F.coalesce("r_out", "tokens_out"), "cost_usd": F.coalesce("r_cost", "cost_usd"),
    }).select(*windows.columns)
    return updated, asked.where(ok).select("window_id", "extraction")
