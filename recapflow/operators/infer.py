"""Hooks for user-supplied models. A model is made once per partition by a picklable factory and fed Arrow
batches; attempts, errors and latency come back as columns. Deterministic stubs stand in by default."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recapflow.functions.stages import settled
from recapflow.operators.guards import is_empty, problems
from recapflow.params import DEFAULTS, Params
from recapflow.sources.documents import parse_extraction

# Fixed values of the stub models.
STUB_TEXT = "Stub summary (no LLM configured)."
STUB_DIM = 384
STUB_WORD_SECONDS = 0.4
STUB_WORD_LENGTH = 0.35
STUB_WORD_PROB = 0.99

# Default requests added when an extraction has to be asked for again.
NUDGE = "\nThe last answer was empty although the transcript contains speech: give a short factual window_summary; lists may stay empty."
REPAIR = "\nAnswer with one valid JSON document of the required shape and nothing else."

_RESULT = [
    T.StructField("raw", T.StringType()), T.StructField("error_type", T.StringType()),
    T.StructField("attempts", T.IntegerType()), T.StructField("latency_ms", T.LongType()),
]


class Model(Protocol):
    def generate_json(self, prompt: str, system: str) -> str: ...

    def generate_text(self, prompt: str, system: str, max_tokens: int) -> str: ...


class Classifier(Protocol):
    def ask(self, state: str, questions: str) -> str: ...


class StubModel:
    """Fixed minimal extraction and fixed text."""

    def generate_json(self, prompt: str, system: str = "") -> str:
        return json.dumps({
            "utterance_attributions": [], "entity_updates": [], "thread_updates": [], "events": [],
            "window_summary": STUB_TEXT, "open_questions": [],
        })

    def generate_text(self, prompt: str, system: str = "", max_tokens: int = 500) -> str:
        return STUB_TEXT


def with_retry(call: Callable[[], str], retries: int, backoff: float) -> tuple[str | None, str | None, int]:
    """(answer, error type, attempts); waits backoff * 2^n between attempts."""
    error = None
    for attempt in range(max(0, retries) + 1):
        if attempt and backoff > 0:
            time.sleep(backoff * 2 ** (attempt - 1))
        try:
            return call(), None, attempt + 1
        except Exception as exc:  # any provider failure becomes a result row
            error = type(exc).__name__[:80]
    return None, error, max(0, retries) + 1


def _apply(df: DataFrame, factory: Callable[[], object], call: Callable[[object, dict], str], inputs: list[str], p: Params) -> DataFrame:
    keep = [f for f in df.schema.fields if f.name not in {x.name for x in _RESULT}]
    names = [f.name for f in keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            model = model or factory()
            results = []
            for row in pdf[inputs].to_dict("records"):
                began = time.monotonic()
                got = with_retry(lambda r=row: call(model, r), p.model_retries, p.model_backoff_seconds)
                results.append((*got, int((time.monotonic() - began) * 1000)))
            extra = pd.DataFrame(results, columns=[x.name for x in _RESULT], index=pdf.index)
            yield pd.concat([pdf, extra], axis=1)

    return df.select(*names).mapInPandas(run, T.StructType([*keep, *_RESULT]))


def run(df: DataFrame, factory: Callable[[], Model] = StubModel, prompt: str = "prompt", kind: str = "text",
        system: str = "", max_tokens: int = 500, p: Params = DEFAULTS) -> DataFrame:
    """Ask the model once per row; adds ``raw``, ``error_type``, ``attempts``, ``latency_ms``."""
    def call(model: Model, row: dict) -> str:
        if kind == "json":
            return model.generate_json(row[prompt], system)
        return model.generate_text(row[prompt], system, max_tokens)

    return _apply(df, factory, call, [prompt], p)


def classify(df: DataFrame, factory: Callable[[], Classifier], state: str = "state", questions: str = "questions", p: Params = DEFAULTS) -> DataFrame:
    """One fan-out question set per row; the answers arrive as JSON text in ``raw``."""
    return _apply(df, factory, lambda m, row: m.ask(row[state], row[questions]), [state, questions], p)


def extract_with_repair(df: DataFrame, factory: Callable[[], Model] = StubModel, system: str = "", p: Params = DEFAULTS) -> DataFrame:
    """Extraction documents for ``prompt``: a valid but empty answer is asked for once more, a failed or
    invalid one is asked for once more as plain JSON. Adds ``extraction``, ``status`` (done / failed).
    Every pass only calls the model for the rows still open and is settled, parsed and judged, before it is split."""
    base = df.columns

    def ask(rows: DataFrame, suffix: str) -> DataFrame:
        asked = run(rows.withColumn("__p", F.concat("prompt", F.lit(suffix))), factory, "__p", "json", system, p=p)
        ext = F.col("extraction")
        return settled(parse_extraction(asked).drop("__p").withColumns({"__ok": F.size(problems(ext)) == 0, "__empty": is_empty(ext)}))

    first = ask(df, "")
    done = first.where(F.col("__ok") & ~F.col("__empty"))
    nudged = ask(first.where(F.col("__ok") & F.col("__empty")).select(*base), NUDGE)
    bad = first.where(~F.col("__ok")).select(*base).unionByName(nudged.where(~F.col("__ok")).select(*base))
    repaired = ask(bad, REPAIR)
    rest = repaired.withColumn("extraction", F.when(F.col("__ok"), F.col("extraction")))
    every = done.unionByName(nudged.where("__ok")).unionByName(rest)
    return every.withColumn("status", F.when(F.col("__ok"), "done").otherwise("failed")).drop("__ok", "__empty")


def stub_words(segments: DataFrame) -> DataFrame:
    """Stub recogniser: one word every 0.4 s. ``segments``: segment_id, t_start, seconds."""
    n = F.greatest(F.lit(1), F.floor(F.col("seconds") / STUB_WORD_SECONDS))
    at = F.col("t_start") + F.col("i") * STUB_WORD_SECONDS
    return (
        segments.where("seconds > 0")
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
        .select("segment_id", "i", F.concat(F.lit("word"), F.col("i")).alias("text"), at.alias("t_start"),
                F.least(at + STUB_WORD_LENGTH, F.col("t_start") + F.col("seconds")).alias("t_end"),
                F.lit(STUB_WORD_PROB).alias("prob"))
    )


def stub_embedding(samples: Column) -> Column:
    """Stub voice embedding: a unit vector seeded by the mean amplitude."""
    def embed(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            mean = float(np.mean(np.asarray(x, dtype="float32"))) if len(x) else 0.0
            v = np.random.default_rng(int(abs(mean * 1e6) % 2**31)).normal(size=STUB_DIM)
            out.append((v / (np.linalg.norm(v) + 1e-9)).astype("float32"))
        return pd.Series(out)

    return F.pandas_udf(embed, T.ArrayType(T.FloatType()), F.PandasUDFType.SCALAR)(samples)


def map_vectors(df: DataFrame, fn: Callable[[pd.Series], pd.Series], source: str, out: str = "embedding") -> DataFrame:
    """Hook for a user's embedding model: Arrow batches of samples in, ARRAY<FLOAT> out."""
    return df.withColumn(out, F.pandas_udf(fn, T.ArrayType(T.FloatType()), F.PandasUDFType.SCALAR)(F.col(source)))


def transcribe(df: DataFrame, factory: Callable[[], object], samples: str = "samples") -> DataFrame:
    """Hook for a user's recogniser with ``transcribe(samples, t_start) -> [(text, start, end, prob)]``."""
    schema = "segment_id BIGINT, text STRING, t_start DOUBLE, t_end DOUBLE, prob DOUBLE"

    def run_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in batches:
            rows = [
                (seg, *word)
                for seg, t0, x in zip(pdf["segment_id"], pdf["t_start"], pdf[samples])
                for word in model.transcribe(np.asarray(x, dtype="float32"), t0)
            ]
            yield pd.DataFrame(rows, columns=["segment_id", "text", "t_start", "t_end", "prob"])

    return df.select("segment_id", "t_start", samples).mapInPandas(run_, schema)
