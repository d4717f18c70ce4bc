"""Small helpers the operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recapflow.functions.stages import settled, shared_folder, written  # noqa: F401  the operators take them from here

SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: A table of at most this many rows may be sent to every executor; larger ones are joined through a salted shuffle.
SMALL_ROWS = 100_000
SALTS = 16


def words(text: Column) -> Column:
    """Words between runs of ASCII white space; NULL and blank texts have none."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare != "", F.split(bare, SPACE_RUN)).otherwise(F.array().cast("array<string>"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, also where ``then`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), then), 1)


def computed(df: DataFrame) -> DataFrame:
    """``df`` as the output of a generator: a later filter is not moved below it, which would compute the columns
    once for the filter and once more for the result."""
    return df.select(F.inline_outer(F.array(F.struct("*"))))


def per_process(name: str, make: Callable):
    """What ``make`` returned when a task of this worker process asked first; later tasks get the same object."""
    kept = sys.modules.setdefault("recapflow_worker_objects", types.ModuleType("recapflow_worker_objects")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def join_small(
    df: DataFrame, small: DataFrame, on: Sequence[str], rows: int, salt: Column, how: str = "inner",
    bound: int | None = None,
) -> DataFrame:
    """Join ``df`` with a table of ``rows`` rows, unique or nearly so per key. Up to ``bound`` rows (SMALL_ROWS) it is broadcast;
    beyond, it is repeated once per salt so that a key with a large share of ``df`` spreads over several tasks.
    NULL keys meet NULL keys."""
    right = small.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in small.columns])
    if rows <= (SMALL_ROWS if bound is None else bound):
        right, meet = F.broadcast(right), F.lit(True)
    else:
        right = right.withColumn("__r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        df, meet = df.withColumn("__salt", F.pmod(salt, F.lit(SALTS)).cast("int")), F.col("__salt") == F.col("__r_salt")
    for c in on:
        meet = meet & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return df.join(right, meet, how).drop("__salt", "__r_salt", *[f"__r_{c}" for c in on])
