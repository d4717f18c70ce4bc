"""State tables: read with the declared schema, write laid out for access by session and time, conform
older layouts, and the two keyed write rules (upsert, insert if absent)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recapflow.functions.ordered import ordinal
from recapflow.schemas import TABLES, table_schema

_LAYOUT = {
    "segments": ("session_id", ["t_start", "id"]),
    "plot_beats": ("session_id", ["run_label", "hour_index", "id"]),
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read a table with its declared schema; columns absent from older files come back as NULL."""
    return spark.read.schema(table_schema(name)).parquet(f"{root}/{name}")


def conform(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Add the missing columns as NULL, cast the others, keep the declared order."""
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    )


def layout(df: DataFrame, name: str) -> DataFrame:
    """Range partitions on (session, time): one session's rows sit together and in order, so row groups can
    be skipped, while a very large session still spreads over many files."""
    if name in _LAYOUT:
        key, order = _LAYOUT[name]
    else:
        key = next((c for c in ("session_id", "channel_id", "entity_id", "event_id", "speaker_id") if c in df.columns), None)
        order = [c for c in ("id",) if c in df.columns]
    by = [c for c in [key, *order] if c]
    return df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df


def write_table(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    layout(conform(df, TABLES[name]), name).write.mode(mode).parquet(f"{root}/{name}")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keyed merge, last write wins; ``order`` ranks competing new rows, the latest last.

    New rows are reduced first, then replace old rows by an anti-join, so old rows are not sorted."""
    cols = old.columns
    winner = F.max_by(F.struct(*cols), F.struct(*order)).alias("row")
    latest = new.groupBy(*keys).agg(winner).select("row.*")
    return old.join(latest.select(*keys), list(keys), "left_anti").select(*cols).unionByName(latest)


def insert_new(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """The rows of ``new`` whose key is not present yet, one per key (the first in ``order``)."""
    cols = new.columns
    rank = F.struct(*(order or [F.col(c) for c in cols if c not in keys] or [F.lit(1)]))
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*cols), rank).alias("row")).select("row.*")
    return first.join(old.select(*keys), list(keys), "left_anti").select(*cols)


def next_ids(df: DataFrame, order: Sequence[str], bucket: Column, start: int = 0, out: str = "id") -> DataFrame:
    """Consecutive ids in ``order`` after ``start``; only one row per ``bucket`` is ever gathered."""
    return ordinal(df, [], order, out, bucket).withColumn(out, (F.col(out) + start).cast("bigint"))
