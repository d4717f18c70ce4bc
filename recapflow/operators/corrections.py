"""Manual corrections of entities and storylines, with an audit trail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEEP_NULLS = {"ignoreNullFields": "false"}


def _patch(table: DataFrame, edits: DataFrame, kind: str, fields: dict[str, str], blank_keeps: set[str]) -> tuple[DataFrame, DataFrame]:
    new = edits.select("id", *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__edit"))
    joined = table.join(new, "id", "left")

    def value(f: str):
        given = F.nullif(f"__{f}", F.lit("")) if f in blank_keeps else F.col(f"__{f}")
        return F.coalesce(given, F.col(f))

    audit = joined.where("__edit").select(
        F.lit(kind).alias("target_type"), F.col("id").alias("target_id"),
        F.to_json(F.struct(*[F.col(f).alias(label) for f, label in fields.items()]), _KEEP_NULLS).alias("before_json"),
        F.to_json(F.struct(*[value(f).alias(label) for f, label in fields.items()]), _KEEP_NULLS).alias("after_json"),
    )
    return joined.withColumns({f: value(f) for f in fields}).select(*table.columns), audit


def patch_entities(entities: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, audit rows) after edits (id, canonical_name, description); NULL keeps a value."""
    return _patch(entities, edits, "entity", {"canonical_name": "name", "description": "description"}, {"canonical_name"})


def patch_threads(threads: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(threads, audit rows) after edits (id, status, title); NULL or '' keeps a value."""
    return _patch(threads, edits, "thread", {"status": "status", "title": "title"}, {"status", "title"})
