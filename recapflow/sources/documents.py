"""Nested JSON documents: model extractions, beat proposals, gold files and JSON text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recapflow.schemas import BEATS, EXTRACTION, GOLD

# Fixed value: the longest list of beats a reply may hold.
MAX_BEATS = 4


def unfence(c: Column) -> Column:
    """Body of the first code fence, without a leading ``json`` tag; unfenced text stays as it is."""
    body = F.trim(F.coalesce(F.try_element_at(F.split(c, "```"), F.lit(2)), c))
    return F.when(F.contains(c, F.lit("```")), F.trim(F.ltrim(body, F.lit("json")))).otherwise(c)


def parse_extraction(df: DataFrame, raw: str = "raw", out: str = "extraction") -> DataFrame:
    """Model text to the extraction struct; NULL when it is not valid JSON of that shape. The struct ends with
    an extra ``broken`` field, which holds unreadable text while parsing and is NULL in every kept document. It comes out of a
    generator: the planner copies a plain expression into every filter and check that reads it, and each copy parses again."""
    schema = EXTRACTION[:-1] + ", broken: STRING>"
    doc = F.from_json(unfence(F.col(raw)), schema, {"columnNameOfCorruptRecord": "broken"})
    kept = df.drop(out) if out in df.columns else df
    return kept.select("*", F.explode_outer(F.filter(F.array(doc), lambda d: d["broken"].isNull())).alias(out))


def parse_beats(df: DataFrame, raw: str = "raw", out: str = "proposal") -> DataFrame:
    """Model text to the beats struct; NULL when it is not valid JSON of that shape or breaks a rule: at most MAX_BEATS
    beats, each with a headline, a significance of 1 to 5 and event ids. A document without beats is valid."""
    doc = F.from_json(unfence(F.col(raw)), BEATS[:-1] + ", broken: STRING>", {"columnNameOfCorruptRecord": "broken"})
    complete = lambda b: b["headline"].isNotNull() & b["significance"].between(1, 5) & b["event_ids"].isNotNull()

    def fits(d: Column) -> Column:
        beats = F.coalesce(d["beats"], F.array())
        return d["broken"].isNull() & (F.size(beats) <= MAX_BEATS) & F.forall(beats, lambda b: F.coalesce(complete(b), F.lit(False)))

    return df.withColumn(out, F.filter(F.array(doc), lambda d: d.isNotNull() & fits(d))).withColumn(out, F.try_element_at(out, F.lit(1)))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold files, one JSON document each, with the file name."""
    return spark.read.schema(GOLD).json(path, multiLine=True).withColumn("file", F.input_file_name())
