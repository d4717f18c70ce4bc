"""Which names occur in which texts, through an inverted index instead of a nested loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recapflow.functions import text as X
from recapflow.functions.ordered import top_n


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0))


def _pairs(words: Column) -> Column:
    n = F.size(words)
    return F.when(n > 1, F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(
        F.array().cast("array<string>")
    )


def _first(found: DataFrame, owned: DataFrame, groups: list[str], owner: str, key: str, limit: int) -> DataFrame:
    """Each text's first ``limit`` owners by ``__best``, then owner. Of a name only as many owners can be among them, and
    only names whose own first owner is, so a name that many share does not meet every text with all of its owners."""
    order = [F.desc("__best"), F.asc(owner)]
    own = top_n(owned, [*groups, "__name"], order, limit, "__at")
    ahead = own.where("__at = 1").select(*groups, "__name", "__best", owner)
    place = F.dense_rank().over(Window.partitionBy(*groups, key).orderBy(*order))
    near = found.join(ahead, [*groups, "__name"]).withColumn("__place", place).where(F.col("__place") <= limit).select(*groups, key, "__name")
    met = near.join(own, [*groups, "__name"]).withColumn("__place", place).where(F.col("__place") <= limit)
    return met.select(*groups, key, owner).distinct()


def mentions(names: DataFrame, texts: DataFrame, groups: Sequence[str], owner: str, key: str, text: str,
             best: str | None = None, limit: int = 0) -> DataFrame:
    """(groups, key, owner) for every name found in a text of its group: case-insensitive, at least two
    characters, and not inside a longer word. ``names``: groups, owner, name. ``texts``: groups, key, text.

    A name can only match where its first word stands or, for longer names, its first two words stand side by
    side (lacking words, its first two symbols). Both sides meet on (group, word or pair), so a frequent first
    word causes no extra work; names of several words are then checked once per text, whoever they belong to. ``best``: a column
    of ``names``, one value per owner; only the ``limit`` owners of each text with the greatest are then given, and the smallest of equals."""
    groups = list(groups)
    ranked = [] if best is None else [F.col(best).alias("__best")]
    cleaned = names.select(*groups, owner, X.strip(F.col("name")).alias("name"), *ranked).where(F.length("name") >= 2)
    owners = cleaned.select(*groups, F.lower("name").alias("__name"), owner, *(["__best"] if ranked else [])).distinct()
    w = F.col("__w")
    item = F.when(F.size(w) > 1, F.concat_ws(" ", w[0], w[1])).when(F.size(w) == 1, w[0]).otherwise(F.left("__name", F.lit(2)))
    wanted = owners.select(*groups, "__name").distinct().withColumn("__w", _words(F.col("__name"))).select(
        *groups, "__name", item.alias("__item"), ((F.size(w) == 1) & (w[0] == F.col("__name"))).alias("__whole")
    )
    low = texts.select(*groups, key, F.lower(text).alias("__low"))
    symbols = F.regexp_extract_all("__low", F.lit(r"(?U)(?=(\W\W))"), F.lit(1))
    items = low.withColumn("__w", _words(F.col("__low"))).select(
        *groups, key, F.explode(F.array_distinct(F.concat("__w", _pairs(F.col("__w")), symbols))).alias("__item")
    )
    hits = items.join(wanted, [*groups, "__item"]).select(*groups, key, "__name", "__whole")
    pattern = F.concat(F.lit(r"(?iU)(?<!\w)"), X.quote_regex(F.col("__name")), F.lit(r"(?!\w)"))
    checked = hits.where(~F.col("__whole")).join(low, [*groups, key]).where(F.contains("__low", "__name") & F.regexp_like("__low", pattern))
    found = hits.where("__whole").select(*groups, key, "__name").unionByName(checked.select(*groups, key, "__name"))
    if best is not None:
        return _first(found, owners, groups, owner, key, limit)
    return found.join(owners, [*groups, "__name"]).select(*groups, key, owner).distinct()
