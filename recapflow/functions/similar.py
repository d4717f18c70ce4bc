"""All pairs of names whose token-set score reaches a threshold, without comparing everything with
everything.

With d = 1 - threshold/100, a pair can only reach the threshold when
  * one side shares tokens covering the fraction k = (1-d)/(1+d) of its own length (this includes the case
    of one token set inside the other), or
  * the leftover parts are so close that the two names, padded with blanks, share at least
    (1-3d)/2 * (1+k) * L + 1 of their character bigrams, where L is either name's length.
So it is enough to look up every name by its rarest tokens (those covering more than 1-k of it) among the
tokens of the other side, and by pairs of its rarest bigrams among those of the other side. Both look-ups are
equi-joins; pairs that share too few bigrams go, and every other is scored exactly. Nothing is left out.
Thresholds of two thirds and less, where no such bound holds, compare all pairs piece by piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recapflow.functions import text as X
from recapflow.functions.fuzzy import token_set_score
from recapflow.functions.stages import settled


def token_key(name: Column) -> Column:
    """Sorted distinct tokens: all the score depends on."""
    return F.array_join(F.array_sort(F.array_distinct(X.tokens(name))), " ")


def _bigrams(key: Column) -> Column:
    """Bigrams of the blank-padded key, repeated ones told apart by a counter."""
    chars = F.split(F.concat(F.lit(" "), key, F.lit(" ")), "")
    n = F.size(chars)
    grams = F.array_sort(F.zip_with(F.slice(chars, 1, n - 1), F.slice(chars, 2, n - 1), lambda a, b: F.concat(a, b)))
    return F.transform(grams, lambda g, i: F.concat(g, (i - F.array_position(grams, g)).cast("string")))


def _ranked(items: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Items (groups, key, item, weight) with the running weight of the rarer items of the same key."""
    # A hot token sums up in the map tasks before the shuffle; only counts are exchanged.
    freq = items.groupBy(*groups, "item").agg(F.count(F.lit(1)).alias("__freq"))
    w = Window.partitionBy(*groups, "key").orderBy("__freq", "item").rowsBetween(Window.unboundedPreceding, -1)
    return (
        items.join(freq, [*groups, "item"]).withColumn("before", F.coalesce(F.sum("weight").over(w), F.lit(0)))
        .withColumn("place", F.row_number().over(Window.partitionBy(*groups, "key").orderBy("__freq", "item"))).drop("__freq")
    )


def candidates(keys: DataFrame, groups: list[str], threshold: float) -> DataFrame:
    """(groups, x, y), x < y: all pairs that can reach the threshold; ``keys`` holds distinct (groups, key)."""
    d = 1 - threshold / 100
    k = (1 - d) / (1 + d)
    share = (1 - 3 * d) / 2 * (1 + k)
    if share <= 0:
        return _all_pairs(keys, groups)
    toks = keys.select(*groups, "key", F.explode(F.split("key", " ")).alias("item")).withColumn("weight", F.length("item") + 1)
    probe = _ranked(toks, groups).where(F.col("before") <= F.length("key") * (1 - k) + 1e-6)
    covered = probe.select(*groups, F.col("key").alias("x"), "item").join(
        toks.select(*groups, F.col("key").alias("y"), "item"), [*groups, "item"]
    ).select(*groups, "x", "y")

    # A name and its partner share ``least`` bigrams, at least two; the two rarest of these are among the rarest
    # n - least + 2 of either. Pairs of bigrams are far more selective than single ones.
    least = F.ceil(F.length("key") * share + 1 - 1e-6)
    grams = keys.select(*groups, "key", F.explode(_bigrams(F.col("key"))).alias("item")).withColumn("weight", F.lit(1))
    first = _ranked(grams, groups).where(F.col("before") <= F.length("key") + 2 - least)
    rare = first.groupBy(*groups, "key").agg(F.array_sort(F.collect_list(F.struct("place", "item"))).alias("__g"))
    two = F.flatten(F.transform("__g", lambda a, i: F.transform(
        F.slice("__g", i + 2, F.size("__g")), lambda b: F.xxhash64(F.least(a["item"], b["item"]), F.greatest(a["item"], b["item"]))
    )))
    signed = rare.select(*groups, "key", F.length("key").alias("n"), F.explode(two).alias("item"))
    a, b = signed.withColumnsRenamed({"key": "x", "n": "nx"}), signed.withColumnsRenamed({"key": "y", "n": "ny"})
    close = a.join(b, [*groups, "item"]).where(
        (F.col("x") < F.col("y")) & (F.abs(F.col("nx") - F.col("ny")) <= (F.col("nx") + F.col("ny")) * d + 1e-6)
    ).select(*groups, "x", "y").distinct()
    bag = keys.select(*groups, "key", _bigrams(F.col("key")).alias("bag"))
    both = close.join(bag.withColumnsRenamed({"key": "x", "bag": "bx"}), [*groups, "x"]).join(
        bag.withColumnsRenamed({"key": "y", "bag": "by"}), [*groups, "y"]
    )
    longer = F.greatest(F.length("x"), F.length("y"))
    enough = both.where(F.size(F.array_intersect("bx", "by")) >= F.ceil(longer * share + 1 - 1e-6)).select(*groups, "x", "y")
    return covered.unionByName(enough).where("x <> y").select(
        *groups, F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")
    ).distinct()


def _all_pairs(keys: DataFrame, groups: list[str], per_piece: int = 512) -> DataFrame:
    """Every pair of a group, for thresholds of two thirds and less, which give no bound on shared bigrams. A group is
    split into pieces of about ``per_piece`` names and every two pieces meet in a task of their own."""
    sizes = keys.groupBy(*groups).agg(F.ceil(F.count(F.lit(1)) / per_piece).cast("int").alias("__p"))
    placed = keys.join(sizes, groups).withColumn("__i", F.pmod(F.xxhash64("key"), F.col("__p")).cast("int"))
    lower = placed.select(*groups, F.col("key").alias("x"), "__i", F.explode(F.sequence("__i", F.col("__p") - 1)).alias("__j"))
    upper = placed.select(*groups, F.col("key").alias("y"), F.col("__i").alias("__j"), F.explode(F.sequence(F.lit(0), "__i")).alias("__i"))
    met = lower.join(upper, [*groups, "__i", "__j"]).where((F.col("__i") < F.col("__j")) | (F.col("x") < F.col("y")))
    return met.select(*groups, F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def _scored(keys: DataFrame, groups: list[str], threshold: float) -> DataFrame:
    """(groups, x, y, score) for all x < y that reach the threshold."""
    pairs = candidates(keys, groups, threshold)
    # The planner moves a filter on a plain function below ``distinct`` and the bigram test, to every hit of every item.
    score = token_set_score.asNondeterministic()
    return pairs.withColumn("score", score("x", "y")).where(F.col("score") >= threshold)


def similar_keys(left: DataFrame, right: DataFrame, groups: Sequence[str], threshold: float) -> DataFrame:
    """(groups, key_a, key_b, score) with score >= threshold; ``left``/``right`` hold groups and ``key``
    (see ``token_key``)."""
    groups = list(groups)
    flags = left.select(*groups, "key", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*groups, "key", F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    sides = settled(flags.where("key <> ''").groupBy(*groups, "key").agg(F.max("l").alias("l"), F.max("r").alias("r")))
    scored = _scored(sides.select(*groups, "key"), groups, threshold)
    both_ways = F.array(F.struct(F.col("x").alias("key_a"), F.col("y").alias("key_b")), F.struct(F.col("y").alias("key_a"), F.col("x").alias("key_b")))
    turned = scored.select(*groups, F.explode(both_ways).alias("p"), "score").select(*groups, "p.*", "score")
    same = sides.select(*groups, F.col("key").alias("key_a"), F.col("key").alias("key_b"), F.lit(100.0).alias("score"))
    return (
        turned.unionByName(same)
        .join(sides.where("l = 1").select(*groups, F.col("key").alias("key_a")), [*groups, "key_a"], "left_semi")
        .join(sides.where("r = 1").select(*groups, F.col("key").alias("key_b")), [*groups, "key_b"], "left_semi")
    )


def similar_within(names: DataFrame, groups: Sequence[str], threshold: float) -> DataFrame:
    """Unordered pairs key_a < key_b of different keys inside a group."""
    groups = list(groups)
    keys = settled(names.select(*groups, "key").where("key <> ''").distinct())
    return _scored(keys, groups, threshold).withColumnsRenamed({"x": "key_a", "y": "key_b"})
