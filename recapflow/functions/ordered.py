"""Order-dependent building blocks that stay parallel inside one key.

A plain window over a key puts all rows of that key into one task. Sessions and channels can be very
uneven, so everything here works on (key, bucket) pieces, where ``bucket`` is an expression that grows
with the order (an hour of stream time, a block of ids). Only one small row per bucket ever meets the
other buckets of its key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

_BUCKET = "__bucket"


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key. The filter on the row number lets Spark cut every map task to ``n`` rows
    per key before the shuffle, so a hot key moves ``n`` rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def id_block(column: str, size: int = 65536) -> Column:
    return F.floor(F.col(column) / F.lit(size))


def time_block(column: str, seconds: float = 3600.0) -> Column:
    return F.floor(F.col(column) / F.lit(float(seconds)))


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str, bucket: Column
) -> DataFrame:
    """Inclusive running sum per key: prefix sums inside buckets plus the total of the earlier buckets."""
    pieces = df.withColumn(_BUCKET, bucket).withColumn("__value", value)
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    totals = pieces.groupBy(*keys, _BUCKET).agg(F.sum("__value").alias("__total"))
    offsets = totals.select(*keys, _BUCKET, F.sum("__total").over(before).alias("__offset"))
    local = pieces.withColumn(out, F.sum("__value").over(inside))
    return (
        local.join(offsets, [*keys, _BUCKET])
        .withColumn(out, F.col(out) + F.coalesce(F.col("__offset"), F.lit(0)))
        .drop(_BUCKET, "__value", "__offset")
    )


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, bucket: Column) -> DataFrame:
    """1-based position of every row inside its key."""
    return running_sum(df, keys, order, F.lit(1), out, bucket)


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], out: str, bucket: Column
) -> DataFrame:
    """Struct of ``fields`` of the preceding row of the key (NULL for the first row)."""
    pieces = df.withColumn(_BUCKET, bucket)
    row = F.struct(*fields)
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(_BUCKET)
    lasts = pieces.groupBy(*keys, _BUCKET).agg(F.max_by(row, F.struct(*order)).alias("__last"))
    carried = lasts.select(*keys, _BUCKET, F.lag("__last").over(across).alias("__carry"))
    return (
        pieces.withColumn("__prev", F.lag(row).over(inside))
        .join(carried, [*keys, _BUCKET])
        .withColumn(out, F.coalesce("__prev", "__carry"))
        .drop(_BUCKET, "__prev", "__carry")
    )


def last_before(
    left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, bucket: Column,
    back: str = "back",
) -> DataFrame:
    """For every left row the last ``n`` right rows strictly before it: one output row per match, with
    ``back`` = 1 for the nearest. Both sides carry ``keys`` and ``order``; other columns are kept.

    Both sides are sorted together inside (key, bucket) pieces, where a left row looks back at the right rows before it. A
    piece hands its last ``n`` right rows on to the later pieces of its key. Each row is shuffled once; each side
    gets a shuffle of its own, so that the sort does not share a task with the work that made the rows."""
    lcols = [c for c in left.columns if c not in keys and c not in order]
    rcols = [c for c in right.columns if c not in keys and c not in order]
    base, place = [*keys, *order], [*keys, _BUCKET]
    held = [f"__l{i}" for i in range(len(lcols))]
    known = reduce(and_, [F.col(c).isNotNull() for c in place])
    lhs = left.select(*base, *[F.col(c).alias(h) for c, h in zip(lcols, held)]).withColumn(_BUCKET, bucket).where(known)
    rhs = right.select(*base, F.struct(*rcols).alias("__r")).withColumn(_BUCKET, bucket).where(known).repartition(*place)
    pieces = lhs.repartition(*place).unionByName(rhs, allowMissingColumns=True)

    def back_by(column: str, w: WindowSpec) -> Column:
        """The last ``n`` values before a row, nearest first; rows without one are passed over."""
        return F.array_compact(F.array(*[F.expr(f"lag({column}, {k}) IGNORE NULLS").over(w) for k in range(1, n + 1)]))

    near = back_by("__r", Window.partitionBy(*place).orderBy(*order, F.col("__r").isNotNull()))
    local = pieces.withColumn("__near", near).where("__r IS NULL").drop("__r")
    ends = top_n(rhs, place, [F.desc(c) for c in order], n, "__rank").select(*place, "__rank", "__r")
    asked = lhs.select(*place).distinct()
    nearest = F.array_sort(F.collect_list(F.when(F.col("__rank").isNotNull(), F.struct("__rank", "__r"))), lambda a, b: a["__rank"] - b["__rank"])
    steps = ends.unionByName(asked, allowMissingColumns=True).groupBy(*place).agg(F.transform(nearest, lambda e: e["__r"]).alias("__ends"))
    steps = steps.withColumn("__ends", F.when(F.size("__ends") > 0, F.col("__ends")))
    earlier = F.slice(F.flatten(back_by("__ends", Window.partitionBy(*keys).orderBy(_BUCKET))), 1, n)
    carried = steps.select(*place, earlier.alias("__earlier"))
    found = F.slice(F.concat("__near", "__earlier"), 1, n)
    typed = [F.col(c).cast(left.schema[c].dataType).alias(c) for c in base]
    told = local.hint("merge").join(carried, place).select(*typed, *[F.col(h).alias(c) for h, c in zip(held, lcols)], F.posexplode(found).alias("__pos", "__r"))
    return told.select(*base, *lcols, (F.col("__pos") + 1).cast("bigint").alias(back), *[F.col(f"__r.{c}").alias(c) for c in rcols])
