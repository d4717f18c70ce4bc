"""Vector code compression: every part of a vector becomes the number of its nearest codebook entry.

Components are integers, floor(1024 x), so that sums and distances are exact. Distances use value dictionaries: per
dimension the distinct integers of a batch, and a table with the squared difference of each to every entry. The distance of
a part to all entries is then one gathered table row per dimension, added up; no multiplication is repeated for
a value that occurs again. Dictionaries and tables belong to a batch, so their size does not grow with the data.

Fitting is a number of rounds: tasks sum their vectors per (part, entry), Spark adds the sums, and the driver holds the
codebooks alone, PARTS * ENTRIES short vectors.

Vectors that are NULL, empty, or hold a NULL or non-finite component are left out, and so are those whose length is not that of
the first vector by id. Integers beyond +-2**25 count as that bound, which keeps distances inside 64 bits. A length that PARTS
does not divide is filled up with zeros. Of equal ids the smaller vector is first; NULL ids come last. With fewer vectors than ENTRIES
the codebooks have one entry per vector; without vectors the result has no rows. Ties go to the lower entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recapflow.llm import common

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BOUND = 2**25
#: Parts whose distances are worked out together; they and the gathered rows stay in the processor's cache.
_TOGETHER = 256


def integers(vector: Column) -> Column:
    """Components as integers; NULL for a vector that is left out."""
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(float(-BOUND))), F.lit(float(BOUND)))).cast("int"))
    return F.when((F.size(vector) > 0) & fit, whole)


def prepare(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, row, v) per vector that is kept, as a table: the other columns in ``row``, the integers in ``v``."""
    rest = F.struct(F.lit(0).alias("__none"), *[F.col(c) for c in vectors.columns if c not in (id, vector)])
    found = vectors.select(F.col(id).alias("id"), rest.alias("row"), integers(F.col(vector)).alias("v")).where("v IS NOT NULL")
    found = common.written(found)
    first = found.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v")).first()
    return found.where(F.size("v") == (first[0] if first else 0))


def _parts(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a batch as (vector, PARTS * width), filled up with zeros."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int32)
    if flat.shape[1] == PARTS * width:
        return flat
    out = np.zeros((n, PARTS * width), np.int32)
    out[:, :flat.shape[1]] = flat
    return out


def _dictionary(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and the place of each value among them."""
    low, high = int(values.min()), int(values.max())
    if high - low > 8 * len(values) + 1024:
        distinct, codes = np.unique(values, return_inverse=True)
        return distinct, codes.reshape(-1)
    there = np.zeros(high - low + 1, bool)
    there[values - low] = True
    place = np.cumsum(there) - 1
    return np.flatnonzero(there) + low, place[values - low]


def nearest(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance per (vector, part). ``books`` is (part, entry, component)."""
    n, (n_parts, entries, width) = len(parts), books.shape
    code, error = np.zeros((n, n_parts), np.int64), np.zeros((n, n_parts), np.int64)
    if n == 0:
        return code, error
    for p in range(n_parts):
        mine = parts[:, p * width:(p + 1) * width].astype(np.int64)
        reach = max(int(mine.max()) - int(books[p].min()), int(books[p].max()) - int(mine.min()))
        kind = np.int32 if reach * reach * width < 2**31 else np.int64
        tables, places = [], []
        for d in range(width):
            distinct, at = _dictionary(mine[:, d])
            gap = distinct[:, None] - books[p, :, d][None, :]
            tables.append((gap * gap).astype(kind))
            places.append(at)
        total, row = np.empty((_TOGETHER, entries), kind), np.empty((_TOGETHER, entries), kind)
        for start in range(0, n, _TOGETHER):
            stop = min(start + _TOGETHER, n)
            sums, more = total[:stop - start], row[:stop - start]
            np.take(tables[0], places[0][start:stop], axis=0, out=sums, mode="clip")
            for d in range(1, width):
                np.take(tables[d], places[d][start:stop], axis=0, out=more, mode="clip")
                sums += more
            best = sums.argmin(axis=1)
            code[start:stop, p] = best
            error[start:stop, p] = sums[np.arange(stop - start), best]
    return code, error


def _sums(books: np.ndarray):
    """Per task, the sum of every component and the number of vectors of each (part, entry) that has some."""
    n_parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_parts, entries, width + 1), np.int64)
        for batch in batches:
            vectors = _parts(batch.column(0), width)
            code, _ = nearest(vectors, books)
            for p in range(n_parts):
                order = np.argsort(code[:, p], kind="stable")
                used, first = np.unique(code[order, p], return_index=True)
                if len(used):
                    mine = vectors[order, p * width:(p + 1) * width].astype(np.int64)
                    total[p, used, :width] += np.add.reduceat(mine, first, axis=0)
                    total[p, used, width] += np.diff([*first, len(order)])
        part, entry = np.nonzero(total[:, :, width])
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "sums"]
        )

    return run


def fit(prepared: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component): the parts of the first vectors by id, then moved to the floor of the mean of
    the parts nearest to them, ``rounds`` times; entries that no part is nearest to stay."""
    first = [r[0] for r in prepared.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    width = -(-max(map(len, first), default=0) // PARTS)
    start = np.zeros((len(first), PARTS * width), np.int64)
    for k, v in enumerate(first):
        start[k, :len(v)] = v
    books = start.reshape(len(first), PARTS, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if first else 0):
        sums = prepared.select("v").mapInArrow(_sums(books), "part int, entry int, sums array<bigint>")
        cells = sums.select("part", "entry", F.posexplode("sums").alias("at", "n")).groupBy("part", "entry", "at").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n"))
        found = np.zeros((PARTS, len(first), width + 1), object)
        for part, entry, at, n in cells.toLocalIterator():
            found[part, entry, at] = int(n)
        used = found[:, :, width] > 0
        books[used] = (found[:, :, :width][used] // found[:, :, width][used][:, None]).astype(np.int64)
    return books


def encode(prepared: DataFrame, books: np.ndarray) -> DataFrame:
    """Adds ``code``, one byte per part, and ``error``, the squared distance to the entries of the code."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = nearest(_parts(batch.column("v"), width), books)
            said = code.astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), pa.array([x.tobytes() for x in said], pa.binary()), pa.array(error.sum(axis=1), pa.int64())],
                names=["id", "row", "code", "error"],
            )

    kept = prepared.select("id", "row").schema
    schema = T.StructType([*kept.fields, T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    return prepared.select("id", "row", "v").mapInArrow(run, schema)


def digest(books: np.ndarray) -> str:
    """Hash of all components as decimal numbers, by part, entry and place, between commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) per kept vector; ``label_error`` is the error of all vectors of
    its label, NULL labels together, and NULL where it passes 64 bits."""
    prepared = prepare(vectors, id, vector)
    books = fit(prepared)
    coded = common.written(encode(prepared, books).select("id", F.col("row")[label].alias("label"), "code", "error"))
    sums = common.written(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("n")))
    sums = sums.select("label", F.expr("try_cast(n AS bigint)").alias("label_error"))
    met = common.join_small(coded, sums, ["label"], sums.count(), F.xxhash64("id", "code"))
    return met.select(
        F.col("id").alias(id), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
