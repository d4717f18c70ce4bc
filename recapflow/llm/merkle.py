"""Merkle dataset manifest: a tree of hashes per group of rows and one over the groups, by time-forward processing.

A leaf is the hash of a row. Leaves of a group stand in the order of their ids; every FAN consecutive nodes (the last
run: fewer) become their parent until one is left, the group's root, and the roots of the groups form a tree likewise.

Both sweeps visit nodes by label (group, last leaf position below, height), which puts every node behind all of its
children. Forward, a priority queue ordered by label holds the digests children send to their parents; whoever is
first in the queue has all its messages there, is hashed, and sends on. Backward, labels descend: a parent takes the proof
above it from the queue and sends each child that proof with the digests of the child's siblings. With these labels at most
FAN messages wait per height. The queue's external part is Spark's: nodes are dealt to tasks in blocks of FAN**HEIGHTS aligned positions,
sorted by label outside memory, streamed through, and the tops of the blocks are the next round's nodes.

A hot group is many blocks. Positions come from a range partitioning by (group, id) and one count per partition and group.
Every NULL cell is hashed as ``-``; rows without a group form one, first in order; rows without an id come first in their
group; equal ids are ordered by leaf, and equal rows are equal leaves next to each other. Long texts are hashed in the task that
reads them and do not travel. A table without rows gives none. Only the named columns are looked at.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recapflow.llm import common

FAN = 16
#: Heights that one round of a sweep climbs; a block has FAN ** HEIGHTS positions.
HEIGHTS = 3
_BITS = FAN.bit_length() - 1
_HEX = 64


def leaf(cells: Sequence[Column]) -> Column:
    """Hash of a row: per cell ``-`` for NULL, else the length in bytes, a colon and the value as text."""
    def said(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(said, cells)), 256)


def fold(digest: Column, proof: Column) -> Column:
    """Root that a leaf and its proof give."""
    def up(below: Column, step: Column) -> Column:
        cut = step["place"] * _HEX
        return F.sha2(F.concat(F.substr(step["siblings"], F.lit(1), cut), below, F.substr(step["siblings"], cut + 1)), 256)

    return F.aggregate(proof, digest, up)


def _numbered(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Adds ``pos``, the place of a row in its group, ``size`` of the group, and keeps all columns of ``df``."""
    ordered = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    marked = common.written(ordered.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    pieces = marked.groupBy(F.col(group).alias("__group"), part.alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    whole = Window.partitionBy("__group")
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumns({"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), "size": F.sum("__n").over(whole)})
    met = marked.join(pieces, F.col(group).eqNullSafe(F.col("__group")) & (part == F.col("__part")))
    return met.select(*df.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias("pos"), "size")


def _heights(size: Column) -> Column:
    """Heights above ``size`` leaves."""
    return F.when(size <= 1, 0).otherwise(F.floor((F.length(F.bin(size - 1)) + _BITS - 1) / _BITS)).cast("int")


def _end(pos: int, height: int) -> int:
    return ((pos + 1) << (_BITS * height)) - 1


_NODE = "tree bigint, height int, pos bigint, digest string, children string, climb int, left int"


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inner nodes of blocks from their nodes (tree, pos, digest, climb, left), which come ordered by label."""
    queue: list[tuple] = []
    out: list[tuple] = []

    def settle(before: tuple | None) -> None:
        while queue and (before is None or queue[0][:3] < before):
            tree, end, height = label = queue[0][:3]
            children = []
            while queue and queue[0][:3] == label:
                *_, digest, climb, left = heapq.heappop(queue)
                children.append(digest)
            said = "".join(children)
            digest, pos = hashlib.sha256(said.encode()).hexdigest(), end >> (_BITS * height)
            out.append((tree, height, pos, digest, said, climb, left))
            if height < climb:
                heapq.heappush(queue, (tree, _end(pos >> _BITS, height + 1), height + 1, pos, digest, climb, left))

    def flush() -> pa.RecordBatch:
        types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        names = [x.split()[0] for x in _NODE.split(", ")]
        columns = list(zip(*out, strict=True)) or [[] for _ in types]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    for batch in batches:
        for tree, pos, digest, climb, left in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            settle((tree, pos, 0))
            heapq.heappush(queue, (tree, _end(pos >> _BITS, 1), 1, pos, digest, climb, left))
        yield flush()
    settle(None)
    yield flush()


def _up(nodes: DataFrame) -> list[DataFrame]:
    """Rounds of inner nodes above ``nodes`` (tree, pos, digest, left), ``left`` being the heights still above them."""
    rounds = []
    todo = nodes.agg(F.max("left")).first()[0] or 0
    for _ in range(-(-todo // HEIGHTS)):
        climb = F.least("left", F.lit(HEIGHTS)).cast("int")
        rows = nodes.where("left > 0").select("tree", "pos", "digest", climb.alias("climb"), "left")
        block = F.expr(f"shiftright(pos, climb * {_BITS})")
        dealt = rows.repartition("tree", block).sortWithinPartitions("tree", "pos")
        inner = common.written(dealt.mapInArrow(_forward, _NODE))
        rounds.append(inner)
        nodes = inner.where("height = climb").select("tree", "pos", "digest", (F.col("left") - F.col("climb")).alias("left"))
    return rounds


def _roots(nodes: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """(tree, root): the one node of every tree that has no heights left above it."""
    tops = nodes.where("left = 0").select("tree", F.col("digest").alias("root"))
    for inner in rounds:
        tops = tops.unionByName(inner.where("height = climb AND left = climb").select("tree", F.col("digest").alias("root")))
    return tops


_PROOF = "array<struct<place: int, siblings: string>>"
_PROOF_ARROW = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.string())]))


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proofs of base rows. Columns (kind, tree, end, height, pos, children, proof, row), ordered by descending label; kind 0 is the
    proof above a block, 1 an inner node, 2 a base row."""
    queue: list[tuple] = []
    for batch in batches:
        kind, tree, end, height, pos, children, proof = (batch.column(k).to_pylist() for k in range(7))
        rows, proofs = [], []
        for k in range(batch.num_rows):
            label = (-tree[k], -end[k], -height[k])
            if kind[k] == 0:
                above = None
                for step in reversed(proof[k]):
                    above = (step["place"], step["siblings"], above)
                heapq.heappush(queue, (*label, 0, above))
                continue
            *at, _, above = heapq.heappop(queue)
            if tuple(at) != label:
                raise RuntimeError("a node without the proof above it")
            if kind[k] == 2:
                steps = []
                while above:
                    steps.append({"place": above[0], "siblings": above[1]})
                    above = above[2]
                rows.append(k)
                proofs.append(steps)
                continue
            said, below = children[k], height[k] - 1
            for place in range(len(said) // _HEX):
                child = (pos[k] << _BITS) + place
                siblings = said[:place * _HEX] + said[(place + 1) * _HEX:]
                heapq.heappush(queue, (-tree[k], -_end(child, below), -below, place, (place, siblings, above)))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(pa.array(rows, pa.int64())) for c in (1, 4, 7)), pa.array(proofs, _PROOF_ARROW)], names=["tree", "pos", "row", "proof"]
        )


def _down(base: DataFrame, rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, pos, row, proof) for the rows of ``base`` (tree, pos, left, row), from ``tops`` (tree, proof): the proofs
    above the roots of the trees, with ``left`` heights below them."""
    at = [base]
    for inner in rounds[:-1]:
        over = inner.where("height = climb AND left > climb")
        at.append(over.select("tree", "pos", (F.col("left") - F.col("climb")).alias("left"), F.lit(None).cast("int").alias("row")))
    above = None
    for k in reversed(range(len(at))):
        ends = F.greatest(F.ceil(F.col("left") / HEIGHTS), F.lit(1)) - 1 == k
        climb = F.least(F.col("left") - HEIGHTS * k, F.lit(HEIGHTS)).cast("int")
        start = tops.where(ends).select("tree", F.lit(0).cast("bigint").alias("pos"), climb.alias("climb"), "proof")
        if above is not None:
            start = start.unionByName(above.select("tree", "pos", F.lit(HEIGHTS).alias("climb"), "proof"))
        kind = at[k].schema["row"].dataType
        null = lambda t: F.lit(None).cast(t)
        end = F.expr(f"shiftleft(pos + 1, {_BITS} * height) - 1")
        columns = ["kind", "tree", "height", "pos", "children", "proof", "row", "block"]
        given = start.select(F.lit(0).alias("kind"), "tree", F.col("climb").alias("height"), "pos", null("string").alias("children"), "proof", null(kind).alias("row"), F.col("pos").alias("block"))
        mine = F.least("left", F.lit(HEIGHTS)).cast("int")
        nodes = at[k].select(F.lit(2).alias("kind"), "tree", F.lit(0).alias("height"), "pos", null("string").alias("children"), null(_PROOF).alias("proof"), "row", F.call_function("shiftright", "pos", mine * _BITS).alias("block"))
        both = given.select(*columns).unionByName(nodes.select(*columns))
        if k < len(rounds):
            inner = rounds[k].select(F.lit(1).alias("kind"), "tree", "height", "pos", "children", null(_PROOF).alias("proof"), null(kind).alias("row"), F.expr(f"shiftright(pos, {_BITS} * (climb - height))").alias("block"))
            both = both.unionByName(inner.select(*columns))
        dealt = both.withColumn("end", end).repartition("tree", "block").sortWithinPartitions(*[F.col(c).desc() for c in ("tree", "end", "height")], "kind")
        swept = dealt.select("kind", "tree", "end", "height", "pos", "children", "proof", "row")
        schema = swept.select("tree", "pos", "row", "proof").schema
        above = swept.mapInArrow(_backward, schema)
        if k:
            above = common.written(above)
    return above


def manifest(
    docs: DataFrame, fields: Sequence[str], id: str = "doc_id", tree: str = "source", also: dict[str, Column] | None = None
) -> DataFrame:
    """(``id``, ``tree``, leaf, subroot, root, proof, and the columns of ``also``) per row: the hash of its ``fields``, the
    roots of its group and of all, and per height the row's place in its run and the digests of the run's other nodes."""
    also = also or {}
    rows = docs.select(
        F.col(id).alias("__id"), F.col(tree).alias("__tree"), leaf([F.col(c) for c in fields]).alias("__leaf"),
        F.struct(F.lit(0).alias("__none"), *[c.alias(name) for name, c in also.items()]).alias("__also"),
    )
    placed = _numbered(common.written(rows), "__tree", ["__id", "__leaf"])
    placed = common.written(placed)
    groups = placed.groupBy("__tree").agg(F.max("size").alias("__leaves")).withColumn("__all", F.lit(0))
    groups = common.written(_numbered(groups, "__all", ["__tree"]).withColumn("left", _heights(F.col("__leaves"))))
    n_groups = groups.count()
    numbers = groups.select(F.col("__tree").alias("__name"), F.col("pos").alias("tree"), "left")
    met = common.join_small(
        placed.withColumn("__name", F.col("__tree")), numbers, ["__name"], n_groups, F.xxhash64("__leaf", "pos")
    )
    base = common.written(met.select("tree", "pos", "left", F.col("__leaf").alias("digest"), F.struct("__id", "__tree", "__leaf", "__also").alias("row")))
    rounds = _up(base.select("tree", "pos", "digest", "left"))
    subroots = common.written(_roots(base, rounds))
    high = F.lit(n_groups)
    crown = common.written(subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("pos"), F.col("root").alias("digest"), _heights(high).alias("left"), F.struct("root").alias("row")))
    crown_rounds = _up(crown.select("tree", "pos", "digest", "left"))
    root = _roots(crown, crown_rounds).first()
    nothing = crown.sparkSession.range(1).select(F.col("id").alias("tree"), _heights(high).alias("left"), F.array().cast(_PROOF).alias("proof"))
    proofs = common.written(_down(crown, crown_rounds, nothing))
    heights = groups.select(F.col("pos").alias("__number"), "left")
    tops = proofs.select(F.col("pos").alias("tree"), "proof", F.col("row.root").alias("subroot")).join(heights, F.col("tree") == F.col("__number"))
    tops = common.written(tops.select("tree", "left", "proof", "subroot"))
    found = _down(base, rounds, tops)
    found = common.join_small(found, tops.select("tree", "subroot"), ["tree"], n_groups, F.col("pos"))
    return found.select(
        F.col("row.__id").alias(id), F.col("row.__tree").alias(tree), F.col("row.__leaf").alias("leaf"), "subroot",
        F.lit(root[1] if root else None).cast("string").alias("root"), "proof", *[F.col("row.__also")[name].alias(name) for name in also],
    )
