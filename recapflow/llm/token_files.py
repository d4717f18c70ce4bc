"""Token ids in wavelet-matrix files.

A shard holds the ids of a run of documents as bit planes: plane 0 has the top bit of every id in order, then the ids
are split into those with a 0 and those with a 1, each in order, and so on. With the number of ones before each place,
the planes answer which id stands at a place, how often an id occurs before a place, and where its k-th occurrence is,
without decoding the shard. A shard file is one compressed record, kept in Parquet so that any store Spark reads can
hold it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recapflow.llm import common

SHARD_IDS = 1 << 20
_MAGIC, _HEAD = b"RFWM1\0", "<6sBQ"  # magic, planes, ids; then the compressed planes
_CACHED_WORDS = 2_000_000


class WaveletMatrix:
    """Bit planes from the top bit down, with the number of zeros of each."""

    def __init__(self, size: int, planes: list[np.ndarray]):
        self.size, self.planes = size, planes  # planes: packed bits, little end first, padded to whole 64-bit words
        self._ones: list[np.ndarray] | None = None

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        seq = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes = []
        for b in range(bits - 1, -1, -1):
            one = (seq & seq.dtype.type(1 << b)) != 0
            packed = np.packbits(one, bitorder="little")
            planes.append(np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]))
            seq = np.concatenate([np.compress(~one, seq), np.compress(one, seq)])  # several times faster than masks as an index
        return cls(len(ids), planes)

    def to_bytes(self) -> bytes:
        body = zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in self.planes))
        return struct.pack(_HEAD, _MAGIC, len(self.planes), self.size) + body

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, bits, size = struct.unpack_from(_HEAD, data)
        if magic != _MAGIC:
            raise ValueError("not a token shard")
        flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[struct.calcsize(_HEAD):]), np.uint8)
        width = len(flat) // bits
        return cls(size, [flat[k * width:(k + 1) * width] for k in range(bits)])

    def _bits(self, k: int) -> np.ndarray:
        return np.unpackbits(self.planes[k], count=self.size, bitorder="little").view(bool)

    def ids(self) -> np.ndarray:
        """All ids in order: the splits are undone from the last plane to the first."""
        seq = np.zeros(self.size, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k in range(len(self.planes) - 1, -1, -1):
            one = self._bits(k)
            zeros = self.size - int(np.count_nonzero(one))
            back = np.empty_like(seq)
            back[np.flatnonzero(~one)] = seq[:zeros]
            back[np.flatnonzero(one)] = seq[zeros:] | seq.dtype.type(1 << (len(self.planes) - 1 - k))
            seq = back
        return seq

    def _index(self) -> list[np.ndarray]:
        if self._ones is None:  # ones before each 64-bit word
            self._ones = [np.concatenate([[0], np.cumsum(np.bitwise_count(p.view(np.uint64)), dtype=np.int64)]) for p in self.planes]
        return self._ones

    def _rank1(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        word, rest = divmod(i, 64)
        tail = int(self.planes[k].view(np.uint64)[word]) & ((1 << rest) - 1) if rest else 0
        return int(self._index()[k][word]) + tail.bit_count()

    def _zeros(self, k: int) -> int:
        return self.size - int(self._index()[k][-1])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        out = 0
        for k in range(len(self.planes)):
            ones = self._rank1(k, i)
            bit = int(self.planes[k][i >> 3]) >> (i & 7) & 1
            out = out << 1 | bit
            i = self._zeros(k) + ones if bit else i - ones
        return out

    def _range(self, id: int, end: int) -> tuple[int, int]:
        """Where the occurrences of an id among the first ``end`` places stand after the last split."""
        start = 0
        if id < 0 or id >> len(self.planes):
            return 0, 0
        for k in range(len(self.planes)):
            a, b = self._rank1(k, start), self._rank1(k, end)
            one = id >> (len(self.planes) - 1 - k) & 1
            start, end = (self._zeros(k) + a, self._zeros(k) + b) if one else (start - a, end - b)
        return start, end

    def rank(self, id: int, i: int) -> int:
        """Occurrences of an id before place i."""
        start, end = self._range(id, min(max(i, 0), self.size))
        return end - start

    def count(self, id: int) -> int:
        return self.rank(id, self.size)

    def _select(self, k: int, one: bool, nth: int) -> int:
        """Place of the nth (from 0) one or zero of plane k."""
        ones = self._index()[k]
        at = ones if one else np.arange(len(ones)) * 64 - ones
        word = int(np.searchsorted(at, nth, side="right")) - 1
        bits = int(self.planes[k].view(np.uint64)[word])
        bits = bits if one else ~bits & (1 << 64) - 1
        for _ in range(nth - int(at[word])):
            bits &= bits - 1
        return word * 64 + (bits & -bits).bit_length() - 1

    def select(self, id: int, nth: int) -> int:
        """Place of the nth (from 0) occurrence of an id."""
        start, end = self._range(id, self.size)
        if not 0 <= nth < end - start:
            raise IndexError(nth)
        at = start + nth
        for k in range(len(self.planes) - 1, -1, -1):
            one = bool(id >> (len(self.planes) - 1 - k) & 1)
            at = self._select(k, one, at - self._zeros(k) if one else at)
        return at


def _picked(flat: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces of ``flat`` in the order of their numbers, size of each): piece k has ``size[k]`` values."""
    n = size[code]
    shift = (np.cumsum(size, dtype=np.int32) - size)[code] - (np.cumsum(n, dtype=np.int32) - n)
    return flat[np.repeat(shift, n) + np.arange(int(n.sum()), dtype=np.int32)], n


class Encoder:
    """Ids of whole texts by a tokenizers file that lower-cases and treats white space as a border between words.

    Words between plain spaces and line feeds are told apart in Arrow, each distinct one is encoded once, and the ids
    are gathered by word number. An ASCII word is looked up in lower case, and a full stop or comma behind its last
    letter as a word of its own, which is how the file cuts it; words that could hold a special token are left alone."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.many = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.flat, self.size = np.empty(0, "<u4"), np.empty(0, np.int32)

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            ids = [e.ids for e in self.many(words[at:at + 20_000], add_special_tokens=False)]
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), "<u4")])
            self.size = np.concatenate([self.size, np.fromiter(map(len, ids), np.int32, len(ids))])
        self.words = pa.concat_arrays([self.words, pa.array(words, pa.string())])

    def _known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words in order, number of ids of each); words are distinct."""
        if len(self.words) > _CACHED_WORDS:
            self._forget()
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            new = words.filter(pc.is_null(at))
            unknown = pc.is_null(at).to_numpy(zero_copy_only=False)
            at = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).copy()
            at[unknown] = len(self.words) + np.arange(len(new))
            self._learn(new.to_pylist())
        else:
            at = at.to_numpy()
        return _picked(self.flat, self.size, at)

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all distinct words in order, number of ids of each)."""
        special = pc.match_substring(words, "<|")
        words = pc.if_else(special, words, pc.ascii_lower(words))
        stop = pc.and_not(pc.match_substring_regex(words, "[a-z][.,]$"), special)
        heads = pc.if_else(stop, pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode()
        ids, size = _picked(*self._known(heads.dictionary), heads.indices.to_numpy())
        stop = stop.to_numpy(zero_copy_only=False)
        comma = pc.ends_with(words, ",").to_numpy(zero_copy_only=False)[stop]
        marks = [e.ids for e in self.many([",", "."], add_special_tokens=False)]
        return np.insert(ids, np.cumsum(size)[stop], np.where(comma, *np.array(marks, "<u4")[:, 0])), size + stop

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each)."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        ids, n = _picked(*self._distinct(words.dictionary), words.indices.to_numpy())
        begin = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
        return ids, np.add.reduceat(n, begin).astype(np.int64) if len(begin) else np.empty(0, np.int64)


def _slices(batch: pa.RecordBatch, chars: int = 20_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about so many bytes of text; a longer text is a run of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(size, (size[start - 1] if start else 0) + chars, side="right"))
        end = max(end, start + 1)
        yield batch.slice(start, end - start)
        start = end


def write(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS,
) -> None:
    """Write the ids of all texts, each closed by ``end_id``, in ascending order of id (NULL ids first, rows that repeat
    an id by text). A task writes shards of about ``shard_ids`` ids; a longer text makes a longer shard. NULL and empty
    texts have the end id only."""
    kind = docs.schema[id].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("before", T.LongType()),
        T.StructField("n_ids", T.LongType()), T.StructField("docs", T.ArrayType(kind)), T.StructField("lengths", T.BinaryType()),
        T.StructField("planes", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = common.per_process(f"encoder {tokenizer}", lambda: Encoder(tokenizer))
        part, seq, before = TaskContext.get().partitionId(), 0, 0

        def shard(names: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            columns = [
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.array([lengths.astype("<u4").tobytes()], pa.binary()),
                pa.array([WaveletMatrix.build(ids).to_bytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        for b in batches:
            for piece in _slices(b):
                ids, n = encoder.encode(piece.column(1))
                held.append((piece.column(0), n + 1, np.insert(ids, np.cumsum(n), np.uint32(end_id))))
                done = False
                while sum(len(x[2]) for x in held) >= shard_ids and not done:
                    names, lengths, ids = pa.concat_arrays([x[0] for x in held]), *(np.concatenate([x[k] for x in held]) for k in (1, 2))
                    ends = np.cumsum(lengths)
                    cut = int(np.searchsorted(ends, shard_ids)) + 1
                    yield shard(names[:cut], lengths[:cut], ids[:ends[cut - 1]])
                    seq, before, done = seq + 1, before + int(ends[cut - 1]), cut == len(names)
                    held = [] if done else [(names[cut:], lengths[cut:], ids[ends[cut - 1]:])]
        if held:
            yield shard(pa.concat_arrays([x[0] for x in held]), *(np.concatenate([x[k] for x in held]) for k in (1, 2)))

    ordered = docs.select(F.col(id), F.col(text)).repartitionByRange(F.col(id)).sortWithinPartitions(id, text)
    ordered.mapInArrow(run, schema).write.parquet(path)


def read(spark: SparkSession, path: str, id: str = "doc_id") -> DataFrame:
    """One row per document, from the files: id, start (ids of all documents before it), n_tokens and ids_crc32."""
    shards = spark.read.parquet(path)
    kind = shards.schema["docs"].dataType.elementType
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row per writing task
    earlier = common.settled(totals.select("part", F.expr("coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("offset")))
    placed = common.join_small(shards, earlier, ["part"], earlier.count(), F.col("seq"))
    schema = T.StructType([
        T.StructField(id, kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                offset, names = b.column(0)[i].as_py(), b.column(1)[i].values
                lengths = np.frombuffer(b.column(2)[i].as_py(), "<u4").astype(np.int64)
                ids = WaveletMatrix.from_bytes(b.column(3)[i].as_py()).ids().astype("<u4")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n:e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([names, pa.array(offset + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], names=schema.names)

    return placed.select((F.col("offset") + F.col("before")).alias("at"), "docs", "lengths", "planes").mapInArrow(run, schema)


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(part, seq, n): how often a token occurs in each shard, from the planes alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [WaveletMatrix.from_bytes(x.as_py()).count(token) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["part", "seq", "n"])

    return spark.read.parquet(path).select("part", "seq", "planes").mapInArrow(run, "part int, seq int, n bigint")


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 1, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write to a new folder in the shared folder and read back; an empty table gives an empty table."""
    spark = docs.sparkSession
    path = f"{common.shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, end_id, id, text)
    return read(spark, path, id)
