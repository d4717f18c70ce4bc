"""Token counts under a unigram vocabulary, without making the tokens.

For each word an Aho-Corasick automaton enumerates the vocabulary pieces that end at each place, and dynamic programming
carries the best score and the number of pieces of that best cut. Ties and unknown characters follow the public
tokenizers library's unigram model: of equally good cuts into the same place the one with the longest last piece wins;
a character that is no piece scores ten less than the worst piece and counts as its UTF-8 bytes (byte fallback) or,
without byte pieces, joins neighbouring unknown characters into one token.

The pre-tokenizer is the library's ``Metaspace``: spaces become U+2581, one is put in front, and words are cut before
each. Words are counted once per task as long as they stay in a table of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recapflow.llm import common

MARK = "▁"
#: Words of up to so many characters are remembered, and so many bytes of them, about.
_CACHED_LENGTH, _CACHED_BYTES = 64, 64_000_000
#: Longer words, whole texts without a space among them, are counted with the cells that the longest piece reaches back for.
_LONG = 4096
UNKNOWN_PENALTY = 10.0


@dataclass
class Counter:
    """Counts pieces under (piece, score) pairs."""

    pieces: list[tuple[str, float]]
    byte_fallback: bool = True
    _known: dict[str, int] = field(default_factory=dict)
    _bytes: int = 0

    def __post_init__(self) -> None:
        self.match = ahocorasick.Automaton()
        self.single = set()
        for piece, score in self.pieces:
            if piece and piece not in self.match:
                self.match.add_word(piece, (len(piece), score))
                if len(piece) == 1:
                    self.single.add(piece)
        self.match.make_automaton()
        self.longest = max((len(p) for p, _ in self.pieces), default=1)
        self.bytes = self.byte_fallback and {f"<0x{i:02X}>" for i in range(256)} <= {p for p, _ in self.pieces}
        self.unknown = min((s for _, s in self.pieces), default=0.0) - UNKNOWN_PENALTY

    def word(self, word: str) -> int:
        """Pieces of the best cut of one word."""
        if not len(self.match):
            return len(word.encode("utf-8", "surrogatepass")) if self.bytes else int(bool(word))
        size = len(word)
        if size > _LONG:
            return self._long(word)
        best, count, tail = [0.0] + [None] * size, [0] * (size + 1), [False] * (size + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        for end, found in self.match.iter(word):
            ends[end].append(found)  # longest first
        for end in range(size):
            for length, score in ends[end]:
                start = end + 1 - length
                total = best[start] + score
                if best[end + 1] is None or total > best[end + 1]:
                    best[end + 1], count[end + 1], tail[end + 1] = total, count[start] + 1, False
            char = word[end]
            if char not in self.single:
                total = best[end] + self.unknown
                if best[end + 1] is None or total > best[end + 1]:
                    best[end + 1], tail[end + 1] = total, True
                    step = len(char.encode("utf-8", "surrogatepass")) if self.bytes else int(not tail[end])
                    count[end + 1] = count[end] + step
        return count[size]

    def _long(self, word: str) -> int:
        """The same in a ring of cells: a piece reaches no further back than the longest one is long."""
        ring = self.longest + 1
        best, count, tail = [0.0] * ring, [0] * ring, False
        matches = self.match.iter(word)
        at, found = next(matches, (-1, None))
        last = 0
        for end, char in enumerate(word):
            top, pieces, unknown = None, 0, False
            while at == end:
                length, score = found
                start = (end + 1 - length) % ring
                if top is None or best[start] + score > top:
                    top, pieces = best[start] + score, count[start] + 1
                at, found = next(matches, (-1, None))
            if char not in self.single:
                total = best[end % ring] + self.unknown
                if top is None or total > top:
                    top, unknown = total, True
                    pieces = count[end % ring] + (len(char.encode("utf-8", "surrogatepass")) if self.bytes else int(not tail))
            best[(end + 1) % ring], count[(end + 1) % ring], tail, last = top, pieces, unknown, pieces
        return last

    def text(self, text: str) -> int:
        """Pieces of a whole text."""
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        if not marked.startswith(MARK):
            marked = MARK + marked
        head, *rest = marked.split(MARK)  # the first part is empty
        known, total = self._known, 0
        if self._bytes > _CACHED_BYTES:
            known.clear()
            self._bytes = 0
        if max(map(len, rest)) > _CACHED_LENGTH:
            total = sum(self.word(MARK + w) for w in rest if len(w) > _CACHED_LENGTH)
            rest = [w for w in rest if len(w) <= _CACHED_LENGTH]
        for w in set(rest).difference(known):
            known[w] = self.word(MARK + w)
            self._bytes += 150 + 2 * len(w)
        for n in map(known.__getitem__, rest):
            total += n
        return total


def sentencepiece_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model file, control pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in ids]


def count(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_chars and n_tokens under the pieces and scores of a sentencepiece model file, read
    by each worker from ``vocabulary``.

    NULL and empty texts have 0 tokens; texts of any length are counted whole, also those without a space, and take memory
    for little more than the text; repeated rows are counted each; other columns are not read; an empty table
    gives an empty table. The file must be readable on every executor, as the tokenizer files are installed there."""
    schema = T.StructType([
        T.StructField(id, docs.schema[id].dataType), T.StructField("n_chars", T.LongType()), T.StructField("n_tokens", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = common.per_process(f"unigram {vocabulary}", lambda: Counter(sentencepiece_vocabulary(vocabulary)))
        for b in batches:
            chars, tokens = [], []
            for x in b.column(1):
                t = x.as_py() or ""
                chars.append(len(t))
                tokens.append(counter.text(t))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(chars, pa.int64()), pa.array(tokens, pa.int64())], names=schema.names)

    return docs.select(F.col(id), F.col(text)).mapInArrow(run, schema)
