"""Token counts of a unigram tokenizer: Aho-Corasick matches and a Viterbi pass that carries score and count only."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prunescan.llm.common import sliced

SPACE = "▁"
#: Score of an unknown character below the worst piece, as tokenizers of this kind have it.
UNKNOWN_PENALTY = 10.0
#: A word with its leading spaces; pieces never reach past one.
WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
NORMAL, BYTE = 1, 6


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Number and value of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores, and whether unknown characters fall back to byte pieces."""

    pieces: tuple[tuple[str, float], ...]
    bytes_: bool


def read_model(path: str) -> Vocabulary:
    """Normal pieces and scores of a SentencePiece model file (read once on the driver; sent to tasks as one bounded value)."""
    pieces, bytes_ = [], False
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            kind = piece.get(3, NORMAL)
            bytes_ |= kind == BYTE
            if kind == NORMAL:
                pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0))
    return Vocabulary(tuple(pieces), bytes_)


class Counter:
    """Counts the pieces of the best segmentation of texts."""

    def __init__(self, vocabulary: Vocabulary, memo: int = 1 << 19):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.singles = frozenset(p for p, _ in vocabulary.pieces if len(p) == 1)
        self.unknown = min(s for _, s in vocabulary.pieces) - UNKNOWN_PENALTY
        self.bytes_ = vocabulary.bytes_
        self.inner = any(SPACE in p.lstrip(SPACE) for p, _ in vocabulary.pieces)
        self.memo: dict[str, int] = {}
        self.most = memo

    def word(self, text: str) -> int:
        """Pieces of one word (or of a whole text, if some piece holds a space inside).

        Ties go to the piece that begins first, so at equal scores the longest last piece stays. A character that
        no piece matches alone is unknown; neighbouring unknown characters are one piece, or with byte
        pieces one for each of their UTF-8 bytes.
        """
        if not self.singles.issuperset(text):
            return self._word_with_unknown(text)
        score, count = [float("-inf")] * (len(text) + 1), [0] * (len(text) + 1)
        score[0] = 0.0
        for last, (size, s) in self.automaton.iter(text):  # by their ends, at one end the longest first
            start = last + 1 - size
            total = score[start] + s
            if total > score[last + 1]:
                score[last + 1], count[last + 1] = total, count[start] + 1
        return count[-1]

    def _word_with_unknown(self, text: str) -> int:
        n = len(text)
        score, count = [float("-inf")] * (n + 1), [0] * (n + 1)
        loose = [False] * (n + 1)  # whether the best way here ends in unknown characters
        score[0] = 0.0
        by_end: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, match in self.automaton.iter(text):
            by_end[last + 1].append(match)
        for end in range(1, n + 1):
            if text[end - 1] not in self.singles:
                by_end[end].append((1, self.unknown))
            for size, s in by_end[end]:
                total = score[end - size] + s
                if total > score[end]:
                    score[end] = total
                    loose[end] = size == 1 and text[end - 1] not in self.singles
                    if loose[end]:
                        count[end] = count[end - 1] + (len(text[end - 1].encode()) if self.bytes_ else not loose[end - 1])
                    else:
                        count[end] = count[end - size] + 1
        return count[n]

    def text(self, text: str) -> int:
        """Pieces of a text: a space is put in front, spaces become their piece character, nothing else is changed."""
        if not text:
            return 0
        marked = SPACE + text.replace(" ", SPACE)
        if self.inner:
            return self.word(marked)
        total, memo = 0, self.memo
        for w in WORD.findall(marked):
            n = memo.get(w)
            if n is None:
                if len(memo) >= self.most:
                    memo.clear()
                n = self.word(w)
                if len(w) <= 64:
                    memo[w] = n
            total += n
        return total


def _counted(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    counter = Counter(vocabulary)
    for batch in sliced(batches):
        n = [counter.text(t) if t else 0 for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64())], [*batch.schema.names[1:], "n_tokens"])


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Tokens of every row's whole text under the unigram model of ``model_path``: the id column and ``n_tokens``.

    Only the number of pieces of the best segmentation is carried, no pieces. A word's count is kept in a bounded
    table, as words recur. Null and empty texts have 0 tokens. Repeated rows are each counted. Rows stay where
    they are: nothing is shuffled. Other columns are not read. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    d = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).alias("doc_id"))
    out = d.mapInArrow(lambda it: _counted(it, sent.value), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens long")
    return out.withColumnRenamed("doc_id", doc_id)
