"""Operator 6: token counts by a linear longest-match automaton.

Greedy word-piece splitting takes the longest vocabulary entry at the front of what is left of a word. The automaton reads
each byte once: where the trie has no edge, the failure link of a node leads to the node that stands for what remains after
the greedy pieces at its front are popped, and a count says how many pieces those are. No piece is ever built.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import modest_batches, utf8


class LongestMatch:
    """Over byte strings. Words start with `first` (word-initial pieces carry it), so one trie holds initial and inner pieces."""

    def __init__(self, pieces: Iterable[bytes], first: bytes = b" ") -> None:
        self.first = first
        self.edges: list[dict[int, int]] = [{}]
        self.final = [False]
        parent, letter = [0], [0]
        for piece in pieces:
            node = 0
            for byte in piece:
                after = self.edges[node].get(byte)
                if after is None:
                    after = self.edges[node][byte] = len(self.edges)
                    self.edges.append({})
                    self.final.append(False)
                    parent.append(node)
                    letter.append(byte)
                node = after
            if node:
                self.final[node] = True
        size = len(self.edges)
        #: Where to go on, and how many pieces are popped on the way; -1: what the node holds can't be split.
        self.failure, self.popped = [-1] * size, [0] * size
        level = list(self.edges[0].values())
        while level:
            following = []
            for node in level:
                if self.final[node]:  # the whole node is one piece: nothing remains
                    self.failure[node], self.popped[node] = 0, 1
                else:  # pieces of the parent, then go on from its failure link by this letter
                    at, count = self.failure[parent[node]], self.popped[parent[node]]
                    while at >= 0 and letter[node] not in self.edges[at]:
                        if at == 0:
                            at = -1
                            break
                        count += self.popped[at]
                        at = self.failure[at]
                    if at >= 0:
                        self.failure[node], self.popped[node] = self.edges[at][letter[node]], count
                following += self.edges[node].values()
            level = following
        self.counts: dict[bytes, int] = _Counts(self)

    def count(self, word: bytes) -> int:
        """Number of pieces of first + word; 1, an unknown, if it can't be split."""
        edges, failure, popped = self.edges, self.failure, self.popped
        node = total = 0
        for byte in self.first + word:
            while byte not in edges[node]:
                if node == 0 or failure[node] < 0:
                    return 1
                total += popped[node]
                node = failure[node]
            node = edges[node][byte]
        while node:
            if failure[node] < 0:
                return 1
            total += popped[node]
            node = failure[node]
        return total


class _Counts(dict):
    """Counts of words met before; bounded."""

    LIMIT = 100_000

    def __init__(self, automaton: LongestMatch) -> None:
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        count = self.automaton.count(word)
        if len(word) <= 48:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = count
        return count


_compiled: dict[str, LongestMatch] = {}


def compiled(vocabulary_path: str) -> LongestMatch:
    """From a file of lines "base64 rank"; a worker compiles each vocabulary once."""
    if vocabulary_path not in _compiled:
        with open(vocabulary_path, "rb") as file:
            _compiled[vocabulary_path] = LongestMatch(base64.b64decode(line.split()[0]) for line in file if line.strip())
    return _compiled[vocabulary_path]


def count_pieces(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Returns for each row of docs: doc_id, n_words, n_pieces (greedy longest-match pieces over all words), longest_word
    (most pieces in a word).

    Words are [^\\x20\\x09-\\x0D]+; each is split as a blank and its UTF-8 bytes. A word that the vocabulary can't split is one
    unknown piece. Null or empty text: zeros. Very long words are read once, like all others. Other columns are ignored.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(vocabulary_path)
        known = automaton.counts.__getitem__
        for batch in source:
            rows = []
            for text in utf8(batch.column(1)):
                counts = [*map(known, (text or b"").split())]
                rows.append((len(counts), sum(counts), max(counts, default=0)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))] if rows else [batch.column(0)] + [pa.array([], pa.int64())] * 3, ["doc_id", "n_words", "n_pieces", "longest_word"])

    return modest_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, "doc_id long, n_words long, n_pieces long, longest_word long")
