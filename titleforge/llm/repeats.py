"""Operator 7: removing long repeated passages by a compacted de Bruijn graph.

Edges of the graph are the windows of `window` words of all documents, nodes the sequences of one word less between them. The
edges that follow each other in a document and share their minimiser (the least hash of a short gram inside) are compacted
into one path on the spot: no edge of such a path is a row of its own. Paths whose minimiser occurs once can't repeat. The
others meet in joins: equal paths are repeated as a whole, and of different paths with one minimiser, a representative each
is opened into its edges again to find those that they share. Source coordinates (document, first word) lead from these paths
and edges back to the words: those whose words have the same 128-bit digest somewhere else are repeated, and adjoining ones make
up whole spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, gram_hashes, materialize, mix, modest_batches, parts, release, utf8

#: Words in a window.
WINDOW = 35
#: Words in a gram that can be a minimiser: two equal windows have the same one at the same place.
GRAM = 8

_PATHS = "minimiser long, path long, edges int, doc_row long, first int"


def _least(grams: np.ndarray, span: int) -> np.ndarray:
    """Position of the least of each `span` grams in a row, the leftmost of equals, by doubling."""
    at = np.arange(len(grams))
    width = 1
    while width < span:
        step = min(width, span - width)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(grams[right] < grams[left], right, left)
        width += step
    return at


_MULTIPLIER = 0x9FB21C651E98DF25
_INVERSE = pow(_MULTIPLIER, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, count: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < count:
        with np.errstate(over="ignore"):
            grown = np.full(max(2 * count, 4096), np.uint64(base))
            grown[0] = 1
            known = _powers[base] = np.cumprod(grown)
    return known[:count]


def sequence_hashes(words: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """64-bit hashes of the sequences words[first : first + count]: differences of running polynomial sums, divided by the
    power of their place, so that equal sequences have equal hashes wherever they stand."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _power(_MULTIPLIER, len(words)))])
        placed = (sums[first + count] - sums[first]) * _power(_INVERSE, len(words) + 1)[first]
        return mix(placed + mix(count.astype(np.uint64) * np.uint64(_MULTIPLIER)))


def paths_of(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(minimiser, path, edges, first word) of the compacted paths of a document's hashed words."""
    count = len(words) - window + 1
    if count <= 0:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.int32),) * 2
    grams = gram_hashes(words, gram)
    at = _least(grams, window - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    edges = np.diff(np.concatenate([first, [count]]))
    path = sequence_hashes(words, first, edges + window - 1)
    return grams[at[first]].view(np.int64), path.view(np.int64), edges.astype(np.int32), first.astype(np.int32)


def _paths(window: int, gram: int):
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in source:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [paths_of(known.of((t or b"").split()), window, gram) for t in utf8(part.column(1))]
                rows = np.repeat(part.column(0).to_numpy(), [len(f[0]) for f in found])
                minimiser, path, edges, first = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(minimiser), pa.array(path), pa.array(edges), pa.array(rows), pa.array(first)], ["minimiser", "path", "edges", "doc_row", "first"])

    return batches


def _open_paths(window: int, gram: int):
    """The edges of representative paths: (minimiser, edge, doc_row, first, single)."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in source:
            for row, text, asked in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2), strict=True):
                words = known.of((text or b"").split())
                asked = asked.values
                minimiser, first, edges, single = (asked.field(n).to_numpy(zero_copy_only=False) for n in ("minimiser", "first", "edges", "single"))
                starts = np.repeat(first, edges).astype(np.int64) + np.arange(edges.sum()) - np.repeat(np.cumsum(edges) - edges, edges)
                edge = sequence_hashes(words, starts, np.full(len(starts), window)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(minimiser, edges)), pa.array(edge), pa.array(np.full(len(starts), row, np.int64)), pa.array(starts.astype(np.int32)), pa.array(np.repeat(single, edges))], ["minimiser", "edge", "doc_row", "first", "single"])

    return batches


def _worded(window: int):
    """The claims (minimiser, path, edges, first, counts) of each document with a 128-bit digest of the words that stand there."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(source, 64):
            rows, digests, lists = [], [], []
            for row, text, claims in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2), strict=True):
                words = (text or b"").split()
                claims = claims.values
                firsts, edges = (claims.field(n).to_pylist() for n in ("first", "edges"))
                digests += [xxhash.xxh3_128_digest(b" ".join(words[f : f + e + window - 1])) for f, e in zip(firsts, edges, strict=True)]
                rows.append(np.full(len(firsts), row, np.int64))
                lists.append(claims)
            if rows:
                every = pa.concat_arrays(lists)
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), *(every.field(n) for n in ("minimiser", "path", "edges", "first", "counts")), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], ["doc_row", "minimiser", "path", "edges", "first", "counts", "high", "low"])

    return batches


def _cut(window: int):
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = []
            for text, spans in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                total = len(words)
                kept = words
                if spans:
                    change = np.zeros(total + 1, np.int64)
                    for span in spans:
                        change[span["first"]] += 1
                        change[span["first"] + span["edges"] + window - 1] -= 1
                    covered = np.cumsum(change[:-1]) > 0
                    kept = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                rows.append((total, total - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            types = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 3, types, strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return batches


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs has doc_row (a unique long) and text. Returns doc_row, spans: array of (first, edges), each for edges + window - 1
    words from word `first` that are covered by repeated windows."""
    source = docs.select("doc_row", "text")
    every = materialize(source.mapInArrow(_paths(window, gram), _PATHS), "repeats-every")
    often = every.groupBy("minimiser").agg(F.count("*").alias("n")).filter("n > 1").select("minimiser")
    often = materialize(often, "repeats-often")  # written, so that both sides of the join are dealt anew and hot keys can be split
    met = materialize(every.join(often, "minimiser", "left_semi"), "repeats-paths")
    release(every, often)
    classes = met.groupBy("minimiser", "path", "edges").agg(F.count("*").alias("n"), F.min(F.struct("doc_row", "first")).alias("at"))
    classes = materialize(classes.select("minimiser", "path", "edges", "n", "at.*"), "repeats-classes")
    # Where different paths share a minimiser, one of each is opened.
    mixed = classes.groupBy("minimiser").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("minimiser")
    asked = classes.join(mixed, "minimiser", "left_semi").groupBy("doc_row").agg(F.collect_list(F.struct("minimiser", "first", "edges", (F.col("n") == 1).alias("single"))).alias("asked"))
    opened = source.join(asked, "doc_row").mapInArrow(_open_paths(window, gram), "minimiser long, edge long, doc_row long, first int, single boolean")
    # An edge of a path that occurs once is repeated if another opened path has it too. A path has no edge twice.
    opened = materialize(opened, "repeats-edges")
    shared = opened.groupBy("minimiser", "edge").agg(F.count("*").alias("n")).filter("n > 1").select("minimiser", "edge")
    edges = opened.join(shared, ["minimiser", "edge"], "left_semi").select("doc_row", "minimiser", F.col("edge").alias("path"), F.lit(1).alias("edges"), "first", F.col("single").alias("counts"))
    whole = met.join(classes.filter("n > 1").select("minimiser", "path", "edges"), ["minimiser", "path", "edges"], "left_semi").select("doc_row", "minimiser", "path", "edges", "first", F.lit(True).alias("counts"))
    # At the source coordinates of each claim stand its words: only what has the same words somewhere else is repeated.
    claims = whole.union(edges).groupBy("doc_row").agg(F.collect_list(F.struct("minimiser", "path", "edges", "first", "counts")).alias("claims"))
    worded = source.join(claims, "doc_row").mapInArrow(_worded(window), "doc_row long, minimiser long, path long, edges int, first int, counts boolean, high long, low long")
    worded = materialize(worded, "repeats-worded")
    release(met, classes, opened)
    same = ["minimiser", "path", "edges", "high", "low"]
    alike = materialize(worded.groupBy(*same).agg(F.count("*").alias("n")).filter("n > 1").select(*same), "repeats-alike")
    return worded.filter("counts").join(alike, same, "left_semi").groupBy("doc_row").agg(F.collect_list(F.struct("first", "edges")).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Returns for each row of docs: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by a blank).

    A word goes if a window of `window` words over it has the same words as a window that starts anywhere else, in the same
    document too. Windows are judged on the input. Documents shorter than a window, null and empty texts lose nothing. Rows
    of equal text lose all their windows. Other columns are ignored.

    Rows are told apart by doc_id where it is unique and by a number of their own where it is not, so that repeated or null
    ids count as documents each.
    """
    base = modest_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    unique = base.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").isEmpty()
    if unique:
        numbered = base.withColumn("doc_row", F.col("doc_id"))
    else:
        numbered = materialize(base.withColumn("doc_row", F.monotonically_increasing_id()), "repeats-numbered")
    spans = repeated_spans(numbered, window, gram)
    joined = numbered.join(spans, "doc_row", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
