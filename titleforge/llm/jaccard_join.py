"""Operator 1: n-gram Jaccard join with filters under several global orders.

Two sets with Jaccard similarity t or more share a token among the first n - ceil(t n) + 1 tokens of each, under every total
order of all tokens. The first order puts tokens that are frequent in the corpus last; it makes the candidates, a table of
pairs. Other orders, frequent tokens last too but shuffled otherwise, cut that table down: a pair stays only if its prefixes
meet under each of them. Full sets are read for what is left.

A set also has a sketch: the parity of the number of its tokens in each of 512 cells. Sketches of two sets differ in no more
bits than the sets differ in tokens, so a pair that differs in more than a link allows is never a row. That bound is exact.

Documents of equal sets are one set from the start. Where a crowd of sets shares a token, families of near copies are tied
first, by a few likely pairs for each set; then all pairs of sets that share a prefix token are looked at unless their
families are one already. So a family costs pairs in proportion to its members, and no link between families is lost.

All links lie within families. link_counts compares all sets of a family whose sizes allow a link, a block of sets with a
block at once, so no pair is a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import WordHashes, gram_hashes, materialize, mix, modest_batches, parts, utf8
from .components import connected_components

#: Words in a shingle, and the similarity in percent.
WORDS, PERCENT = 5, 80
#: Most tokens in the list of frequent ones (8 bytes and a class each, so the list is bounded).
FREQUENT = 200_000
#: Orders beyond the first whose prefixes must meet as well.
MORE_ORDERS = 2
#: Parts in which the rows of a frequent token are dealt out.
SALTS = 64
#: Longs in a sketch, of 64 cells each.
SKETCH = 8
#: Sets that share a token make a crowd beyond this; rounds in which crowds are tied; neighbours that a set looks at for a
#: partner in each place and round, and partners that are verified.
CROWD, ROUNDS, NEIGHBOURS, PARTNERS = 48, 8, 8, 3
#: Pairs for each set beyond which the likeliest are verified first.
DENSE = 4
#: Rows (of two longs) up to which a list is sent to all tasks.
SMALL = 200_000
#: Tokens that are counted at once in a task; counts under LEAST in such a lot are left out (lossy counting).
LOT, LEAST = 2_000_000, 3
#: Sets, and tokens of them, in a block of a family whose links are counted at once, about.
BLOCK, BLOCK_TOKENS = 256, 100_000


def shingles(text: bytes | None, known: WordHashes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashed shingles of a text; bytes.lower() and bytes.split() touch ASCII alone, as wanted."""
    hashed = known.of((text or b"").lower().split())
    if len(hashed) < words:
        return gram_hashes(hashed, len(hashed), len(hashed)) if len(hashed) else hashed
    return np.unique(gram_hashes(hashed, words))


def set_id(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - 2**63


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1


def sketch(tokens: np.ndarray) -> bytes:
    """For each cell the parity of the number of tokens in it, as SKETCH longs."""
    cells = (mix(tokens) % np.uint64(64 * SKETCH)).astype(np.int64)
    return np.packbits(np.bincount(cells, minlength=64 * SKETCH).astype(np.uint8) & 1).tobytes()


_SKETCH = [f"s{i}" for i in range(SKETCH)]


def _wanted(n: Column, other_n: Column, percent: int) -> Column:
    """Tokens that sets of these sizes must share to be linked."""
    return F.ceil((n + other_n).cast("long") * percent / F.lit(100 + percent)).cast("long")


def _apart(sketches: list[Column], others: list[Column]) -> Column:
    """Bits in which two sketches differ: no more than tokens in which the sets differ."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(sketches, others, strict=True)), F.lit(0))


class Order:
    """A total order of tokens for each seed: frequent tokens last by their class, else by hash."""

    def __init__(self, frequent: np.ndarray, classes: np.ndarray) -> None:
        at = np.argsort(frequent)
        self.frequent, self.classes = frequent[at], classes[at].astype(np.uint64)

    def class_of(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return np.zeros(len(tokens), np.uint64)
        at = np.minimum(np.searchsorted(self.frequent, tokens), len(self.frequent) - 1)
        return np.where(self.frequent[at] == tokens, self.classes[at], np.uint64(0))

    def prefix(self, tokens: np.ndarray, seed: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The first tokens of a sorted set under the order of a seed, in order, and their classes."""
        classes = self.class_of(tokens)
        with np.errstate(over="ignore"):
            keys = classes << np.uint64(56) | mix(tokens + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(8)
        at = np.argsort(keys, kind="stable")[:size]  # stable: equal keys stand in order of token
        return tokens[at], classes[at]


def _survey(words: int):
    """Rows (doc_id, n, set_id, sketch) for documents, (token, n) for tokens that are frequent in a lot."""
    names = ["doc_id", "n", "set_id", "token", *_SKETCH]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lot, held = WordHashes(), [], 0

        def counted() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(lot), return_counts=True)
            often = counts >= LEAST
            none = pa.nulls(int(often.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.array(counts[often].astype(np.int64)), none, pa.array(tokens[often].view(np.int64)), *[none] * SKETCH], names)

        for batch in parts(source):
            sizes, ids, sketches = [], [], []
            for text in utf8(batch.column(1)):
                tokens = shingles(text, known, words)
                sizes.append(len(tokens))
                ids.append(set_id(tokens))
                sketches.append(sketch(tokens))
                lot.append(tokens)
                held += len(tokens)
                if held >= LOT:
                    yield counted()
                    lot, held = [], 0
            columns = np.frombuffer(b"".join(sketches), np.int64).reshape(-1, SKETCH)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.nulls(batch.num_rows, pa.int64()), *(pa.array(columns[:, i].copy()) for i in range(SKETCH))], names)
        if lot:
            yield counted()

    return batches


def _prefixes(order: Order, words: int, percent: int):
    """(token, set_id, n, place, frequent) for the prefix of each set; equal sets of one task once."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met = WordHashes(), set()
        for batch in parts(source):
            rows = []
            for text in utf8(batch.column(0)):
                tokens = shingles(text, known, words)
                if not len(tokens) or (own := set_id(tokens)) in met:
                    continue
                if len(met) >= 200_000:
                    met.clear()
                met.add(own)
                prefix, classes = order.prefix(tokens, 0, prefix_size(len(tokens), percent))
                rows.append((prefix, classes > 0, own, len(tokens)))
            if rows:
                sizes = [len(r[0]) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([r[0] for r in rows]).view(np.int64)),
                        pa.array(np.repeat(np.array([r[2] for r in rows], np.int64), sizes)),
                        pa.array(np.repeat(np.array([r[3] for r in rows], np.int32), sizes)),
                        pa.array(np.concatenate([np.arange(s, dtype=np.int32) for s in sizes])),
                        pa.array(np.concatenate([r[1] for r in rows])),
                    ],
                    ["token", "set_id", "n", "place", "frequent"],
                )

    return batches


def _sets(words: int, order: Order, percent: int, more_orders: int):
    """(set_id, tokens, firsts) for rows (set_id, text) whose text has that set, or any where set_id is null. firsts: an array
    for each further order with the tokens of the set's prefix."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in parts(source):
            found = {}
            for wanted, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                tokens = shingles(text, known, words)
                # Rows that repeat a doc_id may hold other texts than that of the wanted set.
                if len(tokens) and wanted in (None, own := set_id(tokens)):
                    found[own] = tokens
            columns = [pa.array(list(found), pa.int64()), pa.array([t.tobytes() for t in found.values()], pa.binary())]
            for seed in range(1, more_orders + 1):
                firsts = [order.prefix(t, seed, prefix_size(len(t), percent))[0].view(np.int64) for t in found.values()]
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, firsts)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *firsts]))))
            yield pa.RecordBatch.from_arrays(columns, ["set_id", "tokens", *(f"first{i}" for i in range(1, more_orders + 1))])

    return batches


def _verified(percent: int):
    """Keeps pairs (a, b) whose sets are similar."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, None
        for batch in source:
            kept = []
            for i, (a, raw_a, raw_b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True)):
                if a != last:
                    last, first = a, np.frombuffer(raw_a.as_buffer(), np.uint64)
                second = np.frombuffer(raw_b.as_buffer(), np.uint64)
                shared = len(np.intersect1d(first, second, True))
                if 100 * shared >= percent * (len(first) + len(second) - shared):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).take(pa.array(kept, pa.int64()))

    return batches


def _frequent(tokens: DataFrame, most: int) -> Order:
    """The `most` most frequent tokens at most, with classes by the logarithm of their counts: a list of bounded size."""
    counts = materialize(tokens.groupBy("token").agg(F.sum("n").alias("n")).withColumn("class", F.least(F.floor(F.log2("n") * 4), F.lit(250)).cast("int")), "join-counts")
    sizes = {r["class"]: r["many"] for r in counts.groupBy("class").agg(F.count("*").alias("many")).collect()}  # 250 rows at most
    total, bound = 0, 251
    for level in sorted(sizes, reverse=True):
        total += sizes[level]
        if total > most:
            break
        bound = level
    rows = counts.filter(F.col("class") >= bound).select("token", "class").toArrow()
    return Order(rows["token"].to_numpy().view(np.uint64), rows["class"].to_numpy())


def similar_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, frequent: int = FREQUENT, more_orders: int = MORE_ORDERS) -> tuple[DataFrame, DataFrame]:
    """(documents, families). documents: doc_id, n, set_id for each row. families: node, root for each set that is linked with
    another set; two sets are in one family exactly if links of the given similarity lead from one to the other."""
    texts = modest_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    survey = materialize(texts.mapInArrow(_survey(words), "doc_id long, n long, set_id long, token long, " + ", ".join(f"{s} long" for s in _SKETCH)), "join-survey")
    documents = survey.filter("set_id is not null").select("doc_id", "n", "set_id", *_SKETCH)
    order = _frequent(survey.filter("token is not null").select("token", "n"), frequent)

    rows = texts.select("text").mapInArrow(_prefixes(order, words, percent), "token long, set_id long, n int, place int, frequent boolean")
    salted = rows.withColumn("salt", F.when(F.col("frequent"), F.pmod("set_id", F.lit(SALTS))).otherwise(0).cast("int"))
    together = W.partitionBy("token", "salt")
    several = salted.withColumn("least", F.min("set_id").over(together)).withColumn("most", F.max("set_id").over(together)).filter("frequent or least <> most")
    shared = materialize(several.select("token", "set_id", "n", "place").distinct(), "join-shared")
    needed = materialize(shared.select("set_id").distinct(), "join-partners")
    sketches = documents.filter("n > 0").join(needed, "set_id", "left_semi").groupBy("set_id").agg(*(F.max(s).alias(s) for s in _SKETCH))
    shared = materialize(shared.join(materialize(sketches, "join-sketches"), "set_id"), "join-shared")

    families = _tie_crowds(shared, texts, documents, order, words, percent, more_orders)
    pairs = _pairs(shared, families, percent)
    sets = _sets_of(pairs, texts, documents, order, words, percent, more_orders)
    pairs = materialize(_met(pairs, sets, more_orders), "join-pairs")
    for _ in range(ROUNDS):
        # Where sets have many partners, the likeliest are verified first; pairs that this brings into one family need no look.
        if pairs.count() <= DENSE * sets.count():
            break
        likely = F.col("apart")
        ranks = pairs.withColumn("of_a", F.row_number().over(W.partitionBy("a").orderBy(likely, "b"))).withColumn("of_b", F.row_number().over(W.partitionBy("b").orderBy(likely, "a")))
        ranks = materialize(ranks.withColumn("first", (F.col("of_a") <= PARTNERS) | (F.col("of_b") <= PARTNERS)).drop("of_a", "of_b"), "join-ranks")
        families = _joined(families, _check(ranks.filter("first"), sets, percent))
        pairs = ranks.filter("not first").drop("first")
        for side in ("a", "b"):
            pairs = pairs.join(families.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
        pairs = materialize(pairs.filter("root_a <> root_b").select("a", "b", "apart"), "join-pairs")
    return documents.select("doc_id", "n", "set_id"), _joined(families, _check(pairs, sets, percent))


def _joined(families: DataFrame | None, links: DataFrame) -> DataFrame:
    """Families after more links (a, b)."""
    links = materialize(links, "join-links")
    if families is not None:
        links = links.union(families.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return materialize(connected_components(links, "join-families"), "join-family")


def _owned(shared: DataFrame, families: DataFrame | None) -> DataFrame:
    """shared with root, the family of each set so far."""
    if families is None:
        return shared.withColumn("root", F.col("set_id"))
    return shared.join(families.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))


def _tie_crowds(shared: DataFrame, texts: DataFrame, documents: DataFrame, order: Order, words: int, percent: int, more_orders: int) -> DataFrame | None:
    """Families within tokens that more than CROWD sets share, so that later not all pairs of such a family are looked at.

    In each round neighbours in a shuffled order of a token's sets are verified if their families differ, at most PARTNERS for
    each set. It is only a start: whatever links it misses are found afterwards among all pairs of different families.
    """
    families, sets = None, None
    crowded = shared.groupBy("token").agg(F.count("*").alias("many")).filter(F.col("many") > CROWD).select("token")
    rows = materialize(shared.join(materialize(crowded, "join-crowded"), "token", "left_semi"), "join-crowds")
    if rows.isEmpty():
        return None
    for turn in range(ROUNDS):
        owned = _owned(rows, families)
        mixed = owned.groupBy("token").agg(F.approx_count_distinct("root", 0.1).alias("kinds")).filter(F.col("kinds") > CROWD).select("token")
        owned = owned.join(materialize(mixed, "join-mixed"), "token", "left_semi")
        shuffled = W.partitionBy("token", F.pmod(F.xxhash64("set_id", F.lit(turn)), F.lit(SALTS))).orderBy(F.xxhash64("set_id", "token", F.lit(turn)))
        others = [f"other{i}" for i in range(NEIGHBOURS)]
        met = owned.select("set_id", "root", "n", *_SKETCH, *(F.lag(F.struct("set_id", "root", "n", *_SKETCH), i + 1).over(shuffled).alias(o) for i, o in enumerate(others)))
        likely = []
        for other in others:
            apart = _apart([F.col(s) for s in _SKETCH], [F.col(f"{other}.{s}") for s in _SKETCH])
            able = (F.col("root") != F.col(f"{other}.root")) & (apart <= F.col("n") + F.col(f"{other}.n") - 2 * _wanted(F.col("n"), F.col(f"{other}.n"), percent))
            likely.append(F.when(able, F.struct(apart.alias("apart"), F.col(f"{other}.set_id").alias("b"))))
        met = met.select(F.col("set_id").alias("a"), F.least(*likely).alias("best")).filter("best is not null").groupBy("a", F.col("best.b").alias("b")).agg(F.min("best.apart").alias("apart"))
        nth = F.row_number().over(W.partitionBy("a").orderBy("apart", F.xxhash64("b", F.lit(turn))))
        pairs = met.withColumn("nth", nth).filter(F.col("nth") <= PARTNERS)
        pairs = materialize(pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("apart").alias("apart")), "join-pairs")
        if pairs.isEmpty():
            break
        if sets is None:
            sets = _sets_of(rows.select(F.col("set_id").alias("a"), F.col("set_id").alias("b")), texts, documents, order, words, percent, more_orders)
        links = materialize(_check(_met(pairs, sets, more_orders), sets, percent), "join-links")
        found = links.count()
        if not found:
            break
        families = _joined(families, links)
    return families


def _pairs(shared: DataFrame, families: DataFrame | None, percent: int) -> DataFrame:
    """All pairs (a, b, apart) of sets of different families that can be similar by their sketches, by what their prefixes
    share and by where; apart: bits in which the sketches differ.

    Let c be the number of shared prefix tokens and w the earlier of the two prefixes' last tokens. Up to w the sets share
    just these c tokens; beyond w the set whose prefix ends there has ceil(t n) - 1 tokens left. So their intersection is at
    most c plus that, and it has to reach t / (1 + t) of the sum of their sizes.
    """
    owned = materialize(_owned(shared, families), "join-owned")
    mixed = owned.groupBy("token").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("token")
    left = owned.join(materialize(mixed, "join-mixed"), "token", "left_semi")
    right = left.select("token", *(F.col(c).alias(f"other_{c}") for c in ("set_id", "n", "place", "root", *_SKETCH)))
    beyond = F.least(F.col("n") - F.col("place"), F.col("other_n") - F.col("other_place"))
    wanted = _wanted(F.col("n"), F.col("other_n"), percent)
    apart = _apart([F.col(s) for s in _SKETCH], [F.col(f"other_{s}") for s in _SKETCH])
    near = (F.col("root") < F.col("other_root")) & (F.least("n", "other_n") * 100 >= F.greatest("n", "other_n") * percent) & (apart <= F.col("n") + F.col("other_n") - 2 * wanted)
    both = left.join(right, (left["token"] == right["token"]) & near)
    both = both.select(F.least("set_id", "other_set_id").alias("a"), F.greatest("set_id", "other_set_id").alias("b"), F.greatest("n", "other_n").cast("long").alias("large"), wanted.alias("wanted"), beyond.alias("beyond"), apart.alias("apart"))
    counted = both.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("beyond").alias("beyond"), F.first("large").alias("large"), F.first("wanted").alias("wanted"), F.first("apart").alias("apart"))
    left_over = F.expr(f"({percent} * large + 99) div 100 - 1")
    # From a shared token on, and from the first one on for each similar pair, no more tokens can be shared than either has left.
    return materialize(counted.filter((F.col("c") + left_over >= F.col("wanted")) & (F.col("beyond") >= F.col("wanted"))).select("a", "b", "apart"), "join-pairs")


def _sets_of(pairs: DataFrame, texts: DataFrame, documents: DataFrame, order: Order, words: int, percent: int, more_orders: int) -> DataFrame:
    """set_id, tokens, and prefixes under further orders, of all sets in pairs; read once more from one document of each."""
    schema = "set_id long, tokens binary" + "".join(f", first{i} array<long>" for i in range(1, more_orders + 1))
    read = _sets(words, order, percent, more_orders)
    needed = materialize(pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct(), "join-needed")
    chosen = materialize(documents.select("doc_id", "set_id").join(needed, "set_id", "left_semi").groupBy("set_id").agg(F.min("doc_id").alias("doc_id")), "join-chosen")
    # A list of up to SMALL ids goes to all tasks; a longer one is joined by dealing out the texts.
    few = F.broadcast(chosen) if chosen.count() <= SMALL else chosen
    named = texts.join(few, "doc_id").select("set_id", "text").mapInArrow(read, schema)
    # Sets of documents without a doc_id, which no join by doc_id reaches.
    nameless = texts.filter("doc_id is null").select(F.lit(None).cast("long").alias("set_id"), "text").mapInArrow(read, schema)
    sets = materialize(named.union(nameless.join(needed, "set_id", "left_semi")), "join-sets")
    return materialize(sets.dropDuplicates(["set_id"]), "join-set")


def _met(pairs: DataFrame, sets: DataFrame, more_orders: int) -> DataFrame:
    """The pairs whose prefixes meet under all further orders; just these prefixes are read."""
    firsts = [f"first{i}" for i in range(1, more_orders + 1)]
    of_a = pairs.join(sets.select(F.col("set_id").alias("a"), *(F.col(f).alias(f"{f}_a") for f in firsts)), "a")
    of_b = of_a.join(sets.select(F.col("set_id").alias("b"), *(F.col(f).alias(f"{f}_b") for f in firsts)), "b")
    for f in firsts:
        of_b = of_b.filter(F.arrays_overlap(f"{f}_a", f"{f}_b"))
    return of_b.select(pairs.columns)


def _check(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that hold."""
    of_a = pairs.select("a", "b").join(sets.select(F.col("set_id").alias("a"), F.col("tokens").alias("tokens_a")), "a")
    of_b = of_a.join(sets.select(F.col("set_id").alias("b"), F.col("tokens").alias("tokens_b")), "b")
    return of_b.select("a", "b", "tokens_a", "tokens_b").mapInArrow(_verified(percent), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, frequent: int = FREQUENT, more_orders: int = MORE_ORDERS) -> DataFrame:
    """Returns for each row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case; a set holds the distinct sequences of `words` words, a shorter text is
    one sequence. Two documents are linked if 100 * intersection >= percent * union. Null, empty and blank texts have no
    shingles and are linked with nothing. Repeated rows and equal texts are linked with each other. A null doc_id counts as a
    document but is never the smallest; other columns are ignored.
    """
    documents, families = similar_sets(docs, words, percent, frequent, more_orders)
    empty = documents.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    named = documents.filter("n > 0").join(families.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    named = materialize(named.select("doc_id", "n", "root"), "join-named")
    least = materialize(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "join-least")
    return named.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(empty)


def _linked(left: list[dict], right: list[dict] | None, percent: int) -> list[tuple[int, int]]:
    """(set_id, links) for sets of two blocks, or of one with itself, that are linked with another set; each set is a dict with
    set_id, many (documents that have it) and tokens. A link counts once for each document of the other set."""
    of = [[np.frombuffer(s["tokens"], np.uint64) for s in side] for side in (left, right if right is not None else left)]
    flat = [np.concatenate(sets) for sets in of]
    if right is None:
        tokens, counts = np.unique(flat[0], return_counts=True)
        tokens = tokens[counts > 1]
    else:
        tokens = np.intersect1d(*flat)
    if not len(tokens):
        return []

    def table(sets: list[np.ndarray], all_tokens: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(tokens, all_tokens), len(tokens) - 1)
        has = tokens[at] == all_tokens
        out = np.zeros((len(sets), len(tokens)), np.float32)  # sums stay exact up to 2**24 shared tokens
        out[np.repeat(np.arange(len(sets)), [len(s) for s in sets])[has], at[has]] = 1
        return out

    first = table(of[0], flat[0])
    second = first if right is None else table(of[1], flat[1])
    shared = np.rint(first @ second.T).astype(np.int64)
    n, other_n = (np.array([len(s) for s in side], np.int64) for side in of)
    linked = 100 * shared >= percent * (n[:, None] + other_n[None, :] - shared)
    if right is None:
        np.fill_diagonal(linked, False)
    found = [(left, linked @ np.array([s["many"] for s in right or left], np.int64))]
    if right is not None:
        found.append((right, np.array([s["many"] for s in left], np.int64) @ linked))
    return [(s["set_id"], int(links)) for side, counts in found for s, links in zip(side, counts, strict=True) if links]


def _links(percent: int):
    """(set_id, links) for rows of blocks (sets), or of pairs of blocks (sets, other_sets)."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = []
            for i in range(batch.num_rows):
                rows += _linked(batch.column(0)[i].as_py(), batch.column(1)[i].as_py() if batch.num_columns > 1 else None, percent)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["set_id", "links"])

    return batches


def link_counts(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, frequent: int = FREQUENT, more_orders: int = MORE_ORDERS) -> DataFrame:
    """near_duplicates with n_links for each row: the number of other rows that it is linked with, all of them counted.

    Sets of a family are dealt to bands by size, and within a band to blocks. Linked sets lie in one band or in neighbours.
    """
    documents, families = similar_sets(docs, words, percent, frequent, more_orders)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    many = materialize(documents.filter("n > 0").groupBy("set_id").agg(F.count("*").alias("many"), F.first("n").alias("n")), "join-many")
    # Slightly wider than the ratio of sizes that a link allows, so that rounding puts no link two bands apart.
    width = math.log(100 / percent) * 1.01 + 1e-3
    banded = materialize(families.select(F.col("node").alias("set_id"), "root").join(many, "set_id").withColumn("band", F.floor(F.log("n") / width)), "join-bands")
    sizes = banded.groupBy("root", "band").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).alias("blocks"))
    sizes = materialize(sizes, "join-sizes")
    placed = banded.join(sizes, ["root", "band"]).select("set_id", "many", "root", "band", F.pmod(F.xxhash64("set_id"), "blocks").alias("block"))
    order = Order(np.empty(0, np.uint64), np.empty(0, np.uint8))
    sets = _sets_of(families.select(F.col("node").alias("a"), F.col("node").alias("b")), texts, documents, order, words, percent, 0)
    blocks = placed.join(sets, "set_id").groupBy("root", "band", "block").agg(F.collect_list(F.struct("set_id", "many", "tokens")).alias("sets"))
    blocks = materialize(blocks, "join-blocks")

    each = sizes.select("root", "band", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    same = each.filter("block < blocks - 1").select("root", "band", "block", F.col("band").alias("other_band"), F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("other_block"))
    above = each.select("root", (F.col("band") - 1).alias("band"), F.col("band").alias("other_band"), F.col("block").alias("other_block"))
    pairs = same.union(each.join(above, ["root", "band"]).select("root", "band", "block", "other_band", "other_block"))
    others = blocks.select("root", *(F.col(c).alias(f"other_{c}") for c in ("band", "block", "sets")))
    met = materialize(pairs, "join-met").join(blocks, ["root", "band", "block"]).join(others, ["root", "other_band", "other_block"]).select("sets", "other_sets")
    schema = "set_id long, links long"
    links = blocks.filter("size(sets) > 1").select("sets").mapInArrow(_links(percent), schema).union(met.mapInArrow(_links(percent), schema))
    links = materialize(materialize(links, "join-counts").groupBy("set_id").agg(F.sum("links").alias("links")), "join-links")

    of_set = many.join(families.withColumnRenamed("node", "set_id"), "set_id", "left").join(links, "set_id", "left")
    of_set = of_set.select("set_id", F.coalesce("root", "set_id").alias("root"), (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named = materialize(documents.filter("n > 0").join(of_set, "set_id").select("doc_id", "n", "root", "n_links"), "join-named")
    least = materialize(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "join-least")
    empty = documents.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return named.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links").union(empty)


def _with_set_id(words: int):
    """The rows without their last column, a text, and with the id of its set: null where it has no shingle."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in parts(source):
            found = [shingles(text, known, words) for text in utf8(batch.columns[-1])]
            ids = pa.array([set_id(tokens) if len(tokens) else None for tokens in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*batch.schema.names[:-1], "_set_id"])

    return batches


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group of near duplicates: that with the smallest doc_id (null after all others), of several
    with that id one by set id, then text. Rows without a shingle are in no group and stay."""
    documents, families = similar_sets(docs, words, percent)
    owned = documents.filter("n > 0").join(families.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    first = owned.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "set_id")).alias("row"))
    first = materialize(first.select(F.col("row.doc_id").alias("_doc_id"), F.col("row.set_id").alias("_set_id")), "join-first")
    repeated = materialize(documents.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_doc_id")).agg(F.count("*").alias("many")).filter("many > 1").select("_doc_id"), "join-repeated")

    # An id that is there once stands for its row; for the others, the set tells which of the rows is meant.
    own = F.col("doc_id").cast("long") == F.col("_doc_id")
    single = first.select("_doc_id").union(documents.filter("n = 0").select("doc_id")).join(repeated, "_doc_id", "left_anti")
    kept = docs.join(single, own, "left_semi")
    several = docs.filter("doc_id is null").union(docs.join(repeated, own, "left_semi").select(docs.columns))
    several = several.withColumn("_text", F.col("text").cast("string")).mapInArrow(_with_set_id(words), StructType([*docs.schema, StructField("_set_id", LongType())]))
    met = several.join(first.withColumnRenamed("_set_id", "_first"), F.col("doc_id").cast("long").eqNullSafe(F.col("_doc_id")) & (F.col("_set_id") == F.col("_first")), "left_semi")
    one = met.groupBy("doc_id", "_set_id").agg(F.min_by(F.struct(*docs.columns), "text").alias("row")).select("row.*")
    return kept.select(docs.columns).union(one.select(docs.columns)).union(several.filter("_set_id is null").select(docs.columns))
