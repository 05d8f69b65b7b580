"""Operator 4: exact top-k search with vector-approximation files.

Each lot of vectors has an approximation file: a byte for each component, its cell between the lot's least and greatest
value. Scanning the cells bounds every inner product from both sides. A vector stays only if its upper bound reaches the kth
best lower bound; exact vectors are then read in order of their bounds until the kth result is certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

TOP = 5
#: Every how manieth vec_id is a query.
EVERY = 50
#: Vectors in an approximation file at most, bytes of queries that are sent to all tasks at once, cells of a component.
BLOCK, SENT, CELLS = 4096, 16_000_000, 256


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _approximate(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An approximation file, as one row, for each lot of up to BLOCK vectors (row, vec_id, v) of one length; made where they lie."""
    for batch in source:
        dims = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            own = np.flatnonzero(dims == dim)
            for at in range(0, len(own), BLOCK):
                part = batch.take(pa.array(own[at : at + BLOCK]))
                values = _matrix(part.column(2), dim)
                low, high = values.min(0), values.max(0)
                step = np.maximum((high - low) / CELLS, np.finfo(np.float64).tiny)
                cells = np.clip(np.floor((values - low) / step), 0, CELLS - 1).astype(np.uint8)
                packed = [[dim], *([x.tobytes()] for x in (part.column(0).to_numpy(), cells, low, step))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(packed, [pa.int32()] + [pa.binary()] * 4, strict=True)], ["dim", "rows", "cells", "low", "step"])


def bounds(cells: np.ndarray, low: np.ndarray, step: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of queries (rows) with the vectors of a file (columns)."""
    floor = low + cells * step
    ceiling = low + (cells + 1.0) * step
    slack = 1e-9 * np.maximum(np.abs(floor), np.abs(ceiling)) + 1e-9  # a cell's edges are rounded
    floor, ceiling = floor - slack, ceiling + slack
    above, below = np.maximum(queries, 0), np.minimum(queries, 0)
    lower, upper = above @ floor.T + below @ ceiling.T, above @ ceiling.T + below @ floor.T
    loose = 1e-12 * (np.abs(lower) + np.abs(upper)) + 1e-6
    return lower - loose, upper + loose


def _scan(top: int, asked: dict[int, tuple[np.ndarray, np.ndarray]]):
    """asked: by length the rows and vectors of queries. (query_row, row, lower, upper) of what can be among a query's best; a
    task carries each query's kth lower bound from one file to the next."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: np.full((len(rows), top), -np.inf) for dim, (rows, _) in asked.items()}
        for batch in source:
            for i in range(batch.num_rows):
                dim = batch.column(0)[i].as_py()
                if dim not in asked:
                    continue
                query_rows, queries = asked[dim]
                rows, cells, low, step = (np.frombuffer(batch.column(k)[i].as_buffer(), t) for k, t in ((1, np.int64), (2, np.uint8), (3, np.float64), (4, np.float64)))
                for at in range(0, len(query_rows), 512):
                    part = slice(at, at + 512)
                    lower, upper = bounds(cells.reshape(-1, dim), low, step, queries[part])
                    own = query_rows[part, None] == rows[None, :]
                    lower[own], upper[own] = -np.inf, -np.inf
                    together = np.concatenate([best[dim][part], lower], axis=1)
                    best[dim][part] = np.partition(together, together.shape[1] - top, axis=1)[:, -top:]
                    q, v = np.nonzero((upper >= best[dim][part].min(1)[:, None]) & ~own)
                    yield pa.RecordBatch.from_arrays([pa.array(query_rows[part][q]), pa.array(rows[v]), pa.array(lower[q, v]), pa.array(upper[q, v])], ["query_row", "row", "lower", "upper"])

    return batches


def _product(x: np.ndarray, y: np.ndarray) -> int:
    if np.abs(x) @ np.abs(y) < 2**53:
        return int(x @ y)
    exact = sum(int(a) * int(b) for a, b in zip(x, y, strict=True))
    return max(-(2**63), min(2**63 - 1, exact))


def _verify(top: int):
    """Rows come sorted by query and falling upper bound."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, best, vector, name = None, [], None, None

        def done() -> pa.RecordBatch:
            rows = [(name, rank, i, -s) for rank, (s, i, _) in enumerate(best, 1)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["query_id", "rank", "vec_id", "score"])

        for batch in source:
            query_rows, query_ids, rows, vec_ids, uppers = (batch.column(i).to_pylist() for i in range(5))
            vectors, queries = batch.column(5), batch.column(6)
            for i, query in enumerate(query_rows):
                if query != current:
                    if best:
                        yield done()
                    current, best, vector, name = query, [], np.array(queries[i].as_py()), query_ids[i]
                if len(best) == top and -best[-1][0] > uppers[i]:
                    continue  # certain: no later bound of this query is higher
                item = (-_product(vector, np.array(vectors[i].as_py())), vec_ids[i], rows[i])
                if len(best) < top or item < best[-1]:
                    best = sorted([*best, item])[:top]
        if best:
            yield done()

    return batches


def _asked(queries: DataFrame, sent: int) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The queries by length, so many at once that they are of `sent` bytes at most (one query at least)."""
    size = queries.agg(F.coalesce(F.sum(8 * F.size("v") + 8), F.lit(0))).first()[0]
    lots = -(-2 * size // sent)  # so that lots dealt by hash stay near half of what may be sent
    for lot in range(lots):
        table = queries.filter(F.pmod(F.xxhash64("row"), F.lit(lots)) == lot).select("row", "v").toArrow().combine_chunks()
        rows, vectors = table["row"].to_numpy(), table["v"].combine_chunks()
        dims = vectors.value_lengths().to_numpy(zero_copy_only=False) if len(rows) else np.empty(0, int)
        at = 0
        while at < len(rows):
            until = at + max(1, int(np.searchsorted(np.cumsum(8 * dims[at:] + 8), sent, "right")))
            part = np.arange(at, until)
            of = {dim: part[dims[part] == dim] for dim in np.unique(dims[part]).tolist()}
            yield {dim: (rows[own], _matrix(vectors.take(pa.array(own)), dim)) for dim, own in of.items()}
            at = until


def top_products(embeddings: DataFrame, top: int = TOP, every: int = EVERY, sent: int = SENT) -> DataFrame:
    """Returns for each query (a row whose vec_id is divisible by `every`) its `top` highest inner products with other rows:
    query_id, rank (from 1), vec_id, score. Components x count as floor(256 x); ties go to the smaller vec_id.

    Vectors that are null or empty, hold null or non-finite components, or have no id take no part; only vectors of equal
    length are compared. Rows that repeat an id, or a whole row, are rows of their own: each is a query if its id says so, and
    a candidate for all others. Of equal vectors only the top + 1 smallest ids are candidates, since larger ones can't come
    before them, so a very common vector costs no more than others. A query with fewer partners gets fewer rows, one without
    partners none. Scores beyond 64 bits are cut to them. Other columns are ignored.

    Approximation files stay where their vectors lie. Queries are sent to them in lots of at most `sent` bytes, one after another.
    """
    spark = embeddings.sparkSession
    whole = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.col("vec_id").isNotNull()
    wide = F.transform("embedding", lambda x: x.cast("double") * 256)
    scaled = embeddings.filter(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(wide, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)).alias("v"))
    # Written with the number, which tells rows apart from here on.
    vectors = materialize(scaled.withColumn("row", F.monotonically_increasing_id()), "va-vectors").select("row", "vec_id", "v")
    nth = F.row_number().over(W.partitionBy("v").orderBy("vec_id", "row"))
    candidates = materialize(vectors.withColumn("nth", nth).filter(F.col("nth") <= top + 1).drop("nth"), "va-candidates")
    queries = vectors.filter(F.col("vec_id") % every == 0)

    files = materialize(candidates.mapInArrow(_approximate, "dim int, rows binary, cells binary, low binary, step binary"), "va-files")
    schema = "query_row long, row long, lower double, upper double"
    found = None
    for asked in _asked(queries, sent):
        more = materialize(files.mapInArrow(_scan(top, asked), schema), "va-found")
        found = more if found is None else found.union(more)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    ranked = found.withColumn("nth", F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("lower")))).filter(F.col("nth") <= top)
    least = ranked.groupBy("query_row").agg(F.when(F.count("*") == top, F.min("lower")).otherwise(F.lit(float("-inf"))).alias("least"))
    kept = found.join(least, "query_row").filter(F.col("upper") >= F.col("least")).select("query_row", "row", "upper")
    kept = kept.join(candidates, "row").join(queries.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_row")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = kept.select("query_row", "query_id", "row", "vec_id", "upper", "v", "q").repartition(parts, "query_row").sortWithinPartitions("query_row", F.desc("upper"), "vec_id", "row")
    return ordered.mapInArrow(_verify(top), "query_id long, rank int, vec_id long, score long")


#: The same in SQL for DuckDB, over the table embeddings.
ORACLE = f"""
WITH whole AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % {EVERY} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= {TOP}
"""
