"""Connected components of an edge table, by forests of lots of edges and alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Edges (16 bytes each) that one task unites at once.
LOT = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), and for each the smallest node that these edges reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (apart := root[x] != root[y]).any():
        x, y = root[x[apart]], root[y[apart]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, up := root[root]):
            root = up
    return nodes, nodes[root]


def _forests(lot: int, with_roots: bool):
    """Each lot's edges as stars (a: smallest node, b: node) around its smallest nodes, with or without edges to themselves."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def stars() -> pa.RecordBatch:
            edges = pa.Table.from_batches(held)
            nodes, roots = forest(edges["a"].to_numpy(), edges["b"].to_numpy())
            kept = slice(None) if with_roots else nodes != roots
            return pa.RecordBatch.from_arrays([pa.array(roots[kept]), pa.array(nodes[kept])], ["a", "b"])

        for batch in source:
            held.append(batch)
            size += batch.num_rows
            if size >= lot:
                yield stars()
                held, size = [], 0
        if size:
            yield stars()

    return batches


def _all_stars(pairs: DataFrame) -> bool:
    """Whether each edge leads from a root to a leaf: no node has two parents, or a parent and children."""
    ends = pairs.select(F.col("b").alias("node"), F.lit(1).alias("parents"), F.lit(0).alias("children")).union(pairs.select("a", F.lit(0), F.lit(1)))
    inner = ends.groupBy("node").agg(F.sum("parents").alias("parents"), F.max("children").alias("children")).filter("parents > 1 or (parents = 1 and children = 1)")
    return inner.agg(F.count("*")).first()[0] == 0


def connected_components(edges: DataFrame, name: str = "components", lot: int = LOT) -> DataFrame:
    """edges has a, b (long) and should be a written table, as it is read twice. Returns node, root: the smallest node
    reachable; each node of an edge once, but not those of edges to themselves or to null alone.

    Tasks of about `lot` edges first replace theirs by stars around the smallest node that these reach; one lot needs no more.
    Beyond that, each step keeps connectivity and brings edges nearer to stars around the smallest node; it ends as soon as all
    edges are such stars. Every step reads and writes a table in the shared folder. The number of steps grows with the
    logarithm of the longest path, and a node with very many edges is only ever aggregated or joined, not gathered.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b")
    lots = -(-pairs.count() // lot)
    if lots <= 1:
        return pairs.coalesce(1).mapInArrow(_forests(2 * lot, True), "root long, node long").select("node", "root")
    while True:
        pairs = materialize(pairs.coalesce(lots).mapInArrow(_forests(lot, False), "a long, b long").distinct(), name)
        if _all_stars(pairs):
            break
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = both.filter("b > a").join(least, "a").select(F.col("root").alias("a"), "b").filter("a < b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("root"))
        small = large.join(down, "b").select(F.col("root").alias("x"), F.explode(F.array("a", "b")).alias("y")).filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        pairs = materialize(small, name)
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("root")).union(pairs.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
