"""Connected components of text keys by least labels."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or "cluster" in context.master:
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="titleforge-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """edges: a, b. Returns node, root (the smallest node reachable). Labels travel along edges and jump to their labels'
    labels; each round is checkpointed, and the last is the one in which none changes. Raises beyond `rounds`.

    The folder is that of spark.checkpoint.dir; where it is unset and all run on this machine, a temporary one."""
    cut = checkpointed
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")))
    for _ in range(rounds):
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("at")).agg(F.min("root").alias("near"))
        stepped = labels.join(seen, F.col("node") == F.col("at")).select("node", F.least("root", "near").alias("next"), F.col("root").alias("before"))
        jumped = stepped.join(labels.select(F.col("node").alias("hop"), F.col("root").alias("far")), F.col("next") == F.col("hop"), "left")
        after = cut(jumped.select("node", F.least("next", F.coalesce("far", "next")).alias("root"), "before"))
        if after.filter("root <> before").isEmpty():
            return labels.select("node", "root")
        labels = after.drop("before")
    raise RuntimeError(f"components are not settled after {rounds} rounds")
