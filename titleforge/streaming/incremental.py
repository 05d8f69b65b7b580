"""An extension: new record files resolved as they arrive, with ids that stay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.match import resolve_mentions


def resolve_stream(spark: SparkSession, folder: str, entities: DataFrame, aliases: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Parquet files with a column mention that arrive in a folder; each micro-batch goes through the cascade and to sink with
    its number, so that a sink can tell a repeated batch."""
    rows = spark.readStream.schema("mention string").parquet(folder)

    def each(batch: DataFrame, number: int) -> None:
        sink(resolve_mentions(batch, entities, aliases), number)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
