"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words everywhere in this subpackage: x20 and x09 to x0D, what bytes.split() takes.
SPACES = " \t\n\x0b\f\r"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all run on
    this machine (tests). On a cluster it has to be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local") or "cluster" in spark.conf.get("spark.master", ""):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="titleforge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when this Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone; the files are then the cluster's to clean up
            return


def release(*tables: DataFrame) -> None:
    """Removes the files of materialized tables that nothing reads any more."""
    for table in tables:
        path = table._titleforge_path
        _delete(table.sparkSession, path)
        _written[:] = [w for w in _written if w[1] != path]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._titleforge_path = path
    return table


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; 0 for null."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, 0).otherwise(F.size(F.split(trimmed, SPACE_PATTERN))).cast("long")


def modest_batches(df: DataFrame) -> DataFrame:
    """df, in a session that hands texts to Python a thousand rows at a time instead of Spark's default of ten thousand, as texts
    are long. Another setting than the default is left as it is."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return df


class Recent(dict):
    """Remembers at least the last `size` entries, and twice as many at most: the older half goes at once."""

    def __init__(self, size: int) -> None:
        self.size, self.older = size, {}

    def __missing__(self, key: object) -> object:
        """None for an unknown key; an old one is young again."""
        found = self.older.get(key)
        if found is not None:
            self.put(key, found)
        return found

    def put(self, key: object, value: object) -> None:
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value


def parts(source: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that what is made of the texts of a slice stays small."""
    for batch in source:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


class WordHashes(dict):
    """64-bit hash of each word; bounded, as words repeat."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64's)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of all n-grams of hashed words, in order; empty if there are fewer words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(count, np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) & (2**64 - 1)))
        for i in range(n):
            total = mix(total + words[i : i + count]) if n <= 8 else total * np.uint64(0x9FB21C651E98DF25) + words[i : i + count]
        return mix(total)
