"""From documents to token ids: language, near duplicates, personal data, mixture, pieces.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame; all but the last
return the columns of documents. Rows are rows: ids may be null or repeated, other columns null, texts empty or very long, and
further columns stay as they are. A table without rows gives one without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from titleforge.llm import fair_mix, jaccard_join, lang_id, pii, transducer
from titleforge.llm.common import SPACE_PATTERN, SPACES, materialize
from titleforge.llm.queries import PIECES


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or letter go. The language that a text shows replaces another stated one and fills in a missing one,
    with und if the text shows none or no label was learned; it goes with the rows to the token ids. Ids play no part, so rows
    with null or repeated ones are judged by their texts like others."""
    return lang_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id, null after all others; of several
    rows with that id one by set id, then text. Texts without a word are in no group and stay."""
    return jaccard_join.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text. Every row stays; a null text stays null."""
    return pii.redact_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: whole documents once or twice, and the one at a source's cut with as many of its
    words as are taken, joined by blanks. Documents that aren't taken go."""
    mix = fair_mix.fair_mix(docs)
    mix = mix.withColumn("nth", F.row_number().over(W.partitionBy("doc_id", "source", "size").orderBy("taken")))
    mix = mix.filter("taken > 0").select(*(F.col(c).alias(f"_mix_{c}") for c in ("doc_id", "source", "size", "nth", "taken")))
    sized = docs.withColumn("_size", fair_mix.word_count(F.col("text")))  # columns of docs may be named size or nth
    left = sized.withColumn("_nth", F.row_number().over(W.partitionBy("doc_id", "source", "_size").orderBy("text")))
    same = F.col("_nth") == F.col("_mix_nth")
    for name in ("doc_id", "source", "_size"):
        same = same & F.col(name).eqNullSafe(F.col(f"_mix_{name.lstrip('_')}"))
    rows = left.join(mix, same)
    words = F.split(F.btrim("text", F.lit(SPACES)), SPACE_PATTERN)
    rest = F.col("_mix_taken") % F.col("_size")
    texts = F.concat(F.array_repeat("text", F.floor(F.col("_mix_taken") / F.col("_size")).cast("int")), F.when(rest > 0, F.array(F.array_join(F.slice(words, F.lit(1), rest.cast("int")), " "))).otherwise(F.array().cast("array<string>")))
    out = rows.withColumn("text", F.explode(texts)).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with digests of ids and of the decoded text, and its language; a null text has no tokens. Every row
    stays."""
    return transducer.encode_documents(docs, PIECES, also=("lang",))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("pieces", pieces),
]

#: SQL can express neither the language nor the pieces; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder before the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
