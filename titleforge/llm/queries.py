"""The queries op1 to op10 over the test tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fair_mix, flac, jaccard_join, lang_id, pii, repeats, transducer, va_search, warc, word_pieces

#: Where the public tokenizers' files lie on every machine.
PIECES, RANKS = "/opt/tokenizers/piece_bpe_32k.model", "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_documents(spark, sf_dir))


def op1_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_counts(_documents(spark, sf_dir))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_documents(_documents(spark, sf_dir))


def op3_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.describe(flac.store(_documents(spark, sf_dir)))


def op4_va_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_search.top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(_documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_pieces.count_pieces(_documents(spark, sf_dir), RANKS)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_documents(spark, sf_dir))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = warc.capture_history(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.encode_documents(_documents(spark, sf_dir), PIECES, with_ids=False)


def op10_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.fair_mix(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard, op2_personal_data, op3_flac_media, op4_va_topk, op5_language, op6_token_counts, op7_repeats, op8_warc, op9_sentencepiece, op10_fair_mix, op1_jaccard_links)}


_OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i + 4], ' ') END AS gram
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(words) - 3, 2))) AS i) s WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

_OP1_LINKS = (
    _OP1.replace("r.component_id\n", "r.component_id, coalesce(l.n_links, 0)::BIGINT AS n_links\n")
    + "LEFT JOIN (SELECT a, count(*) AS n_links FROM both_ways GROUP BY a) l ON l.a = d.doc_id\n"
)

_OP7 = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT r, i, sha256(array_to_string(words[i:i + 34], ' ')) AS h FROM w, LATERAL (SELECT unnest(range(1, len(words) - 33)) AS i) s),
often AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + o AS p FROM win JOIN often USING (h), range(35) t(o)),
kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
  FROM (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w) x ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": _OP1, "op1_jaccard_links": _OP1_LINKS, "op4_va_topk": va_search.ORACLE, "op7_repeats": _OP7, "op8_warc": warc.ORACLE, "op10_fair_mix": fair_mix.ORACLE}
