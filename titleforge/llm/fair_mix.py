"""Operator 10: mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, word_count

#: Weights of the sources in order of code point, null last; repeated as often as needed.
WEIGHTS = (5, 2, 1)
#: The mix holds this share of all words.
BUDGET = 1.5
#: Times that a document may be taken.
PASSES = 2
#: Mean rows in a bucket of the running sums.
BUCKET_ROWS = 4096


def _running(df: DataFrame, by: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """df with, for each (new name: column) of sums, the sum of that column up to the row in the order of `by`, itself
    included. Rows are dealt to ranges; only the ranges' totals, a row for each, meet, so no task holds all rows."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = materialize(df.repartitionByRange(parts, *by).withColumn("part", F.spark_partition_id()), name)
    totals = dealt.groupBy("part").agg(*(F.sum(c).alias(n) for n, c in sums.items())).collect()
    before, at = {}, {n: 0.0 if dict(df.dtypes)[c] == "double" else 0 for n, c in sums.items()}
    for row in sorted(totals, key=lambda r: r["part"]):
        before[row["part"]] = dict(at)
        at = {n: at[n] + (row[n] or 0) for n in sums}
    within = W.partitionBy("part").orderBy(*by).rowsBetween(W.unboundedPreceding, W.currentRow)
    schema = "part int, " + ", ".join(f"_{n} {dict(dealt.dtypes)[c]}" for n, c in sums.items())
    starts = df.sparkSession.createDataFrame([(part, *own.values()) for part, own in before.items()], schema)  # a row for each range
    dealt = dealt.join(F.broadcast(starts), "part")
    for n, c in sums.items():
        dealt = dealt.withColumn(n, F.sum(c).over(within) + F.col(f"_{n}")).drop(f"_{n}")
    return dealt.drop("part")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, passes: int = PASSES) -> DataFrame:
    """A row for each source: source, source_rank (from 0), weight, source_rows, source_size, target, level.

    Water filling in closed form: sources ordered by cap / weight fill up first; with those before i at their caps, the
    level of the others is (budget - caps before) / (weights from i on). That level rises while caps bind and falls
    afterwards, so the true level is the largest.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"), F.lit(1).cast("long").alias("one"))
    ranked = _running(sums, [F.col("source").asc_nulls_last()], {"source_rank": "one"}, "mix-sources").withColumn("source_rank", F.col("source_rank") - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size").cast("double") * passes).withColumn("fills", F.col("cap") / F.col("weight"))
    filled = materialize(_running(ranked, [F.col("fills"), F.col("source_rank")], {"caps": "cap", "weights": "weight"}, "mix-filled"), "mix-levels")
    whole = filled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(float(budget) * (whole["size"] or 0)) - (F.col("caps") - F.col("cap"))) / (F.lit(float(whole["weight"] or 0)) - (F.col("weights") - F.col("weight")))
    highest = filled.agg(F.max(level)).first()[0] or 0.0
    return filled.select("source", "source_rank", "weight", "source_rows", "source_size", F.least("cap", F.lit(highest) * F.col("weight")).alias("target"), F.lit(highest).alias("level"))


def shuffled(doc_id: Column) -> Column:
    """A document's place in the shuffle, in [0, 1): the first 48 bits of the MD5 of its id, so that reruns agree."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def fair_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, passes: int = PASSES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Returns for each row of docs: doc_id, source, size, source_size, target, taken.

    Each source's documents are shuffled and served one after another, up to `passes` times round, all sources at once in
    proportion to their weights. A document's virtual finish time is the source's words up to its end divided by the source's
    weight. At the time when the whole budget has been served (the level of the reshared targets), documents that have
    finished are taken whole, and the one in service in each source with the words served so far, rounded up. These rows are
    sorted by their time across the cluster, and the mix ends where the total budget is used up, which shortens the last ones
    by what was rounded up: a word for each source at most. So each source is within a few words of its target.

    Running sums never gather a source in one task: rows go to buckets of about bucket_rows by their place in the shuffle,
    the buckets' sums give each bucket's start, and only a bucket is sorted at once. Global orders use range partitionings with
    the sums of the partitions.

    Null or empty text: size 0, taken 0. Null source: a source of its own, last in order. Null or repeated ids: rows are
    served each for itself; equal rows are interchangeable. No rows: no rows. Other columns are ignored.
    """
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), shuffled(F.col("doc_id")).alias("place")), "mix-sizes")
    targets = materialize(source_targets(sized, weights, budget, passes).coalesce(1), "mix-targets")
    keyed = sized.withColumnRenamed("source", "own_source")
    rows = keyed.join(targets, F.col("own_source").eqNullSafe(F.col("source")), "inner").drop("own_source")
    rows = rows.withColumn("bucket", F.floor(F.col("place") * F.ceil(F.col("source_rows") / bucket_rows)))
    starts = rows.groupBy("source_rank", "bucket").agg(F.sum("size").alias("words")).withColumn("bucket_start", F.sum("words").over(W.partitionBy("source_rank").orderBy("bucket")) - F.col("words")).drop("words")
    within = W.partitionBy("source_rank", "bucket").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("start", F.sum("size").over(within) - F.col("size")).join(starts, ["source_rank", "bucket"])
    rows = materialize(rows.withColumn("start", F.col("start") + F.col("bucket_start")).select("doc_id", "source", "size", "source_size", "target", "source_rank", "weight", "level", "start"), "mix-rows")

    served = rows.filter("size > 0").select("source_rank", "start", "size", "weight", "level", F.explode(F.transform(F.sequence(F.lit(0), F.lit(passes - 1)), lambda p: p * F.col("source_size"))).alias("round_start"))
    words = F.least(F.col("size"), F.ceil(F.col("level") * F.col("weight") - F.col("round_start") - F.col("start")))
    finish = F.least(F.col("level"), (F.col("round_start") + F.col("start") + F.col("size")) / F.col("weight"))
    served = served.select("source_rank", "start", (F.col("round_start") + F.col("start")).alias("begin"), finish.alias("finish"), words.alias("words")).filter("words > 0")
    total = int(float(budget) * (sized.agg(F.sum("size")).first()[0] or 0))
    ordered = _running(served, [F.col("finish"), F.col("source_rank"), F.col("begin")], {"used": "words"}, "mix-order")
    kept = ordered.withColumn("words", F.least("words", F.lit(total) - F.col("used") + F.col("words"))).filter("words > 0")
    taken = kept.groupBy("source_rank", "start").agg(F.sum("words").alias("taken"))
    found = rows.withColumn("served", F.col("size") > 0).join(taken.withColumn("served", F.lit(True)), ["source_rank", "start", "served"], "left")
    return found.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


#: The same in SQL for DuckDB, over the table documents.
ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:12])::BIGINT::DOUBLE / {2**48}.0::DOUBLE AS place
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_rank, 2.0::DOUBLE * source_size AS cap FROM sums),
weighed AS (SELECT *, [5.0, 2.0, 1.0][(source_rank % 3 + 1)::INT]::DOUBLE AS weight FROM ranked),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (SELECT source, source_rank, weight, source_size, least(cap, max(level) OVER () * weight) AS target FROM levels),
placed AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.source_rank, t.weight,
         (sum(d.size) OVER (PARTITION BY t.source_rank ORDER BY d.place, d.doc_id, d.size ROWS UNBOUNDED PRECEDING))::BIGINT - d.size AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
served AS (
  SELECT p.source_rank, p.start, r.pass * p.source_size + p.start AS begin, least(l.level, (r.pass * p.source_size + p.start + p.size)::DOUBLE / p.weight) AS finish,
         least(p.size, ceil(l.level * p.weight - r.pass * p.source_size - p.start)::BIGINT) AS words
  FROM placed p, (VALUES (0), (1)) AS r(pass), (SELECT max(level) AS level FROM levels) l WHERE p.size > 0),
cumulated AS (
  SELECT *, floor(1.5::DOUBLE * (SELECT sum(size) FROM sized)) - (sum(words) OVER (ORDER BY finish, source_rank, begin ROWS UNBOUNDED PRECEDING) - words) AS remaining FROM served WHERE words > 0),
taken AS (SELECT source_rank, start, sum(greatest(0, least(words, remaining)))::BIGINT AS taken FROM cumulated GROUP BY ALL)
SELECT p.doc_id, p.source, p.size, p.source_size, p.target, CASE WHEN p.size > 0 THEN coalesce(t.taken, 0) ELSE 0 END AS taken
FROM placed p LEFT JOIN taken t ON p.source_rank = t.source_rank AND p.start = t.start
"""
