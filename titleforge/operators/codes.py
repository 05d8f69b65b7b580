"""Classification codes: lookup and attachment, and ranking of buyers by the overlap of their codes with a portfolio's."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import checkpointed as checkpointed
from ..functions.text import doc_type, grain_of, normalize_grant, normalize_patent_id, recency, reduce_codes, year_of


@dataclass(frozen=True)
class MatchConfig:
    grain: str = "subclass"
    metric: str = "shared_count"
    threshold: float = 1.0
    min_patents: int = 1
    floor: float = 0.5
    w_overlap: float = 1.0
    w_volume: float = 1.0
    w_recency: float = 1.0


# The columns of the three results.
PER = "portfolio_patent buyer overlap_strength in_domain_patents last_acquisition_date shared_codes is_off_gazetteer rank_score rank".split()
OVERALL = "buyer portfolio_patents_matched total_overlap_strength in_domain_patents last_acquisition_date is_off_gazetteer".split()
CLASSES = "portfolio_patent buyer buyer_patent cpc_class year is_off_gazetteer".split()
#: Lists that the portfolio patents of a set come in, so that none gets too long for a row.
LISTS = 16
#: No year is less. Asking for it keeps years in each use of the buyers' sets, so that Spark makes their rows once for all of them.
LEAST_YEAR = -(2**31)
#: Tasks for each core that result rows are made in; fewer would leave cores idle, as Spark merges tasks by what they read.
TASKS = 4


def lookup(ids: DataFrame, codes: DataFrame, delimiter: str = ";") -> DataFrame:
    """ids: patent_id. codes: patent_id, cpc (one to a cell, or several with a delimiter). Returns patent_id, cpc_codes for wanted ids found."""
    parts = F.split(F.col("cpc"), re.escape(delimiter)) if delimiter else F.array("cpc")
    cells = codes.select(normalize_grant(F.col("patent_id").cast("string")).alias("patent_id"), F.explode(parts).alias("code")).withColumn("code", F.trim("code")).filter("code <> ''")
    return cells.join(ids.select("patent_id").distinct(), "patent_id", "left_semi").groupBy("patent_id").agg(F.array_sort(F.collect_set("code")).alias("cpc_codes"))


def resolve_cached(ids: DataFrame, cache: DataFrame, source: DataFrame | None, now: float, ttl: float) -> tuple[DataFrame, DataFrame]:
    """(patent_id, cpc_codes, status; new cache). Fresh entries serve from the cache, empty lists too; the rest asks the source
    or is uncached without one. ttl of 0 or less never ends. New entries win over old ones."""
    fresh = cache if ttl <= 0 else cache.filter(F.lit(now) - F.col("fetched_at") < ttl)
    wanted = ids.select("patent_id").distinct()
    hits = wanted.join(fresh.select("patent_id", "cpc_codes"), "patent_id")
    misses = wanted.join(fresh, "patent_id", "left_anti")
    if source is None:
        fetched = misses.withColumn("cpc_codes", F.lit(None).cast("array<string>"))
        merged = cache
    else:
        fetched = misses.join(lookup(misses, source), "patent_id", "left").withColumn("cpc_codes", F.coalesce("cpc_codes", F.array().cast("array<string>")))
        both = cache.withColumn("_new", F.lit(0)).unionByName(fetched.withColumn("fetched_at", F.lit(now)).withColumn("_new", F.lit(1)))
        newest = F.row_number().over(W.partitionBy("patent_id").orderBy(F.desc("_new"), F.desc("fetched_at")))
        merged = both.withColumn("_nth", newest).filter("_nth = 1").drop("_nth", "_new")
    out = hits.union(fetched)
    return out.withColumn("status", F.when(F.col("cpc_codes").isNull(), "uncached").when(F.size("cpc_codes") > 0, "found").otherwise("not_found")), merged


def grant_ids(df: DataFrame, number: str = "doc_number", kind: str = "doc_kind") -> Column:
    """The normalized number of a grant, else "". Without a column of kinds, they count as null."""
    kinds = F.col(kind) if kind in df.columns else F.lit(None).cast("string")
    return normalize_patent_id(F.col(number), doc_type(F.col(number), kinds))


def attach(df: DataFrame, found: DataFrame, number: str = "doc_number", kind: str = "doc_kind", cached: bool = True) -> DataFrame:
    """df with cpc_codes, cpc_subclasses, cpc_lookup_status (na for what isn't a grant). found: patent_id, cpc_codes; rows that
    it holds with null codes weren't looked up."""
    base = df.drop("cpc_codes", "cpc_subclasses", "cpc_lookup_status")
    known = found.select(F.col("patent_id").alias("_id"), F.col("cpc_codes").alias("_codes"), F.col("cpc_codes").isNull().alias("_open"))
    joined = base.withColumn("_id", grant_ids(df, number, kind)).join(known, "_id", "left")
    none = F.array().cast("array<string>")
    codes = F.coalesce("_codes", none)
    status = F.when(F.col("_id") == "", "na").when(F.size(codes) > 0, "found").when(F.coalesce("_open", F.lit(False)), "uncached").otherwise("not_found" if cached else "uncached")
    return joined.select(*base.columns, codes.alias("cpc_codes"), reduce_codes(codes).alias("cpc_subclasses"), status.alias("cpc_lookup_status"))


def hit_rate(df: DataFrame) -> dict[str, float]:
    row = df.agg(*[F.count(F.when(F.col("cpc_lookup_status") == s, 1)).alias(s) for s in ("found", "not_found", "uncached", "na")]).first().asDict()
    asked = row["found"] + row["not_found"]
    return row | {"eligible": asked + row["uncached"], "hit_rate": round(row["found"] / asked, 4) if asked else 0.0}


def code_rate(df: DataFrame, number: str, kind: str) -> dict[str, float]:
    """The share of a table's grants that have codes."""
    known = df.select(grant_ids(df, number, kind).alias("id"), F.size(F.coalesce("cpc_codes", F.array().cast("array<string>"))).alias("n"))
    row = known.agg(F.count(F.when((F.col("id") != "") & (F.col("n") > 0), 1)).alias("found"), F.count(F.when((F.col("id") != "") & (F.col("n") == 0), 1)).alias("not_found")).first()
    asked = row["found"] + row["not_found"]
    return row.asDict() | {"uncached": 0, "na": 0, "eligible": asked, "hit_rate": round(row["found"] / asked, 4) if asked else 0.0}


def assert_hit_rate(stats: dict[str, float], floor: float) -> None:
    """Stops a match that would rest on too few codes."""
    if stats["eligible"] and stats["uncached"] == stats["eligible"]:
        raise ValueError("no code is cached; attach codes first")
    if stats["found"] + stats["not_found"] and stats["hit_rate"] < floor:
        raise ValueError(f"only {stats['hit_rate']:.0%} of the patents have codes; at least {floor:.0%} are wanted")


def footprint(rows: DataFrame, grain: str = "subclass") -> DataFrame:
    """rows: patent, cpc. Returns portfolio_patent, code: distinct."""
    return rows.select(normalize_grant(F.col("patent").cast("string")).alias("portfolio_patent"), F.explode(F.split("cpc", "[;,|]")).alias("c")).filter("trim(c) <> ''").select("portfolio_patent", grain_of(F.trim("c"), grain).alias("code")).distinct()


def buyer_patents(df: DataFrame, buyer: str, grain: str = "subclass", number: str = "doc_number", kind: str = "doc_kind", date: str = "transaction_date", ordinal: str | None = None) -> DataFrame:
    """buyer (null counts as empty), patent_id, codes, year, ord: one row for each buyer and grant; ord: the first row's ordinal."""
    ids = grant_ids(df, number, kind)
    years = year_of(F.col(date)) if date in df.columns else F.lit(0)
    first = F.col(ordinal) if ordinal and ordinal in df.columns else F.lit(None).cast("long")
    rows = df.select(F.coalesce(F.col(buyer), F.lit("")).alias("buyer"), ids.alias("patent_id"), F.coalesce(reduce_codes(F.col("cpc_codes"), grain), F.array().cast("array<string>")).alias("codes"), F.coalesce(years, F.lit(0)).alias("year"), first.alias("ord")).filter("patent_id <> ''")
    return rows.groupBy("buyer", "patent_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes"), F.max("year").alias("year"), F.min("ord").alias("ord"))


def _year_text(year: Column) -> Column:
    return F.when(year > 0, year.cast("int").cast("string")).otherwise("")


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS * spark.sparkContext.defaultParallelism)


def match_portfolio(portfolio: DataFrame, patents: DataFrame, config: MatchConfig = MatchConfig(), known: DataFrame | None = None) -> dict[str, DataFrame]:
    """portfolio: portfolio_patent, code. patents: buyer, patent_id, codes, year and, if ties go to the buyer met first, ord.
    known: column codes, with each patent's codes among others; it spares a pass over patents.
    Returns per, overall and class tables.

    Patents matter by their sets of codes alone. So distinct sets of the portfolio meet distinct sets of the buyers, in an
    equi-join on codes; sums follow from how many patents of a buyer have a set; and portfolio patents come in last, by their
    set, as lists that are taken apart last: rows with ready values are spread by buyer before that, as sets may be few. No row
    stands for a portfolio patent and a buyer's patent but in the class table, whose rows they are. Ranks compare
    values to six places, so that the order of a sum's terms can't change them; ties go by ord, then buyer.
    """
    if "ord" not in patents.columns:
        patents = patents.withColumn("ord", F.lit(None).cast("long"))
    owned = patents.withColumn("own_set", F.sort_array("codes"))
    held = owned.groupBy("buyer", "own_set").agg(F.count("*").alias("many"), F.max("year").alias("year"), F.min("ord").alias("ord"))
    wanted = portfolio.groupBy("portfolio_patent").agg(F.array_sort(F.collect_set("code")).alias("set"))
    asked = wanted.select("set").distinct().withColumn("code", F.explode("set"))
    sets = held.select("own_set").distinct() if known is None else known.select(F.sort_array("codes").alias("own_set")).distinct()
    pairs = sets.withColumn("code", F.explode("own_set")).join(asked, "code")
    if config.metric == "rarity_weighted":
        coded = held.filter(F.coalesce("year", F.lit(0)) >= LEAST_YEAR).select("many", F.posexplode_outer("own_set").alias("nth", "code"))
        counts = coded.groupBy("code").agg(F.sum("many").alias("df"), F.sum(F.when(F.coalesce("nth", F.lit(0)) == 0, F.col("many"))).alias("firsts"))
        weights = counts.select("code", (F.sum("firsts").over(W.partitionBy()).cast("double") / F.col("df")).alias("weight"))
        pairs = pairs.join(weights, "code")
    else:
        pairs = pairs.withColumn("weight", F.lit(None).cast("double"))
    met = pairs.groupBy("set", "own_set").agg(F.count("*").alias("shared"), F.sum("weight").alias("rarity"), F.array_sort(F.collect_list("code")).alias("codes"))
    points = {"shared_count": F.col("shared").cast("double"), "jaccard": F.col("shared") / (F.size("own_set") + F.size("set") - F.col("shared")), "rarity_weighted": F.col("rarity")}[config.metric]
    met = met.withColumn("points", points).filter(F.col("points") >= config.threshold)
    sums = held.join(met, "own_set").groupBy("set", "buyer").agg(F.sum(F.col("points") * F.col("many")).alias("strength"), F.sum("many").alias("in_domain_patents"), F.max("year").alias("year"), F.min("ord").alias("ord"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("codes")))).alias("shared_codes")).filter(F.col("in_domain_patents") >= config.min_patents)
    ranked = sums.withColumn("rank_value", config.w_overlap * F.col("strength") + config.w_volume * F.col("in_domain_patents") + config.w_recency * recency(F.col("year")))
    nth = F.row_number().over(W.partitionBy("set").orderBy(F.desc(F.round("rank_value", 6)), F.col("ord").asc_nulls_last(), "buyer"))
    off = F.when(F.col("buyer").startswith("prov-"), "true").otherwise("false").alias("is_off_gazetteer")
    ranked = ranked.select("set", "buyer", F.round("strength", 4).alias("overlap_strength"), "in_domain_patents", "year", _year_text(F.col("year")).alias("last_acquisition_date"), "shared_codes", off, F.round("rank_value", 4).alias("rank_score"), nth.cast("long").alias("rank"))
    listed = wanted.groupBy("set", F.pmod(F.xxhash64("portfolio_patent"), F.lit(LISTS)).alias("nth")).agg(F.collect_list("portfolio_patent").alias("patents")).drop("nth")
    tasks = _tasks(patents)
    per = ranked.drop("year").repartition(tasks, "buyer").join(listed, "set").select(F.explode("patents").alias("portfolio_patent"), *PER[1:])
    each = wanted.groupBy("set").agg(F.count("*").alias("patents"))
    overall = ranked.join(each, "set").groupBy("buyer").agg(F.sum("patents").alias("portfolio_patents_matched"), F.round(F.sum(F.col("overlap_strength") * F.col("patents")), 4).alias("total_overlap_strength"), F.max("in_domain_patents").alias("in_domain_patents"), _year_text(F.max("year")).alias("last_acquisition_date"), F.first("is_off_gazetteer").alias("is_off_gazetteer"))
    evidence = met.select("set", "own_set", "codes").join(owned.select("own_set", "buyer", "patent_id", "year"), "own_set")
    if config.min_patents > 1:
        enough = sums.select(F.col("set").alias("_set"), F.col("buyer").alias("_buyer"))
        evidence = evidence.join(enough, (F.col("set") == F.col("_set")) & F.col("buyer").eqNullSafe(F.col("_buyer")), "left_semi")
    evidence = evidence.select("set", "buyer", F.col("patent_id").alias("buyer_patent"), F.explode("codes").alias("cpc_class"), _year_text(F.col("year")).alias("year"), off)
    classes = evidence.repartition(tasks, "buyer", "buyer_patent").join(listed, "set").select(F.explode("patents").alias("portfolio_patent"), *CLASSES[1:])
    return {"per": per, "overall": overall, "class": classes}
