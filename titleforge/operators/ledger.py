"""The buyer ledger: firm-to-firm transactions, buyers, and the bridge from buyers to properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import conveyance_type
from ..sources.sinks import write_manifest
from .relational import add_doc_columns

KEY = ["reel_no", "frame_no"]
KEPT = ("assignment",)


def transactions(assignments: DataFrame, assignors: DataFrame, kept: tuple[str, ...] = KEPT) -> DataFrame:
    """Assignments of the kept conveyance types with their latest execution date, else the recorded one."""
    executed = assignors.groupBy(*KEY).agg(F.max(F.nullif("execution_date", F.lit(""))).alias("executed"))
    typed = assignments.withColumn("conveyance_type", conveyance_type(F.col("conveyance_text"))).filter(F.col("conveyance_type").isin(*kept))
    joined = typed.join(executed, KEY, "left")
    return joined.select(*KEY, "conveyance_type", F.col("conveyance_text").alias("conveyance_text_raw"), F.coalesce("executed", F.nullif("recorded_date", F.lit(""))).alias("transaction_date"), F.when(F.col("executed").isNotNull(), "execution").otherwise("recorded").alias("date_source"), "recorded_date", "correspondent_name")


def parties(rows: DataFrame, resolution: DataFrame, prefix: str) -> DataFrame:
    """Sorted distinct ids, names and parents of a side for each transaction, and whether all are companies."""
    joined = rows.filter(F.length("name") > 0).join(resolution, F.col("name") == F.col("mention"))
    return joined.groupBy(*KEY).agg(
        F.array_sort(F.collect_set("entity_id")).alias(f"{prefix}_entity_ids"),
        F.array_sort(F.collect_set("canonical_name")).alias(f"{prefix}_canonical_names"),
        F.array_sort(F.collect_set(F.coalesce(F.nullif("ultimate_parent_id", F.lit("")), "entity_id"))).alias(f"{prefix}_parent_ids"),
        F.bool_and(F.col("entity_type") == "company").alias(f"{prefix}_companies"),
    )


def canonical_properties(properties: DataFrame, form: str = "normalized") -> DataFrame:
    """properties with doc_type, patent_id_normalized and canonical_property_id: within a transaction and title the number of
    the first document, applications before grants, publications and others."""
    typed = add_doc_columns(properties, form)
    rank = F.when(F.col("doc_type") == "application", 0).when(F.col("doc_type") == "grant", 1).when(F.col("doc_type") == "publication", 2).otherwise(3)
    one = W.partitionBy(*KEY, F.coalesce(F.nullif("invention_title", F.lit("")), "doc_number")).orderBy(rank, F.col("doc_number").asc_nulls_last())
    return typed.withColumn("canonical_property_id", F.first("doc_number").over(one))


def disjoint(a: Column, b: Column) -> Column:
    return ~F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def build_ledger(assignments: DataFrame, assignors: DataFrame, assignees: DataFrame, properties: DataFrame, resolution: DataFrame, kept: tuple[str, ...] = KEPT, form: str = "normalized") -> dict[str, DataFrame]:
    """transaction_ledger, buyers and buyer_property_bridge as lazy frames."""
    props = canonical_properties(properties, form)
    counts = props.groupBy(*KEY).agg(F.count_distinct("canonical_property_id").alias("property_count"))
    sides = transactions(assignments, assignors, kept).join(parties(assignors, resolution, "seller"), KEY).join(parties(assignees, resolution, "buyer"), KEY)
    firms = sides.filter(F.col("seller_companies") & F.col("buyer_companies") & disjoint(F.col("seller_parent_ids"), F.col("buyer_parent_ids")))
    ledger = firms.join(counts, KEY, "left").select(*KEY, "conveyance_type", "conveyance_text_raw", "transaction_date", "date_source", "recorded_date", "seller_entity_ids", "seller_canonical_names", "buyer_entity_ids", "buyer_canonical_names", "seller_parent_ids", "buyer_parent_ids", F.coalesce("property_count", F.lit(0)).cast("int").alias("property_count"), "correspondent_name")
    deals = ledger.select(*KEY, "transaction_date", F.explode("buyer_entity_ids").alias("entity_id"))
    bridge = deals.join(props, KEY).select("entity_id", *KEY, "canonical_property_id", F.col("doc_number").alias("doc_number_raw"), F.col("doc_kind").alias("kind_code"), "doc_type", "patent_id_normalized", "doc_date", "invention_title", "transaction_date", F.lit("").alias("cpc_lookup_status")).distinct()
    sums = deals.groupBy("entity_id").agg(F.count("*").alias("deals_count"), F.min("transaction_date").alias("first_acquisition_date"), F.max("transaction_date").alias("last_acquisition_date"))
    patents = bridge.groupBy("entity_id").agg(F.count_distinct("canonical_property_id").alias("patents_count"))
    named = resolution.groupBy("entity_id").agg(F.min_by(F.struct("canonical_name", "entity_type", "resolution_source", "resolution_confidence", "ultimate_parent_id"), "mention").alias("r")).select("entity_id", "r.*")
    parents = named.select(F.col("entity_id").alias("ultimate_parent_id"), F.col("canonical_name").alias("ultimate_parent_name"))
    buyers = sums.join(named, "entity_id").join(parents, "ultimate_parent_id", "left").join(patents, "entity_id", "left")
    buyers = buyers.select("entity_id", "canonical_name", "entity_type", "resolution_source", "resolution_confidence", "ultimate_parent_id", F.coalesce("ultimate_parent_name", "canonical_name").alias("ultimate_parent_name"), F.lit("").alias("country"), F.lit("").alias("sector"), "deals_count", F.coalesce("patents_count", F.lit(0)).alias("patents_count"), "first_acquisition_date", "last_acquisition_date", F.col("entity_id").startswith("prov-").alias("is_off_gazetteer"))
    return {"transaction_ledger": ledger, "buyers": buyers, "buyer_property_bridge": bridge}


def write_ledger(made: dict[str, DataFrame], folder: str, considered: int, kept: tuple[str, ...] = KEPT) -> dict[str, object]:
    """The three tables as Parquet, sorted, and metrics.json. Returns the metrics."""
    spark = made["buyers"].sparkSession
    orders = {"transaction_ledger": KEY, "buyers": [F.desc("deals_count"), "entity_id"], "buyer_property_bridge": ["entity_id", *KEY]}
    for name, by in orders.items():
        made[name].orderBy(*by).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    read = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in orders}
    bridge = read["buyer_property_bridge"]
    metrics = {
        "kept_conveyance_types": sorted(kept),
        "transactions_considered": considered,
        "transactions_firm_to_firm": read["transaction_ledger"].count(),
        "buyers": read["buyers"].count(),
        "bridge_rows": bridge.count(),
        "bridge_grant_rows": bridge.filter("doc_type = 'grant'").count(),
    }
    write_manifest(f"{folder}/metrics.json", metrics)
    return metrics


def leaderboard(buyers: DataFrame, scope: DataFrame, by: str = "patents", top: int = 20) -> DataFrame:
    """The first buyers by the properties that a scope of the bridge holds of theirs, or by deals, with their place."""
    if by == "patents":
        counts = scope.groupBy("entity_id").agg(F.count_distinct("canonical_property_id").alias("patents_count"))
        buyers = buyers.drop("patents_count").join(counts, "entity_id", "left").withColumn("patents_count", F.coalesce("patents_count", F.lit(0)))
    found = top_buyers(buyers, by, top)
    place = F.row_number().over(W.orderBy(F.desc(f"{by}_count"), "entity_id"))  # of the rows that are left, `top` at most
    return found.withColumn("place", place).select("place", "entity_id", "canonical_name", "entity_type", "resolution_source", "is_off_gazetteer", "deals_count", *(["patents_count"] if by == "patents" else []), "first_acquisition_date", "last_acquisition_date")


def code_metrics(bridge: DataFrame) -> dict[str, float]:
    """How many grant rows of a reconciled bridge have codes."""
    row = bridge.agg(F.count(F.when(F.col("cpc_lookup_status") != "na", 1)).alias("eligible"), F.count(F.when(F.col("cpc_lookup_status") == "found", 1)).alias("found")).first()
    return {"cpc_eligible_rows": row["eligible"], "cpc_found": row["found"], "cpc_hit_rate": round(row["found"] / row["eligible"], 4) if row["eligible"] else 0.0}


def top_buyers(buyers: DataFrame, by: str = "patents", top: int = 20) -> DataFrame:
    """By patents or deals, nulls last, ties by id."""
    measure = {"patents": "patents_count", "deals": "deals_count"}[by]
    return buyers.orderBy(F.col(measure).desc_nulls_last(), "entity_id").limit(top)


def sampled_scope(bridge: DataFrame, each: int) -> DataFrame:
    """The latest grants of each buyer."""
    latest = W.partitionBy("entity_id").orderBy(F.col("transaction_date").desc_nulls_last(), "doc_number_raw")
    return bridge.filter("doc_type = 'grant'").withColumn("_nth", F.row_number().over(latest)).filter(F.col("_nth") <= each).drop("_nth")


def reconcile_codes(bridge: DataFrame, codes: DataFrame) -> DataFrame:
    """bridge with cpc_codes, cpc_subclasses and cpc_lookup_status. codes: patent_id, cpc. Again on its own result: the same."""
    base = bridge.drop("cpc_codes", "cpc_subclasses", "cpc_lookup_status")
    lists = codes.select(F.col("patent_id").cast("string").alias("patent_id_normalized"), F.trim("cpc").alias("code")).filter("code <> ''").groupBy("patent_id_normalized").agg(F.array_sort(F.collect_set("code")).alias("cpc_codes"), F.array_sort(F.collect_set(F.substring("code", 1, 4))).alias("cpc_subclasses"))
    joined = base.join(lists, "patent_id_normalized", "left")
    status = F.when(F.col("doc_type") != "grant", "na").when(F.col("cpc_codes").isNotNull(), "found").otherwise("not_found")
    none = F.array().cast("array<string>")
    return joined.select(*base.columns, F.coalesce("cpc_codes", none).alias("cpc_codes"), F.coalesce("cpc_subclasses", none).alias("cpc_subclasses"), status.alias("cpc_lookup_status"))
