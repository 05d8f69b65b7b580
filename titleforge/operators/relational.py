"""Steps on one table: projection, order, first rows of a key, derived columns, counts, pages, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.classify import classify_value
from ..functions.scorers import score
from ..functions.text import derive, doc_type, effective_separator, normalize_patent_id, string_view

#: Column that carries the rows' order through a pipeline; dropped at the sinks.
ORDINAL = "_ordinal"


def put(df: DataFrame, name: str, value: Column) -> DataFrame:
    """The column at the end, in place of one of that name."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != name], value.alias(name))


def select(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that exist, in their order; all if none does."""
    kept = [c for c in columns if c in df.columns]
    return df.select(*[F.col(f"`{c}`") for c in kept]) if kept else df


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def order(df: DataFrame, column: str, ascending: bool = True, tie: str | None = None) -> DataFrame:
    """Nulls last both ways; ties by the given key."""
    if column not in df.columns:
        return df
    by = F.col(f"`{column}`")
    return df.orderBy(by.asc_nulls_last() if ascending else by.desc_nulls_last(), *([F.col(tie)] if tie else []))


def toggled(current: tuple[str, bool] | None, column: str) -> tuple[str, bool]:
    """The order that a click on a column's header asks for: ascending, or descending if it was ascending by that column."""
    return column, current != (column, True)


def dedupe(df: DataFrame, subset: list[str] | None, first_by: list[str]) -> DataFrame:
    """The first row of each key, by first_by; null and empty text are one key. The rank limit runs before the shuffle too, so
    a hot key costs one row for each task."""
    keys = [c for c in (subset or df.columns) if c in df.columns]
    if not keys:
        return df
    parts = [F.coalesce(string_view(F.col(f"`{c}`"), df.schema[c].dataType), F.lit("")) for c in keys]
    nth = F.row_number().over(W.partitionBy(*parts).orderBy(*first_by))
    return df.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def derived(df: DataFrame, source: str, op: str, target: str = "") -> DataFrame:
    if source not in df.columns:
        return df
    return put(df, target or f"{source}_{op}", derive(string_view(F.col(f"`{source}`"), df.schema[source].dataType), op))


def aggregate(df: DataFrame, keys: list[str], count_distinct: str | None = None) -> DataFrame:
    """count, and {column}_distinct without nulls; the most frequent first, ties by key."""
    keys = [k for k in keys if k in df.columns]
    if not keys:
        return df
    measures = [F.count(F.lit(1)).alias("count")]
    if count_distinct and count_distinct in df.columns:
        measures.append(F.count_distinct(F.col(f"`{count_distinct}`")).alias(f"{count_distinct}_distinct"))
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*measures).orderBy(F.desc("count"), *[F.col(f"`{k}`").asc_nulls_last() for k in keys])


def classified(df: DataFrame, column: str, target: str = "", method: str = "rules", mode: str = "all", separator: str = "") -> DataFrame:
    if column not in df.columns:
        return df
    return put(df, target or f"{column}_type", classify_value(F.col(f"`{column}`"), effective_separator(separator, column), mode, method))


def compare(df: DataFrame, left: str, right: str, target: str = "", method: str = "exact", scorer: str = "wratio", threshold: int = 90, action: str = "flag", emit_score: bool = False, review_threshold: int = 0) -> DataFrame:
    """Two columns row by row. A match needs both sides; flags are "true" and "false"; scores stand before rows are dropped."""
    if left not in df.columns or right not in df.columns:
        return df
    if action not in ("flag", "drop_matches", "keep_matches") or method not in ("exact", "fuzzy"):
        raise ValueError(f"unknown compare action or method: {action!r}, {method!r}")
    a, b = (string_view(F.col(f"`{c}`"), df.schema[c].dataType) for c in (left, right))
    points = F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, 100).otherwise(0)) if method == "exact" else F.bround(score(a, b, scorer))
    name = target or f"{left}_matches_{right}"
    df = df.withColumn("_score", points.cast("int"))
    least = 100 if method == "exact" else threshold
    match = F.coalesce((F.col("_score") >= least) & (F.length(a) > 0) & (F.length(b) > 0), F.lit(False))
    df = df.withColumn("_match", match)
    if emit_score:
        df = put(df, f"{name}_score", F.col("_score"))
    if review_threshold:
        df = put(df, f"{name}_review", F.when(F.col("_match") & (F.col("_score") < min(review_threshold, 100)), "true").otherwise("false"))
    if action == "flag":
        df = put(df, name, F.when(F.col("_match"), "true").otherwise("false"))
    else:
        df = df.filter(F.col("_match") if action == "keep_matches" else ~F.col("_match"))
    return df.drop("_score", "_match")


def kind_filter(df: DataFrame, column: str = "doc_kind", number_column: str = "doc_number", types: list[str] | None = None, codes: list[str] | None = None, action: str = "keep") -> DataFrame:
    """Rows by document type or by raw code; without either nothing changes."""
    if column not in df.columns or not (types or codes):
        return df
    number = F.col(f"`{number_column}`") if number_column in df.columns else F.lit(None).cast("string")
    fits = F.coalesce(F.col(f"`{column}`").isin(codes or []), F.lit(False)) | doc_type(number, F.col(f"`{column}`")).isin(types or [])
    return df.filter(fits if action == "keep" else ~fits)


def transfer_type(df: DataFrame, left: str, right: str, left_type: str = "company", right_type: str = "company", method: str = "rules") -> DataFrame:
    """Rows whose sides have the given entity types in all their parts."""
    if left not in df.columns or right not in df.columns:
        return df
    kind = lambda c: classify_value(F.col(f"`{c}`"), effective_separator("", c), "all", method)
    return df.filter(F.coalesce((kind(left) == left_type) & (kind(right) == right_type), F.lit(False)))


def add_doc_columns(df: DataFrame, form: str = "normalized") -> DataFrame:
    df = df.withColumn("doc_type", doc_type(F.col("doc_number"), F.col("doc_kind")))
    return df.withColumn("patent_id_normalized", normalize_patent_id(F.col("doc_number"), F.col("doc_type"), form))


def page(df: DataFrame, number: int, size: int | None, *by: Column) -> DataFrame:
    """Page `number` from 1 of rows in order; size None is all."""
    ordered = df.orderBy(*by)
    return ordered if size is None else ordered.offset((max(number, 1) - 1) * size).limit(size)


def page_bounds(total: int, number: int, size: int | None) -> tuple[int, int, int]:
    """(page clamped to what there is, first row, end)."""
    if size is None or size <= 0:
        return 1, 0, total
    pages = max(1, -(-total // size))
    number = min(max(number, 1), pages)
    return number, (number - 1) * size, min(number * size, total)


def distinct_values(df: DataFrame, column: str, most: int = 200) -> list[str] | None:
    """Sorted distinct text that isn't empty; None if there is more than `most`, which is as far as is read."""
    text = string_view(F.col(f"`{column}`"), df.schema[column].dataType)
    rows = df.select(text.alias("v")).filter("v is not null").distinct().limit(most + 1).collect()
    return None if len(rows) > most else sorted(r[0] for r in rows if r[0])


def first_rows(df: DataFrame, limit: int, *by: Column) -> DataFrame:
    return df.orderBy(*by).limit(limit) if limit > 0 else df


