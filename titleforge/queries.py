"""The library's operators applied to the test tables, each with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import classify, scorers, text
from .model import COLUMNS
from .operators import codes, filters, graph, ledger, match, relational
from .sources import xml_records

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql:
            _ORACLE[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- predicates

def _filter(name: str, source: str, columns: list[str], clauses: list[filters.Clause], sql: str, combine: str = "and", search: str = "") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return filters.apply(table(spark, sf_dir, source), clauses, search, combine).select(*columns)

    query(sql, name)(run)


_C = filters.Clause
_filter("filter_contains", "part", ["p_partkey", "p_name"], [_C("p_name", "contains", "WIDGET")], "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'widget')")
_filter("filter_starts_with", "part", ["p_partkey", "p_type"], [_C("p_type", "starts_with", "ECO")], "SELECT p_partkey, p_type FROM part WHERE starts_with(lower(p_type), 'eco')")
_filter("filter_equals", "orders", ["o_orderkey"], [_C("o_orderstatus", "equals", "f")], "SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) = 'f'")
_filter("filter_in_range", "part", ["p_partkey", "p_size"], [_C("p_size", "in_range", "10", "3")], "SELECT p_partkey, p_size FROM part WHERE p_size::VARCHAR BETWEEN '10' AND '3'")
_filter("filter_or", "customer", ["c_custkey"], [_C("c_mktsegment", "equals", "BUILDING"), _C("c_nationkey", "equals", "7")], "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building' OR c_nationkey::VARCHAR = '7'", "or")
_filter("quick_search", "nation", ["n_nationkey", "n_name"], [], "SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'n_1') OR contains(n_nationkey::VARCHAR, 'n_1') OR contains(n_regionkey::VARCHAR, 'n_1')", search="N_1")

_NULLS = "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))


for _name, _op, _sql in (
    ("filter_not_equals", "not_equals", "segment IS NULL OR lower(segment) <> 'machinery'"),
    ("filter_not_empty", "not_empty", "length(segment) > 0"),
    ("filter_is_empty", "is_empty", "segment IS NULL OR segment = ''"),
):
    query(f"SELECT * FROM ({_NULLS}) WHERE {_sql}", _name)(lambda s, d, op=_op: filters.apply(_segments(s, d), [_C("segment", op, "MACHINERY")]))


# --- relational steps

@query("SELECT c_name AS name, c_custkey AS id FROM customer")
def select_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.rename(relational.select(table(spark, sf_dir, "customer"), ["c_name", "c_custkey", "missing"]), {"c_name": "name", "c_custkey": "id"})


@query(f"SELECT c_custkey, segment, row_number() OVER (ORDER BY segment NULLS LAST, c_custkey) AS place FROM ({_NULLS})")
def sort_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order as a column; the rank comes from range partitions and their sizes."""
    ordered = relational.order(_segments(spark, sf_dir), "segment", True, "c_custkey")
    keys = [F.col("segment").asc_nulls_last(), F.col("c_custkey")]
    parts = _segments(spark, sf_dir).groupBy("segment").agg(F.count("*").alias("n"))
    before = parts.withColumn("before", F.sum("n").over(W.orderBy(F.col("segment").asc_nulls_last())) - F.col("n")).withColumnRenamed("segment", "s").drop("n")
    joined = ordered.join(before, F.col("segment").eqNullSafe(F.col("s")))
    return joined.select("c_custkey", "segment", (F.col("before") + F.row_number().over(W.partitionBy("segment").orderBy(*keys))).alias("place"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 3, 50, F.col("o_orderkey"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1000")
def load_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.first_rows(table(spark, sf_dir, "orders").select("o_orderkey"), 1000, F.col("o_orderkey"))


@query("SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment <> ''")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in relational.distinct_values(table(spark, sf_dir, "customer"), "c_mktsegment") or []], "value string")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")
def dedupe_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.dedupe(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query("SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def dedupe_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus")
    return relational.dedupe(rows, None, ["l_suppkey"])


@query('SELECT l_suppkey, count(*) AS "count" FROM lineitem GROUP BY l_suppkey')
def aggregate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.aggregate(table(spark, sf_dir, "lineitem"), ["l_suppkey"])


@query('SELECT l_suppkey, l_returnflag, count(*) AS "count", count(DISTINCT l_partkey) AS l_partkey_distinct FROM lineitem GROUP BY ALL')
def aggregate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.aggregate(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"], "l_partkey")


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("d"))


for _op, _sql in (("year", "substr(d, 1, 4)"), ("month", "substr(d, 5, 2)")):
    query(f"SELECT o_orderkey, d, {_sql} AS d_{_op} FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS d FROM orders)", f"derive_{_op}")(lambda s, d, op=_op: relational.derived(_dated(s, d), "d", op))


@query("SELECT doc_id, lower(text) AS low, split_part(source || '; ' || lang, '; ', 1) AS first_part, upper(source) AS up FROM documents")
def derive_case_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.derive(F.col("text"), "lower").alias("low"), text.derive(F.concat("source", F.lit("; "), "lang"), "split_first").alias("first_part"), text.derive(F.col("source"), "upper").alias("up"))


# --- scalar functions

_KEY = "trim(regexp_replace(upper(replace({0}, 'ß', 'SS')), '[^A-Z0-9]+', ' ', 'g'))"


@query(f"SELECT doc_id, {_KEY.format('text')} AS key FROM documents")
def clean_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_key(F.col("text")).alias("key"))


@query(f"SELECT c_custkey, trim(regexp_replace(upper(replace(c_name, '#', ' ')) || ' HOLDINGS CO INC', '(?:\\s+(?:{'|'.join(text.LEGAL_SUFFIXES)}))+$', '')) AS bare FROM customer")
def strip_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.upper(F.replace("c_name", F.lit("#"), F.lit(" "))), F.lit(" HOLDINGS CO INC"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.strip_legal_suffix(key).alias("bare"))


@query("SELECT c_custkey, list_filter(list_transform(string_split(c_name || ';  ; ' || c_mktsegment || '; x ', '; '), lambda p: trim(p)), lambda p: p <> '') AS parts FROM customer")
def split_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.split_parties(F.concat("c_name", F.lit(";  ; "), "c_mktsegment", F.lit("; x "))).alias("parts"))


_TEXTS = ("ASSIGNMENT OF ASSIGNORS INTEREST", "RELEASE BY SECURED PARTY", "SECURITY AGREEMENT", "NUNC PRO TUNC ASSIGNMENT", "CORRECTIVE ASSIGNMENT", "MERGER", "CHANGE OF NAME", "LICENSE", "LIEN", "TERMINATION OF SECURITY INTEREST", "OTHER THING", "CHANGE OF NAME AND MERGERS", "LICENCE")
_PICK = "[" + ", ".join(f"'{t}'" for t in _TEXTS) + f"][(o_orderkey % {len(_TEXTS)} + 1)::INT]"


_CONVEYANCE = "CASE " + " ".join(f"WHEN regexp_matches({{t}}, '{p}') THEN '{k}'" for p, k in text.CONVEYANCE_RULES) + " ELSE 'other' END"


@query(f"SELECT o_orderkey, {_CONVEYANCE.format(t='t')} AS kind FROM (SELECT o_orderkey, {_PICK} AS t FROM orders)")
def conveyance_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.element_at(F.array(*[F.lit(t) for t in _TEXTS]), (F.col("o_orderkey") % len(_TEXTS) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.conveyance_type(pick).alias("kind"))


_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_SIZE = "len(list_filter(string_split({0}, ' '), lambda t: t <> ''))"
_NAMES = """SELECT 'c' || c_custkey AS id, ['ACME HOLDINGS LLC', c_name, 'Doe, Jane ' || chr(65 + (c_custkey % 26)::INT) || '.', c_mktsegment || ' Jr', 'A, b c d e f'][(c_custkey % 5 + 1)::INT] AS name FROM customer
UNION ALL SELECT 'p' || p_partkey, p_name FROM part UNION ALL SELECT 'n' || n_nationkey, n_name || ' Kabushiki-Kaisha' FROM nation UNION ALL SELECT 's' || s_suppkey, replace(s_name, '#', ' ') || ', Inc.' FROM supplier"""
_KIND_OF = f"""CASE WHEN list_has_any(string_split(key, ' '), {_LIST(classify.COMPANY_TOKENS)}) OR contains(key, 'KABUSHIKI KAISHA') THEN 'company'
  WHEN contains(name, ',') AND {_SIZE.format(_KEY.format("split_part(name, ',', 1)"))} BETWEEN 1 AND 3 AND {_SIZE.format(_KEY.format("substr(name, strpos(name, ',') + 1)"))} BETWEEN 1 AND 3 THEN 'individual'
  WHEN len(list_filter(string_split(key, ' '), lambda t: t <> '' AND NOT list_contains({_LIST(classify.PERSON_SUFFIXES)}, t))) BETWEEN 2 AND 4 AND len(list_filter(string_split(key, ' '), lambda t: t <> '' AND NOT list_contains({_LIST(classify.PERSON_SUFFIXES)}, t) AND NOT regexp_full_match(t, '[A-Z]+'))) = 0 THEN 'individual' ELSE 'unknown' END"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, parts, nations, suppliers = (table(spark, sf_dir, t) for t in ("customer", "part", "nation", "supplier"))
    forms = F.array(F.lit("ACME HOLDINGS LLC"), F.col("c_name"), F.concat(F.lit("Doe, Jane "), F.char(F.lit(65) + F.col("c_custkey") % 26), F.lit(".")), F.concat("c_mktsegment", F.lit(" Jr")), F.lit("A, b c d e f"))
    rows = customers.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.get(forms, (F.col("c_custkey") % 5).cast("int")).alias("name"))
    rows = rows.union(parts.select(F.concat(F.lit("p"), "p_partkey"), "p_name")).union(nations.select(F.concat(F.lit("n"), "n_nationkey"), F.concat("n_name", F.lit(" Kabushiki-Kaisha"))))
    return rows.union(suppliers.select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.replace("s_name", F.lit("#"), F.lit(" ")), F.lit(", Inc."))))


@query(f"SELECT id, {_KIND_OF} AS kind FROM (SELECT *, {_KEY.format('name')} AS key FROM ({_NAMES}))")
def classify_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("id", classify.classify(F.col("name")).alias("kind"))


_PAIRED = f"""SELECT a.id, a.name || '; ' || b.name AS value, a.kind AS x, b.kind AS y FROM (SELECT *, {_KIND_OF} AS kind, row_number() OVER (ORDER BY id) AS n FROM (SELECT *, {_KEY.format('name')} AS key FROM ({_NAMES}))) a
JOIN (SELECT *, {_KIND_OF} AS kind, row_number() OVER (ORDER BY id DESC) AS n FROM (SELECT *, {_KEY.format('name')} AS key FROM ({_NAMES}))) b USING (n)"""


@query(
    f"""SELECT id, CASE WHEN x = y THEN x ELSE 'unknown' END AS all_kind, CASE WHEN 'company' IN (x, y) THEN 'company' WHEN 'individual' IN (x, y) THEN 'individual' ELSE 'unknown' END AS any_kind, x AS first_kind,
  CASE WHEN x = y THEN x ELSE 'unknown' END AS majority_kind FROM ({_PAIRED})"""
)
def classify_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of two names each, by the four modes."""
    names = _names(spark, sf_dir)
    one, two = ((names.withColumn("n", F.row_number().over(W.orderBy(by)))) for by in (F.col("id"), F.col("id").desc()))  # some thousand names
    value = F.concat("name", F.lit("; "), "other")
    rows = one.join(two.select("n", F.col("name").alias("other")), "n").select("id", value.alias("value"))
    return rows.select("id", *(classify.classify_value(F.col("value"), "; ", mode).alias(f"{mode}_kind") for mode in ("all", "any", "first", "majority")))


_DOCS = "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'US0' || p_partkey WHEN p_partkey % 5 = 1 THEN lpad(p_partkey::VARCHAR, [11, 7, 8][(p_partkey % 3 + 1)::INT], '2') ELSE 'D' || p_partkey END AS number, ['B1', CASE WHEN p_partkey % 2 = 0 THEN 'A1' ELSE 'A2' END, 'X0', NULL, 'A'][(p_partkey % 5 + 1)::INT] AS kind FROM part"
_TYPE = """CASE WHEN coalesce(kind, '') = 'X0' THEN 'application' WHEN kind LIKE 'B%' THEN 'grant'
  WHEN kind IN ('A1', 'A2', 'A9', 'P1', 'P4') AND length(regexp_replace(number, '[^0-9]', '', 'g')) = 11 THEN 'publication'
  WHEN kind = 'A' THEN CASE WHEN length(regexp_replace(number, '[^0-9]', '', 'g')) <= 8 THEN 'grant' ELSE 'publication' END
  WHEN regexp_matches(number, '^(D|PP|RE|H|T)') AND regexp_matches(number, '[0-9]') THEN 'grant' WHEN length(regexp_replace(number, '[^0-9]', '', 'g')) = 11 THEN 'publication' ELSE 'unknown' END"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    number = F.when(key % 5 == 0, F.concat(F.lit("US0"), key)).when(key % 5 == 1, F.expr("lpad(string(p_partkey), element_at(array(11, 7, 8), int(p_partkey % 3 + 1)), '2')")).otherwise(F.concat(F.lit("D"), key))
    kind = F.get(F.array(F.lit("B1"), F.when(key % 2 == 0, "A1").otherwise("A2"), F.lit("X0"), F.lit(None), F.lit("A")), (key % 5).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", number.alias("doc_number"), kind.alias("doc_kind"))


@query(
    f"""SELECT p_partkey, doc_type, CASE WHEN doc_type <> 'grant' THEN '' WHEN regexp_matches(number, '^(US)?([A-Z]{{0,2}})([0-9]+)$')
  THEN regexp_extract(number, '^(?:US)?([A-Z]{{0,2}})([0-9]+)$', 1) || coalesce(nullif(ltrim(regexp_extract(number, '^(?:US)?([A-Z]{{0,2}})([0-9]+)$', 2), '0'), ''), '0') ELSE number END AS patent_id
FROM (SELECT *, {_TYPE} AS doc_type FROM ({_DOCS}))"""
)
def doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = relational.add_doc_columns(_docs(spark, sf_dir))
    return d.select("p_partkey", "doc_type", F.col("patent_id_normalized").alias("patent_id"))


for _action, _not in (("keep", ""), ("discard", "NOT ")):
    query(f"SELECT p_partkey FROM ({_DOCS}) WHERE {_not}(coalesce(kind = 'X0', false) OR {_TYPE} = 'grant')", f"kind_filter_{_action}")(
        lambda s, d, a=_action: relational.kind_filter(_docs(s, d), types=["grant"], codes=["X0"], action=a).select("p_partkey")
    )


@query("SELECT p_partkey, upper(replace(p_type, ' ', ''))[1:4] AS subclass, string_split(upper(replace(p_brand || '/' || p_size, ' ', '')), '/')[1] AS main_group FROM part")
def grain_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.grain_of(F.col("p_type")).alias("subclass"), text.grain_of(F.concat("p_brand", F.lit("/"), "p_size"), "main_group").alias("main_group"))


@query("SELECT c_custkey, 'prov-' || substr(sha1(c_name), 1, 16) AS id FROM customer")
def hash_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.hash_id("prov-", F.col("c_name")).alias("id"))


@query("SELECT s.s_suppkey, c_custkey, CASE WHEN s_name = c_name THEN 'true' ELSE 'false' END AS s_name_matches_c_name, CASE WHEN s_name = c_name THEN 100 ELSE 0 END AS s_name_matches_c_name_score FROM supplier s JOIN customer ON s_nationkey = c_nationkey")
def compare_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "customer"), F.col("s_nationkey") == F.col("c_nationkey"))
    return relational.compare(both.select("s_suppkey", "c_custkey", "s_name", "c_name"), "s_name", "c_name", emit_score=True).drop("s_name", "c_name")


@query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority <> c_mktsegment OR o_orderpriority IS NULL OR c_mktsegment IS NULL")
def compare_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return relational.compare(both, "o_orderpriority", "c_mktsegment", action="drop_matches").select("o_orderkey")


# --- joins, rollups and ranks

_PROPERTIES = "SELECT l_orderkey::VARCHAR AS reel_no, l_linenumber::VARCHAR AS frame_no, p_type AS invention_title, 'US0' || l_partkey AS doc_number, ['X0', 'B1', 'A1'][(l_partkey % 3 + 1)::INT] AS doc_kind FROM lineitem JOIN part ON p_partkey = l_partkey"


def _properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    kind = F.get(F.array(F.lit("X0"), F.lit("B1"), F.lit("A1")), (F.col("l_partkey") % 3).cast("int"))
    return rows.select(F.col("l_orderkey").cast("string").alias("reel_no"), F.lit("1").alias("frame_no"), F.col("p_type").alias("invention_title"), F.concat(F.lit("US0"), "l_partkey").alias("doc_number"), kind.alias("doc_kind"))


@query(
    f"""SELECT reel_no, doc_number, first_value(doc_number) OVER (PARTITION BY reel_no, coalesce(nullif(invention_title, ''), doc_number)
  ORDER BY CASE doc_kind WHEN 'X0' THEN 0 WHEN 'B1' THEN 1 ELSE 2 END, doc_number NULLS LAST) AS canonical_property_id FROM ({_PROPERTIES})"""
)
def canonical_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.canonical_properties(_properties(spark, sf_dir)).select("reel_no", "doc_number", "canonical_property_id")


# The ledger's tables from the test tables: an order is a transaction of its lines' suppliers to its customer over its parts.
_ASSIGNMENTS = f"SELECT o_orderkey::VARCHAR AS reel_no, '1' AS frame_no, {_PICK} AS conveyance_text, strftime(o_orderdate, '%Y%m%d') AS recorded_date, o_orderpriority AS correspondent_name FROM orders"
_ASSIGNORS = "SELECT l_orderkey::VARCHAR AS reel_no, '1' AS frame_no, s_name AS name, CASE WHEN l_linenumber = 1 THEN '' ELSE strftime(l_shipdate, '%Y%m%d') END AS execution_date, l_linenumber FROM lineitem JOIN supplier ON s_suppkey = l_suppkey"
_ASSIGNEES = "SELECT o_orderkey::VARCHAR AS reel_no, '1' AS frame_no, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey"
_RESOLUTION = """SELECT s_name AS mention, 's' || s_suppkey AS entity_id, upper(s_name) AS canonical_name, CASE WHEN s_acctbal < 0 THEN 'individual' ELSE 'company' END AS entity_type, 'exact' AS resolution_source, 1.0::DOUBLE AS resolution_confidence, 'n' || s_nationkey AS ultimate_parent_id FROM supplier
UNION ALL SELECT c_name, CASE WHEN c_acctbal < 0 THEN 'prov-' ELSE 'c' END || c_custkey, upper(c_name), 'company', 'fuzzy', 0.95::DOUBLE, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE 'n' || c_nationkey END FROM customer"""
_PROPS = "SELECT l_orderkey::VARCHAR AS reel_no, '1' AS frame_no, p_type AS invention_title, 'US0' || l_partkey AS number, ['X0', 'B1', 'A1'][(l_partkey % 3 + 1)::INT] AS kind, strftime(l_shipdate, '%Y%m%d') AS doc_date FROM lineitem JOIN part ON p_partkey = l_partkey"


def _party_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    orders, lines, parts, suppliers, customers = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part", "supplier", "customer"))
    day = lambda c: F.date_format(c, "yyyyMMdd")
    key = lambda c: (F.col(c).cast("string").alias("reel_no"), F.lit("1").alias("frame_no"))
    pick = F.element_at(F.array(*[F.lit(t) for t in _TEXTS]), (F.col("o_orderkey") % len(_TEXTS) + 1).cast("int"))
    kind = F.get(F.array(F.lit("X0"), F.lit("B1"), F.lit("A1")), (F.col("l_partkey") % 3).cast("int"))
    sold = lines.join(suppliers, F.col("s_suppkey") == F.col("l_suppkey"))
    parent = F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.concat(F.lit("n"), "c_nationkey"))
    sellers = suppliers.select(F.col("s_name").alias("mention"), F.concat(F.lit("s"), "s_suppkey").alias("entity_id"), F.upper("s_name").alias("canonical_name"), F.when(F.col("s_acctbal") < 0, "individual").otherwise("company").alias("entity_type"), F.lit("exact").alias("resolution_source"), F.lit(1.0).alias("resolution_confidence"), F.concat(F.lit("n"), "s_nationkey").alias("ultimate_parent_id"))
    buyers = customers.select("c_name", F.concat(F.when(F.col("c_acctbal") < 0, "prov-").otherwise("c"), "c_custkey"), F.upper("c_name"), F.lit("company"), F.lit("fuzzy"), F.lit(0.95), parent)
    return {
        "assignments": orders.select(*key("o_orderkey"), pick.alias("conveyance_text"), day("o_orderdate").alias("recorded_date"), F.col("o_orderpriority").alias("correspondent_name")),
        "assignors": sold.select(*key("l_orderkey"), F.col("s_name").alias("name"), F.when(F.col("l_linenumber") == 1, "").otherwise(day("l_shipdate")).alias("execution_date"), "l_linenumber"),
        "assignees": orders.join(customers, F.col("c_custkey") == F.col("o_custkey")).select(*key("o_orderkey"), F.col("c_name").alias("name")),
        "properties": lines.join(parts, F.col("p_partkey") == F.col("l_partkey")).select(*key("l_orderkey"), F.col("p_type").alias("invention_title"), F.concat(F.lit("US0"), "l_partkey").alias("doc_number"), kind.alias("doc_kind"), day("l_shipdate").alias("doc_date")),
        "resolution": sellers.union(buyers),
    }


def _ledger(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = _party_tables(spark, sf_dir)
    return ledger.build_ledger(t["assignments"], t["assignors"], t["assignees"], t["properties"], t["resolution"])


_LEDGER = f"""WITH r AS ({_RESOLUTION}),
typed AS (SELECT *, {_CONVEYANCE.format(t='conveyance_text')} AS conveyance_type FROM ({_ASSIGNMENTS})),
executed AS (SELECT reel_no, frame_no, max(nullif(execution_date, '')) AS x FROM ({_ASSIGNORS}) GROUP BY ALL),
txn AS (SELECT t.*, coalesce(x, nullif(recorded_date, '')) AS transaction_date, CASE WHEN x IS NOT NULL THEN 'execution' ELSE 'recorded' END AS date_source FROM typed t LEFT JOIN executed USING (reel_no, frame_no) WHERE conveyance_type = 'assignment'),
sellers AS (SELECT reel_no, frame_no, list_sort(list(DISTINCT entity_id)) AS seller_entity_ids, list_sort(list(DISTINCT canonical_name)) AS seller_canonical_names, list_sort(list(DISTINCT coalesce(nullif(ultimate_parent_id, ''), entity_id))) AS seller_parent_ids, bool_and(entity_type = 'company') AS firms FROM ({_ASSIGNORS}) JOIN r ON name = mention WHERE name <> '' GROUP BY ALL),
buyers_of AS (SELECT reel_no, frame_no, list_sort(list(DISTINCT entity_id)) AS buyer_entity_ids, list_sort(list(DISTINCT canonical_name)) AS buyer_canonical_names, list_sort(list(DISTINCT coalesce(nullif(ultimate_parent_id, ''), entity_id))) AS buyer_parent_ids, bool_and(entity_type = 'company') AS firms FROM ({_ASSIGNEES}) JOIN r ON name = mention WHERE name <> '' GROUP BY ALL),
typed_props AS (SELECT *, {_TYPE} AS doc_type FROM ({_PROPS})),
props AS (SELECT *, CASE WHEN doc_type = 'grant' THEN ltrim(number[3:], '0') ELSE '' END AS patent_id_normalized,
  first_value(number) OVER (PARTITION BY reel_no, frame_no, coalesce(nullif(invention_title, ''), number) ORDER BY CASE doc_type WHEN 'application' THEN 1 WHEN 'grant' THEN 2 WHEN 'publication' THEN 3 ELSE 4 END, number) AS canonical_property_id FROM typed_props),
counts AS (SELECT reel_no, frame_no, count(DISTINCT canonical_property_id) AS n FROM props GROUP BY ALL),
ledger AS (SELECT t.reel_no, t.frame_no, conveyance_type, conveyance_text AS conveyance_text_raw, transaction_date, date_source, recorded_date, seller_entity_ids, seller_canonical_names, buyer_entity_ids, buyer_canonical_names, seller_parent_ids, buyer_parent_ids, coalesce(n, 0)::INT AS property_count, correspondent_name
  FROM txn t JOIN sellers s USING (reel_no, frame_no) JOIN buyers_of b USING (reel_no, frame_no) LEFT JOIN counts USING (reel_no, frame_no) WHERE s.firms AND b.firms AND NOT list_has_any(seller_parent_ids, buyer_parent_ids)),
deals AS (SELECT reel_no, frame_no, transaction_date, unnest(buyer_entity_ids) AS entity_id FROM ledger),
bridge AS (SELECT DISTINCT entity_id, reel_no, frame_no, canonical_property_id, number AS doc_number_raw, kind AS kind_code, doc_type, patent_id_normalized, doc_date, invention_title, transaction_date, '' AS cpc_lookup_status FROM deals JOIN props USING (reel_no, frame_no)),
named AS (SELECT entity_id, unnest(arg_min(struct_pack(canonical_name, entity_type, resolution_source, resolution_confidence, ultimate_parent_id), mention)) FROM r GROUP BY entity_id),
buyers AS (SELECT d.entity_id, r.canonical_name, r.entity_type, r.resolution_source, r.resolution_confidence, r.ultimate_parent_id, coalesce(pr.canonical_name, r.canonical_name) AS ultimate_parent_name, '' AS country, '' AS sector, d.deals_count, coalesce(p.patents_count, 0) AS patents_count, first_acquisition_date, last_acquisition_date, starts_with(d.entity_id, 'prov-') AS is_off_gazetteer
  FROM (SELECT entity_id, count(*) AS deals_count, min(transaction_date) AS first_acquisition_date, max(transaction_date) AS last_acquisition_date FROM deals GROUP BY 1) d JOIN named r USING (entity_id) LEFT JOIN named pr ON pr.entity_id = r.ultimate_parent_id
  LEFT JOIN (SELECT entity_id, count(DISTINCT canonical_property_id) AS patents_count FROM bridge GROUP BY 1) p ON p.entity_id = d.entity_id) """

query(_LEDGER + "SELECT * FROM ledger", "firm_to_firm")(lambda s, d: _ledger(s, d)["transaction_ledger"])
query(_LEDGER + "SELECT * FROM bridge", "bridge_explode")(lambda s, d: _ledger(s, d)["buyer_property_bridge"])
query(_LEDGER + "SELECT * FROM buyers", "buyers_summary")(lambda s, d: _ledger(s, d)["buyers"])
query(_LEDGER + "SELECT reel_no, frame_no, conveyance_type, conveyance_text AS conveyance_text_raw, transaction_date, date_source, recorded_date, correspondent_name FROM txn", "txn_effective_date")(lambda s, d: ledger.transactions(*(_party_tables(s, d)[t] for t in ("assignments", "assignors"))))
for _by in ("patents", "deals"):
    query(_LEDGER + f"SELECT * FROM buyers ORDER BY {_by}_count DESC, entity_id LIMIT 20", f"top_buyers_{_by}")(lambda s, d, by=_by: ledger.top_buyers(_ledger(s, d)["buyers"], by, 20))
query(
    _LEDGER + "SELECT row_number() OVER (ORDER BY patents_count DESC, entity_id)::INT AS place, entity_id, canonical_name, entity_type, resolution_source, is_off_gazetteer, deals_count, patents_count, first_acquisition_date, last_acquisition_date FROM buyers ORDER BY place LIMIT 50",
    "leaderboard",
)(lambda s, d: (lambda made: ledger.leaderboard(made["buyers"], made["buyer_property_bridge"], "patents", 50))(_ledger(s, d)))


@query(
    f"""WITH a AS (SELECT reel_no, string_agg(name, '; ' ORDER BY l_linenumber, name) AS assignor_names, count(*)::VARCHAR AS assignor_count, max(nullif(execution_date, '')) AS execution_date FROM ({_ASSIGNORS}) GROUP BY reel_no)
SELECT h.reel_no, conveyance_text, correspondent_name, assignor_names, e.name AS assignee_names, assignor_count, '1' AS assignee_count, execution_date, coalesce(execution_date, recorded_date) AS transaction_date, CASE WHEN execution_date IS NOT NULL THEN 'execution' ELSE 'recorded' END AS date_source, invention_title, number AS doc_number, kind AS doc_kind, doc_date
FROM ({_ASSIGNMENTS}) h JOIN a USING (reel_no) JOIN ({_ASSIGNEES}) e USING (reel_no) JOIN ({_PROPS}) p USING (reel_no)"""
)
def flat_denormalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records, as the XML source gives them, and their flat table."""
    t = _party_tables(spark, sf_dir)
    text_of = lambda names, have: [F.col(n) if n in have else F.lit(None).cast("string").alias(n) for n in names]
    sellers = t["assignors"].groupBy("reel_no").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "name", "execution_date"))).alias("list"))
    sellers = sellers.select("reel_no", F.transform("list", lambda x: F.struct(x["name"].alias("name"), x["execution_date"].alias("execution_date"), F.lit(None).cast("string").alias("date_acknowledged"))).alias("assignors"))
    buyers = t["assignees"].groupBy("reel_no").agg(F.collect_list(F.struct("name")).alias("assignees"))
    wanted = COLUMNS["properties"][2:]
    props = t["properties"].groupBy("reel_no").agg(F.collect_list(F.struct(*text_of(wanted, t["properties"].columns))).alias("properties"))
    records = t["assignments"].select(*text_of(COLUMNS["assignments"], t["assignments"].columns)).join(sellers, "reel_no").join(buyers, "reel_no").join(props, "reel_no")
    return xml_records.flat_table(records).select("reel_no", "conveyance_text", "correspondent_name", "assignor_names", "assignee_names", "assignor_count", "assignee_count", "execution_date", "transaction_date", "date_source", "invention_title", "doc_number", "doc_kind", "doc_date")


_MENTIONS = "SELECT upper(s_name) || ', Inc.' AS mention FROM supplier UNION SELECT s_name FROM supplier UNION SELECT 'Doe, Jane' || chr(65 + n_nationkey::INT) FROM nation UNION SELECT '--'"


@query(
    f"""WITH m AS ({_MENTIONS}), k AS (SELECT mention, {_KEY.format('mention')} AS key, trim(regexp_replace({_KEY.format('mention')}, '(?:\\s+(?:{'|'.join(text.LEGAL_SUFFIXES)}))+$', '')) AS bare FROM m)
SELECT mention, CASE WHEN key = '' THEN '' WHEN s_suppkey IS NOT NULL THEN 'w' || s_suppkey ELSE 'person-' || substr(sha1(key), 1, 16) END AS entity_id, CASE WHEN key = '' THEN 'unresolved' WHEN s_suppkey IS NOT NULL THEN 'exact' ELSE 'person' END AS resolution_source,
  CASE WHEN key = '' THEN 0.0 WHEN s_suppkey IS NOT NULL THEN 1.0 ELSE 0.95 END::DOUBLE AS resolution_confidence, CASE WHEN key = '' THEN 'unknown' WHEN s_suppkey IS NOT NULL THEN 'company' ELSE 'individual' END AS entity_type
FROM k LEFT JOIN supplier ON {_KEY.format('s_name')} = bare"""
)
def exact_alias_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade over names that its exact and person stages resolve, as SQL can say."""
    suppliers = table(spark, sf_dir, "supplier")
    rows = suppliers.select(F.concat("s_name", F.lit(" LLC")).alias("organization"), F.concat(F.lit("w"), "s_suppkey").alias("assignee_id"), F.col("s_suppkey").alias("_ord"))
    entities, aliases = match.build_dictionary(match.build_reference(rows, "organization", "assignee_id", "_ord"))
    people = table(spark, sf_dir, "nation").select(F.concat(F.lit("Doe, Jane"), F.char(F.col("n_nationkey") + 65)))
    mentions = suppliers.select(F.concat(F.upper("s_name"), F.lit(", Inc.")).alias("mention")).union(suppliers.select("s_name")).union(people).union(spark.createDataFrame([("--",)], "mention string"))
    return match.resolve_mentions(mentions, entities, aliases).select("mention", "entity_id", "resolution_source", "resolution_confidence", "entity_type")


@query(
    """SELECT buyer, patent_id, list_sort(list_distinct(flatten(list(codes)))) AS codes, max(year) AS year FROM (
  SELECT 'c' || o_custkey AS buyer, CASE WHEN l_partkey % 3 = 1 THEN l_partkey::VARCHAR ELSE '' END AS patent_id, [upper(replace(p_type, ' ', ''))[1:4]] AS codes, year(o_orderdate)::INT AS year FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)
WHERE patent_id <> '' GROUP BY buyer, patent_id"""
)
def buyer_patents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    kind = F.get(F.array(F.lit("X0"), F.lit("B1"), F.lit("A1")), (F.col("l_partkey") % 3).cast("int"))
    df = rows.select(F.concat(F.lit("c"), "o_custkey").alias("buyer"), F.concat(F.lit("US0"), "l_partkey").alias("doc_number"), kind.alias("doc_kind"), F.date_format("o_orderdate", "yyyyMMdd").alias("transaction_date"), F.array("p_type").alias("cpc_codes"))
    return codes.buyer_patents(df, "buyer").select("buyer", "patent_id", "codes", "year")


@query("SELECT entity_id, doc_number_raw FROM (SELECT o_custkey AS entity_id, o_orderkey AS doc_number_raw, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def sampled_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("doc_number_raw"), F.col("o_orderdate").alias("transaction_date"), F.lit("grant").alias("doc_type"))
    return ledger.sampled_scope(rows, 3).select("entity_id", "doc_number_raw")


@query(
    """WITH c AS (SELECT p_partkey::VARCHAR AS id, list_sort(list(DISTINCT trim(p_type))) AS cpc_codes, list_sort(list(DISTINCT trim(p_type)[1:4])) AS cpc_subclasses FROM part WHERE p_partkey % 2 = 0 AND trim(p_type) <> '' GROUP BY 1)
SELECT l_orderkey, l_linenumber, coalesce(cpc_codes, []::VARCHAR[]) AS cpc_codes, coalesce(cpc_subclasses, []::VARCHAR[]) AS cpc_subclasses, CASE WHEN id IS NULL THEN 'not_found' ELSE 'found' END AS cpc_lookup_status
FROM lineitem LEFT JOIN c ON id = l_partkey::VARCHAR"""
)
def reconcile_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bridge = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("patent_id_normalized"), F.lit("grant").alias("doc_type"))
    found = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("patent_id"), F.col("p_type").alias("cpc"))
    return ledger.reconcile_codes(bridge, found).drop("patent_id_normalized", "doc_type")


_PATENTS = """SELECT 'c' || o_custkey AS buyer, l_partkey::VARCHAR AS patent_id, list_sort(list(DISTINCT p_type)) AS codes, max(year(o_orderdate))::INT AS year
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2"""
_PORTFOLIO = "SELECT DISTINCT p_partkey::VARCHAR AS portfolio_patent, p_type AS code FROM part WHERE p_size = 7"
_MET = f"""WITH pat AS ({_PATENTS}), port AS ({_PORTFOLIO}), coded AS (SELECT buyer, patent_id, year, len(codes) AS own, unnest(codes) AS code FROM pat),
w AS (SELECT code, (SELECT count(*) FROM pat)::DOUBLE / count(*) AS weight FROM coded GROUP BY code), sz AS (SELECT portfolio_patent, count(*) AS wanted FROM port GROUP BY 1),
met AS (SELECT portfolio_patent, buyer, patent_id, count(*) AS shared, sum(weight) AS rarity, any_value(own) AS own, max(year) AS year, list_sort(list(DISTINCT code)) AS codes
  FROM coded JOIN port USING (code) JOIN w USING (code) GROUP BY ALL),
pts AS (SELECT m.*, {{0}} AS points FROM met m JOIN sz USING (portfolio_patent)),
sums AS (SELECT portfolio_patent, buyer, sum(points) AS strength, count(*) AS in_domain_patents, max(year) AS year, list_sort(list_distinct(flatten(list(codes)))) AS shared_codes FROM pts WHERE points >= {{1}} GROUP BY ALL),
rk AS (SELECT *, strength + in_domain_patents + greatest(year - 2000, 0) AS rank_value FROM sums),
per AS (SELECT portfolio_patent, row_number() OVER (PARTITION BY portfolio_patent ORDER BY round(rank_value, 6) DESC, buyer) AS rank, buyer, round(strength, 4) AS overlap_strength, shared_codes, in_domain_patents, year::VARCHAR AS last_acquisition_date,
  round(rank_value, 4) AS rank_score, 'false' AS is_off_gazetteer FROM rk) """


def _match(spark: SparkSession, sf_dir: str, config: codes.MatchConfig) -> dict[str, DataFrame]:
    part = table(spark, sf_dir, "part")
    types = part.groupBy("p_partkey").agg(F.sort_array(F.collect_set("p_type")).alias("codes"))
    dated = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    rows = dated.join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_partkey").agg(F.max("year").alias("year"))
    patents = rows.join(types.hint("merge"), F.col("p_partkey") == F.col("l_partkey")).select(F.concat(F.lit("c"), "o_custkey").alias("buyer"), F.col("l_partkey").cast("string").alias("patent_id"), "codes", "year")
    portfolio = part.filter("p_size = 7").select(F.col("p_partkey").cast("string").alias("portfolio_patent"), F.col("p_type").alias("code")).distinct()
    return codes.match_portfolio(portfolio, patents, config, types)


for _metric, _points, _least in (("shared_count", "shared::DOUBLE", 1.0), ("jaccard", "shared / (own + wanted - shared)", 0.5), ("rarity_weighted", "rarity", 1.0)):
    query(_MET.format(_points, _least) + "SELECT * FROM per", f"cpc_match_per_{_metric}")(lambda s, d, m=_metric, t=_least: _match(s, d, codes.MatchConfig(metric=m, threshold=t))["per"])
query(
    _MET.format("shared::DOUBLE", 1.0) + "SELECT buyer, count(*) AS portfolio_patents_matched, round(sum(overlap_strength), 4) AS total_overlap_strength, max(in_domain_patents) AS in_domain_patents, max(last_acquisition_date) AS last_acquisition_date, 'false' AS is_off_gazetteer FROM per GROUP BY buyer",
    "cpc_match_overall",
)(lambda s, d: _match(s, d, codes.MatchConfig())["overall"])
query(_MET.format("shared::DOUBLE", 1.0) + "SELECT portfolio_patent, buyer, patent_id AS buyer_patent, unnest(codes) AS cpc_class, year::VARCHAR AS year, 'false' AS is_off_gazetteer FROM pts", "cpc_match_class")(lambda s, d: _match(s, d, codes.MatchConfig())["class"])


@query("SELECT key, source FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source) AS n FROM (SELECT n_name AS key, 1 AS source FROM nation UNION ALL SELECT r_name, 2 FROM region UNION ALL SELECT n_name, 3 FROM nation)) WHERE n = 1")
def alias_precedence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = n.select(F.col("n_name").alias("key"), F.lit(1).alias("source")).union(r.select("r_name", F.lit(2))).union(n.select("n_name", F.lit(3)))
    return match.first_wins(rows, "key", "source")


@query("SELECT n_name AS key, 'old' AS state FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_name, 'new' FROM nation WHERE n_nationkey >= 10")
def provisional_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return match.append_new(n.filter("n_nationkey < 10").select(F.col("n_name").alias("key"), F.lit("old").alias("state")), n.select(F.col("n_name").alias("key"), F.lit("new").alias("state")), "key")


def _cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    cache = part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("patent_id"), F.array("p_brand").alias("cpc_codes"), F.when(F.col("p_partkey") % 2 == 0, 50.0).otherwise(10.0).alias("fetched_at"))
    source = part.filter("p_partkey % 5 = 0").select(F.col("p_partkey").cast("string").alias("patent_id"), F.col("p_type").alias("cpc"))
    return codes.resolve_cached(part.select(F.col("p_partkey").cast("string").alias("patent_id")), cache, source, 100.0, 60.0)


_HIT = "SELECT p_partkey::VARCHAR AS patent_id, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN [p_brand] WHEN p_partkey % 5 = 0 THEN [p_type] ELSE []::VARCHAR[] END AS cpc_codes, p_partkey FROM part"
query(f"SELECT patent_id, cpc_codes, CASE WHEN len(cpc_codes) > 0 THEN 'found' ELSE 'not_found' END AS status FROM ({_HIT}) WHERE p_partkey > 0", "cache_misses")(lambda s, d: _cache(s, d)[0].filter("patent_id <> '0'"))
query(f"SELECT patent_id, cpc_codes, CASE WHEN p_partkey % 6 = 0 THEN 50.0 ELSE 100.0 END::DOUBLE AS fetched_at FROM ({_HIT}) WHERE p_partkey > 0", "cache_merge")(lambda s, d: _cache(s, d)[1].filter("patent_id <> '0'"))


# --- similarity and entity resolution

_JARO = "SELECT p.p_partkey, round(100 * jaro_winkler_similarity(p.p_name, o.p_name), 6) AS score FROM part p JOIN part o ON o.p_partkey + 1 = p.p_partkey"
for _scorer in scorers.SCORERS:

    def _scored(spark: SparkSession, sf_dir: str, scorer: str = _scorer) -> DataFrame:
        p = table(spark, sf_dir, "part")
        other = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("other"))
        return p.join(other, "p_partkey").select("p_partkey", F.round(scorers.score(F.col("p_name"), F.col("other"), scorer), 6).alias("score"))

    query(_JARO if _scorer == "jaro_winkler" else None, f"fuzzy_{_scorer}")(_scored)


@query()
def blocked_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(text.clean_key(F.col("p_name")).alias("key")).distinct().withColumn("ord", F.xxhash64("key"))
    probes = names.select(F.concat("key", F.lit(" X")).alias("probe"))
    return match.fuzzy_match(probes, names, 80, "token_sort")


@query()
def normalize_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ord"))
    return match.normalize_learn(names, 85, "token_sort")


@query()
def resolve_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.concat("s_name", F.lit(" INC")).alias("organization"), F.lit("").alias("assignee_id"), F.col("s_suppkey").alias("_ord"))
    entities, aliases = match.build_dictionary(match.build_reference(rows, "organization", "assignee_id", "_ord"))
    mentions = rows.select(F.col("organization").alias("mention")).union(table(spark, sf_dir, "customer").select(F.concat(F.initcap("c_mktsegment"), F.lit(" Corp ")))).union(table(spark, sf_dir, "part").select("p_name"))
    return match.resolve_mentions(mentions, entities, aliases, threshold=92, scorer="token_sort")


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS a, 'q' || l_suppkey AS b FROM lineitem), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS root FROM both_ways UNION SELECT r.node, x.b FROM r JOIN both_ways x ON x.a = r.root) SELECT node, min(root) AS root FROM r GROUP BY node"""
)
def cluster_components_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("q"), "l_suppkey").alias("b")).distinct()
    return graph.components(rows)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
