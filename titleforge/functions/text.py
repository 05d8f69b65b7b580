"""Scalar functions on text, dates as text and identifiers, all as native column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = "; "

# Legal forms that end a company's name.
LEGAL_SUFFIXES = (
    "INCORPORATED INC CORPORATION CORP COMPANY CO LLC LLP LP LTD LIMITED PLC GMBH AG KG SA SARL SAS NV BV OY AB AS SPA SRL KK PTY PTE ULC APS OYJ ASA"
).split()


def string_view(column: Column, kind: T.DataType) -> Column:
    """A column as the text that predicates see: lists joined, nested values as JSON."""
    if isinstance(kind, T.StringType):
        return column
    if isinstance(kind, T.ArrayType):
        return F.array_join(column.cast("array<string>"), PARTS, "")
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.to_json(column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text = column.cast("string")
        return F.regexp_replace(text, r"\.0$", "")
    return column.cast("string")


def clean_key(column: Column) -> Column:
    """Upper case; each run of other letters than A-Z and 0-9 is one blank; trimmed."""
    return F.trim(F.regexp_replace(F.upper(column), "[^A-Z0-9]+", " "))


def strip_legal_suffix(key: Column) -> Column:
    """Without the legal forms at the end; a key of legal forms alone keeps its first."""
    return F.trim(F.regexp_replace(key, rf"(?:\s+(?:{'|'.join(LEGAL_SUFFIXES)}))+$", ""))


def split_parties(column: Column, separator: str = PARTS) -> Column:
    """Trimmed parts without blank ones; without a separator the whole value is the one part."""
    parts = F.split(column, re.escape(separator)) if separator else F.array(column)
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def effective_separator(separator: str, column: str) -> str:
    return separator or (PARTS if column.endswith("_names") else "")


# Patterns of conveyance texts with their types, the first that is found decides.
CONVEYANCE_RULES = (
    (r"\bRELEASE\b|TERMINATION\s+(AND\s+RELEASE|OF\s+SECURITY)", "release"),
    (r"SECURITY\s+(INTEREST|AGREEMENT)|FOR\s+SECURITY|\bLIEN\b|COLLATERAL", "security_interest"),
    (r"NUNC\s+PRO\s+TUNC", "nunc_pro_tunc"),
    (r"CORRECTIV|CORRECTION|TO\s+CORRECT", "correction"),
    (r"\bMERGER\b|CHANGE\s+OF\s+NAME\s+AND\s+MERGER", "merger"),
    (r"CHANGE\s+OF\s+NAME|NAME\s+CHANGE", "name_change"),
    (r"\bLICENSE\b|\bLICENCE\b", "license"),
    (r"ASSIGN", "assignment"),
)


def conveyance_type(column: Column, null_as_other: bool = False) -> Column:
    """The first rule that fits; text without any is other, null stays null."""
    text = F.upper(column)
    found = F.when(column.isNull(), F.lit("other") if null_as_other else F.lit(None).cast("string"))
    for pattern, label in CONVEYANCE_RULES:
        found = found.when(text.rlike(pattern), label)
    return found.otherwise("other")


DERIVE_OPS = ("year", "month", "split_first", "upper", "lower")


def derive(column: Column, op: str) -> Column:
    """year and month cut dates as text; split_first takes the first party."""
    if op == "year":
        return F.substring(column, 1, 4)
    if op == "month":
        return F.substring(column, 5, 2)
    if op == "split_first":
        return F.substring_index(column, PARTS, 1)
    if op == "upper":
        return F.upper(column)
    if op == "lower":
        return F.lower(column)
    raise ValueError(f"unknown derive op {op!r}; one of {', '.join(DERIVE_OPS)}")


def year_of(column: Column) -> Column:
    return F.when(column.rlike("^[0-9]{4}"), F.substring(column, 1, 4).cast("int")).otherwise(0)


def recency(year: Column) -> Column:
    return F.greatest(year - 2000, F.lit(0))


def doc_type(number: Column, kind: Column) -> Column:
    """application, grant, publication or unknown, from kind code and number; null counts as empty."""
    number, kind = F.upper(F.trim(F.coalesce(number, F.lit("")))), F.upper(F.trim(F.coalesce(kind, F.lit(""))))
    digits = F.length(F.regexp_replace(number, "[^0-9]", ""))
    return (
        F.when(kind == "X0", "application")
        .when(kind.startswith("B"), "grant")
        .when(kind.isin("A1", "A2", "A9", "P1", "P4") & (digits == 11), "publication")
        .when(kind == "A", F.when(digits <= 8, "grant").otherwise("publication"))
        .when(number.rlike("^(?:D|PP|RE|H|T)") & (digits > 0), "grant")
        .when(digits == 11, "publication")
        .otherwise("unknown")
    )


_GRANT = r"^(?:US)?([A-Z]{0,2})([0-9]+)$"


#: Forms of a grant's number: without country and leading zeros, or as it stands.
DOC_FORMS = ("normalized", "raw")


def normalize_patent_id(number: Column, kind: Column, form: str = "normalized") -> Column:
    """Empty unless a grant; else without country prefix and leading zeros. form raw: trimmed upper case."""
    text = F.upper(F.trim(F.coalesce(number, F.lit(""))))
    if form == "raw":
        found = text
    else:
        found = F.when(text.rlike(_GRANT), F.concat(F.regexp_extract(text, _GRANT, 1), F.regexp_replace(F.regexp_extract(text, _GRANT, 2), "^0+(?!$)", ""))).otherwise(text)
    return F.when(kind == "grant", found).otherwise("")


def normalize_grant(column: Column) -> Column:
    """An id of a file: upper case without commas, blanks and trailing kind code, then as normalize_patent_id."""
    text = F.regexp_replace(F.upper(F.coalesce(column, F.lit(""))), r"[,\s]", "")
    text = F.regexp_replace(text, r"(?<=[0-9])[A-Z][0-9]?$", "")
    return normalize_patent_id(text, F.lit("grant"))


def grain_of(symbol: Column, grain: str = "subclass") -> Column:
    text = F.upper(F.regexp_replace(symbol, " ", ""))
    if grain == "subclass":
        return F.substring(text, 1, 4)
    if grain == "main_group":
        return F.substring_index(text, "/", 1)
    if grain == "full_symbol":
        return text
    raise ValueError(f"unknown grain {grain!r}")


def reduce_codes(codes: Column, grain: str = "subclass") -> Column:
    return F.array_distinct(F.transform(F.filter(codes, lambda x: x.isNotNull() & (F.trim(x) != "")), lambda x: grain_of(x, grain)))


def hash_id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(key.cast("binary")), 1, 16))


def title_key(key: Column) -> Column:
    """Each run of letters of a cleaned key with its first one upper; so also after digits."""
    return F.array_join(F.transform(F.regexp_extract_all(key, F.lit("([A-Z]+|[^A-Z]+)"), F.lit(1)), lambda run: F.initcap(run)), "")


def review_flag(score: Column, threshold: int) -> Column:
    """"true" if 0 < score < threshold, at most 100; null stays null."""
    return F.when(score.isNotNull(), F.when((score > 0) & (score < min(threshold, 100)), "true").otherwise("false"))


def transaction_date(executed: Column, recorded: Column) -> tuple[Column, Column]:
    """(date, source): the execution date, else the recorded one; source is null without any."""
    executed, recorded = F.nullif(executed, F.lit("")), F.nullif(recorded, F.lit(""))
    return F.coalesce(executed, recorded), F.when(executed.isNotNull(), "execution").when(recorded.isNotNull(), "recorded")


def safe_name(name: str) -> str:
    return "".join(c if c.isalnum() or c in " -_" else "_" for c in name).strip() or "batch"
