"""Predicates on the text view of columns, combined, plus quick search; compiled to one native condition."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import string_view

OPS = ("contains", "starts_with", "equals", "not_equals", "not_empty", "is_empty", "in_range")


@dataclass(frozen=True)
class Clause:
    column: str
    op: str
    value: str = ""
    value2: str = ""
    case_sensitive: bool = False


def view(df: DataFrame, column: str) -> Column:
    return string_view(F.col(f"`{column}`"), df.schema[column].dataType)


def condition(df: DataFrame, clause: Clause) -> Column:
    """Never null: a null value fits only not_equals and is_empty."""
    text = view(df, clause.column)
    if clause.op not in OPS:
        raise ValueError(f"unknown filter op {clause.op!r}; one of {', '.join(OPS)}")
    folded, value = (text, clause.value) if clause.case_sensitive else (F.lower(text), clause.value.lower())
    if clause.op == "contains":
        found = folded.contains(value)
    elif clause.op == "starts_with":
        found = folded.startswith(value)
    elif clause.op == "equals":
        found = folded == value
    elif clause.op == "not_equals":
        found = text.isNull() | (folded != value)
    elif clause.op == "not_empty":
        found = F.length(text) > 0
    elif clause.op == "is_empty":
        found = text.isNull() | (text == "")
    else:
        found = text.between(clause.value, clause.value2)
    return F.coalesce(found, F.lit(False))


def quick(df: DataFrame, search: str) -> Column:
    """Any column holds the text, whatever its case."""
    return functools.reduce(lambda a, b: a | b, [condition(df, Clause(c, "contains", search)) for c in df.columns], F.lit(False))


def apply(df: DataFrame, clauses: list[Clause], search: str = "", combine: str = "and") -> DataFrame:
    if combine not in ("and", "or"):
        raise ValueError(f"combine must be and or or, not {combine!r}")
    missing = [c.column for c in clauses if c.column not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}; there are {', '.join(df.columns)}")
    if clauses:
        join = (lambda a, b: a & b) if combine == "and" else (lambda a, b: a | b)
        df = df.filter(functools.reduce(join, [condition(df, c) for c in clauses]))
    return df.filter(quick(df, search)) if search else df


def default_op(column: str, faceted: bool = False) -> str:
    return "in_range" if column.endswith("_date") else "equals" if faceted else "contains"
