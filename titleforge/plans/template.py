"""Pipelines as JSON: strict decoding, schema prediction, warnings, and compilation to lazy DataFrame steps."""

from __future__ import annotations

import json
from dataclasses import MISSING, asdict, dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import METHODS, MODES
from ..functions.scorers import SCORERS
from ..functions.text import DERIVE_OPS, effective_separator, normalize_grant, reduce_codes
from ..model import COLUMNS
from ..operators import codes, filters, match, relational
from ..operators.memory import Memory
from ..sources import files, sinks
from .config import Context

#: Fields of each kind of step with their defaults; MISSING: required.
STEPS: dict[str, dict[str, Any]] = {
    "filter": {"table": MISSING, "clauses": [], "combine": "and", "columns": None, "sort": None},
    "normalize": {"table": MISSING, "column": "name", "target": "", "threshold": 90, "separator": "", "learn": True, "scorer": "wratio", "emit_score": False, "review_threshold": 0, "emit_type": False},
    "classify": {"table": MISSING, "column": "name", "target": "", "method": "rules", "mode": "all", "separator": ""},
    "compare": {"table": MISSING, "left": MISSING, "right": MISSING, "target": "", "method": "exact", "scorer": "wratio", "threshold": 90, "action": "flag", "emit_score": False, "review_threshold": 0},
    "transfer_type": {"table": "flat", "assignor_column": "assignor_names", "assignee_column": "assignee_names", "assignor_type": "company", "assignee_type": "company", "method": "rules"},
    "kind_filter": {"table": "flat", "column": "doc_kind", "number_column": "doc_number", "types": [], "codes": [], "action": "keep"},
    "reference_match": {"table": "flat", "column": "assignor_names", "reference_path": "", "name_column": "disambig_assignee_organization", "id_column": "", "target": "", "matched_target": "", "id_target": "", "threshold": 90, "scorer": "wratio", "separator": "", "mode": "any", "delimiter": "", "action": "flag", "emit_score": False, "review_threshold": 0},
    "dedupe": {"table": MISSING, "subset": None},
    "select": {"table": MISSING, "columns": []},
    "sort": {"table": MISSING, "column": "", "ascending": True},
    "derive": {"table": MISSING, "source": MISSING, "target": "", "op": "year"},
    "aggregate": {"table": MISSING, "group_by": [], "count_distinct": None, "out_table": ""},
    "fetch_cpc": {"table": "flat", "column": "doc_number", "kind_column": "doc_kind"},
    "attach_cpc_file": {"table": "flat", "column": "doc_number", "kind_column": "doc_kind", "source_path": "", "patent_column": "Publication Number", "code_column": "CPC", "separator": ";"},
    "cpc_match": {"table": "flat", "portfolio_mode": "patent_list", "portfolio_path": "", "buyer_column": "assignee_names_canonical", "number_column": "doc_number", "kind_column": "doc_kind", "date_column": "transaction_date", "out_table": "matched_buyers_by_portfolio_patent", "overall_table": "matched_buyers_overall", "emit_class_matches": False, "class_match_table": "matched_cpc_classes"},
    "export": {"fmt": "parquet", "tables": None, "columns": None, "renames": None},
}
_KINDS = ("company", "individual", "unknown")
_ENUMS = {"combine": ("and", "or"), "scorer": tuple(SCORERS), "mode": MODES, "op": DERIVE_OPS, "fmt": sinks.FORMATS, "assignor_type": _KINDS, "assignee_type": _KINDS, "portfolio_mode": ("patent_list", "footprint_file")}
_ACTIONS = {"compare": ("flag", "drop_matches", "keep_matches"), "kind_filter": ("keep", "discard"), "reference_match": ("flag", "keep_matched", "drop_matched")}
_TYPES = ("grant", "application", "publication", "unknown")
#: A target that old templates gave each normalize step; it now follows from the column.
LEGACY_TARGET = "name_canonical"


@dataclass
class Step:
    kind: str
    options: dict[str, Any]
    enabled: bool = True

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["options"][name]
        except KeyError:
            raise AttributeError(name) from None


@dataclass
class Load:
    tables: list[str] | None = None
    columns: dict[str, list[str]] = field(default_factory=dict)
    limit: int = 0


@dataclass
class Template:
    name: str
    load: Load = field(default_factory=Load)
    steps: list[Step] = field(default_factory=list)
    description: str = ""


def decode_clause(data: dict[str, Any]) -> dict[str, Any]:
    if not isinstance(data, dict) or "column" not in data:
        raise ValueError("filter: a clause is an object with a column")
    op, case = data.get("op") or "contains", data.get("case_sensitive", False)
    if op not in filters.OPS:
        raise ValueError(f"filter: op {op!r} isn't one of {', '.join(filters.OPS)}")
    if not isinstance(case, bool):
        raise ValueError("filter: case_sensitive must be true or false")
    return {"column": str(data["column"]), "op": op, "value": str(data.get("value", "")), "value2": str(data.get("value2", "")), "case_sensitive": case}


def decode_step(data: dict[str, Any]) -> Step:
    kind = data.get("kind")
    if kind not in STEPS:
        raise ValueError(f"unknown step kind {kind!r}; one of {', '.join(STEPS)}")
    known = STEPS[kind]
    options = {}
    for name, default in known.items():
        if name not in data and default is MISSING:
            raise ValueError(f"{kind}: {name} is missing")
        value = data.get(name, default)
        if value is None and name in ("columns", "group_by", "types", "codes") and default == []:
            value = []
        listed = name in ("subset", "tables", "group_by", "types", "codes") or name == "columns" and kind != "export"
        if listed and value is not None and not isinstance(value, (list, tuple)):
            raise ValueError(f"{kind}: {name} must be a list")
        if name in _ENUMS and value in ("", None):
            value = default
        if isinstance(default, bool) and not isinstance(value, bool):
            raise ValueError(f"{kind}: {name} must be true or false")
        allowed = _ENUMS.get(name)
        if name == "method":
            allowed = ("exact", "fuzzy") if kind == "compare" else METHODS
        if name == "mode" and kind == "reference_match":
            allowed = ("any", "all")
        if name == "action":
            allowed = _ACTIONS[kind]
        if allowed and value not in allowed:
            raise ValueError(f"{kind}: {name} {value!r} isn't one of {', '.join(allowed)}")
        if name in ("threshold", "review_threshold") and (isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= 100):
            raise ValueError(f"{kind}: {name} must lie between 0 and 100")
        options[name] = value
    if kind == "filter":
        if not isinstance(options["clauses"], list):
            raise ValueError("filter: clauses must be a list")
        options["clauses"] = [decode_clause(c) for c in options["clauses"]]
        sort = options["sort"]
        if sort is not None and (isinstance(sort, str) or len(sort) != 2):
            raise ValueError('filter: sort must be ["column", true or false] or null')
        options["sort"] = None if sort is None else [str(sort[0]), bool(sort[1])]
    if kind == "normalize" and options["target"] == LEGACY_TARGET:
        options["target"] = ""
    if kind == "kind_filter" and (odd := set(options["types"]) - set(_TYPES)):
        raise ValueError(f"kind_filter: type {', '.join(sorted(odd))} isn't one of {', '.join(_TYPES)}")
    enabled = data.get("enabled", True)
    if not isinstance(enabled, bool):
        raise ValueError(f"{kind}: enabled must be true or false")
    return Step(kind, options, enabled)


def decode(data: dict[str, Any]) -> Template:
    if not isinstance(data, dict) or not isinstance(data.get("name"), str) or not data["name"].strip() or not isinstance(data.get("steps", []), list) or not isinstance(data.get("load", {}), dict) or not isinstance(data.get("description", ""), str):
        raise ValueError("a template is an object with a name, a list of steps, and perhaps an object load and a text description")
    load = data.get("load", {})
    found = Load(load.get("tables"), {str(t): [str(c) for c in names] for t, names in (load.get("columns") or {}).items()}, max(0, int(load.get("limit") or 0)))
    return Template(data["name"], found, [decode_step(s) for s in data.get("steps", [])], data.get("description", ""))


def encode(template: Template) -> dict[str, Any]:
    steps = [{"kind": s.kind, "enabled": s.enabled} | s.options for s in template.steps]
    out = {"name": template.name, "load": asdict(template.load), "steps": steps}
    return out | ({"description": template.description} if template.description else {})


def load_templates(text: str) -> list[Template]:
    data = json.loads(text)
    return [decode(d) for d in (data if isinstance(data, list) else [data])]


def added_columns(step: Step) -> list[str]:
    o = step.options
    if step.kind == "normalize":
        target = o["target"] or f"{o['column']}_canonical"
        return [target, *([f"{target}_score"] if o["emit_score"] or o["review_threshold"] else []), *([f"{target}_review"] if o["review_threshold"] else []), *([f"{target}_type"] if o["emit_type"] else [])]
    if step.kind == "classify":
        return [o["target"] or f"{o['column']}_type"]
    if step.kind == "compare":
        target = o["target"] or f"{o['left']}_matches_{o['right']}"
        return [*([f"{target}_score"] if o["emit_score"] else []), *([f"{target}_review"] if o["review_threshold"] else []), *([target] if o["action"] == "flag" else [])]
    if step.kind == "derive":
        return [o["target"] or f"{o['source']}_{o['op']}"]
    if step.kind == "reference_match" and o["action"] == "flag":
        c = o["column"]
        return [*reference_targets(step), *([f"{c}_match_score"] if o["emit_score"] else []), *([f"{c}_match_review"] if o["review_threshold"] else [])]
    if step.kind in ("fetch_cpc", "attach_cpc_file"):
        return ["cpc_codes", "cpc_subclasses", "cpc_lookup_status"]
    return []


def reference_targets(step: Step) -> list[str]:
    c = step.column
    return [step.target or f"{c}_disambiguated", step.matched_target or f"{c}_matched", step.id_target or f"{c}_assignee_id"]


def unique_targets(steps: list[Step]) -> list[Step]:
    """The steps with normalize targets that no step before has taken in the same table."""
    taken, out = set(), []
    for step in steps:
        if step.kind == "normalize" and step.enabled:
            target, n = step.target or f"{step.column}_canonical", 2
            if (step.table, target) in taken:
                target = f"{step.column}_canonical"
                while (step.table, target) in taken:
                    target, n = f"{step.column}_canonical_{n}", n + 1
            taken.add((step.table, target))
            step = Step(step.kind, step.options | {"target": target}, step.enabled)
        out.append(step)
    return out


def needed_tables(template: Template) -> set[str] | None:
    """The tables that a template touches; None if an export writes them all."""
    if any(s.kind == "export" and s.tables is None for s in template.steps):
        return None
    needed = {t for t, names in template.load.columns.items() if names}
    for step in template.steps:
        needed |= set(step.tables) if step.kind == "export" else {step.table}
    return needed or None


def out_table(step: Step) -> str:
    return step.out_table or f"{step.table}_by_{'_'.join(step.group_by)}"


def columns_after(template: Template, upto: int | None = None, base: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """The schema that the steps lead to, without data."""
    tables = {t: list(c) for t, c in (base or {t: COLUMNS[t] for t in (template.load.tables or COLUMNS)}).items()}
    for name, kept in template.load.columns.items():
        if name in tables:
            tables[name] = [c for c in kept if c in tables[name]]
    for step in template.steps[:upto]:
        if not step.enabled or step.kind == "export" or step.table not in tables:
            continue
        have = tables[step.table]
        if step.kind in ("filter", "select") and step.columns:
            tables[step.table] = [c for c in step.columns if c in have] or have
        elif step.kind == "aggregate":
            keys = [k for k in step.group_by if k in have]
            if keys:
                tables[out_table(step)] = [*keys, "count", *([f"{step.count_distinct}_distinct"] if step.count_distinct in have else [])]
        elif step.kind == "cpc_match":
            tables |= {step.out_table: list(codes.PER), step.overall_table: list(codes.OVERALL)} | ({step.class_match_table: list(codes.CLASSES)} if step.emit_class_matches else {})
        else:
            added = added_columns(step)
            tables[step.table] = [c for c in have if c not in added] + added
    return tables


def validate(template: Template, base: dict[str, list[str]] | None = None) -> list[str]:
    """Warnings about tables, columns and files that steps name but won't find."""
    warnings = [] if any(s.enabled for s in template.steps) else ["no step is enabled"]
    for i, step in enumerate(template.steps):
        if not step.enabled:
            continue
        tables, at = columns_after(template, i, base), f"step {i + 1} ({step.kind})"
        if step.kind == "export":
            warnings += [f"{at}: no table {t}" for t in step.tables or [] if t not in tables]
            continue
        if step.table not in tables:
            warnings.append(f"{at}: no table {step.table}")
            continue
        named = [c.get("column") for c in step.options.get("clauses", [])] + [step.options.get(k) for k in ("column", "left", "right", "source", "assignor_column", "assignee_column")]
        named += [*(step.options.get("group_by") or []), *(step.options.get("subset") or [])]
        warnings += [f"{at}: no column {c}" for c in dict.fromkeys(named) if c and c not in tables[step.table]]
        warnings += [f"{at}: an upper bound is missing" for c in step.options.get("clauses", []) if c["op"] == "in_range" and not c.get("value2")]
        warnings += [f"{at}: no file {p}" for k in ("reference_path", "portfolio_path", "source_path") if (p := step.options.get(k)) and "://" not in p and not Path(p).exists()]
    return warnings


def describe(step: Step) -> str:
    shown = ", ".join(f"{k}={v}" for k, v in step.options.items() if v not in (None, "", [], {}, STEPS[step.kind].get(k)))
    return f"{step.kind}: {shown}" + ("" if step.enabled else " (off)")


def apply_step(spark: SparkSession, tables: dict[str, DataFrame], step: Step, context: Context | None = None, memory: Memory | None = None, learned: list[DataFrame] | None = None) -> dict[str, DataFrame]:
    """The tables after a step; nothing is computed yet but what code lookup asks for. learned gets tables of what a memory
    has to learn."""
    context = context or Context()
    if not step.enabled or step.kind == "export" or step.table not in tables:
        return tables
    df, o, out = tables[step.table], step.options, dict(tables)
    rest = {k: v for k, v in o.items() if k != "table"}
    put = lambda new: out | {step.table: new}
    ordinal = relational.ORDINAL
    if step.kind == "filter":
        new = filters.apply(df, [filters.Clause(**c) for c in o["clauses"]], combine=o["combine"])
        if o["sort"]:
            if o["sort"][0] not in df.columns:
                raise ValueError(f"no column {o['sort'][0]}; there are {', '.join(df.columns)}")
            new = relational.order(new, *o["sort"])
        return put(relational.select(new, [*o["columns"], ordinal]) if o["columns"] else new)
    if step.kind == "normalize":
        if o["column"] not in df.columns:
            return out
        known, types = (memory.table(spark), memory.type_table(spark)) if memory is not None else (None, None)
        return put(match.normalize_column(df, o["column"], ordinal, o["target"], o["threshold"], effective_separator(o["separator"], o["column"]), o["scorer"], o["emit_score"], o["review_threshold"], o["emit_type"], o["learn"], known, types, learned))
    if step.kind == "classify":
        return put(relational.classified(df, **rest))
    if step.kind == "compare":
        return put(relational.compare(df, **rest))
    if step.kind == "transfer_type":
        return put(relational.transfer_type(df, o["assignor_column"], o["assignee_column"], o["assignor_type"], o["assignee_type"], o["method"]))
    if step.kind == "kind_filter":
        return put(relational.kind_filter(df, **rest))
    if step.kind == "reference_match":
        if o["column"] not in df.columns or not ("://" in o["reference_path"] or Path(o["reference_path"]).exists()):
            return out
        action = {"keep_matched": "keep", "drop_matched": "drop"}.get(o["action"], "flag")
        new = match.reference_match(df, match.load_reference(spark, o["reference_path"], o["name_column"], o["id_column"], o["delimiter"]), o["column"], o["threshold"], o["scorer"], effective_separator(o["separator"], o["column"]), o["mode"], action, o["emit_score"], o["review_threshold"])
        usual = [f"{o['column']}_{n}" for n in ("disambiguated", "matched", "assignee_id")]
        return put(new.withColumnsRenamed(dict(zip(usual, reference_targets(step), strict=True))) if action == "flag" else new)
    if step.kind == "dedupe":
        return put(relational.dedupe(df, o["subset"] or [c for c in df.columns if c != ordinal], [ordinal]))
    if step.kind == "select":
        return put(relational.select(df, [*o["columns"], ordinal]) if any(c in df.columns for c in o["columns"]) else df)
    if step.kind == "sort":
        return put(relational.order(df, o["column"], o["ascending"], ordinal))
    if step.kind == "derive":
        return put(relational.derived(df, o["source"], o["op"], o["target"]))
    if step.kind == "aggregate":
        new = relational.aggregate(df, o["group_by"], o["count_distinct"])
        return out | {out_table(step): new} if new is not df else out
    if step.kind in ("attach_cpc_file", "fetch_cpc"):
        if o["column"] not in df.columns:
            return out
        ids = df.select(codes.grant_ids(df, o["column"], o["kind_column"]).alias("patent_id")).filter("patent_id <> ''")
        if step.kind == "fetch_cpc":
            return put(codes.attach(df, context.resolve(spark, ids), o["column"], o["kind_column"]))
        if not ("://" in o["source_path"] or Path(o["source_path"]).exists()):
            return out
        found = codes.lookup(ids, files.read_codes(spark, o["source_path"], o["patent_column"], o["code_column"]), o["separator"])
        return put(codes.attach(df, found, o["column"], o["kind_column"]))
    if "cpc_codes" not in df.columns:
        raise ValueError("cpc_match needs cpc_codes; attach codes first")
    rules = context.config.match.rules()
    codes.assert_hit_rate(codes.code_rate(df, o["number_column"], o["kind_column"]), rules.floor)
    listed = files.read_portfolio(spark, o["portfolio_path"], o["portfolio_mode"])
    if o["portfolio_mode"] == "patent_list":
        wanted = listed.select(normalize_grant(F.col("patent")).alias("patent_id")).filter("patent_id <> ''").distinct()
        found = context.resolve(spark, wanted)
        codes.assert_hit_rate(codes.hit_rate(found.withColumnRenamed("status", "cpc_lookup_status")), rules.floor)
        portfolio = found.select(F.col("patent_id").alias("portfolio_patent"), F.explode(reduce_codes(F.col("cpc_codes"), rules.grain)).alias("code"))
    else:
        portfolio = codes.footprint(listed, rules.grain)
    patents = codes.buyer_patents(df, o["buyer_column"], rules.grain, o["number_column"], o["kind_column"], o["date_column"], ordinal)
    made = codes.match_portfolio(portfolio, patents, rules)
    return out | {o["out_table"]: made["per"], o["overall_table"]: made["overall"]} | ({o["class_match_table"]: made["class"]} if o["emit_class_matches"] else {})


def compile_template(spark: SparkSession, template: Template, tables: dict[str, DataFrame], context: Context | None = None, memory: Memory | None = None) -> dict[str, DataFrame]:
    """Lazy tables after all steps but exports. Rows carry an ordinal of the input's order; exports leave it out."""
    ready = {t: df if relational.ORDINAL in df.columns else df.withColumn(relational.ORDINAL, F.monotonically_increasing_id()) for t, df in tables.items()}
    for step in unique_targets(template.steps):
        ready = apply_step(spark, ready, step, context, memory)
    return ready
