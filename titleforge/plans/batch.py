"""Runs of a template over many inputs: a folder for each run with outputs, counts of every step, and a record of it all."""

from __future__ import annotations

import csv
import json
import os
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_name
from ..model import COLUMNS
from ..operators import relational
from ..operators.graph import checkpointed
from ..operators.memory import Memory
from ..sources import files, sinks
from .config import Context
from .template import Step, Template, apply_step, describe, encode, needed_tables, unique_targets, validate

#: Share of a table's rows from which on a step that drops them is noted.
LARGE_DROP = 0.99
INDEX = ("timestamp", "template", "inputs", "succeeded", "failed", "cancelled", "run_dir")
CONVERTED = ("timestamp", "source", "status", "outputs", "rows", "error")
#: (level, message); level is info, warning or error.
Events = Callable[[str, str], None]


@dataclass
class StepStat:
    """What a step did to its table."""

    index: int
    label: str
    table: str
    rows_before: int = 0
    rows_after: int = 0
    columns_added: list[str] = field(default_factory=list)
    note: str = ""


@dataclass
class FileResult:
    source: str
    ok: bool = False
    error: str | None = None
    elapsed: float = 0.0
    outputs: list[str] = field(default_factory=list)
    rows: dict[str, int] = field(default_factory=dict)
    steps: list[StepStat] = field(default_factory=list)
    step_outputs: list[str] = field(default_factory=list)
    learned: list[tuple[str, str, int]] = field(default_factory=list)


def emptied(index: int, kind: str, table: str, before: int, after: int, events: Events) -> str:
    """The note on a step that leaves nothing, or next to nothing, of a table; "" otherwise."""
    if not before or after > before * (1 - LARGE_DROP):
        return ""
    if after == 0:
        events("error", f"step {index} ({kind}) left {table} without rows; look at its clauses, paths and columns")
        return "dropped all rows"
    note = f"dropped {before - after} of {before} rows"
    events("info", f"step {index} ({kind}) {note} of {table}")
    return note


def project(df: DataFrame, step: Step, name: str) -> DataFrame:
    """A table as an export writes it: chosen columns in their order (all, if none of them exists), renamed."""
    df = df.drop(relational.ORDINAL)
    chosen = (step.columns or {}).get(name)
    return relational.rename(relational.select(df, chosen) if chosen else df, (step.renames or {}).get(name, {}))


def exported(tables: dict[str, DataFrame], step: Step, folder: Path, events: Events, prefix: str = "", existing: str = "overwrite") -> list[str]:
    """An export step. With a prefix files are named by their input: <prefix>.<fmt> for one table, else <prefix>_<table>.<fmt>;
    existing says what happens to those that are there: overwrite, skip or unique. Without a prefix none is ever overwritten."""
    names = step.tables if step.tables is not None else [t for t in COLUMNS if t in tables] + [t for t in tables if t not in COLUMNS]
    there = [n for n in names if n in tables]
    for name in names:
        if name not in tables:
            events("warning", f"export: no table {name}")
    written = []
    for name in there:
        chosen = (step.columns or {}).get(name)
        if chosen and not set(chosen) & set(tables[name].columns):
            events("warning", f"export: none of the columns of {name} exists; all are written")
        path = folder / f"{name}.{step.fmt}"
        if prefix:
            path = folder / (f"{prefix}.{step.fmt}" if len(there) == 1 else f"{prefix}_{name}.{step.fmt}")
            if existing == "skip" and path.exists():
                events("info", f"export: {path.name} is there")
                continue
        if not prefix or existing == "unique":
            path = sinks.unique_path(path)
        for warning in sinks.export(project(tables[name], step, name), str(path), step.fmt, name):
            events("warning", warning)
        written.append(str(path))
    return written


def process(spark: SparkSession, template: Template, source: str, folder: Path, context: Context, memory: Memory | None, events: Events, trace: str = "", prefix: str = "", existing: str = "overwrite") -> FileResult:
    """One input. Tables are written to the checkpoint folder after each step, so that counting them doesn't work them out again."""
    result, began = FileResult(source), time.monotonic()
    try:
        wanted = needed_tables(template) if template.load.tables is None else set(template.load.tables)
        loaded = files.load(spark, source, sorted(wanted) if wanted else None, template.load.limit, template.load.columns)
        tables = {t: checkpointed(df.withColumn(relational.ORDINAL, F.monotonically_increasing_id())) for t, df in loaded.items()}
        counts = {t: df.count() for t, df in tables.items()}
        learned: list[DataFrame] = []
        own = Memory.from_dict(memory.to_dict()) if memory is not None else Memory()
        for index, step in enumerate(unique_targets(template.steps), 1):
            name = step.options.get("table", "")
            stat = StepStat(index, describe(step), name, counts.get(name, 0))
            result.steps.append(stat)
            if not step.enabled:
                stat.note, stat.rows_before = "disabled", 0
                continue
            if step.kind == "export":
                folder.mkdir(parents=True, exist_ok=True)
                result.outputs += exported(tables, step, folder, events, prefix, existing)
                continue
            before = tables
            tables = dict(apply_step(spark, tables, step, context, own, learned))
            touched = [t for t in tables if tables[t] is not before.get(t)]
            for table in touched:
                tables[table] = checkpointed(tables[table])
                counts[table] = tables[table].count()
            for found in learned:
                rows = [tuple(r) for r in found.collect()]  # a memory is a list on the driver
                own.learn(rows)
                result.learned += rows
            learned.clear()
            if name in tables:
                stat.rows_after = counts[name]
                stat.columns_added = sorted(set(tables[name].columns) - set(before[name].columns if name in before else []))
                stat.note = emptied(index, step.kind, name, stat.rows_before, stat.rows_after, events)
            for table in touched if trace else ():
                path = folder / "steps" / f"{index:02d}_{safe_name(table)}.{trace}"
                sinks.export(tables[table].drop(relational.ORDINAL), str(path), trace, table)
                result.step_outputs.append(str(path))
        result.rows, result.ok = counts, True
    except Exception as e:  # one input's failure leaves the others alone; it is in the record
        result.error = f"{type(e).__name__}: {e}"
        events("error", f"{source}: {result.error}")
    result.elapsed = time.monotonic() - began
    return result


def prefixes(inputs: list[str], folders: list[Path]) -> list[str]:
    """A name for each input's files, distinct within a folder."""
    taken: set[tuple[Path, str]] = set()
    out = []
    for path, folder in zip(inputs, folders, strict=True):
        name, n = Path(path).stem, 1
        while (folder, name) in taken:
            name, n = f"{Path(path).stem} ({n})", n + 1
        taken.add((folder, name))
        out.append(name)
    return out


def mirrored(inputs: list[str], root: Path) -> list[Path]:
    """Folders below root as the inputs' folders lie below what they have in common."""
    parents = [Path(p).absolute().parent for p in inputs]
    base = os.path.commonpath(parents) if parents else ""
    return [root / p.relative_to(base) for p in parents]


def _append(path: Path, header: tuple[str, ...], rows: list[tuple]) -> None:
    fresh = not path.exists()
    with path.open("a", newline="", encoding="utf-8") as out:
        csv.writer(out).writerows([header, *rows] if fresh else rows)


def run(spark: SparkSession, template: Template, inputs: list[str], folder: str, strict: bool = False, should_stop: Callable[[], bool] | None = None, workers: int = 1, context: Context | None = None, memory: Memory | None = None, events: Events | None = None, trace: str = "", convert: bool = False, existing: str = "overwrite", mirror: bool = False, timestamp: str = "") -> dict[str, Any]:
    """Each input by itself, several at once with workers. Returns the manifest.

    A run has a folder of its own below `folder`, with a folder for each input, manifest.json, run.log and summary.xlsx; and a
    line in runs_index.csv. With convert, files go to `folder` itself, named by their inputs (mirror: in folders like theirs),
    and _convert_index.csv gets a line for each. With strict, warnings stop the run before it begins. What normalize steps learn
    goes into memory at the end, in the order of the inputs. A run that should stop leaves out the inputs that haven't begun.
    """
    if existing not in ("overwrite", "skip", "unique"):
        raise ValueError(f"unknown policy {existing!r} for existing files")
    messages: list[tuple[str, str]] = []

    def note(level: str, message: str) -> None:
        messages.append((level, message))
        if events:
            events(level, message)

    warnings = validate(template, files.inputs_columns(spark, inputs))
    if strict and warnings:
        raise ValueError("; ".join(warnings))
    context, began = context or Context(), time.monotonic()
    timestamp = timestamp or datetime.now(timezone.utc).strftime("%Y%m%d-%H%M%S")
    root = Path(folder)
    home = root if convert else sinks.unique_path(root / f"{safe_name(template.name)}_{timestamp}")
    home.mkdir(parents=True, exist_ok=True)
    if convert:
        targets = mirrored(inputs, home) if mirror else [home] * len(inputs)
        names = prefixes(inputs, targets)
    else:
        targets, names = [home / n for n in prefixes(inputs, [home] * len(inputs))], [""] * len(inputs)

    def one(job: tuple[str, Path, str]) -> FileResult | None:
        if should_stop and should_stop():
            return None
        return process(spark, template, job[0], job[1], context, memory, note, trace, job[2], existing)

    jobs = list(zip(inputs, targets, names, strict=True))
    if workers > 1:
        with ThreadPoolExecutor(workers) as pool:
            done = list(pool.map(one, jobs))
    else:
        done = [one(job) for job in jobs]
    results = [r for r in done if r is not None]
    if memory is not None:
        for result in results:
            memory.learn(result.learned)
    succeeded = sum(r.ok for r in results)
    record = {
        "schema": 1,
        "template": encode(template),
        "timestamp": timestamp,
        "duration_seconds": round(time.monotonic() - began, 1),
        "workers": workers,
        "cancelled": len(results) < len(inputs),
        "strict": strict,
        "warnings": warnings,
        "events": [{"level": level, "message": message} for level, message in messages],
        "summary": {"succeeded": succeeded, "failed": len(results) - succeeded},
        "run_dir": str(home),
        "inputs": [{"input": r.source, "files": r.outputs, "error": r.error} for r in results],
        "results": [{k: v for k, v in asdict(r).items() if k != "learned"} for r in results],
    }
    if convert:
        shown = lambda r: (timestamp, r.source, "ok" if r.ok else "failed", "; ".join(Path(p).name for p in r.outputs), "; ".join(f"{t}={n}" for t, n in r.rows.items()), r.error or "")
        _append(home / "_convert_index.csv", CONVERTED, [shown(r) for r in results])
        return record
    sinks.write_manifest(str(home / "manifest.json"), record)
    (home / "run.log").write_text("\n".join([f"{template.name}, {timestamp}", *(f"{level}: {message}" for level, message in messages), *(f"{r.source}: {'ok' if r.ok else r.error}, {r.elapsed:.1f} s, {json.dumps(r.rows)}" for r in results)]) + "\n", encoding="utf-8")
    summarize(spark, home / "summary.xlsx", record, results)
    _append(root / "runs_index.csv", INDEX, [(timestamp, template.name, len(inputs), succeeded, len(results) - succeeded, str(record["cancelled"]).lower(), home.name)])
    return record


def summarize(spark: SparkSession, path: Path, record: dict[str, Any], results: list[FileResult]) -> None:
    """A workbook with the run, its steps and its outputs."""
    keys = ("timestamp", "duration_seconds", "workers", "cancelled", "strict", "run_dir")
    whole = [("template", record["template"]["name"]), *((k, str(record[k])) for k in keys), *((f"warning {i}", w) for i, w in enumerate(record["warnings"], 1))]
    steps = [(Path(r.source).name, s.index, s.label, s.rows_before, s.rows_after, s.rows_after - s.rows_before, s.note) for r in results for s in r.steps]
    outputs = [(Path(r.source).name, p, Path(p).stem, r.rows.get(Path(p).stem), Path(p).suffix.lstrip(".")) for r in results for p in r.outputs]
    sinks.write_workbook(path, {
        "run": spark.createDataFrame(whole, "key string, value string"),
        "steps": spark.createDataFrame(steps, "file string, step int, description string, rows_before long, rows_after long, delta long, note string"),
        "outputs": spark.createDataFrame(outputs, "file string, path string, table string, rows long, format string"),
    })


def preview(spark: SparkSession, template: Template, path: str, rows: int = 1000, context: Context | None = None) -> tuple[dict[str, DataFrame], list[StepStat]]:
    """(tables, counts of each step) from the first records alone, without exports and with an empty memory."""
    limit = min(rows, template.load.limit) if template.load.limit > 0 else rows
    tables = {t: checkpointed(df.withColumn(relational.ORDINAL, F.monotonically_increasing_id())) for t, df in files.load(spark, path, template.load.tables, limit, template.load.columns).items()}
    stats = []
    for index, step in enumerate(unique_targets(template.steps), 1):
        name = step.options.get("table", "")
        if step.kind == "export" or not step.enabled:
            continue
        before = tables
        tables = {t: df if df is before.get(t) else checkpointed(df) for t, df in apply_step(spark, tables, step, context, Memory()).items()}
        if name in tables:
            stats.append(StepStat(index, describe(step), name, before[name].count() if name in before else 0, tables[name].count(), sorted(set(tables[name].columns) - set(before[name].columns if name in before else []))))
    return {t: df.drop(relational.ORDINAL) for t, df in tables.items()}, stats


def summary(folder: str) -> str:
    """Markdown on all templates of a folder: their steps and warnings."""
    from .template import load_templates

    lines = ["# Templates", ""]
    for path in sorted(Path(folder).glob("*.json")):
        try:
            found = load_templates(path.read_text(encoding="utf-8"))
        except (OSError, ValueError) as e:
            lines += [f"## {path.name}", "", f"can't be read: {e}", ""]
            continue
        lines += [f"## {path.name}", ""]
        for template in found:
            lines += [f"### {template.name}", "", *(f"{i}. {describe(s)}" for i, s in enumerate(template.steps, 1)), ""]
            warnings = validate(template)
            lines += ["Warnings:" if warnings else "Warnings: none", *(f"- {w}" for w in warnings), ""]
    return "\n".join(lines).rstrip() + "\n"
