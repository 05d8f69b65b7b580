"""Records of nested XML: a splittable scan, a tolerant parse in Arrow batches, and the tables made from them by explode."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import PARTS
from ..model import COLUMNS, RECORD

TAG = "patent-assignment"
_START = re.compile(rf"<{TAG}[\s>]")
_REFERENCE = re.compile(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)(\w+;)?")
_FORBIDDEN = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def _clean(text: str | None) -> str | None:
    text = (text or "").strip()
    return text or None


def _first(node: ET.Element, *paths: str) -> str | None:
    for path in paths:
        if (found := node.find(path)) is not None and (text := _clean("".join(found.itertext()))):
            return text
    return None


def _date(node: ET.Element, name: str) -> str | None:
    return _first(node, f"{name}/date") or _first(node, name)


def mended(xml: str) -> str:
    """Text that a strict parser takes where only references are unknown, signs aren't escaped or letters are forbidden."""

    def known(m: re.Match) -> str:
        name = m[1]
        if not name:
            return "&amp;"
        letters = html.unescape(f"&{name}")
        return escape(letters) if not letters.startswith("&") else ""

    return _FORBIDDEN.sub("", _REFERENCE.sub(known, xml))


def extract(xml: str) -> dict | None:
    """A record's fields; None for text that isn't well-formed, so that one bad record harms no other."""
    try:
        node = ET.fromstring(xml)
    except ET.ParseError:
        try:
            node = ET.fromstring(mended(xml))
        except ET.ParseError:
            return None
    head = node.find("assignment-record")
    head = node if head is None else head
    sender = head.find("correspondent")
    row = {
        "reel_no": _first(head, "reel-no"), "frame_no": _first(head, "frame-no"), "last_update_date": _date(head, "last-update-date"), "recorded_date": _date(head, "recorded-date"),
        "purge_indicator": _first(head, "purge-indicator"), "page_count": _first(head, "page-count"), "conveyance_text": _first(head, "conveyance-text"),
        "correspondent_name": None if sender is None else _first(sender, "name"),
    }
    row |= {f"correspondent_address_{i}": None if sender is None else _first(sender, f"address-{i}") for i in range(1, 5)}
    row["assignors"] = [{"name": _first(x, "name"), "execution_date": _date(x, "execution-date"), "date_acknowledged": _date(x, "date-acknowledged")} for x in node.iterfind("patent-assignors/patent-assignor")]
    row["assignees"] = [{"name": _first(x, "name"), "address_1": _first(x, "address-1"), "address_2": _first(x, "address-2"), "city": _first(x, "city"), "state": _first(x, "state"), "country_name": _first(x, "country-name", "country"), "postcode": _first(x, "postcode")} for x in node.iterfind("patent-assignees/patent-assignee")]
    row["properties"] = []
    for prop in node.iterfind("patent-properties/patent-property"):
        title = _first(prop, "invention-title")
        ids = prop.findall("document-id")
        if not ids:
            row["properties"].append({"invention_title": title} | dict.fromkeys(COLUMNS["properties"][3:]))
        for x in ids:
            row["properties"].append({"invention_title": title, "doc_country": _first(x, "country"), "doc_number": _first(x, "doc-number"), "doc_kind": _first(x, "kind"), "doc_name": _first(x, "name"), "doc_date": _date(x, "date")})
    return row


def _parse(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(RECORD)
    for batch in source:
        rows = []
        for ordinal, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            start = _START.search(chunk)
            row = extract(f"{chunk[start.start() :]}</{TAG}>") if start else None
            if row:
                rows.append({"ordinal": ordinal} | row)
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_records(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """One row for each well-formed record, with its ordinal in file order. The scan splits large files at record ends. limit
    takes the first records; 0 or less takes all."""
    chunks = spark.read.option("lineSep", f"</{TAG}>").text(path)
    rows = chunks.select(F.monotonically_increasing_id().alias("ordinal"), F.col("value")).mapInArrow(_parse, RECORD)
    return rows.orderBy("ordinal").limit(limit) if limit > 0 else rows


def lost_records(spark: SparkSession, path: str) -> int:
    """How many records of a file can't be parsed even when mended, and are left out."""
    chunks = spark.read.option("lineSep", f"</{TAG}>").text(path).filter(F.col("value").rlike(_START.pattern))
    return chunks.count() - read_records(spark, path).count()


def unzip(path: str, folder: str) -> str:
    """The first .xml member of an archive, unpacked into a folder that the cluster can read."""
    with zipfile.ZipFile(path) as archive:
        member = next((n for n in archive.namelist() if n.lower().endswith(".xml")), None)
        if member is None:
            raise ValueError(f"no .xml member in {path}")
        out = Path(folder) / Path(member).name
        with archive.open(member) as source, out.open("wb") as target:
            while block := source.read(1 << 20):
                target.write(block)
    return str(out)


def child_table(records: DataFrame, table: str) -> DataFrame:
    if table == "assignments":
        return records.select(*COLUMNS["assignments"])
    return records.select("reel_no", "frame_no", F.explode(table).alias("x")).select("reel_no", "frame_no", "x.*")


def flat_table(records: DataFrame) -> DataFrame:
    """A row for each property and document of a record, with the record's header and rollups; no shuffle."""

    def names(side: str) -> F.Column:
        return F.nullif(F.array_join(F.filter(F.transform(side, lambda x: x["name"]), lambda n: F.length(n) > 0), PARTS), F.lit(""))

    def latest(field: str) -> F.Column:
        return F.array_max(F.filter(F.transform("assignors", lambda x: x[field]), lambda d: F.length(d) > 0))

    executed = latest("execution_date")
    rows = records.select(
        *COLUMNS["assignments"],
        names("assignors").alias("assignor_names"), names("assignees").alias("assignee_names"),
        F.size("assignors").cast("string").alias("assignor_count"), F.size("assignees").cast("string").alias("assignee_count"),
        executed.alias("execution_date"), latest("date_acknowledged").alias("date_acknowledged"),
        F.coalesce(executed, F.col("recorded_date")).alias("transaction_date"), F.when(executed.isNotNull(), "execution").when(F.col("recorded_date").isNotNull(), "recorded").alias("date_source"),
        F.explode_outer("properties").alias("p"),
    )
    return rows.select(*[c for c in rows.columns if c != "p"], *[F.col(f"p.{c}").alias(c) for c in COLUMNS["properties"][2:]])


def tables(records: DataFrame, wanted: list[str] | None = None) -> dict[str, DataFrame]:
    return {t: flat_table(records) if t == "flat" else child_table(records, t) for t in COLUMNS if wanted is None or t in wanted}
