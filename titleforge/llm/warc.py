"""Operator 8: WARC archives with revisits, read back into one capture history that is ordered by URL key and time.

Writing: each task writes its records to an archive of its own in the shared folder. Reading: each archive gives one run of
captures, sorted by URL key and time, in files in the shared folder. Merging: tasks take ranges of the key, find their range in
each run by bisection, and merge the k runs with a loser tree, a batch of each in memory.
"""

from __future__ import annotations

import datetime
import gzip
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, materialize

#: Payloads shorter than this are never revisits.
LEAST = 100
#: Captures in a run that is sorted in memory, in a batch of a run's file, and runs that are merged at once.
RUN, BATCH, FAN = 50_000, 4096, 128
#: Batches in a sample for each range that is cut by it.
SAMPLED = 50
_EPOCH = datetime.datetime(2000, 1, 1)
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NO_ID = 1 << 65


class LoserTree:
    """Merges k sorted iterators: inner nodes hold the losers of their matches, so that each row costs log k comparisons."""

    def __init__(self, runs: list[Iterable[Any]]) -> None:
        self.sources = [iter(r) for r in runs]
        self.heads = [next(s, None) for s in self.sources]
        self.size = len(self.sources)
        self.losers = [-1] * max(1, self.size)
        self.winner = self._build(1) if self.size else -1

    def _less(self, a: int, b: int) -> bool:
        if a < 0 or self.heads[a] is None:
            return False
        if b < 0 or self.heads[b] is None:
            return True
        return (self.heads[a], a) < (self.heads[b], b)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        left, right = self._build(2 * node), self._build(2 * node + 1)
        if self._less(right, left):
            left, right = right, left
        self.losers[node] = right
        return left

    def __iter__(self) -> Iterator[Any]:
        while self.winner >= 0 and self.heads[self.winner] is not None:
            run = self.winner
            yield self.heads[run]
            self.heads[run] = next(self.sources[run], None)
            node = (run + self.size) // 2
            while node:
                if self._less(self.losers[node], run):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.winner = run


def url_key(url: str | None) -> str:
    """Host labels in reverse, then path and query in lower case: com,example,www)/a?b. Empty for null; a URL that can't be taken
    apart is its own key."""
    if not url:
        return ""
    plain = re.sub(r"[\[\]]", "", url)
    try:
        parts = urllib.parse.urlsplit(plain)
    except ValueError:  # a host that normalises to signs which no host has: the whole is the key
        return _CONTROL.sub("", plain.lower())
    host = ",".join(reversed(re.sub(r"^www\d*\.", "", parts.netloc.rpartition("@")[2].lower()).split(".")))
    return f"{host}){parts.path.lower() or '/'}" + (f"?{parts.query.lower()}" if parts.query else "")


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=_NO_ID if page_id is None else page_id & (1 << 64) - 1)}>"


def _page(urn: str) -> int | None:
    value = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    return None if value == _NO_ID else value - (value >> 63 << 64)


def record(page_id: int | None, url: str | None, seconds: int, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit if refers_to is given: its block is the HTTP head with the full payload's length alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    when = (_EPOCH + datetime.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {when}"]
    if url:
        lines.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict[str, Any]:
    """A record's fields; the payload's digest is checked, and its length is that of the HTTP head."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)\r\ncontent-length: *([0-9]+)", http)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if fields["warc-type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload in {fields['warc-record-id']}")
    seconds = int((datetime.datetime.strptime(fields["warc-date"], "%Y-%m-%dT%H:%M:%SZ") - _EPOCH).total_seconds())
    return {"page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "seconds": seconds, "payload_bytes": length, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": _page(fields["warc-refers-to"]) if "warc-refers-to" in fields else None, "payload": payload}


def records(file: Any) -> Iterator[tuple[int, int, dict[str, Any]]]:
    """(offset, length, fields) of each record of an archive with a gzip member for each record."""
    offset, pending = 0, b""
    while True:
        unpacker, out, used = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            if not pending:
                pending = file.read(1 << 20)
                if not pending:
                    if used:
                        raise ValueError("the archive ends inside a record")
                    return
            used += len(pending)
            out.append(unpacker.decompress(pending))
            pending = unpacker.unused_data
            used -= len(pending)
        yield offset, used, parse(b"".join(out))
        offset += used


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame) -> DataFrame:
    """Writes the rows of pages to archives and returns archive and records of each: the manifest, itself a written table.

    Archives of tasks that were repeated are in no manifest and are never read. Of equal payloads of LEAST bytes or more, the
    row with the smallest page_id is the response; rows without a page_id are always responses, and so are rows that repeat
    that smallest id.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("long", F.octet_length("payload") >= LEAST)
    firsts = full.filter("long and page_id is not null").groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("key"), "first_id")
    firsts = materialize(firsts, "warc-firsts")  # so that the join below deals both sides anew and can split a hot digest
    # Short payloads may all be alike; they meet nothing, so they are dealt out by their id.
    key = F.when(F.col("long"), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    joined = full.withColumn("key", key).join(firsts, "key", "left")
    refers = F.when(F.col("page_id") > F.col("first_id"), F.col("first_id"))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        name = f"{path}/{uuid.uuid4().hex}.warc.gz"
        count = 0
        with system.open_output_stream(name, compression=None) as out:
            for batch in source:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    page_id, url, html, digest, refers_to = row
                    out.write(gzip.compress(record(page_id, url, abs(page_id or 0) % 1_000_000_000, html, digest, refers_to), 1, mtime=0))
                    count += 1
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([name.rpartition("/")[2]]), pa.array([count], pa.int64())], ["archive", "records"])
        else:
            system.delete_file(name)

    written = joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to")).mapInArrow(batches, "archive string, records long")
    return materialize(written.withColumn("folder", F.lit(folder)), "warc-manifest")


_RUN_FIELDS = ["url_key", "seconds", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "length"]
_RUN_SCHEMA = "url_key string, seconds long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
_RUN_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def _order(row: tuple) -> tuple:
    return (row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RUN_TYPES, strict=True)], _RUN_FIELDS)


class Run:
    """A file of captures in order, of which a batch at a time is in memory."""

    def __init__(self, folder: str, name: str) -> None:
        system, path = _open(folder)
        self.file = system.open_input_file(f"{path}/{name}")
        self.reader = pa.ipc.open_file(self.file)

    def _rows(self, at: int) -> list[tuple]:
        return list(zip(*(c.to_pylist() for c in self.reader.get_batch(at).columns), strict=True))

    def between(self, low: tuple | None, high: tuple | None) -> Iterator[tuple[tuple, tuple]]:
        """(order, row) from low on and before high; the first batch is found by bisection."""
        first, until = 0, self.reader.num_record_batches
        while low is not None and until - first > 1:
            middle = (first + until) // 2
            first, until = (middle, until) if _order(self._rows(middle)[0]) <= low else (first, middle)
        for at in range(first, self.reader.num_record_batches):
            for row in self._rows(at):
                order = _order(row)
                if high is not None and order >= high:
                    return
                if low is None or order >= low:
                    yield order, row

    def close(self) -> None:
        self.file.close()


def _write_run(folder: str, rows: Iterable[tuple]) -> tuple[str, int, list[tuple]]:
    """(name, number of rows, first row of each batch) of a new run file."""
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    name, count, heads, lot = f"{uuid.uuid4().hex}.arrow", 0, [], []
    with system.open_output_stream(f"{path}/{name}") as out, pa.ipc.new_file(out, pa.schema(list(zip(_RUN_FIELDS, _RUN_TYPES, strict=True)))) as writer:

        def put() -> None:
            nonlocal count, lot
            heads.append(lot[0])
            writer.write_batch(_table(lot))
            count += len(lot)
            lot = []

        for row in rows:
            lot.append(row)
            if len(lot) >= BATCH:
                put()
        if lot:
            put()
    return name, count, heads


def _merged(folder: str, names: list[str], low: tuple | None = None, high: tuple | None = None) -> Iterator[tuple]:
    """The captures of several runs in order, by a loser tree; a batch of each run is in memory."""
    runs = [Run(folder, n) for n in names]
    try:
        for _, row in LoserTree([r.between(low, high) for r in runs]):
            yield row
    finally:
        for run in runs:
            run.close()


_HEADS = "run string, records long, " + _RUN_SCHEMA


def _listed(found: tuple[str, int, list[tuple]]) -> pa.RecordBatch:
    """A row for each batch of a run: the run's name, its captures at the first one (else 0), and the batch's first capture."""
    name, count, heads = found
    table = _table(heads)
    return pa.RecordBatch.from_arrays([pa.array([name] * len(heads)), pa.array([count] + [0] * (len(heads) - 1), pa.int64()), *table.columns], ["run", "records", *_RUN_FIELDS])


def read_runs(manifest: DataFrame, folder: str) -> DataFrame:
    """Reads the archives of a manifest back, once, and writes runs of captures sorted by URL key and time to files in the
    folder. Returns a row for each batch of each run; runs of tasks that were repeated are in no row and are never read."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for archive, where in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = _open(where)
                run: list[tuple] = []
                with system.open_input_stream(f"{path}/{archive}", compression=None) as file:
                    for offset, length, x in records(file):
                        run.append((url_key(x["url"]), x["seconds"], x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"], archive, offset, length))
                        if len(run) >= RUN:
                            yield _listed(_write_run(folder, sorted(run, key=_order)))
                            run = []
                if run:
                    yield _listed(_write_run(folder, sorted(run, key=_order)))

    files = manifest.select("archive", "folder")
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(files.repartition(parts).mapInArrow(batches, _HEADS), "warc-runs")


def merge_runs(heads: DataFrame, folder: str, fan: int = FAN) -> DataFrame:
    """All captures in global order of URL key, time and page_id. While there are more than `fan` runs, groups of so many are
    merged to longer ones, a task for each group; then each task merges one range of what is left. Ranges are cut by a sample
    of the runs' batches, so a key that many captures share is cut as well. A task holds a batch of each of its runs."""
    spark = heads.sparkSession
    while (count := heads.filter("records > 0").count()) > fan:
        groups = -(-count // fan)
        named = heads.filter("records > 0").select("run", F.pmod(F.xxhash64("run"), F.lit(groups)).alias("group")).groupBy("group").agg(F.collect_list("run").alias("runs"))
        heads = materialize(named.select("runs").repartition(groups).mapInArrow(_longer(folder, fan), _HEADS), "warc-runs")

    names = sorted(r[0] for r in heads.filter("records > 0").select("run").collect())  # `fan` at most
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = min(1.0, SAMPLED * parts / max(1, heads.count()))
    dealt = F.pmod(F.xxhash64("run", "archive", "offset"), F.lit(1 << 20)) < int(share * (1 << 20))
    cuts = sorted(_order(tuple(r)) for r in heads.filter(dealt).select(*_RUN_FIELDS).limit(2 * SAMPLED * parts).collect())
    cuts = sorted({cuts[len(cuts) * i // parts] for i in range(1, parts)} if cuts else ())
    edges = [None, *cuts, None]

    def ranges(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for nth in batch.column(0).to_pylist():
                out: list[tuple] = []
                for row in _merged(folder, names, edges[nth], edges[nth + 1]):
                    out.append(row)
                    if len(out) >= BATCH:
                        yield _table(out)
                        out = []
                if out:
                    yield _table(out)

    return spark.range(0, len(edges) - 1, 1, len(edges) - 1).mapInArrow(ranges, _RUN_SCHEMA)


def _longer(folder: str, fan: int):
    """Merges the runs of each row (a list of names) to one, at most `fan` at once, and lists it."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for names in batch.column(0).to_pylist():
                names = sorted(names)
                while True:
                    found = _write_run(folder, _merged(folder, names[:fan]))
                    names = [*names[fan:], found[0]]
                    if len(names) == 1:
                        break
                yield _listed(found)

    return batches


def capture_history(pages: DataFrame) -> DataFrame:
    """Writes pages to archives, reads them back and merges their runs. Returns a row for each row of pages, in order of URL
    key and time: page_id, payload_bytes, payload_digest (both of the full payload), record_type, refers_to, url_key, seconds
    (since 2000), archive, offset, length.

    Pages have no time of capture, so seconds stands in for it: page_id without its sign, modulo 10**9. Null or empty html: an
    empty payload, always a response. Null url: the empty key. Null page_id: a response without an id; further rows with the
    smallest page_id of a payload are responses too, as a record can't refer to its own id. Very long pages are one record
    like others; of large groups of equal pages only ids meet. Other columns are ignored.
    """
    folder = fresh_path(pages.sparkSession, "warc-files")
    merged = merge_runs(read_runs(write_archives(pages), folder), folder)
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "seconds", "archive", "offset", "length")


#: The contract's columns in SQL for DuckDB, over the table pages.
ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST} AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST} AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""
