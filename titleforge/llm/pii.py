"""Operator 2: personal data, also where it is disguised, with spans that hold in the source text.

Base detection runs on the text as it is. Deobfuscation composes three transducers: (1) letters that look like others
(homoglyphs, full-width forms) become plain ones and invisible letters vanish, (2) runs of spelled digits become digits, (3)
bracketed or spaced "at" and "dot" become signs. Each transducer keeps for every output letter the source span it stands for,
so identifiers found in the normalised text map back to source code points.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import modest_batches, parts

KINDS = ("email", "ip", "card", "phone")
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, letter in enumerate(reversed(digits)):
        value = int(letter) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def find(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; those that fail their check are dropped without another try.

    E-mail addresses are found from their @ backwards and forwards, which gives the leftmost matches in linear time.
    """
    spans = []
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL_SIGNS:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            spans.append(Span("email", begin, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
            spans.append(Span("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append(Span("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                spans.append(Span("phone", *m.span()))
    return spans


# Letters that are drawn like plain ones (Cyrillic, Greek), and letters without any form.
_LOOKALIKES = dict(
    zip(
        "аеорсухіјѕԁАВЕКМНОРСТХΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν",
        "aeopcyxijsdABEKMHOPCTXABEZHIKMNOPTYXoav",
        strict=True,
    )
)
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Full-width forms U+FF01 to U+FF5E stand 0xFEE0 above the plain ones; digits of five scripts and mathematical digits follow by rule.
_PLAIN: dict[int, str | None] = {ord(k): v for k, v in _LOOKALIKES.items()} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_PLAIN |= {zero + d: str(d) for zero in (0x0660, 0x06F0, 0x0966, 0x09E6, 0x0E50) for d in range(10)} | {0x1D7CE + i: str(i % 10) for i in range(50)}
_PLAIN |= {0x3002: ".", 0x2024: ".", 0xFE52: ".", 0xFE6B: "@", 0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0xA0: " "}
_PLAIN |= {ord(c): "" for c in _INVISIBLE}
_ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in _PLAIN) + "]")

_DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_DIGIT_WORD = "(?:" + "|".join(_DIGIT_WORDS) + ")"
_SIGN_WORD = "(?:dot|point|plus|dash)"
_SPELLED = re.compile(rf"(?<![^\W_])(?:plus[\s,-]+)?{_DIGIT_WORD}(?:[\s,-]+(?:{_SIGN_WORD}[\s,-]+)?{_DIGIT_WORD}){{3,}}(?![^\W_])", re.IGNORECASE)
_SIGNS = {"dot": ".", "point": ".", "plus": "+", "dash": "-"}
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
# Runs of blanks are possessive and start right after a letter, a digit or a bracket, so that each blank is read a bounded
# number of times; blanks before a bracket are added by _bracketed.
_BRACKETED = re.compile(rf"{_OPEN}\s*+(at|@|dot|\.)\s*+{_CLOSE}\s*+", re.IGNORECASE)
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])\s++(?:at|@)\s++(?=[A-Za-z0-9-]++(?:(?:\s++dot\s++|\.)(?![A-Za-z]{2})[A-Za-z0-9-]++)*+(?:\s++dot\s++|\.)[A-Za-z]{2})", re.IGNORECASE)
_SPACED_DOT = re.compile(r"(?<=[A-Za-z0-9])\s++dot\s++(?=[A-Za-z]{2,})", re.IGNORECASE)
_LOCAL_DOT = re.compile(r"(?<=[A-Za-z0-9])\s++dot\s++(?=[A-Za-z0-9])", re.IGNORECASE)
_HINT = re.compile(rf"{_OPEN}\s*+(?:at|dot|@|\.)\s*+{_CLOSE}|\sdot\s|\s(?:at|@)\s++[a-z0-9-]++\.[a-z0-9]", re.IGNORECASE)


class Tape:
    """A text with, for each of its letters, the source span that it stands for; runs that map one to one stay implicit."""

    def __init__(self, text: str, marks: list[tuple[int, int, int]] | None = None) -> None:
        self.text = text
        #: (first letter of a run, its source start, source letters of each output letter; 1: one to one, else the whole run).
        self.marks = marks or [(0, 0, 1)]
        self.firsts = [m[0] for m in self.marks]

    def source(self, at: int, end: bool) -> int:
        """Source position of a letter's start, or of its end."""
        first, start, width = self.marks[bisect.bisect_right(self.firsts, at) - 1]
        if width == 1:
            return start + at - first + end
        return start + (width if end else 0)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """The tape after replacing [start, end) by a text, for each edit in order: composition with one more transducer."""
        if not edits:
            return self
        out: list[str] = []
        marks: list[tuple[int, int, int]] = []
        length = at = 0

        def copy(begin: int, end: int) -> None:
            nonlocal length
            if begin >= end:
                return
            i = bisect.bisect_right(self.firsts, begin) - 1
            while i < len(self.marks) and self.firsts[i] < end:
                first, start, width = self.marks[i]
                low = max(first, begin)
                marks.append((length + low - begin, start + (low - first if width == 1 else 0), width))
                i += 1
            out.append(self.text[begin:end])
            length += end - begin

        for begin, end, put in edits:
            copy(at, begin)
            if put:
                start = self.source(begin, False)
                marks.append((length, start, max(self.source(end - 1, True) - start, 1) if end > begin else 1))
                if marks[-1][2] == 1 and len(put) > 1:
                    marks[-1] = (length, start, 2)
                out.append(put)
                length += len(put)
            at = end
        copy(at, len(self.text))
        return Tape("".join(out), marks or [(0, 0, 1)])


def _unspell(words: str) -> str:
    out = []
    for word in re.findall(r"[A-Za-z]+", words):
        low = word.lower()
        out.append(_DIGIT_WORDS.get(low) or _SIGNS.get(low, ""))
    return "".join(out)


def _bracketed(text: str) -> list[tuple[int, int, str]]:
    """Edits for signs in brackets, with the blanks on either side."""
    edits: list[tuple[int, int, str]] = []
    for m in _BRACKETED.finditer(text):
        begin, free = m.start(), edits[-1][1] if edits else 0
        while begin > free and text[begin - 1].isspace():
            begin -= 1
        edits.append((begin, m.end(), "@" if m[1].lower() in ("at", "@") else "."))
    return edits


def deobfuscate(text: str) -> Tape | None:
    """The normalised tape; None if the text has nothing that any of the transducers rewrites."""
    odd = not text.isascii() and _ODD.search(text)
    hint = _HINT.search(text)
    spelled = _SPELLED.search(text)
    if not (odd or hint or spelled):
        return None
    tape = Tape(text)
    if odd:
        tape = tape.rewrite([(m.start(), m.end(), _PLAIN[ord(m[0])]) for m in _ODD.finditer(tape.text)])
    if spelled or odd:
        tape = tape.rewrite([(m.start(), m.end(), _unspell(m[0])) for m in _SPELLED.finditer(tape.text)])
    if hint or odd:
        tape = tape.rewrite(_bracketed(tape.text))
        tape = tape.rewrite([(m.start(), m.end(), "@") for m in _SPACED_AT.finditer(tape.text)])
        signs = [m.end() for m in re.finditer(r"@[A-Za-z0-9.-]+", tape.text)]
        edits = []
        for m in _SPACED_DOT.finditer(tape.text):  # only where it goes on a domain
            if signs and (i := bisect.bisect_left(signs, m.start())) < len(signs) and signs[i] == m.start():
                edits.append((m.start(), m.end(), "."))
                tail = re.compile(r"[A-Za-z0-9-]+").match(tape.text, m.end())
                if tail:
                    bisect.insort(signs, tail.end())
        dots = {m.end(): m.start() for m in _LOCAL_DOT.finditer(tape.text)}
        for m in re.finditer("@", tape.text) if dots else ():  # within what precedes a sign that stands for a disguised one
            begin = m.start()
            if text[tape.source(begin, False) : tape.source(begin, True)] == "@":
                continue
            while True:
                while begin and tape.text[begin - 1] in _LOCAL_SIGNS:
                    begin -= 1
                if begin not in dots:
                    break
                edits.append((dots[begin], begin, "."))
                begin = dots[begin]
        tape = tape.rewrite(sorted(set(edits)))
    return tape if tape.text != text else None


def spans_of(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), both by kind as listed, then start. A disguised find is added where it rests on letters that a
    transducer rewrote, also beside a base span that is a fragment of it."""
    base = find(text)
    tape = deobfuscate(text)
    if tape is None:
        return base, base
    added = []
    for span in find(tape.text):
        begin, end = tape.source(span.start, False), tape.source(span.end - 1, True)
        if text[begin:end] != tape.text[span.start : span.end]:
            added.append(Span(span.kind, begin, end))
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted({*base, *added}, key=lambda s: (order[s.kind], s.start, s.end))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find_documents(docs: DataFrame) -> DataFrame:
    """Returns for each row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans), n_added (disguised ones),
    base_sha256 and spans: kind:start:end by kind as in KINDS, then start; code points, ends exclusive.

    Null or empty text: zeros, the hash of nothing, and no spans. Whole texts of any length, in linear time. Repeated rows
    give repeated results; other columns are ignored.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(source):
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = spans_of(text or "")
                counts = [sum(s.kind == k for s in base) for k in KINDS]
                rows.append((*counts, len(spans) - len(base), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            types = [pa.int64()] * 5 + [pa.string()] * 2
            columns = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"
    return modest_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, schema)


def redacted(text: str) -> str:
    """The text with each found span replaced by <KIND>; where spans overlap, the first and longest names what they cover."""
    spans = sorted(spans_of(text)[1], key=lambda s: (s.start, -s.end))
    out, at = [], 0
    for kind, start, end in spans:
        if start < at:
            at = max(at, end)
            continue
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced by its kind; all columns and rows stay. Null text stays null."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(source):
            at = batch.schema.get_field_index("text")
            texts = pa.array([None if t is None else redacted(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return modest_batches(docs).mapInArrow(batches, docs.schema)
