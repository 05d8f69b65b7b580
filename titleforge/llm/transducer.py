"""Operator 9: SentencePiece encoding and decoding as shortest paths of a weighted finite-state transducer.

The transducer is compiled from the model file's own bytes: a normaliser (its rules, dummy prefix, white space to U+2581), an
arc for each piece, and arcs from each character that no piece has to its UTF-8 byte pieces. It is composed with each input
and its shortest path in the tropical semiring (min, +) is taken.

For a unigram model an arc weighs minus its piece's score. For a BPE model the weights stand on pairs of adjacent arcs: 0 if
merging the two pieces' characters by the model's merge order gives just these two pieces, infinite otherwise. A sequence
is the BPE encoding exactly if all its adjacent pairs are, so one path of finite weight is left and the result equals
repeated merging.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, modest_batches

SPACE = "▁"
#: Parts, and pairs of pieces, that a worker remembers at least (twice as many at most); what is beyond is worked out again.
REMEMBERED = 250_000
_INF = float("inf")
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(field, wire type, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        field, wire = key >> 3, key & 7
        if wire == 0:
            yield field, wire, varint()
        elif wire == 2:
            size = varint()
            yield field, wire, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[wire]
            yield field, wire, data[at : at + size]
            at += size


class Normaliser:
    """The first transducer: the longest of a model's rules at each place rewrites what it matches, other letters pass.

    Rules come as a double-array trie over UTF-8 bytes (units of 32 bits: label, leaf flag, offset) and a list of replacements.
    Letters that begin no longer rule are remembered with what they become.
    """

    def __init__(self, rules: bytes) -> None:
        size = struct.unpack_from("<I", rules)[0] if rules else 0
        self.units = struct.unpack_from(f"<{size // 4}I", rules, 4) if rules else ()
        self.texts = rules[4 + size :]
        self.letters: dict[str, str | None] = {}

    def _next(self, at: int, byte: int) -> int | None:
        """The place of a node's child, before its offset."""
        at ^= byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def _offset(self, at: int) -> int:
        unit = self.units[at]
        return at ^ (unit >> 10 << ((unit & 512) >> 6))

    def longest(self, data: bytes) -> tuple[int, str] | None:
        """(bytes, replacement) of the longest rule at the front of data."""
        at, found = self._offset(0), None
        for i, byte in enumerate(data, 1):
            child = self._next(at, byte)
            if child is None:
                break
            at = self._offset(child)
            if self.units[child] >> 8 & 1:
                begin = self.units[at] & 0x7FFFFFFF
                found = (i, self.texts[begin : self.texts.index(b"\0", begin)].decode())
        return found

    def _alone(self, letter: str) -> str | None:
        """What a letter becomes; None if a rule begins with it and goes on."""
        at = self._offset(0)
        for byte in letter.encode():
            child = self._next(at, byte)
            if child is None:
                return letter
            at = self._offset(child)
        if any(self._next(at, byte) is not None for byte in range(1, 256)):
            return None
        found = self.longest(letter.encode())
        return found[1] if found else letter

    def __call__(self, text: str) -> str:
        if not self.units:
            return text
        out, at = [], 0
        while at < len(text):
            letter = text[at]
            if letter not in self.letters:
                self.letters[letter] = self._alone(letter)
            put = self.letters[letter]
            step = 1
            if put is None:
                found = self.longest(text[at : at + 32].encode())  # no rule is longer
                put, step = (found[1], len(text[at : at + 32].encode()[: found[0]].decode())) if found else (letter, 1)
            out.append(put)
            at += step
        return "".join(out)


class Transducer:
    """Compiled from the bytes of a SentencePiece model."""

    def __init__(self, model: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        self.bpe, self.prefix, self.squeeze, rules = False, True, True, b""
        for field, _, value in _fields(model):
            if field == 1:
                text, score, kind = "", 0.0, NORMAL
                for f, _, v in _fields(value):
                    if f == 1:
                        text = v.decode()
                    elif f == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif f == 3:
                        kind = v
                self.pieces.append((text, score, kind))
            elif field == 2:
                self.bpe = any(f == 3 and v == 2 for f, _, v in _fields(value))
            elif field == 3:
                for f, _, v in _fields(value):
                    if f == 2:
                        rules = v
                    elif f == 3:
                        self.prefix = bool(v)
                    elif f == 4:
                        self.squeeze = bool(v)
        self.rules = Normaliser(rules)
        #: User-defined pieces stand as they are, the longest first; nothing crosses their edges.
        self.own = {text: i for i, (text, _, kind) in enumerate(self.pieces) if kind == USER}
        self.own_text = re.compile("|".join(re.escape(t.replace(SPACE, " ")) for t in sorted(self.own, key=len, reverse=True))) if self.own else None
        self.own_piece = re.compile("(" + "|".join(map(re.escape, sorted(self.own, key=len, reverse=True))) + ")") if self.own else None
        self.ids = {text: i for i, (text, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.bytes_at = {int(text[3:5], 16): i for i, (text, _, kind) in enumerate(self.pieces) if kind == BYTE}
        #: Order of merging: the better the score the earlier.
        self.rank = {text: -self.pieces[i][1] for text, i in self.ids.items()}
        self.prefixes = {text[:i]: False for text in self.ids for i in range(1, len(text))}
        self.prefixes |= dict.fromkeys(self.ids, True)
        self.letters = set("".join(self.ids))
        #: By letter: (piece id or -1, the same for the next letter).
        self.trie: dict[str, tuple] = {}
        for text in sorted(self.ids, key=len):
            children, node = self.trie, None
            for letter in text[:-1]:
                node = children.get(letter)
                if node is None:
                    node = children[letter] = (-1, {})
                children = node[1]
            children[text[-1]] = (self.ids[text], children[text[-1]][1] if text[-1] in children else {})
        self.outputs = [text.replace(SPACE, " ").encode() if kind in (NORMAL, USER) else bytes([int(text[3:5], 16)]) if kind == BYTE else b" \xe2\x81\x87 " if kind == UNKNOWN else b"" for text, _, kind in self.pieces]
        self.packed = [struct.pack("<i", i) for i in range(len(self.pieces))]
        self.parts = self._parts()
        self.is_byte = np.array([kind == BYTE for _, _, kind in self.pieces])
        self.pairs = Recent(REMEMBERED)
        self.spines: dict[str, tuple | None] = {}
        self.cache = Recent(REMEMBERED)

    def _parts(self) -> re.Pattern | None:
        """Cuts the normalised input where no piece crosses: before white space, around line ends, and between a letter and
        those signs that follow a letter in no piece. None if a piece crosses white space."""
        if any(SPACE in text.lstrip(SPACE) for text in self.ids):
            return None
        line = "" if "\n" in self.letters else "\n"
        crossed = set("".join(re.findall(r"(?<=[^\W\d_])[^\w\s]", "\0".join(self.ids))))
        ends = re.escape("".join(sorted(set(".,;:!?|)\"") - crossed)))
        word = rf"{SPACE}*[^\W\d_]+(?=[{ends}{SPACE}{line}]|$)"
        return re.compile(f"{line}|{word}|{SPACE}*[^{SPACE}{line}]+|{SPACE}+" if line else f"{word}|{SPACE}*[^{SPACE}]+|{SPACE}+")

    # --- the pair weights of a BPE model

    def merged(self, text: str) -> tuple[list[str], dict[str, tuple[str, str]]]:
        """Repeated merging of the best, leftmost pair; also which parts each merged symbol was made of."""
        symbols, made = list(text), {}
        while len(symbols) > 1:
            best, at = _INF, -1
            for i in range(len(symbols) - 1):
                rank = self.rank.get(symbols[i] + symbols[i + 1], _INF)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                break
            made[symbols[at] + symbols[at + 1]] = (symbols[at], symbols[at + 1])
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols, made

    def spine(self, piece: str) -> tuple | None:
        """(reachable, right edge, left edge): the symbols that stand at the piece's edges while it is merged, each with the
        rank at which it is consumed; None as edges if a symbol has a better rank than its parts, so that ranks aren't times."""
        found = self.spines.get(piece)
        if found is None:
            symbols, made = self.merged(piece)
            regular = all(len(part) == 1 or self.rank[part] < self.rank[whole] for whole, parts in made.items() for part in parts)
            edges = []
            for side in (1, 0):
                symbol, until, edge = piece, _INF, []
                while True:
                    edge.append((symbol, until))
                    if len(symbol) == 1 or symbol not in made:
                        break
                    until, symbol = self.rank[symbol], made[symbol][side]
                edges.append(edge)
            found = self.spines[piece] = (symbols == [piece], *(edges if regular else (None, None)))
        return found

    def adjacent(self, left: str, right: str) -> bool:
        """Whether merging left + right gives just these two."""
        _, edge, _ = self.spine(left)
        _, _, other = self.spine(right)
        if edge is None or other is None:
            return self.merged(left + right)[0] == [left, right]
        rank = self.rank
        for x, x_until in edge:
            for y, y_until in other:
                crossing = rank.get(x + y)
                if crossing is not None and crossing < x_until and crossing <= y_until:
                    x_from, y_from = rank[x] if len(x) > 1 else -_INF, rank[y] if len(y) > 1 else -_INF
                    if x_from < y_until and y_from < x_until:
                        return False
        return True

    # --- composition with an input and its shortest path

    def arcs(self, text: str, begin: int) -> list[str]:
        """The pieces that leave a position of the input, shortest first."""
        found, known = [], self.prefixes
        for end in range(begin + 1, len(text) + 1):
            whole = known.get(text[begin:end])
            if whole is None:
                break
            if whole:
                found.append(text[begin:end])
        return found

    def fallback(self, letter: str) -> list[int]:
        return [self.bytes_at.get(b, self.unknown) for b in letter.encode()] if self.bytes_at else [self.unknown]

    def path(self, text: str) -> list[int]:
        """Piece ids of the shortest path through the transducer composed with a part of the normalised input."""
        return self.only_path(text) if self.bpe else self.least_path(text)

    def only_path(self, text: str) -> list[int]:
        """With weights of 0 and infinity, best-first search. A prefix has one path of finite weight at most, so a position
        from which the end can't be reached is given up for good: the search is linear in positions times arcs."""
        n, pairs, trie, arcs_at, done = len(text), self.pairs, self.trie, {}, []
        at, before = 0, -1
        while at < n:
            arcs = arcs_at.get(at)
            if arcs is None:
                arcs = arcs_at[at] = []
                children, end = trie, at
                while end < n and (node := children.get(text[end])) is not None:
                    end += 1
                    children = node[1]
                    if node[0] >= 0:
                        arcs.append((node[0], end))
                if not arcs and text[at] not in self.ids:
                    arcs.append((-1, at + 1))
            found = None
            while arcs:
                found = arcs.pop()  # the longest first
                piece = found[0]
                if piece >= 0 and before >= 0:
                    both = before << 32 | piece
                    free = pairs[both]
                    if free is None:
                        left, right = self.pieces[before][0], self.pieces[piece][0]
                        free = self.spine(right)[0] and self.adjacent(left, right)
                        pairs.put(both, free)
                    if free:
                        break
                elif piece < 0 or self.spine(self.pieces[piece][0])[0]:
                    break
                found = None
            if found is None:
                at, before = done.pop()
                continue
            done.append((at, before))
            before, at = found
        out: list[int] = []
        for (begin, _), piece in zip(done, [*(d[1] for d in done[1:]), before], strict=True):
            if piece >= 0:
                out.append(piece)
            else:
                out += self.fallback(text[begin])
        return out

    def least_path(self, text: str) -> list[int]:
        """With real weights, relaxation of all arcs in order of their start."""
        n, worst = len(text), 10.0 + max(self.rank.values(), default=0.0)
        weight, came = [0.0] + [_INF] * n, [(0, "")] * (n + 1)
        for begin in range(n):
            if weight[begin] == _INF:
                continue
            arcs = self.arcs(text, begin)
            for piece in arcs or [""]:
                end, total = begin + (len(piece) or 1), weight[begin] + (self.rank[piece] if piece else worst)
                if total < weight[end]:
                    weight[end], came[end] = total, (begin, piece)
            if text[begin] not in self.ids and weight[begin] + worst < weight[begin + 1]:
                weight[begin + 1], came[begin + 1] = weight[begin] + worst, (begin, "")
        parts, end = [], n
        while end:
            begin, piece = came[end]
            parts.append([self.ids[piece]] if piece else self.fallback(text[begin]))
            end = begin
        return [i for part in reversed(parts) for i in part]

    def _ruled(self, text: str) -> str:
        """The text by the normaliser's rules, user-defined pieces aside."""
        if not self.rules.units or not self.own_text:
            return self.rules(text)
        out, at = [], 0
        for m in self.own_text.finditer(text):
            out += [self.rules(text[at : m.start()]), m[0]]
            at = m.end()
        return "".join([*out, self.rules(text[at:])])

    def normalised(self, text: str) -> str:
        text = self._ruled(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def _part(self, part: str) -> bytes:
        ids = self.path(part)
        found = b"".join([self.packed[i] for i in ids])
        if len(part) <= 48:
            self.cache.put(part, found)
        return found

    def encode(self, text: str) -> np.ndarray:
        """Piece ids of a text."""
        text = self.normalised(text)
        if self.own_piece is None:
            return np.frombuffer(self._encoded(text), "<i4")
        pieces = [struct.pack("<i", self.own[p]) if i % 2 else self._encoded(p) for i, p in enumerate(self.own_piece.split(text))]
        return np.frombuffer(b"".join(pieces), "<i4")

    def _encoded(self, text: str) -> bytes:
        known = self.cache
        parts = self.parts.findall(text) if self.parts else [text] if text else []
        return b"".join([known[p] or self._part(p) for p in parts])

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of a sequence of piece ids."""
        out = self.outputs
        whole = b"".join([out[i] for i in ids.tolist()])
        return whole[1:] if self.prefix and whole[:1] == b" " else whole


_compiled: dict[str, Transducer] = {}


def compiled(model_path: str) -> Transducer:
    """A worker compiles each model once."""
    if model_path not in _compiled:
        with open(model_path, "rb") as file:
            _compiled[model_path] = Transducer(file.read())
    return _compiled[model_path]


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """Returns for each row of docs: doc_id, n_tokens, n_bytes_fallback, ids_sha256 (of the ids as little-endian int32),
    decoded_sha256 (of the text decoded from the ids, UTF-8), round_trip (that text equals the input), token_ids if
    with_ids, and the columns named in also.

    model_path names a model file that every worker has, like the interpreter's own files. Null text counts as empty: no
    tokens. A U+2581 in the input decodes as a blank, so round_trip is false there. Equal texts get equal rows. Other columns
    are ignored.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = compiled(model_path)
        for batch in source:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                lists: list[np.ndarray] = []
                for text in part.column(1).to_pylist():
                    ids = model.encode(text or "")
                    decoded = model.decode(ids)
                    rows.append((len(ids), int(np.count_nonzero(model.is_byte[ids])), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest(), decoded == (text or "").encode()))
                    lists.append(ids)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True)]
                arrays = [part.column(0), *columns]
                names = ["doc_id", "n_tokens", "n_bytes_fallback", "ids_sha256", "decoded_sha256", "round_trip"]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate([*lists, np.empty(0, "<i4")]).astype(np.int32), pa.int32())))
                    names.append("token_ids")
                arrays += part.columns[2:]
                names += also
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_tokens long, n_bytes_fallback long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", token_ids array<int>" * with_ids
    schema += "".join(f", `{name}` {docs.schema[name].dataType.simpleString()}" for name in also)
    return modest_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *also).mapInArrow(batches, schema)
