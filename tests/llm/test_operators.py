"""Each operator against a plain version of its contract, over awkward rows."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from titleforge.llm import components, fair_mix, flac, jaccard_join, lang_id, pii, repeats, transducer, va_search, warc, word_pieces
from titleforge.llm.queries import PIECES, RANKS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(5)


def corpus():
    """(doc_id, text) with nulls, empties, blanks, ties, copies, near copies, shared and inner repeats, and a long text."""
    pool = [f"w{i}" for i in range(400)]
    say = lambda n: [RNG.choice(pool) for _ in range(n)]
    base, passage = say(120), say(60)
    texts = [None, "", " \t\n", "one", "one", "One", "a b c d", "a a a a a a " * 20, " ".join(base), " ".join(base).upper(), " ".join(base)]
    for _ in range(70):
        near = list(base)
        for _ in range(RNG.randint(1, 4)):
            near[RNG.randrange(len(near))] = RNG.choice(pool)
        texts.append("  ".join(near))
    texts += [" ".join(say(RNG.randint(1, 40)) + passage[: RNG.randint(30, 60)] + say(RNG.randint(0, 40))) for _ in range(20)]
    texts += [" ".join(say(RNG.randint(1, 80))) for _ in range(20)] + ["x" * 30_000, "é🎉\x00 " * 50, " ".join(say(8000))]
    return [(i, t) for i, t in enumerate(texts)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 7 == 0 else "en" if i % 2 else "fr", None if i % 5 == 0 else f"s{i % 4}", 0, "clash") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n string").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def test_jaccard_join(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CROWD", 8)
    sets = {i: shingles(t) for i, t in ROWS}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert jaccard_join.near_duplicates(empty).count() == 0
    kept = {r.doc_id for r in jaccard_join.keep_first(docs).collect()}
    assert kept == {i for i in sets if find(i) == i}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100}
    got = {r.node: r.root for r in components.connected_components(edges, lot=3).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100}
    assert components.connected_components(edges.limit(0)).count() == 0
    pairs = [(RNG.randrange(300), RNG.randrange(300)) for _ in range(200)]
    least = {x: x for pair in pairs for x in pair}
    while any(least[a] != least[b] for a, b in pairs):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    nodes, roots = components.forest(*(np.array(side) for side in zip(*pairs, strict=True)))
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == least


def test_jaccard_join_of_missing_and_repeated_ids(spark):
    words = [f"a{i}" for i in range(100)]
    first, near, other = " ".join(words), " ".join(words[:-1] + ["b"]), " ".join(f"c{i}" for i in range(90))
    rows = spark.createDataFrame([(None, first), (5, near), (5, other), (9, other + " d"), (4, "plain words"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(None, 96, 5), (5, 96, 5), (5, 86, 5), (9, 87, 5), (4, 1, 4), (None, 0, None)], key=str)


def test_keep_identified_without_labels(spark):
    rows = [(1, "words here", None), (2, "words there", None), (3, "123", None), (4, None, None), (5, "", "en")]
    kept = lang_id.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted(tuple(r) for r in kept) == [(1, "words here", "und"), (2, "words there", "und")]


def test_keep_first_of_missing_and_repeated_ids(spark):
    words = [f"a{i}" for i in range(100)]
    a, near, b, c = " ".join(words), " ".join(words[:-1] + ["b"]), " ".join(f"c{i}" for i in range(90)), " ".join(f"d{i}" for i in range(90))
    rows = [(5, a), (5, b), (9, near), (4, b + " x"), (None, a), (None, c), (None, c + " y"), (7, "z"), (7, "z"), (8, None), (8, " "), (None, "")]
    kept = jaccard_join.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = [(r.doc_id, r.text) for r in kept.collect()]
    nameless = [t for i, t in got if i is None and t]
    assert len(nameless) == 1 and nameless[0] in (c, c + " y")
    assert sorted((x for x in got if x[0] or not x[1]), key=str) == sorted([(5, a), (4, b + " x"), (7, "z"), (8, None), (8, " "), (None, "")], key=str)


def test_links_of_jaccard_join(spark, docs, empty, monkeypatch):
    sets = {i: shingles(t) for i, t in ROWS}
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    want = {i: sum(linked(s, o) for j, o in sets.items() if i != j) for i, s in sets.items()}
    roots = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()}
    monkeypatch.setattr(jaccard_join, "BLOCK", 9)
    rows = jaccard_join.link_counts(docs).collect()
    assert {r.doc_id: r.n_links for r in rows} == want and max(want.values()) > 20
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == roots
    assert jaccard_join.link_counts(empty).count() == 0
    words = [f"a{i}" for i in range(100)]  # 100 and 80 words: as far apart in size as a link allows
    rows = spark.createDataFrame([(1, " ".join(words)), (None, " ".join(words[:81])), (3, " ".join(words[:80])), (3, " ".join(words))], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.n_links) for r in jaccard_join.link_counts(rows).collect()), key=str)
    assert got == sorted([(1, 96, 2), (3, 96, 2), (None, 77, 3), (3, 76, 1)], key=str)


def test_personal_data(docs, empty):
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def brute(text):
        out = [("email", *m.span()) for m in email.finditer(text)]
        out += [("ip", *m.span()) for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        for kind, pattern, low, high in (("card", card, 13, 19), ("phone", phone, 9, 15)):
            for m in pattern.finditer(text):
                digits = re.sub("[^0-9]", "", m[0])
                if low <= len(digits) <= high and (kind == "phone" or pii.luhn(digits)):
                    out.append((kind, *m.span()))
        return out

    for _ in range(5000):
        text = "".join(RNG.choice("ab@@..1234567890-+ ()é_%") for _ in range(RNG.randint(0, 40)))
        assert [tuple(s) for s in pii.find(text)] == brute(text)
    for text, kind, found in (
        ("to john [at] mail (dot) example [dot] com now", "email", "john [at] mail (dot) example [dot] com"),
        ("jоhn@exаmple.com x", "email", "jоhn@exаmple.com"),
        ("plus one five five five one two three four five six", "phone", "plus one five five five one two three four five six"),
        ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
    ):
        base, spans = pii.spans_of(text)
        assert base == [] and [(s.kind, text[s.start : s.end]) for s in spans] == [(kind, found)]
    for clean in ("the one at home", "look at the dot", "one two three are numbers"):
        assert pii.spans_of(clean) == ([], [])
    assert pii.redacted("mail a@b.de or +49 30 1234567.") == "mail <EMAIL> or <PHONE>."
    rows = pii.find_documents(docs).collect()
    assert len(rows) == len(ROWS) and pii.find_documents(empty).count() == 0
    assert len(pii.find("9" * 200_000 + "@" + "a" * 200_000)) == 0


def test_personal_data_disguised_in_part(spark):
    texts = ["to jоhn@example.com now", "to john@example.cоm now", "a.b@mаil.example.com", "10.0.0.1２ up"]
    found = ["jоhn@example.com", "john@example.cоm", "a.b@mаil.example.com", "10.0.0.1２"]
    for text, whole in zip(texts, found, strict=True):
        base, spans = pii.spans_of(text)
        assert set(base) < set(spans) and [text[s.start : s.end] for s in spans if s not in base] == [whole]
        assert pii.redacted(text) == text.replace(whole, "<IP>" if whole[0] == "1" else "<EMAIL>")
    rows = pii.find_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.n_added for r in sorted(rows)] == [1, 1, 1, 1]


def test_added_spans_by_brute_force():
    """Letter by letter: each output letter carries its source span, and each transducer rewrites one match after another."""
    cell = r"[^\W_]"
    words = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0"}
    digit = "(?:" + "|".join(words) + ")"
    open_, close = r"[\[({<]", r"[\])}>]"

    def replaced(tape, pattern, put):
        text, out, at = "".join(c for c, _, _ in tape), [], 0
        for m in re.finditer(pattern, text, re.IGNORECASE):
            new = put(m, text, tape)
            if new is None:
                continue
            out += tape[at : m.start()] + [(c, tape[m.start()][1], tape[m.end() - 1][2]) for c in new]
            at = m.end()
        return out + tape[at:]

    def brute(source):
        tape = [(c, i, i + 1) for i, c in enumerate(source)]
        tape = [(p, b, e) for c, b, e in tape for p in [{"о": "o", "а": "a", "１": "1", "\u200b": ""}.get(c, c)] if p]
        signs = {"dot": ".", "point": ".", "plus": "+", "dash": "-"}
        tape = replaced(tape, rf"(?<!{cell})(?:plus[\s,-]+)?{digit}(?:[\s,-]+(?:(?:dot|point|plus|dash)[\s,-]+)?{digit}){{3,}}(?!{cell})", lambda m, *_: "".join(words.get(w.lower()) or signs[w.lower()] for w in re.findall("[A-Za-z]+", m[0])))
        tape = replaced(tape, rf"\s*{open_}\s*(at|@|dot|\.)\s*{close}\s*", lambda m, *_: "@" if m[1].lower() in ("at", "@") else ".")
        tape = replaced(tape, r"(?<=[A-Za-z0-9])\s+(?:at|@)\s+(?=[A-Za-z0-9-]+(?:(?:\s+dot\s+|\.)[A-Za-z0-9-]+)*(?:\s+dot\s+|\.)[A-Za-z]{2})", lambda *_: "@")
        while True:  # a dot that goes on a domain, or the local part before a disguised sign
            text = "".join(c for c, _, _ in tape)
            found = [m for m in re.finditer(r"(?<=[A-Za-z0-9])\s+dot\s+(?=[A-Za-z0-9])", text)]
            for m in found:
                after = re.match(r"(?:[A-Za-z0-9._%+-]|\s+dot\s+(?=[A-Za-z0-9]))*@", text[m.end() :])
                disguised = after and source[slice(*tape[m.end() + after.end() - 1][1:])] != "@"
                if re.search(r"@[A-Za-z0-9.-]+$", text[: m.start()]) and re.match("[A-Za-z]{2}", text[m.end() :]) or disguised:
                    tape = tape[: m.start()] + [(".", tape[m.start()][1], tape[m.end() - 1][2])] + tape[m.end() :]
                    break
            else:
                break
        text = "".join(c for c, _, _ in tape)
        spans = set()
        for kind, start, end in pii.find(text):
            begin, stop = tape[start][1], tape[end - 1][2]
            if source[begin:stop] != text[start:end]:
                spans.add((kind, begin, stop))
        return spans | {tuple(s) for s in pii.find(source)}

    parts = ["john", "b", "о", "а", "mail", "com", "de", "@", " at ", " dot ", " [at] ", "(dot)", " [ . ] ", ".", " ", "  ", "\u200b", "one ", "two ", "five, ", "plus ", "nine", "１", "12", "+1", "-"]
    for _ in range(6000):
        text = "".join(RNG.choice(parts) for _ in range(RNG.randint(1, 14)))
        assert {tuple(s) for s in pii.spans_of(text)[1]} == brute(text), text


def test_personal_data_in_linear_time():
    n = 10**6
    for text in (" " * n + "[at] x.com", "a" + " " * n + "at b.com", "[" + " " * n + "at]x", "[ " * (n // 2), "one" + " " * n + "two" + " " * n + "x"):
        began = time.process_time()
        pii.spans_of(text)
        assert time.process_time() - began < 5
    assert [s.kind for s in pii.spans_of("john" + " " * 10 + "[at" + " " * 10 + "]example.com")[1]] == ["email"]


def test_personal_data_with_spelled_signs():
    for found in (
        "john at example.com",
        "john at mail.example.com",
        "john at example [dot] com",
        "john AT example dot co.uk",
        "john dot smith at example dot com",
        "j dot r dot smith [at] example.com",
    ):
        base, spans = pii.spans_of(f"write: {found}, please")
        assert base == [] and [(s.kind, s.start, s.end) for s in spans] == [("email", 7, 7 + len(found))]
    for clean in ("it is at 10.30 or at 3.5 or at the end. Then", "connect the dot at the end", "arrived at home. Later"):
        assert pii.spans_of(clean) == ([], [])
    assert [tuple(s) for s in pii.spans_of("the dot john@mail.com")[1]] == [("email", 8, 21)]


def test_flac(docs, empty):
    rows = {r.doc_id: r for r in flac.describe(flac.store(docs)).collect()}
    for i, text in ROWS:
        raw = (text or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
    assert rows[3].media_sha256 == rows[4].media_sha256 and flac.describe(flac.store(empty)).count() == 0
    raw = bytes((128 + 100 * np.sin(np.arange(5760) / 40)).astype(np.uint8))
    (file,) = flac.encode_many([raw])
    assert flac.read_samples(file, 1000, 900) == raw[1000:1900] and len(file) < len(raw) / 2
    damaged = bytearray(file)
    damaged[-300] ^= 1
    with pytest.raises(ValueError):
        flac.decode_many([bytes(damaged)])


def test_flac_reads_linear_predictors():
    """A frame written bit by bit: order 2, precision 5, shift 1, two Rice partitions."""
    samples = [((i * 7) % 23) - 11 for i in range(576)]
    weights, shift = (3, -1), 1
    bits = "".join(f"{s & 255:08b}" for s in samples[:2]) + f"{4:04b}{shift:05b}" + "".join(f"{w & 31:05b}" for w in weights) + "00" + f"{1:04b}"
    for n in range(2, 576):
        if n in (2, 288):
            k = 3 if n == 2 else 5
            bits += f"{k:04b}"
        rest = samples[n] - (sum(w * samples[n - 1 - i] for i, w in enumerate(weights)) >> shift)
        folded = rest * 2 if rest >= 0 else -rest * 2 - 1
        bits += "0" * (folded >> k) + "1" + f"{folded & (1 << k) - 1:0{k}b}"
    bits += "0" * (-len(bits) % 8)
    head = bytes([0xFF, 0xF8, 0x24, 0x02, 0])
    one = lambda data, table, wide: int(flac._checksums(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]), table, wide)[0])
    frame = head + bytes([one(head, flac.CRC8, 8), (32 + 1) << 1]) + int(bits, 2).to_bytes(len(bits) // 8, "big")
    frame += one(frame, flac.CRC16, 16).to_bytes(2, "big")
    out, _, ends = flac.decode_frames(np.frombuffer(frame, np.uint8), np.array([0]))
    assert out[0].tolist() == samples and ends[0] == len(frame)


def test_flac_reads_foreign_streams():
    """Streams written bit by bit: predictors of one order and several precisions, parameters of 5 bits, escaped partitions, and
    seek tables that are sparse or left out; all in one call."""
    one = lambda data, table, wide: int(flac._checksums(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]), table, wide)[0])

    def frame(number, samples, precision, method, split, escaped):
        weights, shift = (3, -1), 1
        bits = "".join(f"{s & 255:08b}" for s in samples[:2]) + f"{precision - 1:04b}{shift:05b}" + "".join(f"{w & (1 << precision) - 1:0{precision}b}" for w in weights) + f"{method:02b}{split:04b}"
        size = 576 >> split
        for n in range(2, 576):
            if n == 2 or n % size == 0:
                plain, k, raw = (n // size) in escaped, 3, 12 if n // size % 2 else 10
                bits += f"{(1 << 4 + method) - 1 if plain else k:0{4 + method}b}" + (f"{raw:05b}" if plain else "")
            rest = samples[n] - (sum(w * samples[n - 1 - i] for i, w in enumerate(weights)) >> shift)
            folded = rest * 2 if rest >= 0 else -rest * 2 - 1
            bits += f"{rest & (1 << raw) - 1:0{raw}b}" if plain else "0" * (folded >> k) + "1" + f"{folded & (1 << k) - 1:0{k}b}"
        bits += "0" * (-len(bits) % 8)
        head = bytes([0xFF, 0xF8, 0x24, 0x02]) + flac._number(number)
        out = head + bytes([one(head, flac.CRC8, 8), (32 + 1) << 1]) + int(bits, 2).to_bytes(len(bits) // 8, "big")
        return out + one(out, flac.CRC16, 16).to_bytes(2, "big")

    def whole(points, swapped=False):
        rows = [[RNG.randrange(-128, 128) if b == 1 else ((i * 7 + b) % 23) - 11 for i in range(576)] for b in range(4)]
        kinds = [(5, 0, 0, ()), (9, 1, 2, (1,)), (15, 0, 1, (0, 1)), (5, 1, 0, (0,))]
        frames = [frame(b if not swapped else 3 - b, r, *k) for b, (r, k) in enumerate(zip(rows, kinds, strict=True))]
        raw = bytes(s + 128 for r in rows for s in r)
        starts = np.cumsum([0, *map(len, frames)])[:-1].tolist()
        file = flac.stream(b"".join(frames), starts, len(raw), hashlib.md5(raw.translate(flac._SIGNED)).digest())
        head = flac.Stream(file)
        table = b"".join(p.to_bytes(8, "big") + at.to_bytes(8, "big") + (576).to_bytes(2, "big") for p, at in head.points[:points])
        return file[:42] + bytes([0x83]) + len(table).to_bytes(3, "big") + table + file[head.first :], raw

    files, raws = zip(*(whole(points) for points in (4, 1, 0, 4)), strict=True)
    own = flac.encode_many([raws[0]])
    assert flac.decode_many([*files, *own]) == [*raws, raws[0]]
    for file, raw in zip(files, raws, strict=True):
        for first, count in ((0, 5), (570, 20), (1700, 4000), (2303, 1)):
            assert flac.read_samples(file, first, count) == raw[first : first + count]
    with pytest.raises(ValueError):
        flac.decode_many([whole(4, swapped=True)[0]])


def test_vector_search(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist(), "x") for i in range(300)] + [(1000 + i, [0.5] * 6, "x") for i in range(40)]
    rows += [(2000, None, "x"), (2050, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x"), (2100, [float("nan")] * 6, "x"), (2150, [float("inf")] * 6, "x"), (2200, [], "x"), (2250, [1.0, 2.0], "x"), (None, [1.0] * 6, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    rows += [(50, rng.normal(size=6).tolist(), "x"), rows[7], (7, rng.normal(size=6).tolist(), "x"), rows[100]]  # ids and rows that repeat
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(5)
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = Counter()
    for at, (q, own) in enumerate(good):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for j, (i, v) in enumerate(good) if j != at and len(v) == len(own))[:5]
            want.update((q, rank, i, -s) for rank, (s, i) in enumerate(best, 1))
    assert Counter(tuple(r) for r in va_search.top_products(table, sent=200).collect()) == want
    assert Counter(tuple(r) for r in va_search.top_products(table).collect()) == want
    assert va_search.top_products(table.limit(0)).count() == 0


def test_language(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lang_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    got = {r.doc_id: r.lang_pred for r in lang_id.identify(docs).collect()}
    assert got[0] == got[1] == got[2] == "und" and lang_id.identify(empty).count() == 0
    assert {r.lang_pred for r in lang_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert lang_id.keep_identified(docs).columns == docs.columns


def test_language_kernel_by_brute_force():
    texts = ["Das Haus", "the house by the sea", "la maison, la mer", "a", "é²½"]

    def grams(text):
        letters = "".join(c if c.isalpha() or ord(c) >= 0x250 else " " for c in text.lower()) + "  "
        return {letters[i : i + n] for n in (1, 2, 3) for i in range(len(letters) - n + 1)}

    found = lang_id._kernel(lang_id.presence(texts), lang_id.presence(texts))
    for i, x in enumerate(texts):
        for j, z in enumerate(texts):
            a, b = grams(x), grams(z)
            # Features are hashed, so that a few n-grams may meet in one.
            assert abs(found[i, j] - len(a & b) / (len(a) * len(b)) ** 0.5) < 0.05
    together = lang_id.presence(texts)
    assert all((lang_id.presence([t])[0] == together[i]).all() for i, t in enumerate(texts))
    assert [lang_id.has_letter(t) for t in ("²", "½ 3", "x²", None, "", "_", "ж")] == [False, False, True, False, False, False, True]


def test_word_pieces(docs, empty):
    for turn in range(300):
        pieces = {bytes(RNG.choice(b"abc ") for _ in range(RNG.randint(1, 5))) for _ in range(9)} | ({b" ", b"a", b"b", b"c"} if turn % 2 else set())
        automaton = word_pieces.LongestMatch(pieces)
        word = bytes(RNG.choice(b"abc") for _ in range(RNG.randint(1, 12)))
        rest, count = b" " + word, 0
        while rest and (size := next((n for n in range(len(rest), 0, -1) if rest[:n] in pieces), 0)):
            rest, count = rest[size:], count + 1
        assert automaton.count(word) == (1 if rest else count)
    got = {r.doc_id: r for r in word_pieces.count_pieces(docs, RANKS).collect()}
    assert got[0].n_pieces == got[1].n_pieces == 0 and all(got[i].n_words == len(WORD.findall(t or "")) for i, t in ROWS)
    assert word_pieces.count_pieces(empty, RANKS).count() == 0


def removed(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    counts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {j for s in range(len(w) - window + 1) if counts[tuple(w[s : s + window])] > 1 for j in range(s, s + window)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "gram"), [(35, 8), (12, 5)])
def test_repeats(docs, empty, window, gram):
    assert sorted((tuple(r) for r in repeats.remove_repeats(docs, window, gram).collect()), key=str) == removed(ROWS, window)
    assert repeats.remove_repeats(empty).count() == 0


def test_repeats_of_ids(spark):
    rows = [(1, "a b c d e f g h " * 9), (1, "z " + "a b c d e f g h " * 9), (None, "q r s " * 30), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in repeats.remove_repeats(table).collect()), key=str) == removed(rows, 35)


def test_warc(spark):
    rows = [(i, f"http://www.h{i % 3}.example.com/P{i}?q", ("page %d " % (i % 5)) * (30 if i % 2 else 1), "x") for i in range(40)]
    rows += [(50, None, None, "x"), (51, "http://a.b/\n", "", "x"), (None, "u", "n" * 200, "x"), (60, "u", "n" * 200, "x"), (61, "u", "n" * 200, "x")]
    got = warc.capture_history(spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(4)).collect()
    first = {}
    for i, _, html, _ in sorted((r for r in rows if r[0] is not None)):
        first.setdefault(html or "", i)
    for r in got:
        html = next(h or "" for i, _, h, _ in rows if i == r.page_id)
        again = r.page_id is not None and len(html) >= 100 and first[html] < r.page_id
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(html), hashlib.sha256(html.encode()).hexdigest(), "revisit" if again else "response", first[html] if again else None)
    keys = [(r.url_key, r.seconds) for r in got]
    assert len(got) == len(rows) and keys == sorted(keys)
    assert warc.capture_history(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_external_merge(spark, monkeypatch):
    """Runs, batches and groups of a few rows, a hot key, hostile URLs and repeated ids; the run sizes reach the workers by pickling."""
    urls = ["http://a℀b.com/", "http://[::1", "http://hot.example.com/x", None, "", "://", "http://x.org:99999999/", "HTTP://EXAMPLE.COM/É"]
    rows = [(i % 50, urls[2] if i % 2 else urls[i % len(urls)], f"text {i % 7} " * 20) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9)
    folder = "file://" + spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/runs"
    heads = warc.read_runs(warc.write_archives(pages), folder)
    assert heads.filter("records > 0").count() >= 8
    got = [tuple(r) for r in warc.merge_runs(heads, folder, fan=3).collect()]
    keys = [warc._order(r) for r in got]
    assert keys == sorted(keys) and len(got) == 300 and Counter(r[2] for r in got) == Counter(r[0] for r in rows)
    assert Counter(r[0] for r in got) == Counter(warc.url_key(u) for _, u, _ in rows)
    monkeypatch.setattr(warc, "BATCH", 4)
    _, path = warc._open(folder)
    runs = [sorted((f"k{RNG.randrange(5)}", RNG.randrange(3), RNG.randrange(9), 1, "d", "response", None, f"a{k}", i, 1) for i in range(RNG.randint(1, 40))) for k in range(6)]
    runs = [sorted(r, key=warc._order) for r in runs]
    names = [warc._write_run(folder, r)[0] for r in runs]
    every = sorted((x for r in runs for x in r), key=warc._order)
    assert [*warc._merged(folder, names)] == every
    for _ in range(30):
        low, high = sorted(warc._order(RNG.choice(every)) for _ in range(2))
        assert [*warc._merged(folder, names, low, high)] == [x for x in every if low <= warc._order(x) < high]


def test_loser_tree():
    for k in range(8):
        runs = [sorted(RNG.choices(range(30), k=RNG.randint(0, 9))) for _ in range(k)]
        assert [*warc.LoserTree(runs)] == sorted(x for r in runs for x in r)


def test_pieces(docs, empty):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in transducer.encode_documents(docs, PIECES).collect():
        text = ROWS[r.doc_id][1] or ""
        assert r.token_ids == library.encode(text) and r.round_trip
        assert r.decoded_sha256 == hashlib.sha256(library.decode(r.token_ids).encode()).hexdigest()
    assert transducer.encode_documents(empty, PIECES).count() == 0


def test_pieces_of_other_models():
    """A normaliser with rules and user-defined pieces, against the library; protocol buffers that follow each other are merged."""
    import sentencepiece

    def field(number, body):
        size, out = len(body), bytearray([number << 3 | 2])
        while size > 127:
            out.append(size & 127 | 128)
            size >>= 7
        return bytes([*out, size]) + body

    with open(PIECES, "rb") as file:
        plain = file.read()
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = next(v for f, _, v in transducer._fields(library.serialized_model_proto()) if f == 3)
    rules = next(v for f, _, v in transducer._fields(spec) if f == 2)
    letters = "aB e\u0301ﬁ½①ｶﾞ㌔Å\u00a0\u200b\t\n한글Ǆ…́ﷺ"
    texts = ["".join(RNG.choice(letters) for _ in range(RNG.randint(0, 30))) for _ in range(400)] + ["", "  a  b ", "x<sep>y <sep>  z", "<sep><sep>"]
    normaliser = transducer.Normaliser(rules)
    squeezed = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    assert [normaliser(t) for t in texts] == [squeezed.normalize(t) for t in texts]
    own = field(1, field(1, b"<sep>") + bytes([2 << 3 | 5, 0, 0, 0, 0, 3 << 3, transducer.USER]))
    for model in (plain + field(3, field(2, rules)), plain + own, plain + own + field(3, field(2, rules))):
        both = transducer.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
        for text in texts:
            assert both[0].encode(text).tolist() == both[1].encode(text), text
            assert both[0].decode(both[0].encode(text)).decode() == both[1].decode(both[1].encode(text))


def test_unigram_path():
    model = transducer.compiled(PIECES)
    import copy

    other = copy.copy(model)
    other.bpe, other.ids, other.rank = False, {"a": 0, "b": 1, "ab": 2, "ba": 3}, {"a": 2.0, "b": 2.0, "ab": 3.0, "ba": 1.0}
    other.prefixes = {"a": True, "b": True, "ab": True, "ba": True}
    assert other.path("aba") == [0, 3]


def test_fair_mix(docs, empty):
    rows = fair_mix.fair_mix(docs, bucket_rows=5).collect()
    assert len(rows) == len(ROWS) and fair_mix.fair_mix(empty).count() == 0
    sizes = {i: len(WORD.findall(t or "")) for i, t in ROWS}
    sources: dict = {}
    for r in rows:
        assert r.size == sizes[r.doc_id] and r.taken <= 2 * r.size
        source = sources.setdefault(r.source, [0, 0, r.target, r.source_size])
        source[0] += r.size
        source[1] += r.taken
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = budget - sum(2 * sources[s][0] for s in capped)
        total = sum(weights[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and left * weights[s] / total > 2 * sources[s][0]}
        if not over:
            break
        capped |= over
    for s in order:
        want = 2 * sources[s][0] if s in capped else left * weights[s] / total
        assert sources[s][0] == sources[s][3] and abs(sources[s][2] - want) < 1e-6 and abs(sources[s][1] - want) <= len(order)
    assert sum(taken for _, taken, _, _ in sources.values()) == int(budget)
    assert sorted(map(str, rows)) == sorted(map(str, fair_mix.fair_mix(docs, bucket_rows=5).collect()))
    again = docs.union(docs.limit(9)).withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))  # repeated and null ids
    got = fair_mix.fair_mix(again, bucket_rows=5).collect()
    assert len(got) == len(ROWS) + 9 and all(0 <= r.taken <= 2 * r.size for r in got)
    assert abs(sum(r.taken for r in got) - 1.5 * sum(r.size for r in got)) < 1
