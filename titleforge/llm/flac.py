"""Operator 3: media columns in FLAC: mono streams of 8-bit samples in blocks of 576, written and read in batches of frames.

Many frames are coded at once: the samples of all frames form a matrix, and Rice codes are packed and read column by column.
The reader takes constant, verbatim, fixed and linear-predictor subframes with Rice partitions, checks the CRC-8 of each
header, the CRC-16 of each frame and the MD5 of the samples, and can start at any block by the seek table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import modest_batches, utf8

BLOCK = 576
#: Frames coded at once.
BATCH = 2048
RATE = 8000
CONSTANT, VERBATIM, FIXED, LPC = 0, 1, 8, 32


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << np.uint32(bits - 8)
    for _ in range(8):
        table = np.where(table >> np.uint32(bits - 1) & np.uint32(1), table << np.uint32(1) ^ np.uint32(polynomial), table << np.uint32(1)) & np.uint32((1 << bits) - 1)
    return table


#: The format's checksum polynomials x^8+x^2+x+1 and x^16+x^15+x^2+1.
CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Of many byte ranges at once; zeros before a range leave a checksum that starts at 0 as it is."""
    width = int((ends - starts).max(initial=0))
    places = ends[None, :] - width + np.arange(width)[:, None]
    columns = np.where(places >= starts[None, :], data[np.maximum(places, 0)], 0).astype(np.uint32)
    crc = np.zeros(len(starts), np.uint32)
    low = np.uint32((1 << bits) - 1)
    for column in columns:
        crc = table[(crc >> np.uint32(bits - 8)) ^ column] ^ (crc << np.uint32(8) & low)
    return crc


def _number(value: int) -> bytes:
    """A frame number in the format's extended UTF-8 form."""
    if value < 0x80:
        return bytes([value])
    out = []
    size = next(n for n in range(2, 8) if value < 1 << (5 * n + 1) or n == 7)
    for _ in range(size - 1):
        out.append(0x80 | value & 0x3F)
        value >>= 6
    return bytes([(0xFF00 >> size) & 0xFF | value, *reversed(out)])


def _residuals(samples: np.ndarray, order: int) -> np.ndarray:
    return np.diff(samples, n=order, axis=1) if order else samples


def _folded(x: np.ndarray) -> np.ndarray:
    return (x << 1) ^ (x >> 31)


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Frames of samples (int32, a row of BLOCK for each frame) with the given numbers; their bytes and starts, with the end
    of the last. Each frame takes the shortest of constant, verbatim and fixed predictors of order 0 to 2."""
    count = len(samples)
    rows = np.arange(count)
    best = np.full(count, 8 * BLOCK)
    kind, parameter = np.full(count, VERBATIM), np.zeros(count, np.int64)
    for order in range(3):
        folded = _folded(_residuals(samples, order))
        first = np.maximum(np.floor(np.log2(np.maximum(folded.mean(1) * 0.69, 1))).astype(np.int64), 0)
        for k in (first, first + 1):
            size = 10 + 8 * order + (folded >> k[:, None].astype(np.int32)).sum(1) + (k + 1) * (BLOCK - order)
            better = size < best
            best[better], kind[better], parameter[better] = size[better], FIXED + order, k[better]
    constant = (samples == samples[:, :1]).all(1)
    best[constant], kind[constant] = 8, CONSTANT
    order = np.where(kind >= FIXED, kind - FIXED, 0)

    # Every sample's code: zeros, then the lowest `wide` bits of `code`.
    code, wide, zeros = (samples & 0xFF).astype(np.int64), np.full(samples.shape, 8, np.int64), np.zeros(samples.shape, np.int64)
    wide[constant, 1:] = 0
    code[constant, 1:] = 0
    for o in range(3):
        of = rows[kind == FIXED + o]
        if len(of):
            folded, k = _folded(_residuals(samples[of], o)).astype(np.int64), parameter[of][:, None]
            code[of, o:] = folded & ((1 << k) - 1) | 1 << k
            wide[of, o:] = k + 1
            zeros[of, o:] = folded >> k
    # The Rice header of 10 bits stands before the first residual: method 0, one partition, parameter.
    extra = np.where(kind >= FIXED, 10, 0)
    heads = [_number(n) for n in numbers.tolist()]
    head_size = np.array([4 + len(h) + 1 for h in heads])
    total = head_size + 1 + (best + 7) // 8 + 2
    starts = np.concatenate([[0], np.cumsum(total)])
    lengths = zeros + wide
    lengths[rows, order] += extra
    ends = np.cumsum(lengths, 1) + (8 * (starts[:-1] + head_size + 1))[:, None]
    words = np.zeros(int(starts[-1]) // 4 + 4)

    def put(at: np.ndarray, value: np.ndarray, bits: np.ndarray) -> None:
        lane = value.astype(np.uint64) << (64 - (at & 31) - bits).astype(np.uint64)
        word = at >> 5
        words[:] += np.bincount(word, (lane >> np.uint64(32)).astype(np.float64), len(words))
        words[:] += np.bincount(word + 1, (lane & np.uint64(0xFFFFFFFF)).astype(np.float64), len(words))

    used = wide > 0
    put((ends - wide)[used], code[used], wide[used])
    coded = rows[kind >= FIXED]
    if len(coded):
        o = order[coded]
        put((ends[coded, o] - lengths[coded, o]), parameter[coded], np.full(len(coded), 10))
    data = np.frombuffer(words.astype(np.uint64).astype(">u4").tobytes(), np.uint8)[: starts[-1]].copy()
    for i, head in enumerate(heads):
        fixed = bytes([0xFF, 0xF8, 0x24, 0x02]) + head
        data[starts[i] : starts[i] + len(fixed)] = np.frombuffer(fixed, np.uint8)
    data[starts[:-1] + head_size - 1] = _checksums(data, starts[:-1], starts[:-1] + head_size - 1, CRC8, 8)
    data[starts[:-1] + head_size] = kind << 1
    crc = _checksums(data, starts[:-1], starts[1:] - 2, CRC16, 16)
    data[starts[1:] - 2], data[starts[1:] - 1] = crc >> 8, crc & 0xFF
    return data.tobytes(), starts


def stream(frames: bytes, starts: list[int], samples: int, md5: bytes) -> bytes:
    """A FLAC file of frames: stream information, a seek point for each block, frames."""
    sizes = [b - a for a, b in zip(starts, [*starts[1:], len(frames)], strict=True)]
    info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes, default=0).to_bytes(3, "big") + max(sizes, default=0).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | samples).to_bytes(8, "big") + md5
    points = b"".join(struct.pack(">QQH", i * BLOCK, at, BLOCK) for i, at in enumerate(starts))
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(points).to_bytes(3, "big") + points + frames


class Stream:
    """The metadata of a FLAC file: samples, md5, bits, seek points (sample, byte) and where its frames begin."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, self.points = 4, False, []
        while not last:
            last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + size]
            if kind == 0:
                self.block = struct.unpack_from(">H", body)[0]
                rest = int.from_bytes(body[10:18], "big")
                self.samples, self.bits, self.channels = rest & (1 << 36) - 1, (rest >> 36 & 31) + 1, (rest >> 41 & 7) + 1
                self.md5 = body[18:34]
            elif kind == 3:
                self.points = [p[:2] for p in struct.iter_unpack(">QQH", body) if p[0] != 2**64 - 1]
            at += 4 + size
        if self.channels != 1 or self.bits != 8:
            raise ValueError("only mono streams of 8-bit samples are read")
        self.first = at


def decode_frames(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(samples, frame numbers, ends) of the frames that start at the given bytes, all of BLOCK samples; ValueError if a
    checksum is wrong."""
    if not len(starts):
        return np.zeros((0, BLOCK), np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    if not ((padded[starts] == 0xFF) & (padded[starts + 1] & 0xFE == 0xF8) & (padded[starts + 2] >> 4 == 2)).all():
        raise ValueError("no frame of 576 samples starts here")
    lead = padded[starts + 4].astype(np.int64)
    size = 1 + sum((lead >= bound).astype(np.int64) for bound in (0xC0, 0xE0, 0xF0, 0xF8, 0xFC, 0xFE))
    number = np.where(size == 1, lead, lead & (0x7F >> size))
    for i in range(1, int(size.max())):
        number = np.where(i < size, number << 6 | padded[np.minimum(starts + 4 + i, len(padded) - 1)] & 0x3F, number)
    head = starts + 4 + size
    if (_checksums(padded, starts, head, CRC8, 8) != padded[head]).any():
        raise ValueError("a frame header's CRC-8 is wrong")
    kinds = padded[head + 1] >> 1
    bits = np.unpackbits(padded)
    places = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(len(bits) - 1))
    following = np.minimum.accumulate(places[::-1])[::-1]  # the next 1 from each bit on
    triple = padded[:-3].astype(np.uint32) << np.uint32(16) | padded[1:-2].astype(np.uint32) << np.uint32(8) | padded[2:-1]
    limit, top = len(triple) - 1, len(bits) - 1

    def read(at: np.ndarray, wide: np.ndarray | int) -> np.ndarray:
        """Up to 16 bits from each position."""
        return (triple[np.minimum(at >> 3, limit)].astype(np.int64) >> (24 - (at & 7) - wide)) & ((1 << wide) - 1)

    def signed(value: np.ndarray, wide: int) -> np.ndarray:
        return value - ((value >> (wide - 1)) << wide)

    out, ends = np.zeros((len(starts), BLOCK), np.int64), np.zeros(len(starts), np.int64)
    precisions = np.zeros(len(starts), np.int64)  # predictors of one order may differ in it: they are read apart
    for kind in np.unique(kinds[kinds >= LPC]).tolist():
        of = np.flatnonzero(kinds == kind)
        precisions[of] = read((head[of] + 2) * 8 + 8 * (kind - LPC + 1), 4) + 1
        if (precisions[of] == 16).any():
            raise ValueError("a predictor's precision is invalid")
    for kind, precision in sorted(set(zip(kinds.tolist(), precisions.tolist(), strict=True))):
        of = np.flatnonzero((kinds == kind) & (precisions == precision))
        at = (head[of] + 2) * 8
        if kind == CONSTANT:
            out[of], at = signed(read(at, 8), 8)[:, None], at + 8
        elif kind == VERBATIM:
            out[of] = padded[(at >> 3)[:, None] + np.arange(BLOCK)].astype(np.int8)
            at = at + 8 * BLOCK
        elif FIXED <= kind <= FIXED + 4 or kind >= LPC:
            order = kind - FIXED if kind < LPC else kind - LPC + 1
            values = np.zeros((BLOCK, len(of)), np.int64)
            for i in range(order):
                values[i], at = signed(read(at, 8), 8), at + 8
            weights, shift = None, 0
            if kind >= LPC:
                shift, at = read(at + 4, 5), at + 9
                weights = np.zeros((order, len(of)), np.int64)
                for i in range(order):
                    weights[i], at = signed(read(at, precision), precision), at + precision
            method, splits = read(at, 2), read(at + 2, 4)
            if (method > 1).any():
                raise ValueError("unknown code of residuals")
            at = at + 6
            for wide, split in sorted(set(zip((4 + method).tolist(), splits.tolist(), strict=True))):
                group = np.flatnonzero((method == wide - 4) & (splits == split))
                here, partition, escape = at[group], BLOCK >> split, (1 << wide) - 1
                k, raw = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
                if partition <= order:
                    raise ValueError("a partition is shorter than the predictor")
                for i in range(order, BLOCK):
                    if i == order or i % partition == 0:
                        k, here = read(here, wide), here + wide
                        plain = k == escape  # residuals as they are, in so many bits
                        raw = np.where(plain, read(here, 5), 0)
                        here = here + 5 * plain
                        if (raw > 16).any() or (k[~plain] > 16).any():
                            raise ValueError("residuals of more than 16 bits don't belong to 8-bit samples")
                    stop = following[np.minimum(here, top)].astype(np.int64)
                    low = np.where(plain, 0, k)
                    folded = (stop - here) << low | read(stop + 1, low)
                    values[i, group], after = (folded >> 1) ^ -(folded & 1), stop + 1 + low
                    if plain.any():
                        value = read(here, raw)
                        whole = np.where(raw > 0, value - ((value >> np.maximum(raw - 1, 0)) << raw), 0)
                        values[i, group], after = np.where(plain, whole, values[i, group]), np.where(plain, here + raw, after)
                    here = after
                at[group] = here
            if kind < LPC:  # a fixed predictor of order o is undone by o running sums
                for o in range(order, 0, -1):
                    values = _sum_from(values, order, o)
            else:
                for i in range(order, BLOCK):
                    values[i] += (weights * values[i - order : i][::-1]).sum(0) >> shift
            out[of] = values.T
        else:
            raise ValueError(f"unknown subframe type {kind}")
        ends[of] = (at + 7) // 8 + 2
    if (ends > len(data)).any():
        raise ValueError("a frame ends beyond the data")
    if (_checksums(padded, starts, ends - 2, CRC16, 16) != (padded[ends - 2].astype(np.uint32) << np.uint32(8) | padded[ends - 1])).any():
        raise ValueError("a frame's CRC-16 is wrong")
    return out.astype(np.int32), number, ends


def _sum_from(values: np.ndarray, order: int, level: int) -> np.ndarray:
    """From the level-th differences after the warm-up samples to the differences one level lower."""
    warm = values[:order].copy()
    last = np.diff(warm, n=level - 1, axis=0)[-1] if level > 1 else warm[-1]
    values = values.copy()
    values[order:] = np.cumsum(values[order:], axis=0) + last
    return values


def payload(text: bytes | None) -> bytes:
    """A text's bytes, then bytes 255 up to a positive multiple of BLOCK."""
    text = text or b""
    return text + b"\xff" * (-len(text) % BLOCK if text else BLOCK)


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A FLAC file of each payload: byte b is sample b - 128."""
    blocks = [len(p) // BLOCK for p in payloads]
    samples = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128).reshape(-1, BLOCK)
    numbers = np.concatenate([np.arange(n) for n in blocks] or [np.zeros(0, int)])
    pieces, starts, base = [], [], 0
    for at in range(0, len(samples), BATCH):
        data, begins = encode_frames(samples[at : at + BATCH], numbers[at : at + BATCH])
        pieces.append(data)
        starts.append(begins[:-1] + base)
        base += len(data)
    data, starts = b"".join(pieces), np.concatenate([*starts, [base]]).astype(np.int64)
    files, row = [], 0
    for raw, n in zip(payloads, blocks, strict=True):
        begin, end = int(starts[row]), int(starts[row + n])
        md5 = hashlib.md5(raw.translate(_SIGNED)).digest()
        files.append(stream(data[begin:end], (starts[row : row + n] - begin).tolist(), len(raw), md5))
        row += n
    return files


_SIGNED = bytes((b - 128) % 256 for b in range(256))


def decode_many(files: list[bytes]) -> list[bytes]:
    """The payloads of FLAC files, verified. Files with a seek point for each block are decoded together, block by block at
    once; others frame after frame. Each frame has to bear the number of its place."""
    heads = [Stream(f) for f in files]
    count = [-(-h.samples // BLOCK) for h in heads]
    whole = [[p[0] for p in h.points] == [*range(0, n * BLOCK, BLOCK)] for h, n in zip(heads, count, strict=True)]
    bases = np.cumsum([0, *map(len, files)])
    data = np.frombuffer(b"".join(files), np.uint8)
    places = [np.array([p[1] for p in h.points] if ok else (), np.int64) + h.first + base for h, base, ok in zip(heads, bases, whole, strict=False)]
    starts = np.concatenate([*places, np.zeros(0, np.int64)])
    wanted = np.concatenate([*(np.arange(len(p)) for p in places), np.zeros(0, np.int64)])
    pieces, at = [], 0
    while at < len(starts):
        until = min(len(starts), at + BATCH)
        low = int(starts[at])
        high = int(starts[until]) if until < len(starts) else len(data)
        samples, numbers, _ = decode_frames(data[low:high], starts[at:until] - low)
        if (numbers != wanted[at:until]).any():
            raise ValueError("a frame stands at another's place")
        pieces.append((samples + 128).astype(np.uint8).tobytes())
        at = until
    together, out, row = b"".join(pieces), [], 0
    for file, head, ok in zip(files, heads, whole, strict=True):
        if ok:
            size = len(head.points) * BLOCK
            raw, row = together[row : row + size][: head.samples], row + size
        else:
            raw = _in_turn(np.frombuffer(file, np.uint8)[head.first :], 0, 0, head.samples)
        if hashlib.md5(raw.translate(_SIGNED)).digest() != head.md5:
            raise ValueError("the samples' MD5 is wrong")
        out.append(raw)
    return out


def _in_turn(frames: np.ndarray, at: int, begin: int, until: int) -> bytes:
    """Payload bytes [begin, until) from the frame at a byte that has sample `begin` first."""
    out, position = [], begin
    while position < until:
        samples, numbers, ends = decode_frames(frames, np.array([at]))
        if numbers[0] * BLOCK != position:
            raise ValueError("a frame stands at another's place")
        out.append((samples + 128).astype(np.uint8).tobytes())
        position, at = position + BLOCK, int(ends[0])
    return b"".join(out)[: until - begin]


def read_samples(file: bytes, first: int, count: int) -> bytes:
    """Payload bytes [first, first + count): decoding starts at the seek point before and ends with the last block needed."""
    head = Stream(file)
    begin, at = max((p for p in head.points if p[0] <= first), default=(0, 0))
    until = min(first + count, head.samples)
    return _in_turn(np.frombuffer(file, np.uint8)[head.first :], at, begin, max(until, begin))[first - begin :]


def _groups(values: list[bytes], most: int = 1_500_000) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(values):
        until, total = at, 0
        while until < len(values) and (until == at or total + len(values[until]) <= most):
            total += len(values[until])
            until += 1
        yield at, until
        at = until


def store(docs: DataFrame) -> DataFrame:
    """Returns for each row of docs: doc_id, n_bytes (of the text, null counts as empty), media (the FLAC file of its payload).
    Equal texts give equal files; other columns are ignored."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = [t or b"" for t in utf8(batch.column(1))]
            for at, until in _groups(texts):
                media = encode_many([payload(t) for t in texts[at:until]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, until - at), pa.array([*map(len, texts[at:until])], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return modest_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, "doc_id long, n_bytes long, media binary")


def blocks(media: DataFrame) -> DataFrame:
    """PCM blocks of stored media: doc_id, first_sample, pcm (payload bytes); readers can seek by first_sample."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for doc_id, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = decode_many([file])[0]
                firsts = range(0, len(raw), BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(firsts), pa.int64()), pa.array(firsts, pa.int64()), pa.array([raw[i : i + BLOCK] for i in firsts], pa.binary())], ["doc_id", "first_sample", "pcm"])

    return media.select("doc_id", "media").mapInArrow(batches, "doc_id long, first_sample long, pcm binary")


def feature(raw: bytes) -> str:
    """Mean, root mean square and rate of sign changes of the samples."""
    samples = np.frombuffer(raw, np.uint8).astype(np.int64) - 128
    changes = int(np.count_nonzero(np.diff(np.signbit(samples))))
    return f"mean={samples.mean():.6f};rms={np.sqrt((samples * samples).mean()):.6f};zcr={changes / max(1, len(samples) - 1):.6f}"


def describe(media: DataFrame) -> DataFrame:
    """Reads stored media back. Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 32 payload
    bytes), media_bytes, media_sha256, feature. A damaged file raises."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            files = batch.column(2).to_pylist()
            for at, until in _groups(files):
                part = files[at:until]
                rows = [(len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(f), hashlib.sha256(f).hexdigest(), feature(raw)) for f, raw in zip(part, decode_many(part), strict=True)]
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, until - at), batch.column(1).slice(at, until - at), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(batches, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
