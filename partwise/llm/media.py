"""Media columns: AVI with intra-coded JPEG frames, read through its RIFF index, with shots and timed clips.

Texts are stored as 8-bit grey samples in frames of the lossless JPEG process
(SOF3, predictor 1). The Huffman table gives a difference of category c a code
of 9 - c bits, so every sample takes nine bits and a whole batch is coded and
decoded with array operations.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from partwise.llm.common import map_batches, texts

WIDTH, HEIGHT = 64, 16
FRAME = WIDTH * HEIGHT
MICROS = 40_000
BINS = 16
#: A cut needs a histogram distance (0 to 2) above the mean of the last WINDOW
#: distances by SPREAD standard deviations, and above FLOOR.
WINDOW, SPREAD, FLOOR = 8, 3.0, 0.15
#: Distances that stand before the first ones, so that a cut at frame 1 or 2 has a threshold too.
PRIOR = (0.0, 0.3)
#: Samples coded at once; bounds the memory of a task.
SAMPLES = 1 << 20

_DIFF = np.arange(-255, 256)
_CAT = np.array([int(abs(d)).bit_length() for d in _DIFF])
_EXTRA = np.where(_DIFF >= 0, _DIFF, _DIFF + (1 << _CAT) - 1)
_CODE = ((((1 << (9 - _CAT)) - 2) << _CAT) | _EXTRA).astype(np.uint16)
_BITS = ((_CODE[:, None] >> np.arange(8, -1, -1)) & 1).astype(np.uint8)
_BACK = np.full(512, 999, np.int16)
_BACK[_CODE] = _DIFF

#: Marker segments before the coded data: SOI, SOF3, DHT (one symbol for each length from 1 to 9), SOS with predictor 1.
_HEAD = (
    b"\xff\xd8"
    + b"\xff\xc3" + struct.pack(">HBHHB3B", 11, 8, HEIGHT, WIDTH, 1, 1, 0x11, 0)
    + b"\xff\xc4" + struct.pack(">HB16B9B", 28, 0, *[1] * 9, *[0] * 7, *range(8, -1, -1))
    + b"\xff\xda" + struct.pack(">HB2B3B", 8, 1, 1, 0, 1, 0, 0)
)
_END = b"\xff\xd9"


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG bytes of frames given as (n, HEIGHT, WIDTH) uint8."""
    x = samples.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    packed = np.packbits(_BITS[(d + 255).reshape(len(x), FRAME)].reshape(len(x), -1), axis=1)
    return [_HEAD + row.tobytes().replace(b"\xff", b"\xff\x00") + _END for row in packed]


def segments(jpeg: bytes) -> tuple[tuple[int, int], dict[int, tuple[int, int]], bytes]:
    """((height, width), {code with a leading 1 bit: (length, category)}, coded data) of a frame, from its own segments.

    Raises ValueError unless it is a frame of the lossless process with one
    8-bit component and predictor 1.
    """
    at, size, table = 2, None, {}
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("frame has no SOI")
    while True:
        if at + 4 > len(jpeg):
            raise ValueError("frame ends before its data")
        marker, length = struct.unpack_from(">HH", jpeg, at)
        body = jpeg[at + 4 : at + 2 + length]
        if marker == 0xFFC3:
            bits, height, width, components = struct.unpack_from(">BHHB", body)
            if bits != 8 or components != 1:
                raise ValueError("frame has not one 8-bit component")
            size = (height, width)
        elif marker == 0xFFC4:
            code, k = 0, 17
            for n, count in enumerate(body[1:17], 1):
                for _ in range(count):
                    table[1 << n | code] = (n, body[k])
                    code, k = code + 1, k + 1
                code <<= 1
        at += 2 + length
        if marker == 0xFFDA:
            if body[0] != 1 or body[3] != 1:
                raise ValueError("scan has not one component with predictor 1")
            break
    if size is None or jpeg[-2:] != _END:
        raise ValueError("frame has no size or no end")
    return size, table, jpeg[at:-2].replace(b"\xff\x00", b"\xff")


def _differences(table: dict[int, tuple[int, int]], coded: bytes, count: int) -> np.ndarray:
    """Differences of ``count`` samples, code by code: for any Huffman table."""
    bits = np.unpackbits(np.frombuffer(coded, np.uint8)).tolist()
    out, at = [], 0
    for _ in range(count):
        code = 1
        while code not in table:
            if at >= len(bits) or code > 1 << 16:
                raise ValueError("code outside the table")
            code, at = code << 1 | bits[at], at + 1
        category = table[code][1]
        if at + category > len(bits):
            raise ValueError("data end inside a sample")
        value = 0
        for b in bits[at : at + category]:
            value = value << 1 | b
        at += category
        out.append(value if not category or value >> (category - 1) else value - (1 << category) + 1)
    return np.array(out, np.int32)


#: The table that ``encode_frames`` writes: a code and its sample take nine bits together, so whole arrays are decoded at once.
_OWN = {(1 << n) | ((1 << n) - 2): (n, 9 - n) for n in range(1, 10)}


def decode_frames(jpegs: list[bytes]) -> np.ndarray:
    """Samples (n, height, width) of lossless JPEG frames of one size, by the Huffman tables that the frames bring."""
    read = [segments(j) for j in jpegs]
    height, width = read[0][0]
    if any(size != (height, width) for size, _, _ in read):
        raise ValueError("frames differ in size")
    d = np.empty((len(read), height * width), np.int32)
    quick = [k for k, (_, table, coded) in enumerate(read) if table == _OWN and len(coded) * 8 == 9 * height * width]
    if quick:
        bits = np.unpackbits(np.frombuffer(b"".join(read[k][2] for k in quick), np.uint8)).reshape(-1, 9)
        words = (bits[:, 0].astype(np.uint16) << 8) | np.packbits(bits[:, 1:], axis=1)[:, 0]
        d[quick] = _BACK[words].reshape(len(quick), -1)
        if (d[quick] == 999).any():
            raise ValueError("code outside the table")
    for k in set(range(len(read))) - set(quick):
        d[k] = _differences(read[k][1], read[k][2], height * width)
    d = d.reshape(len(read), height, width)
    d[:, 0, 0] += 128
    d[:, :, 0] = d[:, :, 0].cumsum(axis=1)
    return d.cumsum(axis=2).astype(np.uint8)


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def build_avi(frames: list[bytes], n_bytes: int) -> bytes:
    """An AVI file: headers, the payload length in an INFO list, the frames, and the idx1 index."""
    avih = struct.pack("<14I", MICROS, 0, 0, 0x10, len(frames), 0, 1, 0, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, MICROS, 1_000_000, 0, len(frames), 0, 0, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    strl = b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", strl)
    info = b"INFO" + _chunk(b"ICMT", str(n_bytes).encode() + b"\0")
    at, index, body = 4, [], [b"movi"]
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body.append(_chunk(b"00dc", f))
        at += len(body[-1])
    parts = _chunk(b"LIST", hdrl) + _chunk(b"LIST", info) + _chunk(b"LIST", b"".join(body)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(parts) + 4) + b"AVI " + parts


def parse_avi(avi: bytes) -> tuple[int, int, list[bytes]]:
    """(microseconds a frame, payload bytes, frames), the frames found through the index. Raises ValueError on a damaged file."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI " or struct.unpack_from("<I", avi, 4)[0] + 8 != len(avi):
        raise ValueError("not an AVI file")
    at, micros, n_bytes, movi, frames = 12, 0, 0, 0, []
    while at < len(avi):
        name, size = struct.unpack_from("<4sI", avi, at)
        if at + 8 + size > len(avi):
            raise ValueError("chunk beyond the end")
        kind = avi[at + 8 : at + 12] if name == b"LIST" else b""
        if kind == b"hdrl":
            micros = struct.unpack_from("<I", avi, at + 20)[0]
        elif kind == b"INFO":
            n_bytes = int(avi[at + 20 : at + 20 + struct.unpack_from("<I", avi, at + 16)[0]].rstrip(b"\0"))
        elif kind == b"movi":
            movi = at + 8
        elif name == b"idx1":
            for tag, _, start, length in struct.iter_unpack("<4sIII", avi[at + 8 : at + 8 + size]):
                if struct.unpack_from("<4sI", avi, movi + start) != (tag, length):
                    raise ValueError("index points beside a chunk")
                frames.append(avi[movi + start + 8 : movi + start + 8 + length])
        at += 8 + size + (size & 1)
    return micros, n_bytes, frames


def histograms(frames: np.ndarray) -> np.ndarray:
    """Grey histograms (n, BINS), each with the sum 1."""
    n = len(frames)
    at = (frames.reshape(n, FRAME) >> 4).astype(np.int64) + np.arange(n)[:, None] * BINS
    return np.bincount(at.ravel(), minlength=n * BINS).reshape(n, BINS) / FRAME


def cuts(hist: np.ndarray) -> list[int]:
    """Numbers of the frames that begin a shot, besides frame 0: adaptive threshold on histogram differences."""
    diffs = np.abs(np.diff(hist, axis=0)).sum(axis=1)
    found = []
    for i, d in enumerate(diffs):
        before = diffs[max(0, i - WINDOW) : i]
        before = before if len(before) >= len(PRIOR) else np.concatenate((PRIOR[len(before) :], before)) if len(before) else np.array(PRIOR)
        if d > FLOOR and d > before.mean() + SPREAD * before.std():
            found.append(i + 1)
    return found


def shots(hist: np.ndarray, micros: int) -> list[tuple[int, int, int, int]]:
    """(first frame, frame behind the last, start and end in milliseconds) of each shot."""
    edges = [0, *cuts(hist), len(hist)]
    return [(a, b, a * micros // 1000, b * micros // 1000) for a, b in zip(edges, edges[1:], strict=False)]


def _payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))


def _store(payloads: list[bytes]) -> list[bytes]:
    counts = [-(-len(p) // FRAME) for p in payloads]
    padded = b"".join(p + b"\0" * (c * FRAME - len(p)) for p, c in zip(payloads, counts, strict=True))
    frames = encode_frames(np.frombuffer(padded, np.uint8).reshape(-1, HEIGHT, WIDTH))
    out, at = [], 0
    for p, c in zip(payloads, counts, strict=True):
        out.append(build_avi(frames[at : at + c], len(p)))
        at += c
    return out


def _load(avis: list[bytes]) -> list[tuple[int, bytes, np.ndarray]]:
    parsed = [parse_avi(a) for a in avis]
    samples = decode_frames([f for _, _, fs in parsed for f in fs])
    out, at = [], 0
    for micros, n, fs in parsed:
        own = samples[at : at + len(fs)]
        at += len(fs)
        out.append((micros, own.tobytes()[:n], own))
    return out


def _groups(values: list, size) -> Iterator[list]:
    """Lists of values of about SAMPLES together; a larger value comes alone."""
    group, total = [], 0
    for v in values:
        group.append(v)
        total += size(v)
        if total >= SAMPLES:
            yield group
            group, total = [], 0
    if group:
        yield group


STORED = "doc_id long, n_bytes long, avi binary"


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, avi): each whole text as an AVI file. A null text is empty; every file has a frame at least."""

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            rows = ((i, *_payload(t)) for i, t in batch)
            for group in _groups(rows, lambda r: len(r[2])):
                yield [(i, n, avi) for (i, n, _), avi in zip(group, _store([r[2] for r in group]), strict=True)]

    return map_batches(texts(docs), STORED, run)


def clips(stored: DataFrame) -> DataFrame:
    """(doc_id, clip, start_ms, end_ms, frames, mean_grey): a row for each shot of each stored file."""

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            for group in _groups(batch, lambda r: len(r[1])):
                out = []
                for (i, _), (micros, _, own) in zip(group, _load([r[1] for r in group]), strict=True):
                    for k, (a, b, start, end) in enumerate(shots(histograms(own), micros)):
                        out.append((i, k, start, end, b - a, float(own[a:b].mean())))
                yield out

    return map_batches(stored.select("doc_id", "avi"), "doc_id long, clip int, start_ms long, end_ms long, frames int, mean_grey double", run)


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(docs: DataFrame) -> DataFrame:
    """Store each text, read the stored bytes back and describe both.

    Null and empty texts are 64 zero bytes. Equal texts have equal values.
    Feature: number of frames, and the clips (start and end in milliseconds, and
    the mean grey of their frames), from the decoded samples. Repeated rows are
    stored one by one; an empty table gives no rows.
    """

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            rows = ((i, *_payload(t)) for i, t in batch)
            for group in _groups(rows, lambda r: len(r[2])):
                avis = _store([r[2] for r in group])
                out = []
                loaded = _load(avis)
                hist = histograms(np.concatenate([x[2] for x in loaded]))
                grey = np.concatenate([x[2] for x in loaded]).reshape(-1, FRAME).mean(axis=1)
                at = 0
                for (i, n, _), avi, (micros, back, own) in zip(group, avis, loaded, strict=True):
                    k = len(own)
                    told = [f"{start}-{end}:{grey[at + a : at + b].mean():.3f}" for a, b, start, end in shots(hist[at : at + k], micros)]
                    feature = f"frames={k};clips={','.join(told)}"
                    at += k
                    out.append((i, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(avi), hashlib.sha256(avi).hexdigest(), feature))
                yield out

    return map_batches(texts(docs), DIGESTS, run)
