"""Keep rules over parts, and joining what is kept in one pass: no shuffle, no copy for each part."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.operators.entries import IMAGE_RULE, META_ITEM, TIFF, VIDEO_RULE
from partwise.functions.text import local_name, lowered
from partwise.operators.svg import URL_NAMES, stays
from partwise.operators.walk import arrow_schema, bounded, parts_array, parts_of, slices
from partwise.walkers import Damaged
from partwise.walkers.audio import CODECS, header_packets, page_crc, pages
from partwise.walkers.part import PARTS
from partwise.walkers.tiff import minimal_exif

_META = "exists(parts, i -> i.num = x.num and " + META_ITEM.format(i="i") + ")"
#: Items whose extents can all be found, less those with one that cannot.
_CLEARED = "exists(parts, e -> e.kind = 'EXTENT' and e.num = x.num and e.size >= 0) and not exists(parts, e -> e.kind = 'EXTENT' and e.num = x.num and e.size < 0)"
_TIFF = ", ".join(map(str, TIFF))
#: What each format keeps (SQL over a part x).
KEEP = {
    "jpeg": "x.kind in ('SOI', 'EOI', 'FFEE') or (x.kind = 'FFE2' and startswith(x.data, cast('ICC_PROFILE' as binary))) or (startswith(x.kind, 'FF') and not x.kind rlike '^FFE[0-9A-F]$' and x.kind <> 'FFFE')",
    "png": "x.kind in ('SIGNATURE', 'IHDR', 'PLTE', 'IDAT', 'IEND', 'tRNS', 'sRGB', 'gAMA', 'cHRM', 'iCCP', 'acTL', 'fcTL', 'fdAT')",
    "webp": "x.kind in ('RIFF', 'VP8 ', 'VP8L', 'VP8X', 'ALPH', 'ANIM', 'ANMF', 'ICCP')",
    "wav": "x.kind in ('RIFF', 'fmt ', 'data', 'fact')",
    "gif": "x.kind in ('SCREEN', 'IMAGE', 'TRAILER', 'EXT:F9', 'EXT:01') or (x.kind = 'EXT:FF' and x.text is not null and substring(x.data, 1, 11) in (cast('NETSCAPE2.0' as binary), cast('ANIMEXTS1.0' as binary)))",
    "flac": "x.kind in ('fLaC', 'BLOCK:0', 'BLOCK:1', 'BLOCK:3', 'AUDIO')",
    "mp3": "x.kind = 'AUDIO'",
    "ogg": "x.kind in ('HEADER', 'AUDIO')",
    "tiff": f"x.kind in ('FILE', 'IFD') or (x.kind in ('TAG', 'VALUE') and x.num not in ({_TIFF}))",
    "mp4": f"not ({VIDEO_RULE} or x.kind like 'TIME:%')",
    "heic": f"not ({IMAGE_RULE}) and not (x.kind = 'EXTENT' and {_META}) and not (x.kind like 'ITEM:%' and {META_ITEM.format(i='x')} and {_CLEARED})",
}
KEEP |= {"mov": KEEP["mp4"], "avif": KEEP["heic"], "heif": KEEP["heic"]}
MARKS = "array<struct<kind:string,offset:long,size:long,n:long,num:long,sub:boolean,text:string,keep:boolean>>"


def marks(types: Iterable[str] | None = None) -> Column:
    """The parts without what they carry, each marked by whether it stays; ``types`` leaves out those that cannot occur."""
    rows = _marks()
    if types is not None and "svg" not in types:
        return rows
    fields = lambda x: [x[f].alias(f) for f in ("kind", "offset", "size", "n", "num", "sub")]
    # Of the values only addresses are read again, which may hold an image.
    address = lambda x: F.when((x["kind"] == "ATTRIBUTE") & lowered(local_name(x["text"])).isin(*URL_NAMES), x["data"].cast("string"))
    svg = F.transform("parts", lambda x: F.struct(*fields(x), address(x).alias("text"), F.coalesce(stays(x), F.lit(False)).alias("keep")))
    return F.when(F.col("file_type") == "svg", svg.cast(MARKS)).otherwise(rows.cast(MARKS))


def _marks() -> Column:
    arms = " ".join(f"when '{t}' then coalesce({k}, false)" for t, k in KEEP.items())
    fields = ", ".join(f"'{f}', x.{f}" for f in ("kind", "offset", "size", "n", "num", "sub"))
    return F.expr(f"transform(parts, x -> named_struct({fields}, 'text', if(x.kind in ('FILE', 'FAULT'), x.text, null), 'keep', case file_type {arms} else false end))")


Mark = dict


def _copy(b: bytes, own: list[Mark]) -> list[bytes]:
    return [b[m["offset"] : m["offset"] + m["size"]] for m in own if m["keep"] and not m["sub"]]


def _jpeg(b: bytes, own: list[Mark]) -> bytes:
    """An orientation other than the usual one comes back in an Exif segment of its own."""
    start, *rest = _copy(b, own)
    turn = next((m["num"] for m in own if m["kind"] == "ORIENTATION"), 1)
    body = minimal_exif(turn)
    return b"".join([start, b"\xff\xe1" + (len(body) + 2).to_bytes(2) + body if turn != 1 else b"", *rest])


def _riff(b: bytes, own: list[Mark]) -> bytes:
    """Sizes and padding anew; a WebP header loses its Exif and XMP flags."""
    chunks = []
    for m in own:
        if m["keep"] and not m["sub"] and m["kind"] != "RIFF":
            raw = b[m["offset"] : m["offset"] + 8 + m["n"]] + bytes(m["n"] & 1)
            chunks.append(raw[:8] + bytes([raw[8] & 0xF3]) + raw[9:] if m["kind"] == "VP8X" and m["n"] else raw)
    body = b[8:12] + b"".join(chunks)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def _flac(b: bytes, own: list[Mark]) -> bytes:
    """The last block that stays is marked as the last."""
    out = [(m["kind"], raw) for m, raw in zip([m for m in own if m["keep"] and not m["sub"]], _copy(b, own), strict=True)]
    last = max(k for k, (kind, _) in enumerate(out) if kind.startswith("BLOCK"))
    return b"".join(bytes([raw[0] & 0x7F | 0x80 * (k == last)]) + raw[1:] if kind.startswith("BLOCK") else raw for k, (kind, raw) in enumerate(out))


def _ogg(b: bytes, own: list[Mark]) -> bytes:
    """An empty comment packet in place of the old one: header pages are laid out again, and all pages numbered and summed anew."""
    if not any(m["kind"] == "COMMENTS" for m in own):
        return b
    found = pages(b)
    lead, count, end = next(v for k, v in CODECS.items() if found[0].body.startswith(k))
    packets, sound = header_packets(found, count)
    packets[0] = lead + bytes(8) + end
    laces = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets)
    body, out, at, goes_on = b"".join(packets), [found[0].raw], 0, False

    def add(head: bytes, rest: bytes) -> None:
        page = head[:18] + len(out).to_bytes(4, "little") + bytes(4) + rest
        out.append(page[:22] + page_crc(page).to_bytes(4, "little") + page[26:])

    for k in range(0, len(laces), 255):
        own_laces = laces[k : k + 255]
        n = sum(own_laces)
        add(b"OggS\0" + bytes([goes_on]) + bytes(8) + found[0].raw[14:18], bytes([len(own_laces)]) + own_laces + body[at : at + n])
        at, goes_on = at + n, own_laces[-1] == 255
    for page in found[sound:]:
        add(page.raw, page.raw[26:])
    return b"".join(out)


def _sound(own: list[Mark]) -> None:
    """Damage that reading passes over ends cleaning."""
    fault = next((m["text"] for m in own if m["kind"] == "FAULT"), None)
    if fault:
        raise Damaged(fault)


def _tiff(b: bytes, own: list[Mark]) -> bytes:
    """In place: values that go become zero, and directories close up around the fields that stay."""
    _sound(own)
    out = bytearray(b)
    order = own[0]["text"]

    def blank(at: int, n: int) -> None:
        if at + n <= len(out):
            out[at : at + n] = bytes(n)

    for m in own:
        if m["kind"] in ("VALUE", "SUBVALUE") and not m["keep"]:
            blank(m["offset"], m["size"])
    for m in own:
        if m["kind"] == "SUBIFD":
            blank(m["offset"], m["size"])
    for m in own:
        if m["kind"] == "IFD":
            at, size = m["offset"], m["size"]
            kept = [b[f["offset"] : f["offset"] + 12] for f in own if f["kind"] == "TAG" and f["keep"] and at + 2 <= f["offset"] < at + size - 4]
            fresh = len(kept).to_bytes(2, order) + b"".join(kept) + b[at + size - 4 : at + size]
            out[at : at + size] = fresh + bytes(size - len(fresh))
    return bytes(out)


def _boxes(b: bytes, own: list[Mark]) -> bytes:
    """In place: boxes that go become ``free``, times and extents become zero, cleared items are renamed."""
    _sound(own)
    out = bytearray(b)
    for m in own:
        if m["keep"] or m["size"] < 0:
            continue
        at, size = m["offset"], m["size"]
        out[at : at + size] = bytes(size)
        if m["kind"].startswith("BOX:"):
            out[at : at + 8] = (size & 0xFFFFFFFF).to_bytes(4) + b"free"
        elif m["kind"].startswith("ITEM:"):
            out[at : at + 4] = b"free"
    return bytes(out)


JOIN: dict[str, Callable[[bytes, list[Mark]], bytes]] = {
    "jpeg": _jpeg, "webp": _riff, "wav": _riff, "flac": _flac, "ogg": _ogg, "tiff": _tiff, "mp4": _boxes, "mov": _boxes, "heic": _boxes, "heif": _boxes, "avif": _boxes,
    **dict.fromkeys(("png", "gif", "mp3"), lambda b, own: b"".join(_copy(b, own))),
}


#: What an SVG with images in data addresses answers: they are files of their own.
PACKAGED_IMAGE = "Cleaning of images in data addresses is not supported"
_DATA_IMAGE = re.compile(r"\s*[\"']*\s*data:[^,]*;base64,", re.I)


def _svg(b: bytes, own: list[Mark]) -> bytes:
    """The text outside the union of the ranges that go."""
    out, at = [], own[0]["offset"]
    for m in sorted(own[1:], key=lambda m: m["offset"]):
        if m["keep"]:
            if m["text"] and m["offset"] >= at and _DATA_IMAGE.match(m["text"]):
                raise Damaged(PACKAGED_IMAGE)
            continue
        if m["offset"] > at:
            out.append(b[at : m["offset"]])
        at = max(at, m["offset"] + m["size"])
    return b"".join([*out, b[at:]])


JOIN["svg"] = _svg


def joined(file_type: str, error: str | None, content: bytes | None, own: list[Mark]) -> tuple[str | None, bytes | None]:
    """(error, cleaned bytes) of one file."""
    if error is not None:
        return error, None
    if file_type not in JOIN:
        return f"Cleaning of {file_type} files is not supported", None
    try:
        return None, JOIN[file_type](content or b"", own)
    except Damaged as e:
        return str(e), None


def clean(walked: DataFrame, key: str = "path", again: bool = False, types: Iterable[str] | None = None) -> DataFrame:
    """(key, file_type, error, cleaned, removed_bytes) from ``walk`` with content; ``cleaned`` is null where the file has an error.

    RIFF files get their size and padding anew, a WebP header loses its Exif and
    XMP flags, JPEG keeps its orientation, the last FLAC block is marked; TIFF
    and ISO media keep their length; an SVG that holds images in data addresses
    answers with an error. ``types`` are the file types that can occur, all if
    not given. With ``again``, the cleaned bytes are walked
    in the same pass: ``again_error`` and ``parts`` of what is left.
    """
    kind = walked.schema[key].dataType.simpleString()
    more = f", again_error string, parts {PARTS}" if again else ""
    told = f"{key} {kind}, file_type string, error string, cleaned binary, removed_bytes long{more}"
    schema = arrow_schema(told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            types, errors, contents, own = (batch.column(k).to_pylist() for k in range(1, 5))
            done = [joined(*row) for row in zip(types, errors, contents, own, strict=True)]
            gone = [None if c is None else len(b or b"") - len(c) for (_, c), b in zip(done, contents, strict=True)]
            columns = [batch.column(0), batch.column(1), pa.array([e for e, _ in done], pa.string()), pa.array([c for _, c in done], pa.binary()), pa.array(gone, pa.int64())]
            if again:
                left = [parts_of(t, c) if c is not None else (None, []) for t, (_, c) in zip(types, done, strict=True)]
                columns += [pa.array([e for e, _ in left], pa.string()), parts_array([p for _, p in left], schema.field("parts").type)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return bounded(walked.select(key, "file_type", "error", "content", marks(types).cast(MARKS).alias("marks"))).mapInArrow(run, told)
