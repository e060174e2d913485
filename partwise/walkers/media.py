"""ISO base media: boxes of MP4 and MOV, items of HEIF and AVIF."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from partwise.walkers.part import Damaged, Part, graphic, u16, u32

MOST_BOXES, DEEPEST = 20_000, 8
#: Boxes that hold boxes.
HOLDERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf")


class Box(NamedTuple):
    kind: bytes
    start: int
    body: int
    end: int


def boxes(b: bytes, at: int, end: int) -> Iterator[Box]:
    """Boxes side by side."""
    count = 0
    while at < end:
        count += 1
        if count > MOST_BOXES:
            raise Damaged("ISO-BMFF file contains too many boxes")
        if at + 8 > end:
            raise Damaged("Truncated ISO-BMFF box")
        size, head = u32(b, at), 8
        if size == 1:
            if at + 16 > len(b):
                raise Damaged("Unexpected end of ISO-BMFF file")
            size, head = int.from_bytes(b[at + 8 : at + 16]), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise Damaged("Invalid ISO-BMFF box size")
        yield Box(b[at + 4 : at + 8], at, at + head, at + size)
        at += size


def _part(b: bytes, box: Box, told: bool = True) -> Part:
    """A box; only ``uuid`` boxes are searched for what they hold."""
    data = b[box.body : box.end] if box.kind == b"uuid" else None
    return Part("BOX:" + box.kind.decode("latin-1"), box.start, box.end - box.start, box.end - box.body, data, text=graphic(box.kind), told=told)


def video(b: bytes, faults: list[str]) -> Iterator[Part]:
    """Boxes with those inside holders as sub-parts, and the time fields (TIME: and the box) of headers. Damage below the top ends the walk without a fault, as a FAULT part."""

    def walk(at: int, end: int, depth: int) -> Iterator[Part]:
        if depth > DEEPEST:
            raise Damaged("ISO-BMFF nesting is too deep")
        for box in boxes(b, at, end):
            yield _part(b, box)._replace(sub=depth > 0)
            if box.kind in (b"mvhd", b"tkhd", b"mdhd") and b[box.body : box.body + 1] in (b"\0", b"\1"):
                n = 16 if b[box.body] else 8
                if box.body + 4 + n <= box.end:
                    set_ = any(b[box.body + 4 : box.body + 4 + n])
                    yield Part("TIME:" + box.kind.decode(), box.body + 4, n, n, text=graphic(box.kind), sub=True, told=set_)
            if box.kind in HOLDERS:
                yield from walk(box.body, box.end, depth + 1)

    for _ in boxes(b, 0, len(b)):
        pass
    yield Part("FILE", 0, len(b), told=False)
    try:
        yield from walk(0, len(b), 0)
    except Damaged as e:
        yield Part("FAULT", len(b), 0, text=str(e), sub=True, told=False)


def heif(b: bytes, faults: list[str]) -> Iterator[Part]:
    """Top boxes, then the items (ITEM: and the type; number and name) and extents (EXTENT, size -1 where one cannot be found) of ``meta``, and the first image size (SIZE)."""
    yield Part("FILE", 0, len(b), told=False)
    meta = None
    for box in boxes(b, 0, len(b)):
        yield _part(b, box)
        meta = box if box.kind == b"meta" else meta
    if meta is None:
        return
    try:
        inside = list(boxes(b, meta.body + 4, meta.end))
        find = lambda kind: next((x for x in inside if x.kind == kind), None)
        if iinf := find(b"iinf"):
            yield from _items(b, iinf)
        if iloc := find(b"iloc"):
            yield from _extents(b, iloc, find(b"idat"))
        yield from _size(b, inside)
    except (Damaged, IndexError) as e:
        yield Part("FAULT", len(b), 0, text=str(e) if isinstance(e, Damaged) else "Unexpected end of ISO-BMFF file", sub=True, told=False)


def _items(b: bytes, iinf: Box) -> Iterator[Part]:
    if iinf.body + 4 > iinf.end:
        raise Damaged("Invalid HEIF iinf box")
    for box in boxes(b, iinf.body + (6 if b[iinf.body] == 0 else 8), iinf.end):
        if box.kind != b"infe" or b[box.body] < 2:
            continue
        wide = b[box.body] > 2
        at = box.body + (10 if wide else 8)
        if at + 4 > box.end:
            raise Damaged("Invalid HEIF infe box")
        number = u32(b, box.body + 4) if wide else u16(b, box.body + 4)
        name, kind, *_ = [*(_strict(x) for x in b[at + 4 : box.end].split(b"\0")), "", ""]
        yield Part("ITEM:" + b[at : at + 4].decode("latin-1"), at, box.end - at, data=kind.encode(), text=name, num=number, sub=True)


def _strict(b: bytes) -> str:
    try:
        return b.decode()
    except UnicodeDecodeError:
        return ""


def _extents(b: bytes, iloc: Box, idat: Box | None) -> Iterator[Part]:
    at = iloc.body + 4
    version = b[iloc.body]

    def take(width: int) -> int:
        nonlocal at
        if width > 8:
            raise Damaged("Invalid ISO-BMFF integer size")
        if at + width > len(b):
            raise Damaged("Unexpected end of ISO-BMFF file")
        at += width
        return int.from_bytes(b[at - width : at])

    sizes, more = take(1), take(1)
    wide = 4 if version >= 2 else 2
    for _ in range(take(wide)):
        number = take(wide)
        method = take(2) & 15 if version in (1, 2) else 0
        take(2)
        base = take(more >> 4)
        for _ in range(take(2)):
            take(more & 15 if version in (1, 2) else 0)
            start, n = base + take(sizes >> 4), take(sizes & 15)
            if method == 1 and idat:
                start += idat.body
            found = (method == 0 and start + n <= len(b)) or (method == 1 and idat is not None and start + n <= idat.end)
            yield Part("EXTENT", start if found else 0, n if found else -1, n, num=number, sub=True, told=False)


def _size(b: bytes, inside: list[Box]) -> Iterator[Part]:
    """Width and height from the first ``ispe`` below ``iprp`` and ``ipco``."""
    for box in inside:
        if box.kind == b"ispe" and box.body + 12 <= box.end:
            yield Part("SIZE", box.body, 12, 12, b[box.body + 4 : box.body + 12], sub=True, told=False)
            return
        if box.kind in (b"iprp", b"ipco"):
            found = list(_size(b, list(boxes(b, box.body, box.end))))
            if found:
                yield from found
                return
