"""JPEG, PNG, WebP and GIF."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from partwise.walkers.part import Damaged, Part, latin, le32, u16, u32
from partwise.walkers.tiff import exif_parts, minimal_exif, orientation

#: A segment's first bytes are enough for all rules but those on comments and APP11.
HEAD = 64


def jpeg(b: bytes, faults: list[str]) -> Iterator[Part]:
    """Segments, coded scans, the end marker, and what trails. Reading reports nothing behind the first scan."""
    if len(b) < 4:
        raise Damaged("File too small")
    if b[:2] != b"\xff\xd8":
        raise Damaged("Not a valid JPEG file")
    yield Part("SOI", 0, 2)
    at, told, turned = 2, True, False
    while at + 2 <= len(b):
        mark = b[at + 1]
        if b[at] != 0xFF or mark == 0xFF:
            at += 1
            continue
        if mark == 0xD9:
            yield Part("EOI", at, 2)
            if at + 2 < len(b):
                yield Part("TRAILING", at + 2, len(b) - at - 2, told=False)
            return
        if mark in (0, 1) or 0xD0 <= mark <= 0xD7:
            at += 2
            continue
        if at + 4 > len(b):
            raise Damaged("Truncated JPEG segment")
        size = 2 + u16(b, at + 2)
        if size < 4 or at + size > len(b):
            raise Damaged("Invalid segment length")
        n, body = size - 4, b[at + 4 : at + size]
        if mark == 0xDA:
            told = False
            size = _scan_end(b, at + size) - at
        minimal = mark == 0xE1 and len(body) == 32 and (turn := orientation(body)) and body == minimal_exif(turn)
        data = body if mark in (0xEB, 0xFE) else body[:HEAD] if mark != 0xDA else None
        yield Part(f"FF{mark:02X}", at, size, n, data, told=told and not minimal)
        if mark == 0xE1 and body[:6] == b"Exif\0\0":
            if told and not minimal:
                yield from exif_parts(body, at + 4)
            if not turned and (turn := orientation(body)):
                turned = True
                yield Part("ORIENTATION", at, size, num=turn, sub=True, told=False)
        at += size
    raise Damaged("JPEG missing EOI marker")


def _scan_end(b: bytes, at: int) -> int:
    """Where coded data stops: at a marker that is neither stuffing, fill nor a restart."""
    while True:
        at = b.find(b"\xff", at)
        if at < 0 or at + 1 >= len(b):
            raise Damaged("JPEG missing EOI marker")
        after = b[at + 1]
        if after not in (0, 0xFF) and not 0xD0 <= after <= 0xD7:
            return at
        at += 1 if after == 0xFF else 2


#: Chunks that carry the image, its colours or its animation.
PNG_KEPT = ("IHDR", "PLTE", "IDAT", "IEND", "tRNS", "sRGB", "gAMA", "cHRM", "iCCP", "acTL", "fcTL", "fdAT")


def png(b: bytes, faults: list[str]) -> Iterator[Part]:
    """Chunks and what trails. Bad checksums and a broken order of chunks are faults; the walk goes on."""
    if b[:8] != b"\x89PNG\r\n\x1a\n":
        raise Damaged("Not a valid PNG file")
    yield Part("SIGNATURE", 0, 8)
    at, kinds = 8, []
    while at + 12 <= len(b):
        n = u32(b, at)
        if at + 12 + n > len(b):
            raise Damaged("Invalid chunk length")
        name = b[at + 4 : at + 8]
        kind = name.decode("utf-8", "replace")
        if zlib.crc32(b[at + 4 : at + 8 + n]) != u32(b, at + 8 + n):
            faults.append(f"PNG CRC mismatch in {kind} chunk")
        if wrong := _misplaced(name, kind, n, kinds):
            faults.append(wrong)
        kinds.append(kind)
        kept = kind in PNG_KEPT
        yield Part(kind, at, 12 + n, n, b[at + 8 : at + 24] if kind == "IHDR" else None if kept else b[at + 8 : at + 8 + n])
        at += 12 + n
        if kind == "IEND":
            if at < len(b):
                yield Part("TRAILING", at, len(b) - at)
            return
    raise Damaged("PNG missing IEND chunk")


def _misplaced(name: bytes, kind: str, n: int, before: list[str]) -> str | None:
    """What is wrong with a chunk here, given the chunks before it."""
    if not (name.isascii() and name.isalpha()):
        return "Invalid PNG chunk type"
    if "IHDR" not in before:
        return "PNG missing IHDR chunk" if kind != "IHDR" else "Invalid PNG IHDR chunk" if n != 13 else None
    if kind == "IHDR":
        return "Duplicate PNG IHDR chunk"
    if name[0] & 0x20 == 0 and kind not in ("PLTE", "IDAT", "IEND"):
        return f"Unsupported critical PNG {kind} chunk"
    if kind == "PLTE":
        return "Duplicate PNG PLTE chunk" if "PLTE" in before else "PNG PLTE chunk after IDAT" if "IDAT" in before else None
    if kind == "IDAT" and "IDAT" in before and before[-1] != "IDAT":
        return "PNG IDAT chunks must be consecutive"
    if kind == "IEND":
        return "Invalid PNG IEND chunk" if n else None if "IDAT" in before else "PNG missing IDAT chunk"
    return None


def riff(b: bytes, faults: list[str], form: bytes, name: str) -> Iterator[Part]:
    """RIFF chunks, a remainder too short or too long for a chunk, and what trails."""
    if b[:4] != b"RIFF" or b[8:12] != form:
        raise Damaged(f"Not a valid {name} file")
    end = 8 + le32(b, 4)
    if end < 12 or end > len(b):
        faults.append(f"Invalid {name} RIFF size" if end < 12 else f"Truncated {name} RIFF data")
        end = len(b)
    yield Part("RIFF", 0, 12)
    at = 12
    while at + 8 <= end:
        n = le32(b, at + 4)
        if at + 8 + n + (n & 1) > end:
            break
        yield Part(latin(b[at : at + 4]), at, 8 + n + (n & 1), n, b[at + 8 : at + 8 + n])
        at += 8 + n + (n & 1)
    if at < end:
        faults.append(f"Invalid {name} chunk length")
        yield Part("MALFORMED", at, end - at)
    if end < len(b):
        yield Part("TRAILING", end, len(b) - end)


def webp(b: bytes, faults: list[str]) -> Iterator[Part]:
    kinds = set()
    for p in riff(b, faults, b"WEBP", "WebP"):
        kinds.add(p.kind)
        visual = p.kind in ("VP8 ", "VP8L", "VP8X", "ALPH", "ANIM", "ANMF", "ICCP")
        yield p._replace(data=p.data[:16]) if visual and p.data else p
    if not kinds & {"VP8 ", "VP8L", "ANMF"}:
        faults.append("WebP missing image data chunk")


def gif(b: bytes, faults: list[str]) -> Iterator[Part]:
    """Screen, images, extensions (EXT: and the label in hexadecimal) and what trails."""

    def table(flags: int) -> int:
        return 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def chain(at: int, what: str) -> tuple[int, bytes]:
        blocks = []
        while at < len(b) and b[at]:
            blocks.append(b[at + 1 : at + 1 + b[at]])
            at += 1 + b[at]
        if at >= len(b):
            raise Damaged(f"Invalid GIF {what} block")
        return at + 1, b"".join(blocks)

    if len(b) < 13 or b[:6] not in (b"GIF87a", b"GIF89a") or 13 + table(b[10]) > len(b):
        raise Damaged("Not a valid GIF file")
    at = 13 + table(b[10])
    yield Part("SCREEN", 0, at, data=b[6:10])
    while at < len(b):
        if b[at] == 0x3B:
            yield Part("TRAILER", at, 1)
            if at + 1 < len(b):
                yield Part("TRAILING", at + 1, len(b) - at - 1)
            return
        if b[at] == 0x2C:
            if at + 10 > len(b):
                raise Damaged("Invalid GIF image block")
            end, _ = chain(at + 11 + table(b[at + 9]), "image")
            yield Part("IMAGE", at, end - at)
        elif b[at] == 0x21:
            if at + 2 >= len(b):
                raise Damaged("Invalid GIF extension block")
            label, first = b[at + 1], b[at + 2]
            if label == 0xF9:
                end, told = at + 4 + first, b""
                if end > len(b) or b[end - 1]:
                    raise Damaged("Invalid GIF extension block")
            elif label == 0xFF:
                end, told = chain(at + 3 + first, "extension")
                told = b[at + 3 : at + 3 + first] + told
            else:
                end, told = chain(at + 2, "extension")
            name = b[at + 3 : at + 14].decode("utf-8", "replace").strip() if label == 0xFF and first == 11 else None
            yield Part(f"EXT:{label:02X}", at, end - at, len(told), told if label in (0xFE, 0xFF) else None, text=name)
        else:
            raise Damaged("Invalid GIF block")
        at = end
    raise Damaged("GIF missing trailer")
