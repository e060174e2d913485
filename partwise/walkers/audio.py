"""WAV, MP3, FLAC and OGG, with the tags they share."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

from partwise.walkers.images import riff
from partwise.walkers.part import Damaged, Part, latin, le32, u32


def synchsafe(b: bytes) -> int | None:
    """Four bytes of seven bits; None if a high bit is set or a byte is missing."""
    if len(b) < 4 or max(b[:4]) > 127:
        return None
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


class Id3(NamedTuple):
    version: int
    flags: int
    payload: int
    total: int


def id3_header(b: bytes) -> Id3 | None:
    """The ID3v2 tag at the start, if it fits."""
    if len(b) < 10 or b[:3] != b"ID3" or b[3] not in (2, 3, 4) or b[4] == 255:
        return None
    payload = synchsafe(b[6:10])
    if payload is None:
        return None
    total = 10 + payload + (10 if b[3] == 4 and b[5] & 0x10 else 0)
    return Id3(b[3], b[5], payload, total) if total <= len(b) else None


def id3_frames(b: bytes, head: Id3, offset: int = 0) -> Iterator[Part]:
    """Frames of the tag as sub-parts, up to padding or damage; their decoded text, or None for bytes."""
    tag = b[10 : 10 + head.payload]
    at = 0
    if head.flags & 0x40 and head.version > 2:
        skip = synchsafe(tag[:4]) if head.version == 4 else 4 + u32(tag, 0) if len(tag) >= 4 else 0
        at = min(skip or 0, len(tag))
    names, width = (3, 6) if head.version == 2 else (4, 10)
    while at + width <= len(tag):
        name = tag[at : at + names]
        size = int.from_bytes(tag[at + 3 : at + 6]) if names == 3 else synchsafe(tag[at + 4 : at + 8]) if head.version == 4 else u32(tag, at + 4)
        if not (name.isascii() and name.isalnum()) or size is None or at + width + size > len(tag):
            return
        body = tag[at + width : at + width + size]
        if size:
            frame = name.decode()
            yield Part(f"FRAME:{frame}", offset + 10 + at, width + size, size, text=_frame_text(frame, body), sub=True)
        at += width + size


def _frame_text(name: str, body: bytes) -> str | None:
    if name in ("COMM", "COM", "USLT", "ULT"):
        wide = body[0] in (1, 2)
        return _decoded(body[0], _behind_zero(body[4:], 2 if wide else 1))
    if name.startswith("T"):
        return _decoded(body[0], body[1:])
    if name.startswith("W"):
        return body.decode("utf-8", "replace").strip()
    return None


def _behind_zero(b: bytes, width: int) -> bytes:
    """What follows the first terminator."""
    for at in range(0, len(b) - width + 1, width):
        if not any(b[at : at + width]):
            return b[at + width :]
    return b""


def _decoded(code: int, b: bytes) -> str:
    """ID3 text; zeros part values, and white space is one blank."""
    if code in (1, 2):
        order = "be"
        if code == 1 and b[:2] in (b"\xff\xfe", b"\xfe\xff"):
            order, b = ("le" if b[:1] == b"\xff" else "be"), b[2:]
        text = b[: len(b) // 2 * 2].decode(f"utf-16-{order}", "replace")
    else:
        text = latin(b) if code == 0 else b.decode("utf-8", "replace") if code == 3 else ""
    return " ".join(text.replace("\0", " / ").split())


def tails(b: bytes, sound: int = 0) -> list[Part]:
    """Tags behind the sound, which begins at ``sound``, last first: ID3v1, APEv2 and Lyrics3 in any number.

    Three letters 128 bytes from an end make an ID3v1 tag, so the longer marks of
    the others go first: in an APEv2 tag of 131 bytes those are of APETAGEX.
    """
    found: list[Part] = []
    end = len(b)
    while end > 0:
        for find in (_ape, _lyrics2, _lyrics1, _id3v1):
            hit = find(b, end)
            if hit is not None and sound <= hit[0] < end:
                break
        else:
            return found
        start, name = hit
        found.append(Part(f"TAIL:{name}", start, end - start, end - start, b[start:end] if name == "ID3v1" else None))
        end = start
    return found


def _id3v1(b: bytes, end: int) -> tuple[int, str] | None:
    return (end - 128, "ID3v1") if end >= 128 and b[end - 128 : end - 125] == b"TAG" else None


def _ape(b: bytes, end: int) -> tuple[int, str] | None:
    foot = b[end - 32 : end] if end >= 32 else b""
    if foot[:8] != b"APETAGEX" or not 1000 <= le32(foot, 8) <= 2000 or not 32 <= le32(foot, 12) <= end:
        return None
    start = end - le32(foot, 12)
    return (start - 32 if start >= 32 and b[start - 32 : start - 24] == b"APETAGEX" else start), "APEv2"


def _lyrics2(b: bytes, end: int) -> tuple[int, str] | None:
    foot = end - 15
    size = b[foot : foot + 6]
    if foot < 0 or b[foot + 6 : end] != b"LYRICS200" or not size.isdigit():
        return None
    for start in (foot - int(size), foot - int(size) - 11):
        if 0 <= start < foot and b[start : start + 11] == b"LYRICSBEGIN":
            return start, "Lyrics3"
    return None


def _lyrics1(b: bytes, end: int) -> tuple[int, str] | None:
    foot = end - 9
    if foot < 0 or b[foot:end] != b"LYRICSEND":
        return None
    start = b.rfind(b"LYRICSBEGIN", max(0, foot - 5100), foot)
    return (start, "Lyrics3") if start >= 0 else None


def _sound(b: bytes, at: int) -> bool:
    """An MPEG frame begins here."""
    return at + 2 <= len(b) and b[at] == 255 and b[at + 1] & 0xE0 == 0xE0 and b[at + 1] & 0x18 != 0x08 and b[at + 1] & 0x06 != 0


def mp3(b: bytes, faults: list[str]) -> Iterator[Part]:
    """ID3v2 tag with frames, sound, and the tags behind it (the first ID3v1 is reported before all others)."""
    head = id3_header(b)
    start = head.total if head else 0
    behind = tails(b, start)
    end = behind[-1].offset if behind else len(b)
    if len(b) < 2:
        faults.append("File too small")
    elif start >= end or not _sound(b, start):
        faults.append("MP3 missing MPEG audio frames")
    if head:
        yield Part("ID3v2", 0, head.total, head.total, num=head.version)
        yield from id3_frames(b, head)
    if start < end:
        yield Part("AUDIO", start, end - start)
    old = [p for p in behind if p.kind == "TAIL:ID3v1"]
    yield from old[:1]
    for p in behind:
        if p not in old[:1]:
            yield p._replace(told=p not in old)


def flac(b: bytes, faults: list[str]) -> Iterator[Part]:
    """Prefixed ID3v2 tag, blocks (BLOCK: and the type) with the texts of Vorbis comments, sound, and the tags behind it."""
    head = None if b[:4] == b"fLaC" else id3_header(b)
    begin = head.total if head else 0
    if b[begin : begin + 4] != b"fLaC":
        raise Damaged("Not a valid FLAC file")
    parts: list[Part] = []
    if head:
        parts += [Part("PREFIX", 0, begin, begin), *id3_frames(b, head)]
    parts.append(Part("fLaC", begin, 4))
    at, last, blocks = begin + 4, False, 0
    while not last:
        if blocks >= 1024:
            raise Damaged("FLAC file contains too many metadata blocks")
        if at + 4 > len(b):
            raise Damaged("Truncated FLAC metadata block")
        last, kind, n = bool(b[at] & 0x80), b[at] & 0x7F, int.from_bytes(b[at + 1 : at + 4])
        if kind == 127:
            raise Damaged("Invalid FLAC metadata block type")
        if at + 4 + n > len(b):
            raise Damaged("Truncated FLAC metadata block")
        if not blocks and (kind or n != 34):
            raise Damaged("FLAC missing STREAMINFO block")
        body = b[at + 4 : at + 4 + n]
        parts.append(Part(f"BLOCK:{kind}", at, 4 + n, n, body[:4] if kind == 2 else None, text=_picture(body) if kind == 6 else None))
        if kind == 4:
            parts += vorbis(body, at + 4)
        at, blocks = at + 4 + n, blocks + 1
    behind = tails(b, at)
    end = behind[-1].offset if behind else len(b)
    if at >= end or b[at : at + 1] != b"\xff" or b[at + 1] & 0xFC != 0xF8:
        raise Damaged("FLAC missing audio frames")
    yield from [*parts, Part("AUDIO", at, end - at), *behind]


def _picture(body: bytes) -> str:
    """The media type that a picture block names."""
    return body[8 : 8 + u32(body, 4)].decode("utf-8", "replace") if len(body) >= 8 and 8 + u32(body, 4) <= len(body) else ""


def vorbis(b: bytes, offset: int) -> Iterator[Part]:
    """Vendor and up to 256 comments as sub-parts; stops at the first text beyond the block."""
    at, count = 0, 1
    for kind in ("VENDOR", *["COMMENT"] * 256):
        if not count or at + 4 > len(b):
            return
        n = le32(b, at)
        text = b[at + 4 : at + 4 + n]
        if at + 4 + n > len(b):
            return
        yield Part(kind, offset + at, 4 + n, n, text=text.decode("utf-8", "replace"), sub=True)
        at, count = at + 4 + n, count - 1
        if kind == "VENDOR":
            if at + 4 > len(b):
                return
            count, at = le32(b, at), at + 4


def wav(b: bytes, faults: list[str]) -> Iterator[Part]:
    """RIFF chunks; the texts of LIST/INFO, the fields of bext and the frames of an ID3 chunk follow as sub-parts."""
    kinds = set()
    for p in riff(b, faults, b"WAVE", "WAV"):
        kinds.add(p.kind)
        body = p.data or b""
        yield p._replace(data=None if p.kind in ("fmt ", "data", "fact") else body[:8])
        if p.kind == "LIST" and body[:4] == b"INFO":
            at = 4
            while at + 8 <= len(body) and at + 8 + le32(body, at + 4) <= len(body):
                n = le32(body, at + 4)
                yield Part("INFO:" + latin(body[at : at + 4]), p.offset + 8 + at, 8 + n, n, body[at + 8 : at + 8 + n], sub=True)
                at += 8 + n + (n & 1)
        elif p.kind == "bext":
            for name, start, stop in BEXT:
                if stop <= len(body):
                    yield Part(f"BEXT:{name}", p.offset + 8 + start, stop - start, stop - start, body[start:stop], sub=True)
        elif p.kind in ("id3 ", "ID3 ") and (head := id3_header(body)):
            yield from id3_frames(body, head, p.offset + 8)
    if not {"fmt ", "data"} <= kinds and not faults:
        faults.append("WAV missing fmt or data chunk")


#: Fields of a broadcast extension.
BEXT = (("Description", 0, 256), ("Originator", 256, 288), ("Originator reference", 288, 320), ("Origination date", 320, 330), ("Origination time", 330, 338))

_TURNED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """The checksum of an OGG page: CRC-32 without reflection, its own field as zero.

    The usual CRC-32 of the page with all bytes turned round gives the same
    number turned round.
    """
    blank = page[:22] + bytes(4) + page[26:]
    raw = zlib.crc32(blank.translate(_TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{raw:032b}"[::-1], 2)


class Page(NamedTuple):
    offset: int
    raw: bytes
    lacing: bytes
    body: bytes

    @property
    def starts(self) -> bool:
        return bool(self.raw[5] & 2)

    @property
    def goes_on(self) -> bool:
        return bool(self.raw[5] & 1)


#: Leading bytes of the packets of each codec, and how many header packets follow the first.
CODECS = {b"\x01vorbis": (b"\x03vorbis", 2, b"\x01"), b"OpusHead": (b"OpusTags", 1, b"")}


def pages(b: bytes) -> list[Page]:
    out, at = [], 0
    while at < len(b):
        head = b[at : at + 27]
        if len(head) < 27:
            raise Damaged("Truncated OGG page")
        if head[:4] != b"OggS":
            raise Damaged("Invalid OGG page header")
        if head[4]:
            raise Damaged("Unsupported OGG page version")
        lacing = b[at + 27 : at + 27 + head[26]]
        end = at + 27 + head[26] + sum(lacing)
        if end > len(b) or len(lacing) < head[26]:
            raise Damaged("Truncated OGG page")
        raw = b[at:end]
        if page_crc(raw) != le32(raw, 22):
            raise Damaged("OGG page checksum mismatch")
        out.append(Page(at, raw, lacing, raw[27 + head[26] :]))
        at = end
    if not out:
        raise Damaged("Not a valid OGG file")
    return out


def header_packets(all_pages: list[Page], count: int) -> tuple[list[bytes], int]:
    """The packets from the second page on, and the first page of sound behind them."""
    packets, open_, total = [], b"", 0
    for k, page in enumerate(all_pages[1:], 1):
        if page.goes_on == (not open_):
            raise Damaged("OGG header packets are not page-aligned")
        at = 0
        for lace in page.lacing:
            total += lace
            if total > 16 << 20:
                raise Damaged("OGG header packets are too large")
            open_ += page.body[at : at + lace]
            at += lace
            if lace < 255:
                packets.append(open_)
                open_ = b""
                if len(packets) == count:
                    if at != len(page.body):
                        raise Damaged("OGG audio packets share a header page")
                    return packets, k + 1
    raise Damaged("OGG is missing its header packets")


def ogg(b: bytes, faults: list[str]) -> Iterator[Part]:
    """Pages (HEADER up to the sound, then AUDIO), and the comment packet with its texts unless it is empty already."""
    found = pages(b)
    first = found[0]
    if not first.starts or first.goes_on:
        raise Damaged("OGG file does not start with a stream header page")
    if first.lacing[-1:] == b"\xff" or sum(x < 255 for x in first.lacing) != 1:
        raise Damaged("OGG identification header page is malformed")
    for page in found[1:]:
        if page.raw[14:18] != first.raw[14:18]:
            raise Damaged("Multiplexed OGG streams are not supported")
        if page.starts:
            raise Damaged("Chained OGG streams are not supported")
    codec = next((c for c in CODECS if first.body.startswith(c)), None)
    if codec is None:
        raise Damaged("OGG stream codec is not supported")
    lead, count, end = CODECS[codec]
    packets, sound = header_packets(found, count)
    if sound >= len(found):
        raise Damaged("OGG missing audio packets")
    if not packets[0].startswith(lead):
        raise Damaged("OGG comment header is malformed")
    if count == 2 and not packets[1].startswith(b"\x05vorbis"):
        raise Damaged("OGG Vorbis setup header is malformed")
    for k, page in enumerate(found):
        yield Part("HEADER" if k < sound else "AUDIO", page.offset, len(page.raw), len(page.body), num=k, told=False)
    if packets[0] != lead + bytes(8) + end:
        body = packets[0][len(lead) :]
        yield Part("COMMENTS", found[1].offset, len(packets[0]), len(body), sub=True)
        yield from vorbis(body, found[1].offset)
