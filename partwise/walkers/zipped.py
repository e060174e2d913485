"""ZIP documents: the central directory as entries, each checked against its data."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from partwise.walkers.part import Damaged, Part

MOST_ENTRIES, MOST_XML, MOST_IMAGE, MOST_ALL = 4096, 8 << 20, 32 << 20, 512 << 20
_TEXTS = (".xml", ".opf", ".rels", "mimetype")
_IMAGES = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".tif", ".tiff", ".svg")


def _end(b: bytes) -> int:
    """The end record whose comment ends the file."""
    at = len(b)
    while (at := b.rfind(b"PK\5\6", max(0, len(b) - 65_557), at)) >= 0:
        if at + 22 <= len(b) and at + 22 + int.from_bytes(b[at + 20 : at + 22], "little") == len(b):
            return at
        at += 3
    raise Damaged("Not a valid ZIP archive")


def _read(b: bytes, form: str, at: int) -> tuple:
    try:
        return struct.unpack_from("<" + form, b, at)
    except struct.error:
        raise Damaged("Unexpected end of ZIP archive") from None


def _safe(name: str) -> bool:
    return bool(name) and name[0] != "/" and "\\" not in name and ".." not in name.split("/")


def _unpacked(name: str, method: int, raw: bytes, size: int, crc: int) -> tuple[bytes | None, str | None]:
    """(data, fault) of an entry."""
    data, rest = raw, b""
    if method == 8:
        packer = zlib.decompressobj(-15)
        try:
            data = packer.decompress(raw, size + 1)
        except zlib.error:
            return None, f"Failed to decompress {name}"
        if len(data) == size and not packer.eof:
            packer.decompress(packer.unconsumed_tail, 1)
        rest = packer.unused_data
    if len(data) != size:
        return None, f"ZIP size mismatch in {name}"
    if rest or (method == 8 and not packer.eof and size):
        return None, f"ZIP compressed data mismatch in {name}"
    if zlib.crc32(data) != crc:
        return None, f"ZIP CRC mismatch in {name}"
    return data, None


def zipped(b: bytes, faults: list[str]) -> Iterator[Part]:
    """One ENTRY for each member: name, size, and its bytes where rules read them (XML) or where it may be an image.

    A directory that breaks the rules has no entries; a member whose data do not
    fit is a fault.
    """
    end = _end(b)
    disk, start_disk, here, total, size, at = _read(b, "HHHHII", end + 4)
    if disk or start_disk or here != total:
        raise Damaged("Multi-disk ZIP archives are not supported")
    if total == 0xFFFF or 0xFFFFFFFF in (size, at):
        raise Damaged("ZIP64 Office files are not supported")
    if total > MOST_ENTRIES:
        raise Damaged("Office file contains too many ZIP entries")
    stop = at + size
    if stop > end:
        raise Damaged("Invalid ZIP central directory")
    entries: list[tuple] = []
    names: set[str] = set()
    whole = 0
    for _ in range(total):
        magic, flags, method, crc, packed, n, name_n, extra, note, on, local = _read(b, "I4xHH4xIIIHHHH6xI", at)
        if magic != 0x02014B50:
            raise Damaged("Invalid ZIP central directory entry")
        if flags & 1:
            raise Damaged("Encrypted Office files are not supported")
        if on:
            raise Damaged("Multi-disk ZIP archives are not supported")
        if method not in (0, 8):
            raise Damaged("Office file uses unsupported ZIP compression")
        if 0xFFFFFFFF in (packed, n, local):
            raise Damaged("ZIP64 Office files are not supported")
        raw = b[at + 46 : at + 46 + name_n]
        at += 46 + name_n + extra + note
        if at > stop:
            raise Damaged("Invalid ZIP central directory entry")
        try:
            name = raw.decode()
        except UnicodeDecodeError:
            raise Damaged("ZIP entry names must be UTF-8") from None
        if not _safe(name):
            raise Damaged(f"Unsafe ZIP entry name {name}")
        if b[local : local + 4] != b"PK\3\4":
            raise Damaged(f"Invalid ZIP local header for {name}")
        own_n, own_extra = _read(b, "HH", local + 26)
        data = local + 30 + own_n + own_extra
        if data + packed > len(b):
            raise Damaged(f"Invalid ZIP compressed size for {name}")
        if b[local + 30 : local + 30 + own_n] != raw:
            raise Damaged(f"ZIP local header name mismatch for {name}")
        whole += n
        if whole > MOST_ALL:
            raise Damaged("Office file is too large to inspect safely")
        if name in names:
            raise Damaged(f"Duplicate ZIP entry {name}")
        names.add(name)
        entries.append((name, method, data, packed, n, crc))
    if at != stop:
        raise Damaged("Invalid ZIP central directory size")
    if whole > 100 * len(b) and whole > 64 << 20:
        raise Damaged("Office file has an unsafe compression ratio")
    for name, method, data, packed, n, crc in entries:
        told, fault = _unpacked(name, method, b[data : data + packed], n, crc)
        if fault:
            faults.append(fault)
        low = name.lower()
        read = (low.endswith(_TEXTS) and n <= MOST_XML) or (low.endswith(_IMAGES) and n <= MOST_IMAGE)
        yield Part("ENTRY", data, packed, n, told if read else None, text=name, num=method)
