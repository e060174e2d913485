"""TIFF directories: the TIFF format itself, and Exif inside JPEG."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from partwise.walkers.part import Damaged, Part

#: Bytes of each field type.
WIDTHS = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
#: Tags that point to a directory of their own.
POINTERS = (0x8769, 0x8825, 0xA005)
MOST_DIRECTORIES, MOST_FIELDS = 64, 2048


@dataclass
class Field:
    tag: int
    form: int
    count: int
    at: int  # of the twelve bytes in the directory
    start: int | None  # of the value; None where it lies outside the data or has an unknown type
    stop: int

    @property
    def points(self) -> bool:
        return self.tag in POINTERS and self.form == 4 and self.count == 1


@dataclass
class Tiff:
    data: bytes
    order: str = field(init=False)

    def __post_init__(self) -> None:
        if len(self.data) < 8:
            raise Damaged("File too small")
        if self.data[:2] not in (b"MM", b"II"):
            raise Damaged("Not a valid TIFF file")
        self.order = "big" if self.data[:2] == b"MM" else "little"

    def number(self, at: int, width: int) -> int:
        raw = self.data[at : at + width]
        if len(raw) < width:
            raise Damaged("Unexpected end of TIFF file")
        return int.from_bytes(raw, self.order)

    def field(self, at: int) -> Field:
        tag, form, count = self.number(at, 2), self.number(at + 2, 2), self.number(at + 4, 4)
        size = WIDTHS.get(form, 0) * count
        start = at + 8 if size <= 4 else self.number(at + 8, 4)
        ok = form in WIDTHS and start + size <= len(self.data)
        return Field(tag, form, count, at, start if ok else None, start + size)

    def directory(self, at: int) -> tuple[list[Field], int]:
        """All fields and the place of the next directory; one bad field spoils the directory."""
        count = self.number(at, 2)
        if count > MOST_FIELDS:
            raise Damaged("TIFF IFD contains too many entries")
        if at + 6 + 12 * count > len(self.data):
            raise Damaged("Invalid TIFF IFD")
        fields = [self.field(at + 2 + 12 * k) for k in range(count)]
        for f in fields:
            if f.form not in WIDTHS:
                raise Damaged("Unsupported TIFF field type")
            if f.start is None:
                raise Damaged("Invalid TIFF field offset")
        return fields, self.number(at + 2 + 12 * count, 4)

    def loose(self, at: int) -> Iterator[Field]:
        """Fields as far as the data goes."""
        try:
            for k in range(self.number(at, 2)):
                if at + 14 + 12 * k > len(self.data):
                    return
                yield self.field(at + 2 + 12 * k)
        except Damaged:
            return

    def raw(self, f: Field) -> bytes:
        return self.data[f.start : f.stop]


def ratio(t: Tiff, raw: bytes, at: int) -> float | None:
    over, under = (int.from_bytes(raw[k : k + 4], t.order) for k in (at, at + 4))
    return over / under if under else None


def exif_text(t: Tiff, f: Field) -> str:
    """An Exif value as it is shown; empty for what is not."""
    raw = t.raw(f)
    if f.form == 2:
        return raw.decode("utf-8", "replace").rstrip("\0")
    if f.form in (3, 4) and f.count == 1:
        return str(int.from_bytes(raw, t.order))
    if f.form == 5 and f.count == 1:
        value = ratio(t, raw, 0)
        return "" if value is None else f"{value:.4f}".rstrip("0").rstrip(".")
    return f"[{len(raw)} bytes]" if raw else ""


def position(t: Tiff, at: int) -> str | None:
    """Latitude and longitude of a GPS directory."""
    found: dict[int, object] = {}
    try:
        count = t.number(at, 2)
        if at + 2 + 12 * count > len(t.data):
            return None
        for k in range(count):
            f = t.field(at + 2 + 12 * k)
            if f.start is None:
                continue
            if f.tag in (1, 3) and f.form == 2:
                found[f.tag] = next((chr(c).upper() for c in t.raw(f) if chr(c).isascii() and chr(c).isalpha()), None)
            elif f.tag in (2, 4) and f.form == 5 and f.count == 3:
                found[f.tag] = [ratio(t, t.raw(f), 8 * i) for i in range(3)]
    except Damaged:
        return None
    told = []
    for side, turns in ((1, {"N": 1, "S": -1}), (3, {"E": 1, "W": -1})):
        sign, parts = {"N": 1, "E": 1, "S": -1, "W": -1}.get(found.get(side)), found.get(side + 1)  # type: ignore[arg-type]
        if sign is None or parts is None or None in parts:
            return None
        told.append(sign * (parts[0] + parts[1] / 60 + parts[2] / 3600))
    return f"{told[0]:.6f}, {told[1]:.6f}"


def exif_parts(segment: bytes, offset: int) -> Iterator[Part]:
    """Fields of an Exif segment (with its six leading bytes) as sub-parts: IFD0 with GPS, then the Exif directory, then the orientation."""
    try:
        t = Tiff(segment[6:])
        first = list(t.loose(t.number(4, 4)))
    except Damaged:
        return
    below = None

    def shown(kind: str, f: Field, text: str) -> Part:
        return Part(kind, offset + 6 + f.at, 12, text=text, num=f.tag, sub=True)

    for f in first:
        if f.tag == 0x8825:
            where = position(t, t.number(f.at + 8, 4)) if f.form == 4 and f.count == 1 else None
            yield shown("GPS", f, where or "Present in EXIF metadata")
        elif f.tag == 0x8769:
            below = t.number(f.at + 8, 4) if f.form == 4 and f.count == 1 else below
        elif f.start is not None:
            yield shown("IFD0", f, exif_text(t, f))
    for f in t.loose(below) if below is not None else ():
        if f.start is not None:
            yield shown("EXIF", f, exif_text(t, f))


def orientation(segment: bytes) -> int | None:
    """1 to 8 from an Exif segment, None if it does not tell."""
    if segment[:6] != b"Exif\0\0" or len(segment) < 14:
        return None
    try:
        t = Tiff(segment[6:])
        at = t.number(4, 4)
        for k in range(t.number(at, 2)):
            if at + 14 + 12 * k > len(t.data):
                return None
            f = t.field(at + 2 + 12 * k)
            if (f.tag, f.form, f.count) == (0x0112, 3, 1):
                value = t.number(f.at + 8, 2)
                return value if 1 <= value <= 8 else None
    except Damaged:
        return None
    return None


def minimal_exif(turn: int) -> bytes:
    """An Exif segment body that tells the orientation and nothing else."""
    tag = (0x0112).to_bytes(2) + (3).to_bytes(2) + (1).to_bytes(4) + turn.to_bytes(2) + bytes(2)
    return b"Exif\0\0" + b"MM\0\x2a" + (8).to_bytes(4) + (1).to_bytes(2) + tag + bytes(4)


def tiff(b: bytes, faults: list[str]) -> Iterator[Part]:
    """Directories (IFD, SUBIFD), their fields (TAG) and the values of these (VALUE), as sub-parts of the whole file.

    A TAG's number is the tag. Damage in the first directory is a fault; further
    directories that cannot be read end the walk.
    """
    t = Tiff(b)
    yield Part("FILE", 0, len(b), len(b), text=t.order, told=False)
    if t.number(2, 2) != 42:
        faults.append("Not a classic TIFF file")
    seen: set[int] = set()

    def fields_of(kind: str, at: int, fields: list[Field]) -> Iterator[Part]:
        yield Part(kind, at, 6 + 12 * len(fields), len(fields), num=at, sub=True, told=False)
        for f in fields:
            text = None
            if f.form == 2:
                text = t.raw(f).decode("utf-8", "replace").rstrip("\0").strip()
            elif f.form in (3, 4) and f.count == 1:
                text = str(int.from_bytes(t.raw(f), t.order))
            yield Part("TAG" if kind == "IFD" else "SUBTAG", f.at, 12, f.stop - f.start, num=f.tag, text=text if text is not None else f"{f.stop - f.start} bytes", sub=True)
            yield Part("VALUE" if kind == "IFD" else "SUBVALUE", f.start, f.stop - f.start, num=f.tag, sub=True, told=False)
            if f.points:
                yield from below(t.number(f.at + 8, 4))

    def below(at: int) -> Iterator[Part]:
        while at and len(seen) < MOST_DIRECTORIES and at not in seen:
            seen.add(at)
            try:
                fields, nxt = t.directory(at)
            except Damaged:
                return
            yield from fields_of("SUBIFD", at, fields)
            at = nxt

    at = t.number(4, 4)
    if not at:
        t.directory(at)
    for k in range(MOST_DIRECTORIES):
        if not at or at in seen:
            return
        seen.add(at)
        try:
            fields, nxt = t.directory(at)
        except Damaged as e:
            if k == 0:
                faults.append(str(e))
            else:  # reading is content with the first directory, cleaning is not
                yield Part("FAULT", at, 0, text=str(e), sub=True, told=False)
            return
        yield from fields_of("IFD", at, fields)
        at = nxt
