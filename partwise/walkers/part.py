"""What walkers yield."""

from __future__ import annotations

from typing import NamedTuple

#: The array column that holds the parts of a file.
PARTS = "array<struct<ord:int,kind:string,offset:long,size:long,n:long,num:long,sub:boolean,told:boolean,text:string,data:binary>>"


class Damaged(ValueError):
    """The container breaks its format's rules; the text says how."""


class Part(NamedTuple):
    """A stretch of a file.

    ``n`` is the length of what it carries. ``data`` holds that only where a rule
    reads it: image and sound data stay in the file. ``text`` is a value that
    only the walker can decode. ``sub``: it lies inside an earlier part and takes
    no part in joining. ``told``: reading reports it; some parts go untold.
    """

    kind: str
    offset: int
    size: int
    n: int = 0
    data: bytes | None = None
    text: str | None = None
    num: int = 0
    sub: bool = False
    told: bool = True


def u16(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 2])


def u32(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 4])


def le32(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 4], "little")


def latin(b: bytes) -> str:
    return b.decode("latin-1")


def graphic(b: bytes) -> str:
    """A four-character code, with a dot for what cannot be shown."""
    return "".join(chr(c) if 32 <= c < 127 else "." for c in b)
