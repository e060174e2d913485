"""Bytes as Catalyst expressions: integers in both orders, cuts and joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def raw(hexadecimal: str) -> Column:
    """Constant bytes."""
    return F.unhex(F.lit(hexadecimal.replace(" ", "")))


def ascii_bytes(text: str | Column) -> Column:
    return F.encode(F.lit(text) if isinstance(text, str) else text, "UTF-8")


def big(value: Column | int, width: int) -> Column:
    """``value`` as ``width`` bytes, most significant first."""
    value = F.lit(value) if isinstance(value, int) else value
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * width, "0"))


def little(value: Column | int, width: int) -> Column:
    """``value`` as ``width`` bytes, least significant first."""
    value = (F.lit(value) if isinstance(value, int) else value).cast("long")
    return F.concat(*[big(F.shiftright(value, 8 * i).bitwiseAND(F.lit(255)), 1) for i in range(width)])


def read_big(data: Column, at: int, width: int) -> Column:
    """Unsigned integer at byte ``at`` (from 0), null beyond the end."""
    part = F.substring(data, at + 1, width)
    return F.when(F.octet_length(data) >= at + width, F.conv(F.hex(part), 16, 10).cast("long"))


def read_little(data: Column, at: int, width: int) -> Column:
    parts = F.concat(*[F.hex(F.substring(data, at + width - i, 1)) for i in range(width)])
    return F.when(F.octet_length(data) >= at + width, F.conv(parts, 16, 10).cast("long"))


def latin(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")
