"""File type from the bytes: an ordered CASE, so the scan needs no Python worker.

ZIP files come as ``zip`` from here; which document they are is told by their
directory (see ``operators.walk``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partwise.functions.binary import ascii_bytes, latin, raw, read_big, read_little
from partwise.operators.svg import is_svg

#: Brands of the ISO base media family.
AVIF = ("avif", "avis")
HEIC = ("heic", "heix", "hevc", "hevx", "heim", "heis", "hevm", "hevs")
HEIF = ("mif1", "msf1")
MP4 = ("isom", "iso2", "iso4", "iso5", "iso6", "mp41", "mp42", "mp4v", "M4V ", "M4A ", "3gp4", "3gp5", "3g2a")


def _brands(content: Column) -> Column:
    """Major and compatible brands of a leading ``ftyp`` box, as an array of four-character strings; null if there is none."""
    short, length = read_big(content, 0, 4), F.octet_length(content)
    wide = F.conv(F.hex(F.substring(content, 9, 8)), 16, 10).try_cast("long")
    head = F.when(short == 1, 16).otherwise(8)
    size = F.when(short == 1, F.when(length >= 16, wide)).when(short == 0, length.cast("long")).otherwise(short)
    text = latin(F.substr(content, head + 1, F.least(size - head, length.cast("long")).cast("int")))
    starts = F.concat(F.array(F.lit(1)), F.when(F.length(text) >= 12, F.sequence(F.lit(9), F.length(text) - 3, F.lit(4))).otherwise(F.array().cast("array<int>")))
    whole = (size - head >= 8) & (size <= length) & F.substring(content, 5, 4).eqNullSafe(ascii_bytes("ftyp"))
    return F.when(whole, F.transform(starts, lambda i: F.substr(text, i, F.lit(4))))


def detect_file_type(content: Column) -> Column:
    """First match wins. Null and empty content are ``unknown``."""
    starts = lambda h: F.startswith(content, raw(h))
    at8 = lambda s: F.substring(content, 9, 4) == ascii_bytes(s)
    brands = _brands(content)
    has = lambda names: F.coalesce(F.arrays_overlap(brands, F.array(*[F.lit(n) for n in names])), F.lit(False))
    byte0, byte1 = read_big(content, 0, 1), read_big(content, 1, 1)
    sync = (byte0 == 255) & (byte1.bitwiseAND(F.lit(0xE0)) == 0xE0) & (byte1.bitwiseAND(F.lit(0x18)) != 0x08) & (byte1.bitwiseAND(F.lit(0x06)) != 0)
    digits = [read_big(content, 6 + i, 1) for i in range(4)]
    tag = digits[0] * (1 << 21) + digits[1] * (1 << 14) + digits[2] * (1 << 7) + digits[3] + 10 + F.when(read_big(content, 5, 1).bitwiseAND(F.lit(0x10)).eqNullSafe(F.lit(16)) & (read_big(content, 3, 1) == 4), 10).otherwise(0)
    id3 = (
        starts("494433") & read_big(content, 3, 1).between(2, 4) & (read_big(content, 4, 1) != 255)
        & (F.greatest(*digits) < 128) & (tag <= F.octet_length(content))
    )
    after_tag = F.when(id3, F.substr(content, (tag + 1).cast("int"), F.lit(4)) == ascii_bytes("fLaC"))
    out = (
        F.when(starts("FFD8FF"), "jpeg").when(starts("89504E470D0A1A0A"), "png").when(starts("25504446"), "pdf")
        .when(starts("52494646") & at8("WEBP"), "webp").when(starts("52494646") & at8("WAVE"), "wav")
        .when(starts("664C6143") | F.coalesce(after_tag, F.lit(False)), "flac")
        .when(starts("4F67675300"), "ogg").when(starts("49492A00") | starts("4D4D002A"), "tiff")
        .when(starts("474946383761") | starts("474946383961"), "gif")
        .when(has(AVIF), "avif").when(has(HEIC), "heic").when(has(HEIF), "heif").when(has(("qt  ",)), "mov").when(has(MP4), "mp4")
        .when(F.coalesce(id3 | sync, F.lit(False)), "mp3").when(starts("D0CF11E0A1B11AE1"), "office-legacy")
        .when(F.contains(F.substring(content, -65557, 65557), raw("504B0506")), "zip").when(is_svg(content), "svg")
    )
    return out.otherwise("unknown")


#: JPEG segments that begin a frame.
FRAMES = ("FFC0", "FFC1", "FFC2", "FFC3", "FFC5", "FFC6", "FFC7", "FFC9", "FFCA", "FFCB", "FFCD", "FFCE", "FFCF")


def image_size(file_type: Column, parts: Column) -> Column:
    """(width, height) of JPEG, PNG, GIF, WebP and AVIF from the parts of a walked file; null for others and for zero sizes."""
    first = lambda test: F.get(F.filter(parts, test), 0)["data"]
    frame = first(lambda x: x["told"] & x["kind"].isin(*FRAMES) & (x["n"] >= 5))
    head, screen, box = first(lambda x: x["kind"] == "IHDR"), first(lambda x: x["kind"] == "SCREEN"), first(lambda x: x["kind"] == "SIZE")
    key = F.filter(parts, lambda x: ((x["kind"] == "VP8X") & (x["n"] >= 10)) | ((x["kind"] == "VP8 ") & (x["n"] >= 10) & (F.substring(x["data"], 4, 3) == raw("9D012A"))) | ((x["kind"] == "VP8L") & (x["n"] >= 5) & F.startswith(x["data"], raw("2F"))))
    kind, data = F.get(key, 0)["kind"], F.get(key, 0)["data"]
    packed = read_little(data, 1, 4)
    low = F.lit(0x3FFF)
    sizes = {
        "jpeg": (read_big(frame, 3, 2), read_big(frame, 1, 2)), "png": (read_big(head, 0, 4), read_big(head, 4, 4)), "gif": (read_little(screen, 0, 2), read_little(screen, 2, 2)),
        "avif": (read_big(box, 0, 4), read_big(box, 4, 4)),
        "webp": (
            F.when(kind == "VP8X", read_little(data, 4, 3) + 1).when(kind == "VP8 ", read_little(data, 6, 2).bitwiseAND(low)).otherwise(packed.bitwiseAND(low) + 1),
            F.when(kind == "VP8X", read_little(data, 7, 3) + 1).when(kind == "VP8 ", read_little(data, 8, 2).bitwiseAND(low)).otherwise(F.shiftright(packed, 14).bitwiseAND(low) + 1),
        ),
    }
    w = h = F.lit(None).cast("long")
    for t, (x, y) in sizes.items():
        w, h = F.when(file_type == t, x).otherwise(w), F.when(file_type == t, y).otherwise(h)
    return F.when((w > 0) & (h > 0), F.struct(w.alias("width"), h.alias("height")))
