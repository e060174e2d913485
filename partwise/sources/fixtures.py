"""Files built from the documents table: input for queries and tests, with whole texts as payload.

``t`` is a text, ``p`` its printable ASCII, ``raw`` its UTF-8 bytes. Layouts vary
by number, so that every format comes with and without its rarer parts.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.functions.binary import raw as raw_bytes
from partwise.operators.walk import arrow_schema, bounded, slices
from partwise.walkers.audio import page_crc

#: Leading bytes for each type, by number.
MAGIC = [
    ("jpeg", "FFD8FFE0"), ("png", "89504E470D0A1A0A"), ("pdf", "255044462D312E37"), ("webp", "524946460000000057454250"), ("wav", "524946460000000057415645"),
    ("flac", "664C6143"), ("ogg", "4F67675300"), ("tiff", "49492A00"), ("gif", "474946383961"), ("avif", "0000001066747970617669660000000000"[:32]),
    ("mov", "0000001066747970717420200000000000"[:32]), ("mp4", "00000010667479706D70343200000000"), ("mp3", "FFFB9064"), ("office-legacy", "D0CF11E0A1B11AE1"),
]
#: A JPEG segment carries so many bytes of a text at most.
SEGMENT = 60_000


def printable(t: str) -> str:
    return re.sub("[^ -~]", "", t)


def _cut(b: bytes, n: int) -> list[bytes]:
    return [b[k : k + n] for k in range(0, max(1, len(b)), n)]


def _field(order: str, tag: int, form: int, count: int, value: bytes | int) -> bytes:
    width = 2 if form == 3 and isinstance(value, int) else 4
    body = value.to_bytes(width, order) if isinstance(value, int) else value  # type: ignore[arg-type]
    return tag.to_bytes(2, order) + form.to_bytes(2, order) + count.to_bytes(4, order) + body.ljust(4, b"\0")  # type: ignore[arg-type]


def tiff_file(order: str, directories: list[list[tuple]], payload: bytes = b"") -> bytes:
    """A TIFF structure: ``directories`` hold (tag, form, count, value); a value is a number, bytes, ("dir", k) for a pointer, or ("strip",) for the payload. The first directory links to those marked ("next", k)."""
    out = (b"II*\0" if order == "little" else b"MM\0*") + bytes(4)
    sizes = [6 + 12 * sum(f[0] != "next" for f in d) for d in directories]
    starts = [8 + sum(sizes[:k]) for k in range(len(directories))]
    at = 8 + sum(sizes)
    blobs, made = [], b""
    strip = at
    blobs.append(payload)
    at += len(payload)
    for d in directories:
        fields, nxt = b"", 0
        for f in d:
            if f[0] == "next":
                nxt = starts[f[1]] if f[1] < len(starts) else 0x7FFFFFF0
                continue
            tag, form, count, value = f
            if isinstance(value, tuple):
                value = starts[value[1]] if value[0] == "dir" else strip
            elif isinstance(value, bytes) and len(value) > 4:
                blobs.append(value)
                value, at = at, at + len(value)
                fields += tag.to_bytes(2, order) + form.to_bytes(2, order) + count.to_bytes(4, order) + value.to_bytes(4, order)  # type: ignore[arg-type]
                continue
            fields += _field(order, tag, form, count, value)
        made += (len(fields) // 12).to_bytes(2, order) + fields + nxt.to_bytes(4, order)  # type: ignore[arg-type]
    return out[:4] + (8).to_bytes(4, order) + made + b"".join(blobs)  # type: ignore[arg-type]


def _ascii(s: str) -> bytes:
    return s.encode() + b"\0"


def _ratios(order: str, *pairs: tuple[int, int]) -> bytes:
    return b"".join(x.to_bytes(4, order) for pair in pairs for x in pair)  # type: ignore[arg-type]


def exif(i: int) -> bytes:
    """Exif with a maker, an orientation, an Exif directory, and for every third number a position."""
    order = "little" if i % 2 else "big"
    make = _ascii(f"maker {i}")
    first = [(0x010F, 2, len(make), make), (0x0112, 3, 1, 1 + i % 8), (0x8769, 4, 1, ("dir", 1))]
    second = [(0x829A, 5, 1, _ratios(order, (1, 1 + i % 50))), (0x9003, 2, 20, _ascii("2024:01:02 03:04:05")), (0xA002, 4, 1, 640)]
    dirs = [first, second]
    if i % 3 == 0:
        first.append((0x8825, 4, 1, ("dir", 2)))
        dirs.append([
            (1, 2, 2, b"N\0"), (2, 5, 3, _ratios(order, (i % 90, 1), (30, 1), (0, 1))), (3, 2, 2, b"W\0"), (4, 5, 3, _ratios(order, (i % 180, 1), (15, 1), (0, 1))),
        ])
    return b"Exif\0\0" + tiff_file(order, dirs)


def _segment(mark: int, body: bytes) -> bytes:
    return bytes([255, mark]) + (len(body) + 2).to_bytes(2) + body


def jpeg(i: int, t: str) -> bytes:
    raw, p = t.encode(), printable(t).encode()
    out = [b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), _segment(0xE1, exif(i))]
    out += [_segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + c) for c in _cut(raw, SEGMENT)]
    out += [_segment(0xFE, c) for c in _cut(p, SEGMENT)]
    out += [_segment(0xEE, b"Adobe"), _segment(0xDB, bytes(32)), _segment(0xC0, b"\x08\0\x07" + (1 + i % 900).to_bytes(2) + b"\x03" + bytes(9))]
    out += [b"\xff\xda\0\x04\0\0" + raw + b"\xff\0\xff\xd0\x33", _segment(0xED, b"Photoshop 3.0\0late"), b"\xff\xda\0\x04\0\0\x11\xff\xd9tail"]
    return b"".join(out)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return len(body).to_bytes(4) + kind + body + zlib.crc32(kind + body).to_bytes(4)


def png(i: int, t: str) -> bytes:
    raw, p = t.encode(), printable(t).encode()
    out = [b"\x89PNG\r\n\x1a\n", _chunk(b"IHDR", (1 + i % 900).to_bytes(4) + b"\0\0\0\x07\x08\0\0\0\0"), _chunk(b"tEXt", b"Comment\0" + p), _chunk(b"iTXt", b"Title\0" + raw)]
    out += [_chunk(b"pHYs", b"\0\0\x0b\x13\0\0\x0b\x13\1"), _chunk(b"tIME", b"\x07\xe8\1\2\3\4\5"), _chunk(b"prVt", bytes(5))]
    return b"".join([*out, _chunk(b"IDAT", raw), _chunk(b"IDAT", b"\x78\x9c\3\0"), _chunk(b"eXIf", bytes(3)), _chunk(b"IEND", b""), b"tail"])


def _riff_chunk(kind: bytes, body: bytes) -> bytes:
    return kind + len(body).to_bytes(4, "little") + body + bytes(len(body) & 1)


def _riff(form: bytes, *chunks: bytes) -> bytes:
    body = form + b"".join(chunks)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def webp(i: int, t: str) -> bytes:
    raw, p = t.encode(), printable(t).encode()
    size = (i % 900).to_bytes(3, "little") + (6).to_bytes(3, "little")
    made = _riff(b"WEBP", _riff_chunk(b"VP8X", b"\x2c\0\0\0" + size), _riff_chunk(b"VP8 ", raw), _riff_chunk(b"EXIF", b"\1\2\3"), _riff_chunk(b"XMP ", p), _riff_chunk(b"abcd", b"\1\2\3\4"))
    return made + (b"tail" if i % 4 == 0 else b"")


def _synchsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def id3(*frames: tuple[bytes, bytes]) -> bytes:
    """An ID3v2.4 tag with ten bytes of padding."""
    body = b"".join(name + _synchsafe(len(b)) + b"\0\0" + b for name, b in frames) + bytes(10)
    return b"ID3\4\0\0" + _synchsafe(len(body)) + body


def id3v1(title: bytes) -> bytes:
    return b"TAG" + title[:30].ljust(30, b"\0") + b"Ann".ljust(30) + bytes(30) + b"2024" + bytes(30) + b"\xff"


def ape(body: bytes) -> bytes:
    foot = b"APETAGEX" + (2000).to_bytes(4, "little") + (len(body) + 32).to_bytes(4, "little") + bytes(16)
    return foot + body + foot


def lyrics(p: bytes) -> bytes:
    body = b"LYRICSBEGIN" + p
    return body + f"{len(body):06d}".encode() + b"LYRICS200"


def wav(i: int, t: str) -> bytes:
    raw, p = t.encode(), printable(t).encode()
    info = b"INFO" + _riff_chunk(b"INAM", p + b"\0") + _riff_chunk(b"ISFT", b"enc") + _riff_chunk(b"IXYZ", b"\0")
    bext = b"about".ljust(256, b"\0") + f"maker {i}".encode().ljust(32, b"\0") + bytes(314)
    chunks = [_riff_chunk(b"fmt ", struct.pack("<HHIIHH", 1, 1, 44100, 88200, 2, 16)), _riff_chunk(b"LIST", info), _riff_chunk(b"bext", bext), _riff_chunk(b"id3 ", id3((b"TIT2", b"\1" + f"né {i}".encode("utf-16"))))]
    return _riff(b"WAVE", *chunks, _riff_chunk(b"cue ", b"\0" * 4), _riff_chunk(b"data", raw), _riff_chunk(b"junk", raw)) + (b"tail" if i % 4 == 0 else b"")


def _blocks(b: bytes) -> bytes:
    return b"".join(bytes([len(c)]) + c for c in _cut(b, 255) if c) + b"\0"


def gif(i: int, t: str) -> bytes:
    raw, p = t.encode(), printable(t).encode()
    out = [b"GIF89a" + (1 + i % 900).to_bytes(2, "little") + b"\x07\0\x80\0\0" + bytes(6), b"\x21\xfe" + _blocks(p), b"\x21\xff\x0bNETSCAPE2.0\3\1\0\0\0"]
    out += [b"\x21\xff\x0bXMP DataXMP" + _blocks(raw), b"\x21\xf9\4\0\0\0\0\0", b"\x2c" + bytes(4) + b"\2\0\3\0\0\2" + _blocks(raw), b"\x21\x77" + _blocks(raw), b"\x3b"]
    return b"".join(out) + (b"tail" if i % 2 else b"")


def comments(vendor: str, *texts: str) -> bytes:
    own = [x.encode() for x in (vendor, *texts)]
    sized = [len(x).to_bytes(4, "little") + x for x in own]
    return sized[0] + len(texts).to_bytes(4, "little") + b"".join(sized[1:])


def _block(kind: int, body: bytes, last: bool = False) -> bytes:
    return bytes([kind | 128 * last]) + len(body).to_bytes(3) + body


def flac(i: int, t: str) -> bytes:
    raw, p = t.encode(), printable(t)
    picture = b"\0\0\0\3\0\0\0\x09image/png" + raw
    out = [id3((b"TPE1", b"\0artist")) if i % 3 == 0 else b"", b"fLaC", _block(0, b"\x10" + bytes(33)), _block(4, comments("enc", f"COMMENT={p}", "ARTIST= ", "COVERART=abc"))]
    out += [_block(6, picture), _block(2, b"ab\0d" + raw[:9]), _block(5, bytes(3)), _block(1, bytes(4), True), b"\xff\xf8" + raw]
    return b"".join(out) + (ape(raw) if i % 5 == 0 else b"") + (id3v1(p.encode()) if i % 2 == 0 else b"")


def mp3(i: int, t: str) -> bytes:
    raw, p = t.encode(), printable(t)
    head = id3((b"TIT2", b"\3" + p.encode()), (b"TALB", b"\1" + f"album é {i}".encode("utf-16")), (b"COMM", b"\3engnote\0" + p.encode()), (b"APIC", raw + b"\0"), (b"PRIV", raw + b"\0"), (b"WOAR", b"http://a.example/"))
    return head + b"\xff\xfb\x90\x64" + raw + (lyrics(p.encode()) if i % 3 == 0 else b"") + (ape(raw) if i % 2 == 0 else b"") + id3v1(p.encode())


def _ogg_pages(packets: list[bytes], first: int, start: bool = False) -> list[bytes]:
    laces = b"".join(b"\xff" * (len(x) // 255) + bytes([len(x) % 255]) for x in packets)
    body, out, at, goes_on = b"".join(packets), [], 0, False
    for k in range(0, len(laces), 255):
        own = laces[k : k + 255]
        n = sum(own)
        page = b"OggS\0" + bytes([goes_on + 2 * start]) + bytes(8) + b"abcd" + (first + len(out)).to_bytes(4, "little") + bytes(4) + bytes([len(own)]) + own + body[at : at + n]
        out.append(page[:22] + page_crc(page).to_bytes(4, "little") + page[26:])
        at, goes_on = at + n, own[-1] == 255
    return out


def ogg(i: int, t: str) -> bytes:
    raw, p = t.encode(), printable(t)
    first = _ogg_pages([b"\x01vorbis" + bytes(23)], 0, True)
    heads = _ogg_pages([b"\x03vorbis" + comments("enc", f"COMMENT={p}", "ARTIST=") + b"\1", b"\x05vorbis" + raw], 1)
    sound = _ogg_pages([raw + b"\1"], 1 + len(heads))
    return b"".join([*first, *heads, *sound])


def tiff(i: int, t: str, lost: bool = False) -> bytes:
    raw, p = t.encode(), printable(t)
    order = "little" if i % 2 else "big"
    about, soft = _ascii(p), _ascii(f"soft {i}")
    first = [(0x0100, 4, 1, 1 + i % 900), (0x010E, 2, len(about), about), (0x0111, 4, 1, ("strip",)), (0x0112, 3, 1, 1 + i % 8), (0x0117, 4, 1, len(raw)), (0x0131, 2, len(soft), soft), (0x8769, 4, 1, ("dir", 1)), ("next", 99 if lost else 2)]
    below = [(0x9003, 2, 20, _ascii("2024:01:02 03:04:05")), (0x9000, 7, 4, b"0230")]
    last = [(0x0100, 4, 1, 5), (0x8298, 2, 4, b"me \0"), (0x02BC, 1, 3, b"xmp")]
    return tiff_file(order, [first, below, last], raw)


def tiff_lost(i: int, t: str) -> bytes:
    """For odd numbers the second directory lies beyond the end."""
    return tiff(i, t, i % 2 == 1)


def _box(kind: bytes, *body: bytes) -> bytes:
    whole = b"".join(body)
    return (len(whole) + 8).to_bytes(4) + kind + whole


def mp4(i: int, t: str) -> bytes:
    raw = t.encode()
    times = (b"\0\0\0\1" * 2 if i % 2 else bytes(8)) + bytes(12)
    moov = _box(b"moov", _box(b"mvhd", bytes(4) + times), _box(b"trak", _box(b"tkhd", bytes(4) + bytes(8)), _box(b"mdia", _box(b"mdhd", b"\1\0\0\0" + b"\2" * 16))), _box(b"udta", raw))
    tail = [_box(b"uuid", bytes(16) + b"com.apple.quicktime.make" + raw), _box(b"uuid", bytes(16) + b"C2PA")] if i % 3 else []
    return b"".join([_box(b"ftyp", b"isom\0\0\0\0mp42"), moov, _box(b"mdat", raw), *tail])


def heic(i: int, t: str) -> bytes:
    """An Exif item in two extents of the text, an XMP item inside ``idat``, an image item, and for odd numbers an item whose data cannot be found."""
    raw = t.encode()
    infe = lambda k, kind, *strings: _box(b"infe", b"\2\0\0\0" + k.to_bytes(2) + b"\0\0" + kind + b"".join(s + b"\0" for s in strings))
    items = [infe(1, b"hvc1", b"picture"), infe(2, b"Exif", b""), infe(3, b"mime", b"", b"application/rdf+xml")] + ([infe(4, b"Exif", b"lost")] if i % 2 else [])
    half = len(raw) // 2

    def meta(data: int) -> bytes:
        at = lambda *pairs: b"".join(a.to_bytes(4) + n.to_bytes(4) for a, n in pairs)
        loc = [(1, 0, [(data + len(raw), 4)]), (2, 0, [(data, half), (data + half, len(raw) - half)]), (3, 1, [(0, 5)])] + ([(4, 2, [(0, 9)])] if i % 2 else [])
        rows = b"".join(k.to_bytes(2) + m.to_bytes(2) + b"\0\0" + len(own).to_bytes(2) + at(*own) for k, m, own in loc)
        iloc = _box(b"iloc", b"\1\0\0\0\x44\0" + len(loc).to_bytes(2) + rows)
        size = _box(b"iprp", _box(b"ipco", _box(b"ispe", bytes(4) + (1 + i % 900).to_bytes(4) + (7).to_bytes(4))))
        return _box(b"meta", bytes(4), _box(b"iinf", bytes(4) + len(items).to_bytes(2), *items), iloc, size, _box(b"idat", b"<xmp>"))

    head = _box(b"ftyp", b"heic\0\0\0\0mif1heic")
    data = len(head) + len(meta(0)) + 8
    return b"".join([head, meta(data), _box(b"mdat", raw, b"\0\1\2\3"), *([_box(b"jumb", raw)] if i % 4 == 0 else [])])


def xml(t: str) -> str:
    return t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _zip(members: dict[str, bytes], i: int) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED) as z:
        for name, data in members.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED)
    return out.getvalue()


def docx(i: int, t: str) -> bytes:
    """Core properties with the text, tracked changes by their number, comments, a custom property, a JPEG, what is no image, and by number an SVG with a JPEG in a data address."""
    p = xml(printable(t))
    changes = "".join(f'<w:ins w:author="Ann {k % 3}"><w:r>x</w:r></w:ins>' for k in range(i % 4)) + '<w:del w:author="Bob"/>' * (i % 2)
    members = {
        "[Content_Types].xml": "<Types/>", "word/document.xml": f'<?xml version="1.0"?><w:document><w:p w:rsidR="00A1">{p}</w:p>{changes}<!-- <w:ins/> --></w:document>',
        "docProps/core.xml": f"<cp:coreProperties><dc:title>{p}</dc:title><dc:creator>A &amp; B</dc:creator><cp:keywords/></cp:coreProperties>",
        "docProps/app.xml": f"<Properties><Application>made {i}</Application></Properties>",
        "docProps/custom.xml": '<Properties><property fmtid="x" name="Client &#65;"><vt:lpwstr>y</vt:lpwstr></property></Properties>',
    }
    if i % 5 == 0:
        members["word/comments.xml"] = f'<w:comments><w:comment w:author="Zoe">{p}</w:comment></w:comments>'
    made = {k: v.encode() for k, v in members.items()}
    made["word/media/image1.png"] = b"\xff\xd8" + _segment(0xFE, b"inside") + b"\xff\xd9"
    made["word/media/image2.jpg"] = b"nothing"
    if i % 3 == 0:
        made["word/media/image3.svg"] = b'<svg><title>t</title><image href="data:image/jpeg;base64,/9j//gAIaW5zaWRl/9k="/></svg>'
    return _zip(made, i)


def linked(i: int, t: str) -> bytes:
    """A DOCX whose relationships lead to parts, out of the document, above its root and nowhere."""
    rel = lambda *rows: "<Relationships>" + "".join(f'<r:Relationship Id="r{k}" Target="{xml(x)}"{mode}/>' for k, (x, mode) in enumerate(rows)) + "</Relationships>"
    members = {
        "[Content_Types].xml": "<Types/>", "word/document.xml": f"<a>{xml(printable(t))}</a>", "docProps/core.xml": "<c/>", "word/comments.xml": "<c/>",
        "_rels/.rels": rel(("word/document.xml", ""), ("/docProps/core.xml", ""), (f"http://a.example/{i}", ' TargetMode="external"')),
        "word/_rels/document.xml.rels": rel(("comments.xml", ""), ("../docProps/./app.xml#f", ""), (f"../../beyond/{i}.xml", ""), (f"media\\{i}.png", ""), (" ", ""), (f"a/../b//{i}&.XML", "")),
    }
    return _zip({k: v.encode() for k, v in members.items()}, i)


def other_document(i: int, t: str) -> bytes:
    """By number: XLSX, PPTX, ODT, EPUB, or an archive of no known kind."""
    p = xml(printable(t))
    kind = i % 5
    if kind == 0:
        m = {"[Content_Types].xml": "<Types/>", "xl/workbook.xml": f"<a>{p}</a>", "xl/comments1.xml": "<c/>", "xl/persons/person.xml": "<p/>"}
    elif kind == 1:
        m = {"[Content_Types].xml": "<Types/>", "ppt/presentation.xml": f"<a>{p}</a>", "ppt/commentAuthors.xml": "<c/>"}
    elif kind == 2:
        m = {"mimetype": "application/vnd.oasis.opendocument.text", "meta.xml": f"<m><dc:title>{p}</dc:title><meta:generator>gen</meta:generator></m>", "content.xml": '<c><office:annotation creator="Eve">n</office:annotation></c>'}
    elif kind == 3:
        m = {
            "mimetype": "application/epub+zip", "META-INF/container.xml": '<c><rootfile full-path="a/b.opf" media-type="application/oebps-package+xml"/></c>',
            "a/b.opf": f'<package><metadata><dc:title>kept</dc:title><dc:creator id="x">{p}</dc:creator><meta property="dcterms:modified">2024</meta><meta name="cover" content="c"/><meta name="calibre:series" content="s"/><link rel="record" href="r"/></metadata></package>',
            "META-INF/calibre_bookmarks.txt": p,
        }
    else:
        m = {"readme.txt": p}
    return _zip({k: v.encode() for k, v in m.items()}, i)


#: What follows the shapes, by number: elements in one another, one that is not closed, a section whose tags are seen or not by where it is read.
_SVG_MORE = ("", "<g><desc>a<desc>b</desc>c</desc></g>", "<desc>open", "<text><![CDATA[ <title>x</title> ]]></text>")


def svg(i: int, t: str, images: bool | None = None) -> bytes:
    """Text in a comment and a title; metadata with comments inside, a script, addresses and styles by number; every second with images in data addresses, or all or none with ``images``."""
    p = xml(printable(t))
    image = "data:image/jpeg;base64,/9j//gAIaW5zaWRl/9k="
    body = f'<?xml version="1.0"?><?xml-stylesheet href="a.css"?><!-- {p.replace("--", "").replace(chr(39), "")} --><svg xmlns="http://www.w3.org/2000/svg" xmlns:inkscape="x" onload="go()"><title>{p}</title><desc/>'
    body += "<metadata><!-- m --><a/></metadata>" * (i % 3) + "<script>x</script>" * (i % 2)
    body += f'<image href="{image}"/><image xlink:href="data:text/plain,x"/>' * (i % 2 if images is None else images)
    body += '<use href="#a"/><rect fill="url(#b)" style="fill:url(http://e.example/)"/>' + _SVG_MORE[i % 4]
    return (b"\xef\xbb\xbf" if i % 2 else b"") + (body + "<style>@import 'x.css';</style></svg>").encode()


def svg_images(i: int, t: str) -> bytes:
    """An SVG with images in data addresses, whatever its number."""
    return svg(i, t, True)


def avif(i: int, t: str) -> bytes:
    return heic(i, t).replace(b"heic\0\0\0\0mif1heic", b"avif\0\0\0\0mif1avif", 1)


BUILD: dict[str, Callable[[int, str], bytes]] = {
    "jpeg": jpeg, "png": png, "webp": webp, "wav": wav, "gif": gif, "flac": flac, "mp3": mp3, "ogg": ogg, "tiff": tiff, "mp4": mp4, "heic": heic, "avif": avif,
    "docx": docx, "zip": other_document, "svg": svg, "svg_images": svg_images, "tiff_lost": tiff_lost, "linked": linked,
}
#: The types that can be cleaned, by number.
TYPES = ("jpeg", "png", "webp", "wav", "gif", "flac", "mp3", "ogg", "tiff", "mp4", "heic")


def files(docs: DataFrame, kind: str | None = None, cut: bool = False) -> DataFrame:
    """(doc_id, file_type, content): each document as a file of that type, or of one of TYPES by its number. With ``cut``, every fifth loses its last seven bytes. Null text counts as empty."""
    told = "doc_id long, file_type string, content binary"
    schema = arrow_schema(told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = (c.to_pylist() for c in batch.columns)
            types = [kind or TYPES[i % len(TYPES)] for i in ids]
            made = [BUILD[k](i, t or "") for k, i, t in zip(types, ids, texts, strict=True)]
            made = [b[:-7] if cut and i % 5 == 0 else b for i, b in zip(ids, made, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(types, schema.field(1).type), pa.array(made, schema.field(2).type)], schema=schema)

    return bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, told)


def magic_files(docs: DataFrame) -> DataFrame:
    """(doc_id, content): a text after the leading bytes of a type; one kind in 15 has none."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    heads = F.array(*[raw_bytes(h) for _, h in MAGIC], raw_bytes(""))
    return docs.select("doc_id", F.concat(F.get(heads, F.pmod("doc_id", F.lit(len(MAGIC) + 1)).cast("int")), text).alias("content"))
