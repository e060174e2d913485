"""Metadata entries (category, name, value) from parts, in the order of the file."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.functions.text import WHITE
from partwise.operators.documents import KINDS, document_entries, empty
from partwise.operators.svg import svg_entries

#: Names of the RIFF INFO fields.
INFO = {
    "INAM": "Title", "IART": "Artist", "IPRD": "Album", "ICMT": "Comment", "ICRD": "Date", "IGNR": "Genre", "ISFT": "Encoder", "IENG": "Engineer",
    "ICOP": "Copyright", "ITRK": "Track", "ITCH": "Technician", "ISBJ": "Subject", "ISRC": "Source", "IKEY": "Keywords",
}
#: Names of Exif fields, of the first directory and of the Exif directory.
EXIF_FIRST = {0x010F: "Camera Make", 0x0110: "Camera Model", 0x011A: "X Resolution", 0x011B: "Y Resolution", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright"}
EXIF = {
    0x829A: "Exposure Time", 0x829D: "F-Number", 0x8827: "ISO Speed", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x920A: "Focal Length",
    0xA002: "Pixel X Dimension", 0xA003: "Pixel Y Dimension", 0xA405: "Focal Length In 35mm Film", 0xA420: "Image Unique ID", 0xA431: "Camera Serial Number",
    0xA433: "Lens Make", 0xA434: "Lens Model", 0xA435: "Lens Serial Number",
}
#: Names of TIFF fields that are metadata.
TIFF = {
    0x010E: "Image description", 0x010F: "Camera make", 0x0110: "Camera model", 0x011A: "X resolution", 0x011B: "Y resolution", 0x0131: "Software", 0x0132: "DateTime",
    0x013B: "Artist", 0x02BC: "XMP data", 0x8298: "Copyright", 0x83BB: "IPTC data", 0x8649: "Photoshop data", 0x8769: "EXIF IFD", 0x8825: "GPS IFD",
    0xA005: "Interoperability IFD", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0xA420: "Image unique ID", 0xA431: "Camera serial number",
    0xA433: "Lens make", 0xA434: "Lens model", 0xA435: "Lens serial number",
}
#: Names of ID3 frames, of version 2.2 and later.
FRAMES = {
    "TIT2": "Title", "TT2": "Title", "TPE1": "Artist", "TP1": "Artist", "TALB": "Album", "TAL": "Album", "TDRC": "Recording date", "TYER": "Recording date",
    "TYE": "Recording date", "TCON": "Genre", "TCO": "Genre", "TCOP": "Copyright", "TCR": "Copyright", "TSSE": "Encoder", "TSS": "Encoder", "TXXX": "User text",
    "TXX": "User text", "COMM": "Comment", "COM": "Comment", "USLT": "Lyrics", "ULT": "Lyrics", "WXXX": "User URL", "WXX": "User URL", "UFID": "Unique file ID",
    "UFI": "Unique file ID", "PRIV": "Private frame", "GEOB": "Embedded object", "GEO": "Embedded object", "APIC": "Attached picture", "PIC": "Attached picture",
}
#: Fields of an ID3v1 tag, by place and length.
OLD_FIELDS = (("Title", 3, 30), ("Artist", 33, 30), ("Album", 63, 30), ("Year", 93, 4), ("Comment", 97, 30))
#: Boxes of MP4 and MOV that are metadata as a whole.
VIDEO_BOXES = ("udta", "meta", "ilst", "cprt", "keys", "XMP_", "Exif", "name", "auth", "©nam", "©ART", "©day", "©too", "©xyz")

_LATIN = "decode(x.data, 'ISO-8859-1')"
CREDENTIALS = f"coalesce({_LATIN} rlike '(?i)c2pa|jumb|content credentials', false)"
TEXT_BOX = f"(x.kind = 'BOX:uuid' and coalesce({_LATIN} rlike '(?i)xmp|exif|com\\\\.apple\\\\.quicktime\\\\.(location|make|model|software)|gps', false))"
_BYTES = "concat(x.n, ' bytes')"
_TAIL = "concat(x.n, ' bytes; removed during {} cleaning')"
_PRINT = "regexp_replace({}, '[\\\\x00-\\\\x1F\\\\x7F]', '')"


_WHITE = "".join(f"\\u{ord(c):04x}" for c in WHITE)


def _trim(text: str) -> str:
    return f"trim(both '{_WHITE}' from {text})"


def _cut(text: str, n: int) -> str:
    return f"if(char_length({text}) > {n}, concat(left({text}, {n}), '...'), {text})"


def _named(values: dict, key: str, otherwise: str = "null") -> str:
    return f"case {key} " + " ".join(f"when {k if isinstance(k, int) else repr(k)} then '{v}'" for k, v in values.items()) + f" else {otherwise} end"


_KEYWORD = f"substring_index({_LATIN}, '\\u0000', 1)"
_PNG_VALUE = _PRINT.format(f"substring({_LATIN}, char_length({_KEYWORD}) + 2)")
_FIELD = _trim(_PRINT.format(f"substring_index({_LATIN}, '\\u0000', 1)"))
_KEY, _VALUE = _trim("substring_index(x.text, '=', 1)"), _trim("if(contains(x.text, '='), substring(x.text, char_length(substring_index(x.text, '=', 1)) + 2), '')")
_TRAILING = [("x.kind = 'TRAILING'", "'Trailing'", "'Trailing Data'", "concat(x.size, ' bytes')"), ("x.kind = 'MALFORMED'", "'Trailing'", "'Malformed RIFF Data'", "concat(x.size, ' bytes')")]
_AUDIO = "'Audio metadata'"
_FRAME = [(
    "x.kind like 'FRAME:%'", "if(x.kind in ('FRAME:APIC', 'FRAME:PIC'), 'Embedded artwork', 'Audio metadata')",
    _named(FRAMES, "substring(x.kind, 7)", "case substring(x.kind, 7, 1) when 'W' then 'URL' when 'T' then 'Text frame' else 'ID3 frame' end"),
    "case when x.kind in ('FRAME:APIC', 'FRAME:PIC') then concat('embedded image, ', x.n, ' bytes') when x.kind like 'FRAME:W%' then x.text else coalesce(nullif(x.text, ''), concat(x.n, ' bytes')) end",
)]
_VORBIS = [
    (f"x.kind = 'VENDOR' and {_trim('x.text')} <> ''", _AUDIO, "'Encoder (vendor)'", _cut(_trim("x.text"), 120)),
    (f"x.kind = 'VENDOR' or (x.kind = 'COMMENT' and {_VALUE} = '')", "null", "null", "null"),
    (f"x.kind = 'COMMENT' and upper({_KEY}) in ('METADATA_BLOCK_PICTURE', 'COVERART')", "'Embedded artwork'", "'Attached picture (Vorbis comment)'", "concat(octet_length(substring(x.text, char_length(substring_index(x.text, '=', 1)) + 2)), ' bytes')"),
    ("x.kind = 'COMMENT'", _AUDIO, _cut(_KEY, 60), _cut(_VALUE, 180)),
]
_TAGS = [("x.kind like 'TAIL:%'", _AUDIO, "concat(substring(x.kind, 6), ' tag')", _TAIL)]
_CREDENTIAL_BOX = (f"x.kind = 'BOX:jumb' or (x.kind = 'BOX:uuid' and {CREDENTIALS})", "'Content Credentials'", "concat(x.text, ' box')", "concat(x.size, ' bytes')")
_VIDEO = "x.kind in (" + ", ".join(f"'BOX:{k}'" for k in VIDEO_BOXES) + f") or {TEXT_BOX}"
META_ITEM = "({i}.kind = 'ITEM:Exif' or ({i}.kind = 'ITEM:mime' and cast({i}.data as string) in ('application/rdf+xml', 'application/xml', 'text/xml')) or ({i}.kind like 'ITEM:%' and contains(lower({i}.text), 'xmp')))"
#: The bytes of all extents of an item: items joined with extents by number.
_ITEM_BYTES = "aggregate(filter(parts, e -> e.kind = 'EXTENT' and e.num = x.num), 0L, (a, e) -> a + e.n)"
_ITEM_LABEL = "if(x.text = '', concat('item ', x.num), x.text)"

#: For each type: (condition, category, name, value) in SQL over a part x; the first that holds gives the entry, a null category none.
RULES: dict[str, list[tuple[str, str, str, str]]] = {
    "jpeg": [
        ("x.kind = 'GPS'", "'Location'", "'GPS / Location data'", "x.text"),
        ("x.kind in ('IFD0', 'EXIF') and x.text = ''", "null", "null", "null"),
        ("x.kind = 'IFD0'", f"if({_named(EXIF_FIRST, 'x.num')} is null, null, 'EXIF')", _named(EXIF_FIRST, "x.num"), "x.text"),
        ("x.kind = 'EXIF'", f"if({_named(EXIF, 'x.num')} is null, null, 'EXIF')", _named(EXIF, "x.num"), "x.text"),
        ("x.kind not rlike '^FF(E[0-9A-F]|FE)$' or x.kind = 'FFEE'", "null", "null", "null"),
        (f"x.kind = 'FFEB' and (startswith(x.data, cast('JUMBF' as binary)) or {CREDENTIALS})", "'Content Credentials'", "'JPEG APP11/JUMBF'", _BYTES),
        ("x.kind = 'FFE1' and startswith(x.data, X'457869660000')", "null", "null", "null"),
        ("x.kind = 'FFE1' and (startswith(x.data, cast('http://ns.adobe.com/xap/' as binary)) or startswith(x.data, cast('<?xpacket' as binary)))", "'XMP'", "'XMP Data'", _BYTES),
        ("x.kind = 'FFE0'", "'APP0'", "case when startswith(x.data, cast('JFIF' as binary)) then 'JFIF Segment' when startswith(x.data, cast('JFXX' as binary)) then 'JFIF Extension Segment' else 'APP0 Segment' end", _BYTES),
        ("x.kind = 'FFE2' and startswith(x.data, cast('ICC_PROFILE' as binary))", "null", "null", "null"),
        ("x.kind = 'FFEC'", "'Ducky'", "'Ducky Tag'", _BYTES),
        ("x.kind = 'FFED' and startswith(x.data, cast('Photoshop 3.0' as binary))", "'IPTC'", "'Photoshop/IPTC Data'", _BYTES),
        ("x.kind = 'FFFE'", "'Comment'", "'Comment'", "if(is_valid_utf8(cast(x.data as string)) and regexp_replace(cast(x.data as string), '\\\\p{Cc}', '') <> '', regexp_replace(cast(x.data as string), '\\\\p{Cc}', ''), concat('[', x.n, ' bytes]'))"),
        ("x.kind = 'FFEB'", "'APP11/JUMBF'", "'APP11/JUMBF Segment'", _BYTES),
        ("true", "concat('APP', conv(substring(x.kind, 4), 16, 10))", "concat('APP', conv(substring(x.kind, 4), 16, 10), ' Segment')", _BYTES),
    ],
    "png": [
        ("x.kind in ('SIGNATURE', 'IHDR', 'PLTE', 'IDAT', 'IEND', 'tRNS', 'sRGB', 'gAMA', 'cHRM', 'iCCP', 'acTL', 'fcTL', 'fdAT')", "null", "null", "null"),
        *_TRAILING,
        (f"x.kind in ('jumb', 'caBX') or {CREDENTIALS}", "'Content Credentials'", "x.kind", _BYTES),
        ("x.kind in ('tEXt', 'zTXt', 'iTXt') and not contains(x.data, X'00')", "null", "null", "null"),
        ("x.kind = 'tEXt'", "'Text'", _PRINT.format(_KEYWORD), _cut(_PNG_VALUE, 100)),
        ("x.kind = 'zTXt'", "'Text'", _PRINT.format(_KEYWORD), f"concat('[compressed, ', greatest(0, x.n - char_length({_KEYWORD}) - 2), ' bytes]')"),
        ("x.kind = 'iTXt'", "'Text'", _PRINT.format(_KEYWORD), "concat('[international text, ', x.n, ' bytes]')"),
        ("x.kind = 'eXIf'", "'EXIF'", "'EXIF Data'", _BYTES),
        ("x.kind = 'tIME' and x.n >= 7", "'Time'", "'Last Modified'", "format_string('%04d-%02d-%02d %02d:%02d:%02d', cast(conv(hex(substring(x.data, 1, 2)), 16, 10) as int), " + ", ".join(f"cast(conv(hex(substring(x.data, {i}, 1)), 16, 10) as int)" for i in range(3, 8)) + ")"),
        ("x.kind = 'pHYs' and x.n >= 9", "'Physical'", "'Pixel Dimensions'", "concat(conv(hex(substring(x.data, 1, 4)), 16, 10), 'x', conv(hex(substring(x.data, 5, 4)), 16, 10), ' per ', if(substring(x.data, 9, 1) = X'01', 'meter', 'unknown'))"),
        ("x.kind in ('tIME', 'pHYs')", "null", "null", "null"),
        ("true", "'Other'", "x.kind", _BYTES),
    ],
    "webp": [
        ("x.kind in ('RIFF', 'VP8 ', 'VP8L', 'VP8X', 'ALPH', 'ANIM', 'ANMF', 'ICCP')", "null", "null", "null"),
        *_TRAILING,
        (f"x.kind in ('JUMB', 'jumb') or {CREDENTIALS}", "'Content Credentials'", _trim("x.kind"), _BYTES),
        ("x.kind = 'EXIF'", "'EXIF'", "'EXIF Data'", _BYTES),
        ("x.kind = 'XMP '", "'XMP'", "'XMP Data'", _BYTES),
        ("true", "'Other'", _trim("x.kind"), _BYTES),
    ],
    "gif": [
        ("x.kind in ('SCREEN', 'IMAGE', 'TRAILER', 'EXT:F9', 'EXT:01')", "null", "null", "null"),
        _TRAILING[0],
        ("x.kind = 'EXT:FE'", "'Comment'", "'Comment'", f"if({_PRINT.format(_LATIN)} = '', {_BYTES}, {_cut(_PRINT.format(_LATIN), 100)})"),
        ("x.kind = 'EXT:FF' and x.text is not null and substring(x.data, 1, 11) in (cast('NETSCAPE2.0' as binary), cast('ANIMEXTS1.0' as binary))", "null", "null", "null"),
        ("x.kind = 'EXT:FF' and x.text is not null and substring(x.data, 1, 11) = cast('XMP DataXMP' as binary)", "'XMP'", "'XMP Data'", "concat(greatest(0, x.n - 11), ' bytes')"),
        ("x.kind = 'EXT:FF'", "'Application'", "coalesce(x.text, 'Unknown Application Extension')", _BYTES),
        ("true", "'Extension'", "concat('Extension 0x', substring(x.kind, 5))", _BYTES),
    ],
    "tiff": [
        ("x.kind in ('TAG', 'SUBTAG')", f"if({_named(TIFF, 'x.num')} is null, null, case when x.num = {0x8825} then 'Location' when x.num = {0x02BC} then 'XMP' when x.num in ({0x83BB}, {0x8649}) then 'IPTC' else 'TIFF metadata' end)", _named(TIFF, "x.num"), "x.text"),
        ("true", "null", "null", "null"),
    ],
    "wav": [
        ("x.kind in ('RIFF', 'fmt ', 'data', 'fact')", "null", "null", "null"),
        *_TRAILING, *_FRAME,
        (f"x.sub and {_FIELD} = ''", "null", "null", "null"),
        ("x.kind like 'INFO:%'", _AUDIO, _named(INFO, "substring(x.kind, 6)", "'INFO field'"), _cut(_FIELD, 180)),
        ("x.kind like 'BEXT:%'", _AUDIO, "concat('bext ', substring(x.kind, 6))", _cut(_FIELD, 180)),
        ("x.kind = 'LIST' and startswith(x.data, cast('INFO' as binary))", "null", "null", "null"),
        ("x.kind = 'LIST'", _AUDIO, f"concat('LIST ', if(x.n < 4, 'LIST', {_trim('decode(substring(x.data, 1, 4), ' + repr('ISO-8859-1') + ')')}), ' chunk')", _TAIL.format("WAV")),
        ("x.kind = 'bext'", _AUDIO, "'Broadcast extension (bext)'", _BYTES),
        ("x.kind in ('id3 ', 'ID3 ')", _AUDIO, "'ID3 tag chunk'", _BYTES),
        ("x.kind in ('iXML', 'axml', '_PMX', 'XMP ')", _AUDIO, f"concat({_trim('x.kind')}, ' data')", _BYTES),
        ("x.kind in ('cue ', 'smpl', 'inst', 'adtl', 'labl', 'note')", _AUDIO, f"concat({_trim('x.kind')}, ' chunk')", _TAIL.format("WAV")),
        ("true", "'Other'", _trim("x.kind"), _BYTES),
    ],
    "mp3": [
        *_FRAME,
        ("x.kind = 'ID3v2'", _AUDIO, "concat('ID3v2.', x.num, ' tag')", _BYTES),
        ("x.kind = 'TAIL:ID3v1'", _AUDIO, "'ID3v1 tag'", _BYTES),
        (_TAGS[0][0], *_TAGS[0][1:3], _TAIL.format("MP3")),
        ("true", "null", "null", "null"),
    ],
    "flac": [
        ("x.kind in ('fLaC', 'BLOCK:0', 'BLOCK:1', 'BLOCK:3', 'AUDIO')", "null", "null", "null"),
        *_FRAME, *_VORBIS,
        ("x.kind = 'PREFIX'", _AUDIO, "'ID3v2 tag prepended to FLAC'", _BYTES),
        ("x.kind = 'BLOCK:4'", _AUDIO, "'Vorbis comments'", _BYTES),
        ("x.kind = 'BLOCK:6'", "'Embedded artwork'", "'Attached picture'", "concat('embedded image', if(x.text = '', '', concat(' (', x.text, ')')), ', ', x.n, ' bytes')"),
        ("x.kind = 'BLOCK:5'", _AUDIO, "'CD cue sheet'", _TAIL.format("FLAC")),
        ("x.kind = 'BLOCK:2'", _AUDIO, "'Application block'", f"concat('\\'', regexp_replace({_LATIN}, '[^ -~]', '.'), '\\', ', x.n, ' bytes; removed during FLAC cleaning')"),
        (_TAGS[0][0], *_TAGS[0][1:3], _TAIL.format("FLAC")),
        ("true", _AUDIO, "concat('Metadata block type ', substring(x.kind, 7))", _TAIL.format("FLAC")),
    ],
    "ogg": [*_VORBIS, ("x.kind = 'COMMENTS'", _AUDIO, "'Vorbis comments'", _BYTES), ("true", "null", "null", "null")],
    "mp4": [
        _CREDENTIAL_BOX,
        (_VIDEO, "'Video metadata'", "concat(x.text, ' box')", "concat(x.size, ' bytes')"),
        ("x.kind like 'TIME:%'", "'Video metadata'", "concat(x.text, ' timestamps')", _BYTES),
        ("true", "null", "null", "null"),
    ],
    "heic": [
        _CREDENTIAL_BOX,
        (META_ITEM.format(i="x"), "'HEIF metadata'", "if(x.kind = 'ITEM:Exif', 'EXIF item', 'XMP item')", f"if({_ITEM_BYTES} > 0, concat({_ITEM_LABEL}, ', ', {_ITEM_BYTES}, ' bytes'), {_ITEM_LABEL})"),
        ("true", "null", "null", "null"),
    ],
}
RULES |= {"mov": RULES["mp4"], "avif": RULES["heic"], "heif": RULES["heic"]}
VIDEO_RULE = f"{_CREDENTIAL_BOX[0]} or {_VIDEO}"
IMAGE_RULE = f"{_CREDENTIAL_BOX[0]} or {TEXT_BOX}"

_ENTRY = "named_struct('category', {}, 'name', {}, 'value', {})"
_OLD = ", ".join(f"named_struct('category', 'Audio metadata', 'name', '{n}', 'value', " + _trim(f"regexp_replace(decode(substring(x.data, {at + 1}, {size}), 'ISO-8859-1'), '[\\\\x00 ]+$', '')") + ")" for n, at, size in OLD_FIELDS)


def _rows(file_type: str) -> str:
    """The entries of all parts of a type, as one SQL expression over ``parts``: an ID3v1 tag gives its fields besides."""
    arms = " ".join(f"when {c} then {_ENTRY.format(*rest)}" for c, *rest in RULES[file_type] if rest[0] != "null" or c != "true")
    arms = arms.replace(_ENTRY.format("null", "null", "null"), "null")
    one = f"case {arms} end"
    many = f"transform(filter(parts, x -> x.told), x -> array({one}))"
    if file_type in ("mp3", "flac"):
        many = f"transform(filter(parts, x -> x.told), x -> if(x.kind = 'TAIL:ID3v1', concat(array({one}), filter(array({_OLD}), f -> f.value <> '')), array({one})))"
    return f"filter(flatten({many}), e -> e.category is not null)"


def entry_rows(types: Iterable[str] | None = None) -> Column:
    """The array of entries of a file from its columns ``file_type`` and ``parts``. All types in one expression, as a batch may mix them; ``types`` leaves out those that cannot occur, which plans faster."""
    return _entry_rows(frozenset(types if types is not None else (*RULES, *KINDS, "svg")))


@cache
def _entry_rows(wanted: frozenset[str]) -> Column:
    """The same expression serves every query: it is long, and built once for each choice of types."""
    file_type = F.col("file_type")
    done: dict[str, list[str]] = {}
    for t in RULES:
        if t in wanted:
            done.setdefault(_rows(t), []).append(t)
    arms = [(file_type.isin(*own), F.expr(rows)) for rows, own in done.items()]
    if wanted & set(KINDS):
        arms.append((file_type.isin(*KINDS), document_entries(file_type, F.col("parts"))))
    if "svg" in wanted:
        arms.append((file_type == "svg", svg_entries(F.col("parts"))))
    out = F.lit(None)
    for test, rows in arms:
        out = F.when(test, rows).otherwise(out)
    return F.coalesce(out, empty())


def entries(walked: DataFrame, key: str = "path", types: Iterable[str] | None = None) -> DataFrame:
    """(key, file_type, ord, category, name, value): ``ord`` counts the entries of a file from 0.

    Damage does not end reading: what lies before it is told. Null content and
    types without metadata have no entries. ``types`` are the file types that
    can occur, all if not given.
    """
    rows = walked.select(key, "file_type", F.posexplode(entry_rows(types)).alias("ord", "e"))
    return rows.select(key, "file_type", "ord", "e.category", "e.name", "e.value")
