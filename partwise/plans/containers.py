"""SQL that tells from the documents table alone what the fixture files hold (see ``sources.fixtures``)."""

from __future__ import annotations

from partwise.sources.fixtures import SEGMENT, TYPES, id3

#: doc_id, the text, its printable ASCII, the text's bytes, and whether either holds words of content credentials.
D = (
    "(SELECT doc_id, t, p, strlen(t)::BIGINT AS n, length(p)::BIGINT AS m, regexp_matches(t, '(?i)c2pa|jumb|content credentials') AS tc, regexp_matches(p, '(?i)c2pa|jumb|content credentials') AS pc "
    "FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[^ -~]', '', 'g') AS p FROM documents))"
)
TYPE = f"CASE doc_id % {len(TYPES)} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TYPES)) + " END"


def _cut(text: str, n: int) -> str:
    return f"CASE WHEN length({text}) > {n} THEN left({text}, {n}) || '...' ELSE {text} END"


_TRIM = "trim(p)"
_ONE_BLANK = "trim(regexp_replace(p, ' +', ' ', 'g'))"
_ID3_OF_WAV = f"({len(id3((b'TIT2', b'')))} + 1 + 2 + 2 * (3 + length(doc_id::VARCHAR)))"
_ID3_OF_MP3 = f"({len(id3(*[(b'AAAA', b'')] * 6))} + 1 + m + 1 + 2 + 2 * (8 + length(doc_id::VARCHAR)) + 9 + m + n + 1 + n + 1 + 17)"
_OLD_TITLE = "trim(left(p, 30))"
#: (category, name, value, condition) of the entries of each type, in order; a value with ``spot`` repeats for each segment of the text, or of its ASCII where marked.
ENTRIES: dict[str, list[tuple[str, ...]]] = {
    "jpeg": [
        ("'APP0'", "'JFIF Segment'", "'14 bytes'"), ("'EXIF'", "'Camera Make'", "'maker ' || doc_id"),
        ("'Location'", "'GPS / Location data'", "printf('%.6f, %.6f', doc_id % 90 + 0.5::DOUBLE, -(doc_id % 180 + 0.25::DOUBLE))", "doc_id % 3 = 0"),
        ("'EXIF'", "'Exposure Time'", "rtrim(rtrim(printf('%.4f', 1::DOUBLE / (1 + doc_id % 50)), '0'), '.')"), ("'EXIF'", "'DateTimeOriginal'", "'2024:01:02 03:04:05'"),
        ("'EXIF'", "'Pixel X Dimension'", "'640'"), ("'XMP'", "'XMP Data'", f"(29 + least({SEGMENT}, n - spot)) || ' bytes'", "true", "n"),
        ("'Comment'", "'Comment'", f"CASE WHEN m = 0 THEN '[0 bytes]' ELSE substring(p, spot + 1, {SEGMENT}) END", "true", "m"),
    ],
    "png": [
        ("CASE WHEN pc THEN 'Content Credentials' ELSE 'Text' END", "CASE WHEN pc THEN 'tEXt' ELSE 'Comment' END", f"CASE WHEN pc THEN (8 + m) || ' bytes' ELSE {_cut('p', 100)} END"),
        ("CASE WHEN tc THEN 'Content Credentials' ELSE 'Text' END", "CASE WHEN tc THEN 'iTXt' ELSE 'Title' END", "CASE WHEN tc THEN (6 + n) || ' bytes' ELSE '[international text, ' || (6 + n) || ' bytes]' END"),
        ("'Physical'", "'Pixel Dimensions'", "'2835x2835 per meter'"), ("'Time'", "'Last Modified'", "'2024-01-02 03:04:05'"), ("'Other'", "'prVt'", "'5 bytes'"),
        ("'EXIF'", "'EXIF Data'", "'3 bytes'"), ("'Trailing'", "'Trailing Data'", "'4 bytes'"),
    ],
    "webp": [
        ("'EXIF'", "'EXIF Data'", "'3 bytes'"), ("CASE WHEN pc THEN 'Content Credentials' ELSE 'XMP' END", "CASE WHEN pc THEN 'XMP' ELSE 'XMP Data' END", "m || ' bytes'"),
        ("'Other'", "'abcd'", "'4 bytes'"), ("'Trailing'", "'Trailing Data'", "'4 bytes'", "doc_id % 4 = 0"),
    ],
    "wav": [
        ("'Audio metadata'", "'Title'", _cut(_TRIM, 180), f"{_TRIM} <> ''"), ("'Audio metadata'", "'Encoder'", "'enc'"), ("'Audio metadata'", "'Broadcast extension (bext)'", "'602 bytes'"),
        ("'Audio metadata'", "'bext Description'", "'about'"), ("'Audio metadata'", "'bext Originator'", "'maker ' || doc_id"), ("'Audio metadata'", "'ID3 tag chunk'", f"{_ID3_OF_WAV} || ' bytes'"),
        ("'Audio metadata'", "'Title'", "'né ' || doc_id"), ("'Audio metadata'", "'cue chunk'", "'4 bytes; removed during WAV cleaning'"), ("'Other'", "'junk'", "n || ' bytes'"),
        ("'Trailing'", "'Trailing Data'", "'4 bytes'", "doc_id % 4 = 0"),
    ],
    "gif": [
        ("'Comment'", "'Comment'", f"CASE WHEN m = 0 THEN '0 bytes' ELSE {_cut('p', 100)} END"), ("'XMP'", "'XMP Data'", "n || ' bytes'"),
        ("'Extension'", "'Extension 0x77'", "n || ' bytes'"), ("'Trailing'", "'Trailing Data'", "'4 bytes'", "doc_id % 2 = 1"),
    ],
    "flac": [
        ("'Audio metadata'", "'ID3v2 tag prepended to FLAC'", "'37 bytes'", "doc_id % 3 = 0"), ("'Audio metadata'", "'Artist'", "'artist'", "doc_id % 3 = 0"),
        ("'Audio metadata'", "'Vorbis comments'", "(51 + m) || ' bytes'"), ("'Audio metadata'", "'Encoder (vendor)'", "'enc'"), ("'Audio metadata'", "'COMMENT'", _cut(_TRIM, 180), f"{_TRIM} <> ''"),
        ("'Embedded artwork'", "'Attached picture (Vorbis comment)'", "'3 bytes'"), ("'Embedded artwork'", "'Attached picture'", "'embedded image (image/png), ' || (17 + n) || ' bytes'"),
        ("'Audio metadata'", "'Application block'", "'''ab.d'', ' || (4 + least(9, n)) || ' bytes; removed during FLAC cleaning'"), ("'Audio metadata'", "'CD cue sheet'", "'3 bytes; removed during FLAC cleaning'"),
        ("'Audio metadata'", "'ID3v1 tag'", "'128 bytes; removed during FLAC cleaning'", "doc_id % 2 = 0"), ("'Audio metadata'", "'Title'", _OLD_TITLE, f"doc_id % 2 = 0 AND {_OLD_TITLE} <> ''"),
        ("'Audio metadata'", "'Artist'", "'Ann'", "doc_id % 2 = 0"), ("'Audio metadata'", "'Year'", "'2024'", "doc_id % 2 = 0"),
        ("'Audio metadata'", "'APEv2 tag'", "(64 + n) || ' bytes; removed during FLAC cleaning'", "doc_id % 5 = 0"),
    ],
    "mp3": [
        ("'Audio metadata'", "'ID3v2.4 tag'", f"{_ID3_OF_MP3} || ' bytes'"), ("'Audio metadata'", "'Title'", f"CASE WHEN {_ONE_BLANK} = '' THEN (1 + m) || ' bytes' ELSE {_ONE_BLANK} END"),
        ("'Audio metadata'", "'Album'", "'album é ' || doc_id"), ("'Audio metadata'", "'Comment'", f"CASE WHEN {_ONE_BLANK} = '' THEN (9 + m) || ' bytes' ELSE {_ONE_BLANK} END"),
        ("'Embedded artwork'", "'Attached picture'", "'embedded image, ' || (n + 1) || ' bytes'"), ("'Audio metadata'", "'Private frame'", "(n + 1) || ' bytes'"), ("'Audio metadata'", "'URL'", "'http://a.example/'"),
        ("'Audio metadata'", "'ID3v1 tag'", "'128 bytes'"), ("'Audio metadata'", "'Title'", _OLD_TITLE, f"{_OLD_TITLE} <> ''"), ("'Audio metadata'", "'Artist'", "'Ann'"), ("'Audio metadata'", "'Year'", "'2024'"),
        ("'Audio metadata'", "'APEv2 tag'", "(64 + n) || ' bytes; removed during MP3 cleaning'", "doc_id % 2 = 0"),
        ("'Audio metadata'", "'Lyrics3 tag'", "(26 + m) || ' bytes; removed during MP3 cleaning'", "doc_id % 3 = 0"),
    ],
    "ogg": [("'Audio metadata'", "'Vorbis comments'", "(35 + m) || ' bytes'"), ("'Audio metadata'", "'Encoder (vendor)'", "'enc'"), ("'Audio metadata'", "'COMMENT'", _cut(_TRIM, 180), f"{_TRIM} <> ''")],
    "tiff": [
        ("'TIFF metadata'", "'Image description'", _TRIM), ("'TIFF metadata'", "'Software'", "'soft ' || doc_id"), ("'TIFF metadata'", "'EXIF IFD'", "'98'"),
        ("'TIFF metadata'", "'DateTimeOriginal'", "'2024:01:02 03:04:05'"), ("'TIFF metadata'", "'Copyright'", "'me'"), ("'XMP'", "'XMP data'", "'3 bytes'"),
    ],
    "mp4": [
        ("'Video metadata'", "'mvhd timestamps'", "'8 bytes'", "doc_id % 2 = 1"), ("'Video metadata'", "'mdhd timestamps'", "'16 bytes'"), ("'Video metadata'", "'udta box'", "(n + 8) || ' bytes'"),
        ("CASE WHEN tc THEN 'Content Credentials' ELSE 'Video metadata' END", "'uuid box'", "(n + 48) || ' bytes'", "doc_id % 3 > 0"), ("'Content Credentials'", "'uuid box'", "'28 bytes'", "doc_id % 3 > 0"),
    ],
    "heic": [
        ("'Content Credentials'", "'jumb box'", "(n + 8) || ' bytes'", "doc_id % 4 = 0"), ("'HEIF metadata'", "'EXIF item'", "'item 2' || CASE WHEN n > 0 THEN ', ' || n || ' bytes' ELSE '' END"),
        ("'HEIF metadata'", "'XMP item'", "'item 3, 5 bytes'"), ("'HEIF metadata'", "'EXIF item'", "'lost, 9 bytes'", "doc_id % 2 = 1"),
    ],
}


def _listed(file_type: str, rows: list[tuple[str, ...]], where: str = "true") -> str:
    """Rows of entries numbered in order."""
    parts = []
    for place, row in enumerate(rows):
        category, name, value, condition, repeat = (*row, *("true", "")[len(row) - 3 :])
        source = f"(SELECT *, unnest(range(0, greatest({repeat}, 1), {SEGMENT})) AS spot FROM {D})" if repeat else D
        parts.append(f"SELECT doc_id, {place} AS place, {'spot' if repeat else '0'} AS spot, {category} AS category, {name} AS name, CAST({value} AS VARCHAR) AS value FROM {source} WHERE ({condition}) AND ({where})")
    union = " UNION ALL ".join(parts)
    return f"SELECT doc_id, {file_type} AS file_type, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place, spot) - 1 AS INTEGER) AS ord, category, name, value FROM ({union})"


def entries_sql(only: str | None = None) -> str:
    """Entries of every document as a file of one type, or as one of all types by its number."""
    if only:
        return _listed(f"'{only}'", ENTRIES[only])
    return " UNION ALL ".join(f"({_listed(f"'{t}'", ENTRIES[t], f'doc_id % {len(TYPES)} = {k}')})" for k, t in enumerate(TYPES))


_CHUNKS = f"greatest(1, CAST(ceil({{}} / {SEGMENT}.0) AS BIGINT))"
_EXIF = "(127 + length('maker ' || doc_id) + CASE WHEN doc_id % 3 = 0 THEN 114 ELSE 0 END)"
_BLOCKS = "({0} + CAST(ceil({0} / 255.0) AS BIGINT) + 1)"
_TAIL = "CASE WHEN doc_id % {} THEN 4 ELSE 0 END"
_LACES = "((42 + m) // 255 + 1 + (7 + n) // 255 + 1)"
_FEWER = "(1 + (7 + n) // 255 + 1)"
#: Bytes that cleaning takes away.
REMOVED = {
    "jpeg": f"18 + 4 + {_EXIF} + 33 * {_CHUNKS.format('n')} + n + 4 * {_CHUNKS.format('m')} + m + 22 + 4 - CASE WHEN doc_id % 8 <> 0 THEN 36 ELSE 0 END",
    "png": "20 + m + 18 + n + 21 + 19 + 17 + 15 + 4",
    "webp": f"12 + 8 + m + m % 2 + 12 + {_TAIL.format('4 = 0')}",
    "wav": f"42 + m + 1 + (m + 1) % 2 + 610 + 8 + {_ID3_OF_WAV} + {_ID3_OF_WAV} % 2 + 12 + 8 + n + n % 2 + {_TAIL.format('4 = 0')}",
    "gif": f"2 + {_BLOCKS.format('m')} + 14 + {_BLOCKS.format('n')} + 2 + {_BLOCKS.format('n')} + {_TAIL.format('2 = 1')}",
    "flac": "CASE WHEN doc_id % 3 = 0 THEN 37 ELSE 0 END + 55 + m + 21 + n + 8 + least(9, n) + 7 + CASE WHEN doc_id % 5 = 0 THEN 64 + n ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 128 ELSE 0 END",
    "mp3": f"{_ID3_OF_MP3} + CASE WHEN doc_id % 3 = 0 THEN 26 + m ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 64 + n ELSE 0 END + 128",
    "ogg": f"27 * CAST(ceil({_LACES} / 255.0) - ceil({_FEWER} / 255.0) AS BIGINT) + {_LACES} - {_FEWER} + 26 + m",
    "tiff": "0", "mp4": "0", "heic": "0",
}
_LE = "from_hex(printf('%02x%02x%02x%02x', ({0}) % 256, ({0}) // 256 % 256, ({0}) // 65536 % 256, ({0}) // 16777216))"
_PAD = "CASE WHEN n % 2 = 1 THEN from_hex('00') ELSE from_hex('') END"
#: The cleaned bytes, for types without checksums of variable data.
CLEANED = {
    "jpeg": (
        "from_hex('FFD8') || CASE WHEN doc_id % 8 <> 0 THEN from_hex('FFE10022457869660000' || '4D4D002A00000008' || '0001011200030000000100' || printf('%02x', 1 + doc_id % 8) || '000000000000') ELSE from_hex('') END "
        "|| from_hex('FFEE000741646F6265' || 'FFDB0022' || repeat('00', 32) || 'FFC00011080007' || printf('%04x', 1 + doc_id % 900) || '03' || repeat('00', 9) || 'FFDA00040000') || encode(t) || from_hex('FF00FFD033' || 'FFDA0004000011FFD9')"
    ),
    "webp": f"from_hex('52494646') || {_LE.format('4 + 18 + 8 + n + n % 2')} || from_hex('57454250' || '565038580A000000' || '20000000' || printf('%02x%02x%02x', doc_id % 900 % 256, doc_id % 900 // 256, 0) || '060000' || '56503820') || {_LE.format('n')} || encode(t) || {_PAD}",
    "wav": f"from_hex('52494646') || {_LE.format('4 + 24 + 8 + n + n % 2')} || from_hex('57415645666D7420100000000100010044AC0000885801000200100064617461') || {_LE.format('n')} || encode(t) || {_PAD}",
    "flac": "from_hex('664C614300000022' || '10' || repeat('00', 33) || '8100000400000000' || 'FFF8') || encode(t)",
    "mp3": "from_hex('FFFB9064') || encode(t)",
}
#: The size of a cleaned file of the other types.
SIZE = {
    "png": "8 + 25 + 12 + n + 16 + 12",
    "gif": f"19 + 19 + 8 + 11 + {_BLOCKS.format('n')} + 1",
    "ogg": f"27 + 1 + 30 + 27 * CAST(ceil({_FEWER} / 255.0) AS BIGINT) + {_FEWER} + 16 + 7 + n + 27 * CAST(ceil(((n + 1) // 255 + 1) / 255.0) AS BIGINT) + (n + 1) // 255 + 1 + n + 1",
    "tiff": "8 + 90 + 30 + 42 + n + CASE WHEN m > 3 THEN m + 1 ELSE 0 END + length('soft ' || doc_id) + 1 + 20",
    "mp4": "20 + 8 + 32 + 8 + 20 + 8 + 28 + 8 + n + 8 + n + CASE WHEN doc_id % 3 > 0 THEN 48 + n + 28 ELSE 0 END",
    "heic": "24 + 8 + 4 + 14 + 28 + 21 + 41 + CASE WHEN doc_id % 2 = 1 THEN 25 + 16 ELSE 0 END + 16 + 3 * 8 + 4 * 8 + 36 + 13 + 8 + n + 4 + CASE WHEN doc_id % 4 = 0 THEN 8 + n ELSE 0 END",
}
SIZE |= {
    "jpeg": "2 + CASE WHEN doc_id % 8 <> 0 THEN 36 ELSE 0 END + 9 + 36 + 19 + 6 + n + 5 + 9",
    "webp": "12 + 18 + 8 + n + n % 2", "wav": "12 + 24 + 8 + n + n % 2", "flac": "4 + 38 + 8 + 2 + n", "mp3": "4 + n",
}


def clean_sql(t: str) -> str:
    told = f"md5({CLEANED[t]})" if t in CLEANED else f"CAST({SIZE[t]} AS BIGINT)"
    return f"SELECT doc_id, {told} AS cleaned, CAST({REMOVED[t]} AS BIGINT) AS removed_bytes FROM {D}"


def _by_type(values: dict[str, str]) -> str:
    return f"CASE doc_id % {len(TYPES)} " + " ".join(f"WHEN {k} THEN {values[t]}" for k, t in enumerate(TYPES)) + " END"


def clean_all_sql() -> str:
    return f"SELECT doc_id, {TYPE} AS file_type, CAST({_by_type(SIZE)} AS BIGINT) AS cleaned_bytes, CAST({_by_type(REMOVED)} AS BIGINT) AS removed_bytes FROM {D}"


def process_sql() -> str:
    """A HEIF item whose data cannot be found stays, and its file goes to review."""
    left = f"doc_id % {len(TYPES)} = {TYPES.index('heic')} AND doc_id % 2 = 1"
    return (
        f"SELECT doc_id, {TYPE} AS file_type, CAST({_by_type(REMOVED)} AS BIGINT) AS removed_bytes, CAST(CASE WHEN {left} THEN 1 ELSE 0 END AS BIGINT) AS remaining, "
        f"CASE WHEN {left} THEN 'warning' ELSE 'done' END AS status FROM {D}"
    )


def validate_sql() -> str:
    """What breaks a file that loses its last seven bytes; tags behind the sound and values behind a first directory may go unseen."""
    errors = {
        "jpeg": "'JPEG missing EOI marker'", "png": "'PNG missing IEND chunk'", "webp": "'Truncated WebP RIFF data'", "wav": "'Truncated WAV RIFF data'",
        "gif": "CASE WHEN doc_id % 2 = 1 OR n >= 3 THEN 'Invalid GIF extension block' WHEN n = 2 THEN 'GIF missing trailer' ELSE 'Invalid GIF image block' END", "flac": "NULL", "mp3": "NULL",
        "ogg": "'Truncated OGG page'", "tiff": "NULL", "mp4": "CASE WHEN doc_id % 3 > 0 OR n >= 7 THEN 'Invalid ISO-BMFF box size' ELSE 'Truncated ISO-BMFF box' END",
        "heic": "CASE WHEN n >= 7 OR (n >= 3 AND doc_id % 4 > 0) THEN 'Invalid ISO-BMFF box size' ELSE 'Truncated ISO-BMFF box' END",
    }
    rows = f"(SELECT doc_id, {TYPE} AS file_type, CASE WHEN doc_id % 5 = 0 THEN {_by_type(errors)} END AS error FROM {D})"
    label = "CASE file_type WHEN 'webp' THEN 'WebP' ELSE upper(file_type) END"
    return f"SELECT doc_id, file_type, error, CASE WHEN contains(error, 'Truncated') THEN 'This file appears to be corrupt or is not a valid ' || {label} || '.' ELSE error END AS message FROM {rows}"


def dimensions_sql() -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{t}' AS file_type, CAST(1 + doc_id % 900 AS BIGINT) AS width, CAST(7 AS BIGINT) AS height FROM documents" for t in ("jpeg", "png", "gif", "webp", "avif"))


#: (query, type, condition on a part, columns, SQL).
PART_QUERIES: list[tuple[str, str, str, tuple[str, ...], str]] = [
    (
        "q_jpeg_segments", "jpeg", "not x.sub", ("x.kind", "count(*) OVER (PARTITION BY doc_id, x.kind) AS n", "x.size"),
        " UNION ALL ".join(
            f"SELECT doc_id, '{k}' AS kind, CAST({c} AS BIGINT) AS n, CAST({s} AS BIGINT) AS size FROM {D}" if not r else f"SELECT doc_id, '{k}' AS kind, CAST({c} AS BIGINT) AS n, CAST({s} AS BIGINT) AS size FROM (SELECT *, unnest(range(0, greatest({r}, 1), {SEGMENT})) AS spot FROM {D})"
            for k, c, s, r in [
                ("SOI", "1", "2", ""), ("FFE0", "1", "18", ""), ("FFE1", f"1 + {_CHUNKS.format('n')}", f"4 + {_EXIF}", ""), ("FFE1", f"1 + {_CHUNKS.format('n')}", f"33 + least({SEGMENT}, n - spot)", "n"),
                ("FFFE", _CHUNKS.format("m"), f"4 + least({SEGMENT}, m - spot)", "m"), ("FFEE", "1", "9", ""), ("FFDB", "1", "36", ""), ("FFC0", "1", "19", ""), ("FFDA", "2", "6 + n + 5", ""), ("FFED", "1", "22", ""),
                ("FFDA", "2", "7", ""), ("EOI", "1", "2", ""), ("TRAILING", "1", "4", ""),
            ]
        ),
    ),
    (
        "q_png_chunks", "png", "true", ("x.kind", "x.n"),
        " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, CAST({n} AS BIGINT) AS n FROM {D}" for k, n in [("SIGNATURE", "0"), ("IHDR", "13"), ("tEXt", "8 + m"), ("iTXt", "6 + n"), ("pHYs", "9"), ("tIME", "7"), ("prVt", "5"), ("IDAT", "n"), ("IDAT", "4"), ("eXIf", "3"), ("IEND", "0"), ("TRAILING", "0")]),
    ),
    (
        "q_id3_frames", "mp3", "x.kind like 'FRAME:%'", ("substring(x.kind, 7) AS frame", "x.n", "x.text"),
        " UNION ALL ".join(f"SELECT doc_id, '{k}' AS frame, CAST({n} AS BIGINT) AS n, CAST({t} AS VARCHAR) AS text FROM {D}" for k, n, t in [("TIT2", "1 + m", _ONE_BLANK), ("TALB", "3 + 2 * (8 + length(doc_id::VARCHAR))", "'album é ' || doc_id"), ("COMM", "9 + m", _ONE_BLANK), ("APIC", "n + 1", "NULL"), ("PRIV", "n + 1", "NULL"), ("WOAR", "17", "'http://a.example/'")]),
    ),
    (
        "q_tail_tags", "mp3", "x.kind like 'TAIL:%'", ("substring(x.kind, 6) AS tag", "x.size"),
        " UNION ALL ".join(f"SELECT doc_id, '{k}' AS tag, CAST({n} AS BIGINT) AS size FROM {D} WHERE {w}" for k, n, w in [("ID3v1", "128", "true"), ("APEv2", "64 + n", "doc_id % 2 = 0"), ("Lyrics3", "26 + m", "doc_id % 3 = 0")]),
    ),
    (
        "q_flac_blocks", "flac", "x.kind like 'BLOCK:%'", ("cast(substring(x.kind, 7) as int) AS type", "x.n"),
        " UNION ALL ".join(f"SELECT doc_id, {k} AS type, CAST({n} AS BIGINT) AS n FROM {D}" for k, n in [(0, "34"), (4, "51 + m"), (6, "17 + n"), (2, "4 + least(9, n)"), (5, "3"), (1, "4")]),
    ),
    (
        "q_vorbis_comments", "flac", "x.kind in ('VENDOR', 'COMMENT')", ("x.kind", "x.text"),
        " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {t} AS text FROM {D}" for k, t in [("VENDOR", "'enc'"), ("COMMENT", "'COMMENT=' || p"), ("COMMENT", "'ARTIST= '"), ("COMMENT", "'COVERART=abc'")]),
    ),
    (
        "q_ogg_pages", "ogg", "x.kind in ('HEADER', 'AUDIO')", ("x.kind", "count(*) OVER (PARTITION BY doc_id, x.kind) AS pages", "sum(x.n) OVER (PARTITION BY doc_id, x.kind) AS bytes", "x.num - min(x.num) OVER (PARTITION BY doc_id, x.kind) AS place"),
        f"SELECT doc_id, kind, pages, bytes, unnest(range(0, pages)) AS place FROM (SELECT doc_id, 'HEADER' AS kind, 1 + CAST(ceil({_LACES} / 255.0) AS BIGINT) AS pages, CAST(30 + 42 + m + 7 + n AS BIGINT) AS bytes FROM {D} "
        f"UNION ALL SELECT doc_id, 'AUDIO', CAST(ceil(((n + 1) // 255 + 1) / 255.0) AS BIGINT), CAST(n + 1 AS BIGINT) FROM {D})",
    ),
    (
        "q_tiff_tags", "tiff", "x.kind in ('TAG', 'SUBTAG')", ("x.num AS tag", "x.n"),
        " UNION ALL ".join(f"SELECT doc_id, CAST({k} AS BIGINT) AS tag, CAST({n} AS BIGINT) AS n FROM {D}" for k, n in [(0x0100, "4"), (0x010E, "m + 1"), (0x0111, "4"), (0x0112, "2"), (0x0117, "4"), (0x0131, "length('soft ' || doc_id) + 1"), (0x8769, "4"), (0x9003, "20"), (0x9000, "4"), (0x0100, "4"), (0x8298, "4"), (0x02BC, "3")]),
    ),
    (
        "q_bmff_boxes", "mp4", "x.kind like 'BOX:%'", ("x.text AS kind", "x.size", "x.sub"),
        " UNION ALL ".join(
            f"SELECT doc_id, '{k}' AS kind, CAST({n} AS BIGINT) AS size, {s} AS sub FROM {D} WHERE {w}"
            for k, n, s, w in [
                ("ftyp", "20", "false", "true"), ("moov", "8 + 32 + 8 + 20 + 8 + 28 + 8 + n", "false", "true"), ("mvhd", "32", "true", "true"), ("trak", "8 + 20 + 8 + 28", "true", "true"), ("tkhd", "20", "true", "true"),
                ("mdia", "36", "true", "true"), ("mdhd", "28", "true", "true"), ("udta", "8 + n", "true", "true"), ("mdat", "8 + n", "false", "true"), ("uuid", "48 + n", "false", "doc_id % 3 > 0"), ("uuid", "28", "false", "doc_id % 3 > 0"),
            ]
        ),
    ),
]

HEIF_ITEMS = " UNION ALL ".join(
    f"SELECT doc_id, CAST({k} AS BIGINT) AS num, '{kind}' AS kind, CAST({n} AS BIGINT) AS bytes, {found} AS found FROM {D} WHERE {w}"
    for k, kind, n, found, w in [(1, "hvc1", "4", "true", "true"), (2, "Exif", "n", "true", "true"), (3, "mime", "5", "true", "true"), (4, "Exif", "9", "false", "doc_id % 2 = 1")]
)
_DOCUMENT = "CASE doc_id % 5 WHEN 0 THEN 'xlsx' WHEN 1 THEN 'pptx' WHEN 2 THEN 'odt' WHEN 3 THEN 'epub' ELSE 'unknown' END"
IDENTIFY = f"SELECT 'd' || doc_id AS key, {_DOCUMENT} AS file_type FROM documents UNION ALL SELECT 'p' || page_id, CASE WHEN regexp_matches(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?i)<\\s*svg[\\s/>]') THEN 'svg' ELSE 'unknown' END FROM pages"
_ESCAPED = "length(replace(replace(replace(replace(p, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'))"
_CORE = len("<cp:coreProperties><dc:title></dc:title><dc:creator>A &amp; B</dc:creator><cp:keywords/></cp:coreProperties>")
_APP = len("<Properties><Application>made </Application></Properties>")
_CUSTOM = len('<Properties><property fmtid="x" name="Client &#65;"><vt:lpwstr>y</vt:lpwstr></property></Properties>')
_PRESENT = " present; removed during DOCX cleaning'"


def docx_sql() -> str:
    authors = "array_to_string(list_sort(list_distinct(list_concat(list_transform(range(0, doc_id % 4), lambda k: 'Ann ' || (k % 3)), list_concat(CASE WHEN doc_id % 2 = 1 THEN ['Bob'] ELSE [] END, CASE WHEN doc_id % 5 = 0 THEN ['Zoe'] ELSE [] END)))), ', ')"
    return _listed("'docx'", [
        ("'Document properties'", "'Core properties'", f"({_CORE} + {_ESCAPED}) || ' bytes'"), ("'Document properties'", "'title'", _cut(_TRIM, 180), f"{_TRIM} <> ''"), ("'Document properties'", "'creator'", "'A & B'"),
        ("'Document properties'", "'App properties'", f"({_APP} + length(doc_id::VARCHAR)) || ' bytes'"), ("'Document properties'", "'Application'", "'made ' || doc_id"),
        ("'Document properties'", "'Custom properties'", f"'{_CUSTOM} bytes'"), ("'Document properties'", "'Custom property'", "'Client A'"),
        ("'Review data'", "'Tracked insertions in word/document.xml'", f"doc_id % 4 || '{_PRESENT}", "doc_id % 4 > 0"), ("'Review data'", "'Tracked deletions in word/document.xml'", f"'1{_PRESENT}", "doc_id % 2 = 1"),
        ("'Review data'", "'Revision IDs in word/document.xml'", f"'1{_PRESENT}"), ("'Review data'", "'Comments in word/comments.xml'", "'Present; removed during DOCX cleaning'", "doc_id % 5 = 0"),
        ("'Review data'", "'Review authors'", authors, f"{authors} <> ''"),
    ])


def other_documents_sql() -> str:
    meta = len("<m><dc:title></dc:title><meta:generator>gen</meta:generator></m>")
    rows = [
        ("'Review data'", "'xl/comments1.xml'", "'Present; removed during XLSX cleaning'", "doc_id % 5 = 0"), ("'Review data'", "'xl/persons/person.xml'", "'Present; removed during XLSX cleaning'", "doc_id % 5 = 0"),
        ("'Review data'", "'ppt/commentAuthors.xml'", "'Present; removed during PPTX cleaning'", "doc_id % 5 = 1"),
        ("'Document properties'", "'ODF metadata'", f"({meta} + {_ESCAPED}) || ' bytes'", "doc_id % 5 = 2"), ("'Document properties'", "'title'", _cut(_TRIM, 180), f"doc_id % 5 = 2 AND {_TRIM} <> ''"),
        ("'Document properties'", "'generator'", "'gen'", "doc_id % 5 = 2"), ("'Review data'", "'Annotations in content.xml'", "'1 present; removed during ODF cleaning'", "doc_id % 5 = 2"),
        ("'Review data'", "'Review authors in content.xml'", "'Eve'", "doc_id % 5 = 2"),
        ("'EPUB metadata'", "'Package metadata'", "'4 removable entries in a/b.opf'", "doc_id % 5 = 3"), ("'EPUB metadata'", "'creator'", f"CASE WHEN {_TRIM} = '' THEN 'Present' ELSE {_cut(_TRIM, 180)} END", "doc_id % 5 = 3"),
        ("'EPUB metadata'", "'dcterms:modified'", "'2024'", "doc_id % 5 = 3"), ("'EPUB metadata'", "'meta calibre:series'", "'s'", "doc_id % 5 = 3"), ("'EPUB metadata'", "'link record'", "'r'", "doc_id % 5 = 3"),
        ("'EPUB metadata'", "'META-INF/calibre_bookmarks.txt'", "'Present; removed during EPUB cleaning'", "doc_id % 5 = 3"),
    ]
    return _listed(_DOCUMENT, rows)


_DOCX_NAMES = ["[Content_Types].xml", "word/document.xml", "docProps/core.xml", "docProps/app.xml", "docProps/custom.xml", "word/media/image1.png", "word/media/image2.jpg"]
ZIP_ENTRIES = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS name, CAST(8 * (doc_id % 2) AS BIGINT) AS method FROM documents" for n in _DOCX_NAMES) + " UNION ALL SELECT doc_id, 'word/comments.xml', CAST(8 * (doc_id % 2) AS BIGINT) FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'word/media/image3.svg', CAST(8 * (doc_id % 2) AS BIGINT) FROM documents WHERE doc_id % 3 = 0"
REMOVED_PARTS = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS name FROM documents" for n in _DOCX_NAMES[2:5]) + " UNION ALL SELECT doc_id, 'word/comments.xml' FROM documents WHERE doc_id % 5 = 0"
_INSIDE = "Embedded image metadata"
EMBEDDED = " UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS category, '{n}' AS name, '{v}' AS value FROM documents WHERE {w}"
    for c, n, v, w in [
        (_INSIDE, "word/media/image1.png", "1 metadata entries inside packaged image; removed during cleaning", "true"), (f"{_INSIDE}: Comment", "word/media/image1.png: Comment", "inside", "true"),
        (_INSIDE, "word/media/image3.svg", "2 metadata entries inside packaged image; removed during cleaning", "doc_id % 3 = 0"),
        (f"{_INSIDE}: SVG metadata", "word/media/image3.svg: title/description elements", "1 present; removed during SVG cleaning", "doc_id % 3 = 0"),
        (f"{_INSIDE}: {_INSIDE}", "word/media/image3.svg: Embedded data URI image", "1 metadata entries inside embedded jpeg image; removed during SVG cleaning", "doc_id % 3 = 0"),
        ("Limited verification", "Embedded package images", "1 packaged image(s) preserved without cleaning because the content could not be read as a supported image format", "true"),
    ]
)
_GONE = " present; removed during SVG cleaning'"


def svg_sql() -> str:
    return _listed("'svg'", [
        ("'SVG metadata'", "'metadata elements'", f"doc_id % 3 || '{_GONE}", "doc_id % 3 > 0"), ("'SVG metadata'", "'title/description elements'", f"2 + CAST(doc_id % 4 IN (1, 2) AS INTEGER) || '{_GONE}"), ("'SVG metadata'", "'XML comments'", f"1 + doc_id % 3 || '{_GONE}"),
        ("'SVG metadata'", "'Processing instructions'", f"'1{_GONE}"), ("'SVG active content'", "'script/foreignObject elements'", f"'1{_GONE}", "doc_id % 2 = 1"),
        ("'SVG external references'", "'external style references'", f"'1{_GONE}"), ("'SVG metadata'", "'removable attributes'", f"'3{_GONE}"),
    ])


SVG_DATA = " UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS category, '{n}' AS name, '{v}' AS value FROM documents"
    for c, n, v in [
        ("Embedded image metadata", "Embedded data URI image", "1 metadata entries inside embedded jpeg image; removed during SVG cleaning"),
        ("Limited verification", "Embedded data URI content", "1 data URI reference(s) preserved; the embedded content could not be verified or cleaned"),
    ]
)
_SHAPES = "CASE WHEN doc_id % 2 = 1 THEN '<image href=\"data:image/jpeg;base64,/9j//gAIaW5zaWRl/9k=\"/><image xlink:href=\"data:text/plain,x\"/>' ELSE '' END || '<use href=\"#a\"/><rect fill=\"url(#b)\"{}/>'"
_MORE = "CASE doc_id % 4 WHEN 1 THEN '<g></g>' WHEN 2 THEN 'open' WHEN 3 THEN '<text><![CDATA[ <title>x</title> ]]></text>' ELSE '' END"
_SVG_HEAD = '\'<?xml version="1.0"?><svg xmlns="http://www.w3.org/2000/svg"{}>\''
#: Instruction and comment touch, as do title, description, metadata and script.
_STYLED = _SHAPES.format(' style="fill:url(http://e.example/)"')
SVG_KEPT = f"""SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN chr(65279) ELSE '' END || {_SVG_HEAD.format(' xmlns:inkscape="x" onload="go()"')} || {_STYLED} || {_MORE} || '</svg>' AS kept,
    CAST(3 + CAST(doc_id % 4 IN (1, 2) AS INTEGER) AS BIGINT) AS n_ranges FROM documents"""
_BARE = _SHAPES.format("")
SVG_CLEAN = f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_SVG_HEAD.format('')} || {_BARE} || {_MORE} || '</svg>' END AS cleaned,
    CASE WHEN doc_id % 2 = 1 THEN 'Cleaning of images in data addresses is not supported' END AS error FROM documents"""
SVG_ATTRS = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS name, '{v}' AS value FROM documents" for n, v in [("xmlns:inkscape", "x"), ("onload", "go()"), ("style", "fill:url(http://e.example/)")])


def extract_all_sql() -> str:
    """By number a document or an SVG, with all that it packages, in order."""
    own = f"SELECT doc_id, file_type, 0 AS packaged, category, name, value FROM ({{}}) WHERE doc_id % 2 = {{}}"
    inner = "SELECT doc_id, '{}' AS file_type, 1 AS packaged, category, name, value FROM ({}) WHERE doc_id % 2 = {}"
    return " UNION ALL ".join([own.format(docx_sql(), 0), own.format(svg_sql(), 1), inner.format("docx", EMBEDDED, 0), inner.format("svg", SVG_DATA, 1)])


#: (relationship part, place, target, external, part it names, there, dropped) in SQL.
_LINKS = [
    ("_rels/.rels", 0, "'word/document.xml'", False, "'word/document.xml'", True, False), ("_rels/.rels", 1, "'/docProps/core.xml'", False, "'docprops/core.xml'", True, True),
    ("_rels/.rels", 2, "'http://a.example/' || doc_id", True, "NULL", False, False), ("word/_rels/document.xml.rels", 0, "'comments.xml'", False, "'word/comments.xml'", True, True),
    ("word/_rels/document.xml.rels", 1, "'../docProps/./app.xml#f'", False, "'docprops/app.xml'", False, True), ("word/_rels/document.xml.rels", 2, "'../../beyond/' || doc_id || '.xml'", False, "NULL", False, False),
    ("word/_rels/document.xml.rels", 3, "'media' || chr(92) || doc_id || '.png'", False, "'word/media/' || doc_id || '.png'", False, False), ("word/_rels/document.xml.rels", 4, "' '", False, "NULL", False, False),
    ("word/_rels/document.xml.rels", 5, "'a/../b//' || doc_id || '&.XML'", False, "'word/b/' || doc_id || '&.xml'", False, False),
]
RELATIONSHIPS = " UNION ALL ".join(
    f"SELECT doc_id, '{part}' AS part, {k} AS ord, {target} AS target, {external} AS external, CAST({resolved} AS VARCHAR) AS resolved, {there} AS present, {dropped} AS dropped FROM documents"
    for part, k, target, external, resolved, there, dropped in _LINKS
)


def damage_sql() -> str:
    """A second directory beyond the end: reading tells the first, cleaning answers with an error."""
    told = f"SELECT doc_id, count(*) AS n FROM ({entries_sql('tiff')}) GROUP BY 1"
    return f"SELECT doc_id, CAST(NULL AS VARCHAR) AS read_error, n - 2 * (doc_id % 2) AS entries, CASE WHEN doc_id % 2 = 1 THEN 'Unexpected end of TIFF file' END AS clean_error FROM ({told})"
