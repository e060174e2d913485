"""Text and name functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of the types.
LABELS = {
    "jpeg": "JPEG", "png": "PNG", "webp": "WebP", "avif": "AVIF", "gif": "GIF", "heic": "HEIC", "heif": "HEIF", "tiff": "TIFF", "svg": "SVG",
    "mp4": "MP4", "mov": "MOV", "mp3": "MP3", "flac": "FLAC", "wav": "WAV", "ogg": "OGG", "pdf": "PDF", "docx": "DOCX", "xlsx": "XLSX",
    "pptx": "PPTX", "odt": "ODT", "ods": "ODS", "odp": "ODP", "epub": "EPUB", "office-legacy": "legacy Office",
}
#: Media types (IANA).
MIME = {
    "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "avif": "image/avif", "gif": "image/gif", "heic": "image/heic", "heif": "image/heif",
    "tiff": "image/tiff", "svg": "image/svg+xml", "mp4": "video/mp4", "mov": "video/quicktime", "mp3": "audio/mpeg", "flac": "audio/flac",
    "wav": "audio/wav", "ogg": "audio/ogg", "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "odt": "application/vnd.oasis.opendocument.text", "ods": "application/vnd.oasis.opendocument.spreadsheet",
    "odp": "application/vnd.oasis.opendocument.presentation", "epub": "application/epub+zip",
}


def _lookup(key: Column, values: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def type_label(file_type: Column) -> Column:
    return _lookup(file_type, LABELS, "file")


def mime_type(file_type: Column) -> Column:
    return _lookup(file_type, MIME, "application/octet-stream")


def truncate(text: Column, n: int) -> Column:
    """At most n code points; a mark follows what is cut."""
    return F.when(F.char_length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def format_size(n: Column) -> Column:
    """One decimal in steps of 1024 up to GB; ``0 B`` for nothing."""
    out = F.lit("0 B")
    for unit, at in (("B", 1), ("KB", 1 << 10), ("MB", 1 << 20), ("GB", 1 << 30)):
        tenths = F.floor(n / F.lit(float(at)) * 10 + 0.5).cast("long")
        shown = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = F.when(n >= at, shown).otherwise(out)
    return out


def extension(name: Column) -> Column:
    """Lower-case text after the last dot; empty if the dot is first or last or missing."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1))


def sanitize_name(name: Column) -> Column:
    """A safe leaf name: last path part, no control characters, no dots at the ends, no reserved base, ``file`` for nothing."""
    leaf = F.regexp_extract(F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/")), r"(?s)([^/]+)/*$", 1)
    leaf = F.when(leaf == "", F.lit("file")).otherwise(leaf)
    clean = F.trim(F.regexp_replace(leaf, r"[\x00-\x1f\x7f]", ""))
    clean = F.regexp_replace(F.regexp_replace(clean, r"^\.+", ""), r"\.+$", "")
    clean = F.when(clean == "", F.lit("file")).otherwise(clean)
    return F.regexp_replace(clean, r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(?=(\.[^.]+)?$)", "$1_file")


def clean_name(name: Column) -> Column:
    """The sanitised name with ``_clean`` before its extension."""
    safe = sanitize_name(name)
    base, ext = F.regexp_extract(safe, r"(?s)^(.+)\.([^.]*)$", 1), F.regexp_extract(safe, r"(?s)^(.+)\.([^.]*)$", 2)
    return F.when(ext != "", F.concat(base, F.lit("_clean."), ext)).otherwise(F.concat(F.when(base != "", base).otherwise(safe), F.lit("_clean")))


#: What errors of corrupt files contain.
CORRUPT = ("invalid segment length", "invalid scan segment length", "truncated", "file too small", "not a valid")


def friendly_error(file_type: Column, message: Column) -> Column:
    """What a reader of the report sees for an error (fixed texts)."""
    low, label = F.lower(message), type_label(file_type)
    any_of = F.lit(False)
    for c in CORRUPT:
        any_of = any_of | low.contains(c)
    return (
        F.when(low.contains("legacy binary office"), message)
        .when(low.contains("unsupported zip compression"), F.concat(label, F.lit(" uses unsupported ZIP compression.")))
        .when(any_of, F.concat(F.lit("This file appears to be corrupt or is not a valid "), label, F.lit(".")))
        .when(low.contains("unsupported"), F.lit("This file type is not supported."))
        .otherwise(message)
    )
