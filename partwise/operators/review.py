"""The relational side: labels, summaries, what was removed, status, notes and names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partwise.functions.scalars import format_size, sanitize_name

#: Fixed values: (words of which category and name contain one, priority, label, whether the value follows the label).
#: A rule with ``=`` before its word asks for exactly that name.
LABEL_RULES = [
    (("gps", "location"), 1, "GPS location", True),
    (("content credentials", "c2pa", "jumb"), 2, "Content Credentials", False),
    (("=Camera Model",), 3, "camera model", True),
    (("=DateTimeOriginal",), 4, "timestamp", True),
    (("date", "time"), 5, "timestamp", True),
    (("=Camera Make",), 6, "camera make", True),
    (("comment", "review"), 7, "comments/review data", False),
    (("author", "creator", "producer"), 8, "author/creator data", False),
    (("embedded artwork", "attached picture"), 9, "embedded audio artwork", False),
    (("apev2", "lyrics3", "unsupported audio metadata"), 10, "audio tail metadata", False),
    (("audio metadata", "id3"), 11, "ID3/audio metadata", False),
    (("embedded image metadata",), 12, "embedded image metadata", False),
    (("epub metadata",), 13, "EPUB package metadata", False),
    (("limited verification",), 30, "limited verification", False),
    (("exif",), 20, "EXIF data", False),
    (("xmp",), 21, "XMP data", False),
    (("jfif", "app"), 22, "JPEG app metadata", False),
    (("trailing",), 23, "trailing data", False),
]
OTHER = 50


def entry_label(category: Column, name: Column, value: Column) -> Column:
    """(priority, label) of an entry; the first rule that fits decides."""
    category, name, value = (F.coalesce(c, F.lit("")) for c in (category, name, value))
    low = F.lower(F.concat(category, F.lit(" "), name))
    fallback = F.when(name != "", name).when(category != "", category).otherwise(F.lit("metadata"))
    out = F.struct(F.lit(OTHER).alias("priority"), fallback.alias("label"))
    for words, priority, label, follows in reversed(LABEL_RULES):
        fits = F.lit(False)
        for w in words:
            fits = fits | ((name == w[1:]) if w.startswith("=") else low.contains(w))
        text = F.when(value != "", F.concat(F.lit(f"{label}: "), value)).otherwise(F.lit(label)) if follows else F.lit(label)
        out = F.when(fits, F.struct(F.lit(priority).alias("priority"), text.alias("label"))).otherwise(out)
    return out


#: Distinct labels of a file meet in so many groups before its first ones are picked.
PARTS = 16


def summaries(entries: DataFrame, key: str = "path", most: int = 3, files: DataFrame | None = None) -> DataFrame:
    """(key, summary): the first three labels by priority and order, each once whatever its case, and how many more.

    Labels are made distinct, then counted and cut to the first three in several
    groups for each file, so that no task holds all labels of one. ``files``
    (key) adds files without entries, as ``No removable metadata``.
    """
    told = entries.withColumn("x", entry_label(F.col("category"), F.col("name"), F.col("value"))).select(key, "ord", "x.priority", "x.label")
    first = told.groupBy(key, F.lower("label").alias("low")).agg(F.min(F.struct("priority", "ord", "label")).alias("first"))
    dealt = first.withColumn("part", F.pmod(F.xxhash64("low"), F.lit(PARTS)))
    own = Window.partitionBy(key, "part")
    ranked = dealt.withColumn("place", F.row_number().over(own.orderBy("first"))).withColumn("n", F.when(F.col("place") == 1, F.count("*").over(own)))
    lists = ranked.where(F.col("place") <= most).groupBy(key).agg(F.transform(F.array_sort(F.collect_list("first")), lambda x: x["label"]).alias("labels"), F.sum("n").alias("n"))
    more = F.col("n") - most
    joined = F.array_join(F.slice("labels", 1, most), " / ")
    out = lists.select(key, F.when(more > 0, F.concat(joined, F.lit(" / "), more.cast("string"), F.lit(" more"))).otherwise(joined).alias("summary"))
    if files is None:
        return out
    return files.select(key).join(out, key, "left").withColumn("summary", F.coalesce("summary", F.lit("No removable metadata")))


def limited(category: Column) -> Column:
    """Whether an entry only tells that something could not be looked into."""
    return F.lower(F.coalesce(category, F.lit(""))) == "limited verification"


def review_summaries(remaining: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """(key, review): what is still there after cleaning, for files under review."""
    kept = summaries(remaining.where(~limited(F.col("category"))), key)
    short = remaining.where(limited(F.col("category"))).select(key).distinct().withColumn("limited", F.lit(True))
    rows = files.select(key).join(kept, key, "left").join(short, key, "left")
    has = F.coalesce("limited", F.lit(False))
    bare = F.when(has, F.lit("Limited verification")).otherwise(F.lit("Review recommended"))
    text = F.concat("summary", F.lit(" still present"), F.when(has, F.lit(" / limited verification")).otherwise(F.lit("")))
    return rows.select(key, F.when(F.col("summary").isNull(), bare).otherwise(text).alias("review"))


#: What is said to be kept, or changed, for each type.
_IMAGE_ITEMS = "HEIC/HEIF image item data is kept; EXIF/XMP metadata items and Content Credentials boxes are neutralized where the browser parser can identify them."
_TRACKS = "{} track and media payload boxes are kept; metadata and Content Credentials boxes are replaced with inert free-space boxes to preserve offsets."
NOTES = {
    "jpeg": "JPEG orientation and color-profile/color-transform data may be kept so photos do not rotate sideways or shift colors.",
    "png": "PNG transparency and color-management chunks are kept so images render the same after cleaning.",
    "webp": "WebP image, alpha, animation, and color-profile chunks are kept so the file still displays correctly.",
    "avif": "AVIF image item data is kept; EXIF/XMP metadata items and Content Credentials boxes are neutralized where the browser parser can identify them.",
    "gif": "GIF frames, transparency controls, plain-text image blocks, and animation loops are kept so animation and appearance are preserved.",
    "tiff": "TIFF image dimensions, orientation, strip/tile offsets, and image data are kept so the raster content remains readable.",
    "heic": _IMAGE_ITEMS, "heif": _IMAGE_ITEMS, "mp4": _TRACKS.format("MP4"), "mov": _TRACKS.format("MOV"),
    "mp3": "MP3 audio frames are kept; ID3v1/ID3v2, APEv2, and Lyrics3 tags, comments, private frames, and embedded artwork are removed.",
    "flac": "FLAC audio frames, stream info, seek tables, and padding are kept; Vorbis comments, embedded artwork, application blocks, cue sheets, and ID3/APE tags are removed.",
    "wav": "WAV format and sample data are kept; LIST/INFO tags, Broadcast Wave bext, iXML/XMP, ID3 chunks, cue labels, and other non-audio chunks are removed.",
    "ogg": "OGG audio packets and codec headers are kept; the Vorbis comment header (tags, vendor string, and embedded artwork comments) is replaced with an empty one and pages are renumbered.",
    "epub": "EPUB book content, styles, and required package structure are kept; author/publisher/calibre metadata is removed, required identifiers/timestamps are normalized, and supported embedded images are recursively cleaned. Unreadable embedded files stay in review.",
    "svg": "SVG drawing elements are kept while metadata elements, title/description text, XML comments, processing instructions, active content, event handlers, external references, and editor namespace attributes are removed. Base64 data URIs holding supported raster images are recursively cleaned; other data URI content is preserved and kept in review.",
    "docx": "Cleaning a DOCX accepts tracked changes and removes review content: any pending insertions are kept, while tracked deletions, comments, and reviewer names are dropped. This changes the document’s visible review state, not only hidden metadata.",
    "pdf": "Cleaning PDF review annotations removes author names, timestamps, popup links, and comment text from markup annotations. Visible annotation notes may change.",
}
HEADINGS = {"docx": "Changes document content:", "pdf": "May change annotations:"}


def note(file_type: Column) -> Column:
    """What cleaning keeps or changes, after its heading; empty for types without a note."""
    pairs = [F.lit(x) for t, text in NOTES.items() for x in (t, f"{HEADINGS.get(t, 'Kept for correct display:')} {text}")]
    return F.coalesce(F.element_at(F.create_map(*pairs), file_type), F.lit(""))


def view_state(status: Column, cleaned: Column, entries: Column) -> Column:
    """What a detail view shows: the first that holds of error, loading, processing, cleaned, no metadata, details."""
    return F.when(status == "error", "error").when(status.isin("loading", "processing"), status).when(cleaned, "cleaned").when(entries == 0, "no-metadata").otherwise("details")


def pending(files: DataFrame) -> DataFrame:
    """The files that still wait."""
    return files.where(F.col("status") == "pending")


def downloadable(files: DataFrame) -> DataFrame:
    """The files that have cleaned bytes."""
    return files.where(F.col("cleaned").isNotNull())


def actions(files: DataFrame, *by: str) -> DataFrame:
    """(by, can_process, can_download) for each batch of files (status, cleaned): nothing while a file is being read or cleaned."""
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    busy, waits, done = any_(F.col("status").isin("loading", "processing")), any_(F.col("status") == "pending"), any_(F.col("cleaned").isNotNull())
    return files.groupBy(*by).agg((waits & ~busy).alias("can_process"), (done & ~busy).alias("can_download"))


def batch_text(done: Column, warning: Column, error: Column) -> Column:
    """The closing line of a batch; empty if nothing was processed."""
    told = [F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {text}"))) for n, text in ((done, "verified clean"), (warning, "need review"), (error, "could not be processed"))]
    joined = F.concat_ws(", ", *told)
    return F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit("Cleaning complete: "), joined, F.lit(".")))


def rejected_text(names: Column, n: Column, budget: Column) -> Column:
    """The line about files that a memory budget left out: the first three ``names`` of ``n``, and how many more."""
    shown = F.transform(F.slice(names, 1, 3), lambda x: F.when(F.coalesce(x, F.lit("")) == "", F.lit("unnamed file")).otherwise(x))
    more = F.when(n > 3, F.concat(F.lit(" and "), (n - 3).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    noun = F.when(n == 1, F.lit("file")).otherwise(F.lit("files"))
    return F.concat(F.lit("Skipped "), n.cast("string"), F.lit(" "), noun, F.lit(" because the local memory budget is "), format_size(budget), F.lit(": "), F.array_join(shown, ", "), more, F.lit(". Download or clear finished files before adding more."))


def first_names(files: DataFrame, key: str, order: str, name: str, most: int = 3) -> DataFrame:
    """(key, names, n): the first names of each batch in order, and how many there are; cut in several groups before they meet."""
    own = Window.partitionBy(key, "part")
    dealt = files.select(key, F.struct(F.col(order).alias("o"), F.col(name).alias("name")).alias("x"), F.pmod(F.xxhash64(order), F.lit(PARTS)).alias("part"))
    ranked = dealt.withColumn("place", F.row_number().over(own.orderBy("x"))).withColumn("n", F.when(F.col("place") == 1, F.count("*").over(own)))
    lists = ranked.where(F.col("place") <= most).groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("x"), F.sum("n").alias("n"))
    return lists.select(key, F.transform(F.slice("x", 1, most), lambda x: x["name"]).alias("names"), "n")


def unique_names(files: DataFrame, batch: str, order: str, name: str) -> DataFrame:
    """``files`` (batch, order, name) with ``output_name``: sanitised names, in order, each with the first free suffix -2, -3, ... of its batch, whatever the case.

    A name that a suffix made can stand in the way of a later one, so each batch
    is gone through in order, by rows as they come: the task holds the names
    used so far. A batch is one archive, of 65,535 names at most.
    """
    told = f"{files.schema[batch].dataType.simpleString()}", f"{files.schema[order].dataType.simpleString()}"
    rows = files.select(F.col(batch).alias("b"), F.col(order).alias("o"), F.col(name).alias("name"), sanitize_name(F.col(name)).alias("safe"))
    sorted_rows = rows.repartition("b").sortWithinPartitions("b", "o", "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: set[str] = set()
        tried: dict[str, int] = {}
        now: object = None
        for x in batches:
            out = []
            for b, safe in zip(x.column(0).to_pylist(), x.column(3).to_pylist(), strict=True):
                if b != now:
                    used, tried, now = set(), {}, b
                dot = safe.rfind(".")
                base, end = (safe[:dot], safe[dot:]) if dot > 0 else (safe, "")
                end = "" if end == "." else end
                k, candidate = tried.get(safe.lower(), 1), base + end
                while k > 1 or candidate.lower() in used:
                    k = max(2, k)
                    candidate = f"{base}-{k}{end}"
                    if candidate.lower() not in used:
                        break
                    k += 1
                tried[safe.lower()] = k
                used.add(candidate.lower())
                out.append(candidate)
            yield pa.RecordBatch.from_arrays([*x.columns[:3], pa.array(out, pa.string())], names=["b", "o", "name", "output_name"])

    done = sorted_rows.mapInArrow(run, f"b {told[0]}, o {told[1]}, name string, output_name string")
    return done.select(F.col("b").alias(batch), F.col("o").alias(order), F.col("name").alias(name), "output_name")


def grouped(entries: DataFrame, key: str = "path") -> DataFrame:
    """(key, category, place, n, first_ord): categories of a file in the order in which they first come."""
    groups = entries.groupBy(key, "category").agg(F.min("ord").alias("first_ord"), F.count("*").alias("n"))
    return groups.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("first_ord", "category")))


def removed(original: DataFrame, remaining: DataFrame, key: str = "path") -> DataFrame:
    """Original entries that no remaining entry of the file equals; nulls equal nulls."""
    right = remaining.select(*[F.col(c).alias(f"__{c}") for c in (key, "category", "name", "value")]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (key, "category", "name", "value")]
    return original.join(right, same, "left_anti")


def status(error: Column, remaining: Column) -> Column:
    """``error``, else ``done`` if no entry remains, else ``warning``."""
    return F.when(error.isNotNull(), "error").when(remaining == 0, "done").otherwise("warning")
