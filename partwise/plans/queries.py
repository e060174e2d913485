"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.functions import scalars, text
from partwise.functions.detect import detect_file_type, image_size
from partwise.operators import documents, nested, ranges, relationships, review, svg
from partwise.operators.clean import clean
from partwise.operators.entries import entries, entry_rows
from partwise.operators.walk import identify, legacy_office, typed, walk
from partwise.plans import containers as made
from partwise.plans.process import analyze, analyzed_entries, process, remove_metadata, type_stable
from partwise.sources.fixtures import MAGIC, TYPES, files, magic_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


_KINDS = " ".join(f"WHEN {i} THEN '{t}'" for i, (t, _) in enumerate(MAGIC))


@_query("q_detect", f"SELECT doc_id, CASE doc_id % {len(MAGIC) + 1} {_KINDS} ELSE 'unknown' END AS file_type FROM documents")
def detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return magic_files(_table(spark, sf_dir, "documents")).select("doc_id", detect_file_type(F.col("content")).alias("file_type"))


def _files(spark: SparkSession, sf_dir: str, kind: str | None = None, cut: bool = False) -> DataFrame:
    return files(_table(spark, sf_dir, "documents"), kind, cut)


def _walked(spark: SparkSession, sf_dir: str, kind: str | None = None, content: bool = False) -> DataFrame:
    return walk(_files(spark, sf_dir, kind), "doc_id", content)


def _add_by_type() -> None:
    for t in TYPES:
        _query(f"q_{t}_extract", made.entries_sql(t))(lambda spark, sf_dir, t=t: entries(_walked(spark, sf_dir, t), "doc_id", (t,)))

        def cleaned(spark: SparkSession, sf_dir: str, t: str = t) -> DataFrame:
            done = clean(_walked(spark, sf_dir, t, content=True), "doc_id")
            told = F.md5("cleaned") if t in made.CLEANED else F.octet_length("cleaned").cast("long")
            return done.select("doc_id", told.alias("cleaned"), "removed_bytes")

        _query(f"q_{t}_clean", made.clean_sql(t))(cleaned)


_add_by_type()


@_query("q_extract", made.entries_sql())
def extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(_walked(spark, sf_dir), "doc_id", TYPES)


@_query("q_analyze", f"SELECT * FROM ({made.entries_sql()}) WHERE doc_id % 5 <> 0")
def analyze_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of sound files: every fifth file is cut to nothing, and a file with an error has none."""
    sound = F.when(F.col("doc_id") % 5 != 0, F.col("content")).otherwise(F.substring("content", 1, 9))
    return analyzed_entries(_files(spark, sf_dir).select("doc_id", sound.alias("content")), "doc_id", TYPES)


@_query("q_process", made.process_sql())
def process_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = process(_files(spark, sf_dir).select("doc_id", "content"), "doc_id", TYPES)
    return out.select("doc_id", "file_type", "removed_bytes", "remaining", "status")


@_query("q_clean", made.clean_all_sql())
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types come from the bytes, and cleaned files are read again: one that fails this proof has no cleaned bytes."""
    done = remove_metadata(_files(spark, sf_dir).select("doc_id", "content"), "doc_id", TYPES)
    return done.select("doc_id", "file_type", F.octet_length("cleaned").cast("long").alias("cleaned_bytes"), "removed_bytes")


@_query("q_type_stable", f"SELECT doc_id, {made.TYPE} AS file_type, CAST(NULL AS VARCHAR) AS error, true AS proved FROM documents")
def stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = type_stable(clean(_walked(spark, sf_dir, content=True), "doc_id", again=True), "doc_id")
    return out.select("doc_id", "file_type", "error", (F.col("again_error").isNull() & F.col("cleaned").isNotNull()).alias("proved"))


@_query("q_bytes_by_type", f"SELECT file_type, count(*) AS files, CAST(sum(removed_bytes) AS BIGINT) AS removed_bytes FROM ({made.process_sql()}) GROUP BY 1")
def bytes_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = clean(_walked(spark, sf_dir, content=True), "doc_id")
    return done.groupBy("file_type").agg(F.count("*").alias("files"), F.sum("removed_bytes").alias("removed_bytes"))


@_query("q_validate", made.validate_sql())
def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth file loses its last seven bytes."""
    walked = walk(_files(spark, sf_dir, cut=True), "doc_id")
    return walked.select("doc_id", "file_type", "error", scalars.friendly_error(F.col("file_type"), F.col("error")).alias("message"))


@_query("q_jpeg_orientation", f"SELECT doc_id, CAST(1 + doc_id % 8 AS BIGINT) AS before, CAST(CASE WHEN doc_id % 8 <> 0 THEN 1 + doc_id % 8 END AS BIGINT) AS after FROM {made.D}")
def orientations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orientation of each JPEG before and after cleaning; the usual one needs no segment."""
    turn = F.get(F.filter("parts", lambda x: x["kind"] == "ORIENTATION"), 0)["num"]
    walked = _walked(spark, sf_dir, "jpeg", content=True)
    after = clean(walked, "doc_id", again=True).select("doc_id", turn.alias("after"))
    return walked.select("doc_id", turn.alias("before")).join(after, "doc_id")


@_query("q_dimensions", made.dimensions_sql())
def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind in ("jpeg", "png", "gif", "webp", "avif"):
        walked = _walked(spark, sf_dir, kind)
        one = walked.select("doc_id", "file_type", image_size(F.col("file_type"), F.col("parts")).alias("d")).select("doc_id", "file_type", "d.width", "d.height")
        out = one if out is None else out.union(one)
    return out


def _parts(spark: SparkSession, sf_dir: str, kind: str, where: str, *columns: str) -> DataFrame:
    return _walked(spark, sf_dir, kind).select("doc_id", F.explode("parts").alias("x")).where(where).selectExpr("doc_id", *columns)


def _add_parts() -> None:
    """Parts as rows, for the formats whose inner tables are of use by themselves."""
    for name, kind, where, columns, sql in made.PART_QUERIES:
        _query(name, sql)(lambda spark, sf_dir, kind=kind, where=where, columns=columns: _parts(spark, sf_dir, kind, where, *columns))


_add_parts()


@_query("q_heif_items", made.HEIF_ITEMS)
def heif_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the bytes of their extents, by a join on the item number."""
    parts = _walked(spark, sf_dir, "heic").select("doc_id", F.explode("parts").alias("x")).select("doc_id", "x.*")
    extents = parts.where("kind = 'EXTENT'").groupBy("doc_id", "num").agg(F.sum("n").alias("bytes"), F.bool_and(F.col("size") >= 0).alias("found"))
    items = parts.where("kind like 'ITEM:%'").select("doc_id", "num", F.substring("kind", 6, 4).alias("kind"))
    return items.join(extents, ["doc_id", "num"], "left").select("doc_id", "num", "kind", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), "found")


@_query("q_identify", made.IDENTIFY)
def identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as ZIP files of several kinds, and pages as they are."""
    docs = _files(spark, sf_dir, "zip").select(F.concat(F.lit("d"), "doc_id").alias("key"), "content")
    pages = _table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("key"), F.encode("html", "UTF-8").alias("content"))
    return identify(docs.union(pages), "key")


@_query("q_docx_extract", made.docx_sql())
def docx_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(walk(typed(_files(spark, sf_dir, "docx").drop("file_type")), "doc_id"), "doc_id", documents.KINDS)


@_query("q_zip_extract", made.other_documents_sql())
def zip_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(walk(typed(_files(spark, sf_dir, "zip").drop("file_type")), "doc_id"), "doc_id", documents.KINDS)


@_query("q_zip_entries", made.ZIP_ENTRIES)
def zip_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = walk(typed(_files(spark, sf_dir, "docx").drop("file_type")), "doc_id").select("doc_id", F.explode("parts").alias("x"))
    return rows.select("doc_id", F.col("x.text").alias("name"), F.col("x.num").alias("method"))


@_query("q_zip_removed_parts", made.REMOVED_PARTS)
def zip_removed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = walk(typed(_files(spark, sf_dir, "docx").drop("file_type")), "doc_id")
    rows = walked.select("doc_id", "file_type", F.explode(documents.names(F.col("parts"))).alias("name"))
    return rows.where(documents.removed_part(F.col("file_type"), F.col("name"))).select("doc_id", "name")


_HOSTILE = "CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN '/' || url WHEN 2 THEN 'a/../' || url WHEN 3 THEN '' WHEN 4 THEN 'a\\\\b' ELSE 'a..b/' || page_id END"


@_query("q_zip_safe_names", f"SELECT page_id, name <> '' AND NOT starts_with(name, '/') AND NOT contains(name, chr(92)) AND NOT list_contains(string_split(name, '/'), '..') AS safe FROM (SELECT page_id, {_HOSTILE.replace(chr(92) * 2, chr(92))} AS name FROM pages)")
def zip_safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", F.expr(_HOSTILE).alias("name"))
    return pages.select("page_id", documents.safe_name(F.col("name")).alias("safe"))


@_query("q_resolve_rels", made.RELATIONSHIPS)
def resolve_rels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relationships.relationships(walk(typed(_files(spark, sf_dir, "linked").drop("file_type")), "doc_id"), "doc_id")


@_query("q_damage", made.damage_sql())
def damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage that counts for cleaning only: entries of sound directories, and the error of cleaning."""
    files_ = _files(spark, sf_dir, "tiff_lost").drop("file_type")
    read = analyze(files_, "doc_id", content=True)
    rows = read.select("doc_id", F.col("error").alias("read_error"), F.size(entry_rows(("tiff",))).cast("long").alias("entries"))
    cleaned = clean(read, "doc_id", types=("tiff",)).select("doc_id", F.col("error").alias("clean_error"))
    return rows.join(cleaned, "doc_id")


@_query("q_embedded_images", made.EMBEDDED)
def embedded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = walk(typed(_files(spark, sf_dir, "docx").drop("file_type")), "doc_id")
    return nested.packaged_entries(walked, "doc_id").select("doc_id", "category", "name", "value")


@_query("q_extract_all", made.extract_all_sql())
def extract_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and SVG texts with the entries of all that they package: images, and images in data addresses of packaged SVG texts."""
    docs, svgs = (_files(spark, sf_dir, t).where(F.col("doc_id") % 2 == k).drop("file_type") for k, t in enumerate(("docx", "svg")))
    told = nested.all_entries(walk(typed(docs.union(svgs)), "doc_id"), "doc_id", ("docx", "svg"))
    return told.select("doc_id", "file_type", (F.col("ord") >= nested.AFTER).cast("int").alias("packaged"), "category", "name", "value")


@_query("q_svg_extract", made.svg_sql())
def svg_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(walk(typed(_files(spark, sf_dir, "svg").drop("file_type")), "doc_id"), "doc_id", ("svg",))


@_query("q_svg_kept", made.SVG_KEPT)
def svg_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts outside all ranges that go as a whole, some of which lie in one another."""
    gone = _walked(spark, sf_dir, "svg").select("doc_id", F.explode(svg.removed_ranges(F.col("parts"))).alias("r")).select("doc_id", "r.start", "r.end")
    out = ranges.kept(_files(spark, sf_dir, "svg"), gone, "doc_id")
    return out.select("doc_id", F.decode("kept", "UTF-8").alias("kept"), "n_ranges")


@_query("q_svg_clean", made.SVG_CLEAN)
def svg_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SVG texts without what goes, and by their number with an image that only its own cleaning could mend."""
    done = clean(_walked(spark, sf_dir, "svg", content=True), "doc_id", types=("svg",))
    return done.select("doc_id", F.decode("cleaned", "UTF-8").alias("cleaned"), "error")


@_query("q_svg_data_uris", made.SVG_DATA)
def svg_data_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = walk(typed(_files(spark, sf_dir, "svg_images").drop("file_type")), "doc_id")
    return nested.data_uri_entries(walked, "doc_id").select("doc_id", "category", "name", "value")


@_query("q_svg_attrs", made.SVG_ATTRS)
def svg_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _walked(spark, sf_dir, "svg").select("doc_id", F.explode(svg.attributes(F.col("parts"))).alias("a"))
    return rows.where(svg.removable(F.col("a"))).select("doc_id", F.col("a.name").alias("name"), F.col("a.value").alias("value"))


@_query("q_xml_comments", "SELECT page_id, CAST(len(regexp_extract_all(html, '(?s)<!--.*?-->')) AS INTEGER) AS n, CAST(coalesce(list_sum(list_transform(regexp_extract_all(html, '(?s)<!--.*?-->'), lambda x: strlen(x))), 0) AS BIGINT) AS bytes FROM pages")
def xml_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = svg.comments(F.col("html"))
    return _table(spark, sf_dir, "pages").select("page_id", c["n"].alias("n"), c["bytes"].alias("bytes"))


@_query("q_xml_pis", "SELECT page_id, CAST(len(list_filter(regexp_extract_all('<?xml version=\"1.0\"?><?php ' || page_id || '?>' || html, '(?s)<\\?(.*?)\\?>', 1), lambda x: x <> 'xml' AND NOT starts_with(x, 'xml '))) AS INTEGER) AS n FROM pages".replace("\\\\", "\\"))
def xml_pis(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit('<?xml version="1.0"?><?php '), F.col("page_id").cast("string"), F.lit("?>"), F.col("html"))
    return _table(spark, sf_dir, "pages").select("page_id", svg.instructions(t).alias("n"))


_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@_query("q_xml_entities", f"SELECT doc_id, md5(encode(text || ' é A & b &unknown; ')) AS decoded, md5(encode({_ESCAPED.format('text')})) AS escaped FROM documents")
def xml_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    encoded = F.concat(text.escape_html(F.col("text")), F.lit(" &#233; &#x41; &#xD800;&#xZ;&amp; b &unknown; "))
    return docs.select("doc_id", F.md5(F.encode(text.decode_entities(F.replace(encoded, F.lit("&nbsp;"), F.lit("\u00a0"))), "UTF-8")).alias("decoded"), F.md5(F.encode(F.replace(text.escape_html(F.col("text")), F.lit("&nbsp;"), F.lit("\u00a0")), "UTF-8")).alias("escaped"))


@_query("q_base64", "SELECT doc_id, md5(base64(encode(text))) AS coded, md5(encode(text)) AS decoded, md5(encode(text)) AS loose FROM documents")
def base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    coded = text.base64_encode(F.encode("text", "UTF-8"))
    loose = F.concat(F.lit(" "), F.regexp_replace(coded, "=", ""), F.lit("\n=ignored!"))
    return docs.select("doc_id", F.md5(F.encode(coded, "UTF-8")).alias("coded"), F.md5(text.base64_decode(coded)).alias("decoded"), F.md5(text.base64_decode(loose)).alias("loose"))


@_query("q_css_unescape", "SELECT page_id, 'url(' || url || ')' AS decoded FROM pages")
def css_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with the first letters of ``url`` escaped in several ways."""
    coded = F.concat(F.expr(r"CASE page_id % 3 WHEN 0 THEN '\\75 rl(' WHEN 1 THEN 'u\\000072l\\28 ' ELSE '\\url\\(' END"), F.col("url"), F.lit(")"))
    return _table(spark, sf_dir, "pages").select("page_id", text.decode_css(coded).alias("decoded"))


_REFERENCE = "CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN '#' || page_id WHEN 2 THEN 'data:' || url WHEN 3 THEN 'a/' || page_id WHEN 4 THEN ' \"JavaScript:x\" ' WHEN 5 THEN '' WHEN 6 THEN 'a/b:c' ELSE '//x' END"


@_query("q_classify_ref", "SELECT page_id, page_id % 8 IN (0, 3, 4, 7) AS external, page_id % 8 IN (0, 4, 7) AS remote, page_id % 8 = 2 AS data FROM pages")
def classify_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.expr(_REFERENCE)
    return _table(spark, sf_dir, "pages").select("page_id", svg.external_reference(v).alias("external"), svg.remote_reference(v).alias("remote"), svg.data_address(v).alias("data"))


@_query("q_text_names", "SELECT page_id, regexp_extract(url, '([^:]*)$', 1) AS local, regexp_replace(lower(url), '[^a-z0-9_-]', '-', 'g') AS class, replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM pages")
def text_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return _table(spark, sf_dir, "pages").select("page_id", text.local_name(u).alias("local"), text.class_name(u).alias("class"), text.escape_html(u).alias("html"))


@_query("q_truncate", "SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS shown FROM documents")
def truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", scalars.truncate(F.col("text"), 100).alias("shown"))


_SIZE = "CASE " + " ".join(
    f"WHEN n >= {at} THEN CAST(CAST(floor(floor(n / {at}.0 * 10 + 0.5) / 10) AS BIGINT) AS VARCHAR) || '.' || CAST(CAST(floor(n / {at}.0 * 10 + 0.5) AS BIGINT) % 10 AS VARCHAR) || ' {u}'"
    for u, at in (("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10), ("B", 1))
) + " ELSE '0 B' END"


@_query("q_format_size", f"SELECT doc_id, {_SIZE} AS shown FROM (SELECT doc_id, CAST(n_chars * n_chars * (doc_id % 7) AS BIGINT) AS n FROM documents)")
def formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("n_chars") * F.col("n_chars") * (F.col("doc_id") % 7)).cast("long")
    return _table(spark, sf_dir, "documents").select("doc_id", scalars.format_size(n).alias("shown"))


_NAME = "(CASE page_id % 7 WHEN 0 THEN url || '.TXT' WHEN 1 THEN 'con.txt' WHEN 2 THEN '..' WHEN 3 THEN '../a\\' || page_id || '.JPG' WHEN 4 THEN 'COM1' WHEN 5 THEN '' ELSE '.hidden.' END)"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.expr(_NAME.replace("\\", "\\\\")).alias("name"))


_SAFE = "(CASE page_id % 7 WHEN 0 THEN regexp_replace(regexp_extract(url || '.TXT', '([^/]+)$', 1), '^\\.+', '') WHEN 1 THEN 'con_file.txt' WHEN 2 THEN 'file' WHEN 3 THEN page_id || '.JPG' WHEN 4 THEN 'COM1_file' WHEN 5 THEN 'file' ELSE 'hidden' END)"


@_query(
    "q_names",
    f"SELECT page_id, safe, CASE WHEN strpos(safe, '.') > 0 THEN regexp_replace(safe, '\\.([^.]*)$', '_clean.\\1') ELSE safe || '_clean' END AS clean, "
    f"lower(CASE WHEN strpos(safe, '.') > 0 THEN regexp_extract(safe, '\\.([^.]*)$', 1) ELSE '' END) AS extension FROM (SELECT page_id, {_SAFE} AS safe FROM pages)",
)
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("name")
    return _names(spark, sf_dir).select("page_id", scalars.sanitize_name(n).alias("safe"), scalars.clean_name(n).alias("clean"), scalars.extension(scalars.sanitize_name(n)).alias("extension"))


def _mime_sql() -> str:
    return "SELECT doc_id, CASE doc_id % 15 " + " ".join(f"WHEN {i} THEN '{scalars.MIME.get(t, 'application/octet-stream')}'" for i, (t, _) in enumerate(MAGIC)) + " ELSE 'application/octet-stream' END AS mime, CASE doc_id % 15 " + " ".join(f"WHEN {i} THEN '{scalars.LABELS[t]}'" for i, (t, _) in enumerate(MAGIC)) + " ELSE 'file' END AS label FROM documents"


@_query("q_mime", _mime_sql())
def mimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = detect_file_type(F.col("content"))
    return magic_files(_table(spark, sf_dir, "documents")).select("doc_id", scalars.mime_type(t).alias("mime"), scalars.type_label(t).alias("label"))


#: Entries made from conversations: (category, name) by turn.
_MADE = [("EXIF", "EXIF Data"), ("Comment", "Comment"), ("Location", "GPS"), ("Other", "junk"), ("Trailing", "Trailing Data"), ("Time", "Last Modified"), ("XMP", "XMP Data"), ("APP0", "JFIF Segment")]
_PICK = "CASE (conv_id + turn) % 8 "
_CATEGORY = _PICK + " ".join(f"WHEN {i} THEN '{c}'" for i, (c, _) in enumerate(_MADE)) + " END"
_ENTRY = _PICK + " ".join(f"WHEN {i} THEN '{n}'" for i, (_, n) in enumerate(_MADE)) + " END"
_MADE_SQL = f"(SELECT conv_id, turn AS ord, {_CATEGORY} AS category, {_ENTRY} AS name, role AS value FROM conversations)"


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), F.expr(_CATEGORY).alias("category"), F.expr(_ENTRY).alias("name"), F.col("role").alias("value"))


_LABELLED = (
    f"(SELECT *, CASE category WHEN 'Location' THEN 1 WHEN 'Time' THEN 5 WHEN 'Comment' THEN 7 WHEN 'EXIF' THEN 20 WHEN 'XMP' THEN 21 WHEN 'APP0' THEN 22 WHEN 'Trailing' THEN 23 ELSE 50 END AS priority, "
    f"CASE category WHEN 'Location' THEN 'GPS location: ' || value WHEN 'Time' THEN 'timestamp: ' || value WHEN 'Comment' THEN 'comments/review data' WHEN 'EXIF' THEN 'EXIF data' "
    f"WHEN 'XMP' THEN 'XMP data' WHEN 'APP0' THEN 'JPEG app metadata' WHEN 'Trailing' THEN 'trailing data' ELSE 'junk' END AS label FROM {_MADE_SQL})"
)


@_query("q_entry_label", f"SELECT conv_id, ord, priority, label FROM {_LABELLED}")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = review.entry_label(F.col("category"), F.col("name"), F.col("value"))
    return _made(spark, sf_dir).withColumn("x", x).select("conv_id", "ord", "x.priority", "x.label")


@_query(
    "q_summary",
    "SELECT conv_id, string_agg(label, ' / ' ORDER BY place) FILTER (place <= 3) || CASE WHEN count(*) > 3 THEN ' / ' || (count(*) - 3) || ' more' ELSE '' END AS summary FROM "
    "(SELECT conv_id, label, row_number() OVER (PARTITION BY conv_id ORDER BY priority, ord, label) AS place FROM "
    f"(SELECT conv_id, label, min(priority) AS priority, min(ord) AS ord FROM {_LABELLED} GROUP BY conv_id, label)) GROUP BY conv_id",
)
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.summaries(_made(spark, sf_dir), "conv_id")


@_query(
    "q_entries_by_category",
    "SELECT conv_id, category, first_ord, n, row_number() OVER (PARTITION BY conv_id ORDER BY first_ord, category) AS place FROM "
    f"(SELECT conv_id, category, min(ord) AS first_ord, count(*) AS n FROM {_MADE_SQL} GROUP BY conv_id, category)",
)
def by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.grouped(_made(spark, sf_dir), "conv_id")


@_query("q_removed_entries", f"SELECT a.* FROM {_MADE_SQL} a WHERE NOT EXISTS (SELECT 1 FROM {_MADE_SQL} b WHERE b.ord % 2 = 0 AND a.conv_id = b.conv_id AND a.category = b.category AND a.name = b.name AND a.value = b.value)")
def removed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _made(spark, sf_dir)
    return review.removed(made, made.where("ord % 2 = 0"), "conv_id")


_STATUS = f"(SELECT conv_id, CASE WHEN conv_id % 10 = 0 THEN 'error' WHEN count(*) FILTER (ord % 2 = 0 AND category <> 'EXIF') = 0 THEN 'done' ELSE 'warning' END AS status FROM {_MADE_SQL} GROUP BY conv_id)"


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count_if((F.col("ord") % 2 == 0) & (F.col("category") != "EXIF"))
    per = _made(spark, sf_dir).groupBy("conv_id").agg(n.alias("n"))
    return per.select("conv_id", review.status(F.when(F.col("conv_id") % 10 == 0, F.lit("damaged")), F.col("n")).alias("status"))


@_query("q_status", f"SELECT conv_id, status FROM {_STATUS}")
def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statuses(spark, sf_dir)


@_query("q_batch_summary", f"SELECT count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'warning') AS warning, count(*) FILTER (status = 'error') AS error FROM {_STATUS}")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("status")
    return _statuses(spark, sf_dir).agg(F.count_if(s == "done").alias("done"), F.count_if(s == "warning").alias("warning"), F.count_if(s == "error").alias("error"))


@_query(
    "q_batch_text",
    "SELECT lang, 'Cleaning complete: ' || concat_ws(', ', CASE WHEN a > 0 THEN a || ' verified clean' END, CASE WHEN b > 0 THEN b || ' need review' END, CASE WHEN c > 0 THEN c || ' could not be processed' END) || '.' AS told "
    "FROM (SELECT lang, count(*) FILTER (doc_id % 3 = 0) AS a, count(*) FILTER (doc_id % 3 = 1) AS b, count(*) FILTER (doc_id % 3 = 2) AS c FROM documents GROUP BY lang)",
)
def batch_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = [F.count_if(F.col("doc_id") % 3 == k).alias(c) for k, c in enumerate("abc")]
    return _table(spark, sf_dir, "documents").groupBy("lang").agg(*n).select("lang", review.batch_text(F.col("a"), F.col("b"), F.col("c")).alias("told"))


_REVIEW_SQL = (
    "SELECT c.conv_id, CASE WHEN s.summary IS NULL THEN CASE WHEN l.conv_id IS NULL THEN 'Review recommended' ELSE 'Limited verification' END "
    "ELSE s.summary || ' still present' || CASE WHEN l.conv_id IS NULL THEN '' ELSE ' / limited verification' END END AS review FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN "
    f"({ORACLE_SQL['q_summary'].replace(_LABELLED, '(SELECT * FROM ' + _LABELLED + ' WHERE ord % 3 = 1)')}) s ON s.conv_id = c.conv_id LEFT JOIN (SELECT DISTINCT conv_id FROM conversations WHERE turn % 5 = 4) l ON l.conv_id = c.conv_id"
)


@_query("q_review_summary", _REVIEW_SQL)
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third entry is still there, and every fifth turn adds one of limited verification."""
    rows = _made(spark, sf_dir)
    short = rows.where("ord % 5 = 4").withColumn("category", F.lit("Limited Verification"))
    return review.review_summaries(rows.where("ord % 3 = 1").unionByName(short), rows.select("conv_id").distinct(), "conv_id")


@_query("q_summary_all", f"SELECT c.conv_id, coalesce(s.summary, 'No removable metadata') AS summary FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ({ORACLE_SQL['q_summary'].replace(_LABELLED, '(SELECT * FROM ' + _LABELLED + ' WHERE conv_id % 2 = 0)')}) s ON s.conv_id = c.conv_id")
def summary_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without entries have a summary too."""
    rows = _made(spark, sf_dir)
    return review.summaries(rows.where("conv_id % 2 = 0"), "conv_id", files=rows.select("conv_id").distinct())


_FILE_STATUS = "CASE doc_id % 6 WHEN 0 THEN 'error' WHEN 1 THEN 'loading' WHEN 2 THEN 'processing' WHEN 3 THEN 'done' ELSE 'pending' END"


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.expr(_FILE_STATUS).alias("status"), F.expr("CASE WHEN doc_id % 6 = 3 THEN encode(coalesce(text, ''), 'UTF-8') END").alias("cleaned"))


@_query("q_view_state", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'error' WHEN 1 THEN 'loading' WHEN 2 THEN 'processing' WHEN 3 THEN 'cleaned' WHEN 4 THEN 'no-metadata' ELSE 'details' END AS view FROM documents")
def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir).select("doc_id", review.view_state(F.col("status"), F.col("cleaned").isNotNull(), F.col("doc_id") % 6 - 4).alias("view"))


@_query("q_downloadable", "SELECT doc_id FROM documents WHERE doc_id % 6 = 3")
def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.downloadable(_listed(spark, sf_dir)).select("doc_id")


@_query("q_pending", "SELECT doc_id FROM documents WHERE doc_id % 6 > 3")
def waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.pending(_listed(spark, sf_dir)).select("doc_id")


@_query("q_actions", "SELECT source, bool_or(doc_id % 6 > 3) AND NOT bool_or(doc_id % 6 IN (1, 2)) AS can_process, bool_or(doc_id % 6 = 3) AND NOT bool_or(doc_id % 6 IN (1, 2)) AS can_download FROM documents GROUP BY source")
def action_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.actions(_listed(spark, sf_dir), "source")


_NOTE_SQL = "CASE doc_id % 19 " + " ".join("WHEN {} THEN '{}'".format(k, (review.HEADINGS.get(t, "Kept for correct display:") + " " + x).replace("'", "''")) for k, (t, x) in enumerate(review.NOTES.items())) + " ELSE '' END"


@_query("q_notes", f"SELECT doc_id, {_NOTE_SQL} AS note FROM documents")
def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(t) for t in review.NOTES])
    kind = F.get(kinds, (F.col("doc_id") % 19).cast("int"))
    return _table(spark, sf_dir, "documents").select("doc_id", review.note(kind).alias("note"))


@_query("q_limited", "SELECT conv_id, turn, turn % 2 = 0 AS limited FROM conversations")
def limited_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.expr("CASE WHEN turn % 2 = 0 THEN 'LIMITED verification' ELSE role END")
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", review.limited(c).alias("limited"))


@_query(
    "q_rejected_names",
    "SELECT source, 'Skipped ' || count(*) || CASE WHEN count(*) = 1 THEN ' file' ELSE ' files' END || ' because the local memory budget is 512.0 MB: ' || string_agg('f' || doc_id, ', ' ORDER BY doc_id) FILTER (place <= 3) || "
    "CASE WHEN count(*) > 3 THEN ' and ' || (count(*) - 3) || ' more' ELSE '' END || '. Download or clear finished files before adding more.' AS told FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents) GROUP BY source",
)
def rejected_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("source", "doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"))
    rows = review.first_names(docs, "source", "doc_id", "name")
    return rows.select("source", review.rejected_text(F.col("names"), F.col("n"), F.lit(512 << 20)).alias("told"))


@_query("q_unique_names", "SELECT lang, doc_id, CASE WHEN place = 1 THEN name ELSE replace(name, '.txt', '-' || place || '.txt') END AS output_name FROM (SELECT lang, doc_id, name, row_number() OVER (PARTITION BY lang, lower(name) ORDER BY doc_id) AS place FROM (SELECT lang, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'N' ELSE 'n' END || doc_id % 7 || '.txt' AS name FROM documents))")
def unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("lang", "doc_id", F.expr("concat(if(doc_id % 2 = 0, 'N', 'n'), doc_id % 7, '.txt')").alias("name"))
    return review.unique_names(docs, "lang", "doc_id", "name").select("lang", "doc_id", "output_name")


@_query("q_legacy", "SELECT doc_id, CASE WHEN doc_id % 15 = 13 THEN 'Legacy binary Office files (.doc, .xls, .ppt) are not supported. Save the file as .docx, .xlsx, or .pptx first.' END AS error FROM documents")
def legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = walk(typed(magic_files(_table(spark, sf_dir, "documents"))), "doc_id")
    old = F.col("file_type") == "office-legacy"
    return walked.select("doc_id", F.when(old, legacy_office(F.col("file_type"), F.col("error"))).alias("error"))
