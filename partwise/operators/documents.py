"""ZIP documents: kind, properties and review data from the entries of the directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from partwise.functions.text import bound, decode_entities, lowered, shortened, trimmed
from partwise.operators.xml import attribute_of, attributes, attributes_in, bare, count_tags, texts_of, values_of

KINDS = ("docx", "xlsx", "pptx", "epub", "odt", "ods", "odp")
ENTRY = "array<struct<category:string,name:string,value:string>>"
#: Properties told of each part, in this order.
CORE = ("title", "subject", "creator", "keywords", "description", "lastModifiedBy", "created", "modified", "revision", "category")
APP = ("Application", "Company", "Manager", "Template", "TotalTime")
ODF = ("title", "subject", "description", "creator", "initial-creator", "creation-date", "date", "generator", "keyword", "editing-duration", "editing-cycles")
#: Dublin Core elements of an EPUB package that go.
DUBLIN = ("creator", "contributor", "publisher", "date", "subject", "description", "rights", "source", "coverage", "relation", "format", "type")
NO_IDENTIFIER, NO_TIME = "urn:uuid:00000000-0000-0000-0000-000000000000", "1970-01-01T00:00:00Z"
#: Parts that cleaning removes, as patterns over lower-case names, and parts of a DOCX that are edited, as written.
REMOVED = {
    "docx": r"^word/comments.*\.xml$|^word/people\.xml$|^word/commentauthors\.xml$",
    "xlsx": r"^xl/comments.*\.xml$|^xl/(threadedcomments|revisions|persons)/.*\.xml$",
    "pptx": r"^ppt/(comments|threadedcomments)/.*\.xml$|^ppt/(commentauthors|authors)\.xml$",
    "epub": r"^(meta-inf/)?(metadata\.xml|calibre_bookmarks\.txt)$",
}
EDITED = r"^word/(document|settings|footnotes|endnotes|header.*|footer.*)\.xml$"
IMAGES = r"(?i)\.(jpg|jpeg|png|webp|gif|tif|tiff|svg)$"


def empty() -> Column:
    return F.array().cast(ENTRY)


def one(category: str | Column, name: str | Column, value: str | Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(category).alias("category"), lit(name).alias("name"), lit(value).alias("value"))


def _when(condition: Column, *rows: Column) -> Column:
    return F.when(condition, F.array(*rows)).otherwise(empty())


def _each(values: Column, row: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.transform(values, lambda v: row(v)), empty())


def members(parts: Column) -> Column:
    return F.filter(parts, lambda x: x["kind"] == "ENTRY")


def _member(parts: Column, name: str | Column) -> Column:
    return F.get(F.filter(members(parts), lambda x: x["text"] == name), 0)


def _xml(member: Column) -> Column:
    """The text of a member; null unless it is UTF-8."""
    return F.try_validate_utf8(member["data"].cast("string"))


def names(parts: Column) -> Column:
    return F.transform(members(parts), lambda x: x["text"])


def safe_name(name: Column) -> Column:
    """Whether a member's name stays inside the folder it is unpacked to."""
    return (name != "") & ~F.startswith(name, F.lit("/")) & ~F.contains(name, F.lit("\\")) & ~F.array_contains(F.split(name, "/"), "..")


def package_path(parts: Column) -> Column:
    """The package document that an EPUB's container names; null if there is none."""
    rootfile = r"""(?s)<(?:[^\s/>:]++:)*+rootfile(\s(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    tags = F.regexp_extract_all(bare(_xml(_member(parts, "META-INF/container.xml"))), F.lit(rootfile), F.lit(1))
    own = F.transform(tags, lambda t: bound(attributes_in(t), lambda a: F.struct(F.coalesce(attribute_of(a, "media-type"), F.lit("")).alias("media"), attribute_of(a, "full-path").alias("path"))))
    fits = F.filter(own, lambda t: t["media"].isin("", "application/oebps-package+xml"))
    paths = F.transform(fits, lambda t: F.ltrim(F.replace(trimmed(t["path"]), F.lit("\\"), F.lit("/")), F.lit("/")))
    return F.get(F.filter(paths, lambda p: F.array_contains(names(parts), p)), 0)


def kind_of(parts: Column) -> Column:
    """Which document a directory holds; null for none."""
    has = lambda n: F.array_contains(names(parts), n)
    kind = trimmed(_xml(_member(parts, "mimetype")))
    odf = "application/vnd.oasis.opendocument."
    return (
        F.when(has("[Content_Types].xml") & has("word/document.xml"), "docx").when(has("[Content_Types].xml") & has("xl/workbook.xml"), "xlsx")
        .when(has("[Content_Types].xml") & has("ppt/presentation.xml"), "pptx").when((kind == "application/epub+zip") & package_path(parts).isNotNull(), "epub")
        .when(kind == f"{odf}text", "odt").when(kind == f"{odf}spreadsheet", "ods").when(kind == f"{odf}presentation", "odp")
    )


def removed_part(kind: str | Column, name: Column) -> Column:
    """Whether cleaning a document of the kind drops a part."""
    low = lowered(name)
    out = name.eqNullSafe(F.lit("meta.xml"))
    kind = F.lit(kind) if isinstance(kind, str) else kind
    for k, pattern in REMOVED.items():
        out = F.when(kind == k, F.rlike(low, F.lit(pattern))).otherwise(out)
    return out | F.startswith(low, F.lit("docprops/"))


def _properties(parts: Column, name: str, label: str, tags: tuple[str, ...]) -> Column:
    def told(m: Column) -> Column:
        rows = lambda plain: _each(texts_of(plain, *tags), lambda x: one("Document properties", x["tag"], x["text"]))
        return F.concat(F.array(one("Document properties", label, F.concat(m["n"].cast("string"), F.lit(" bytes")))), bound(bare(_xml(m)), rows))

    return _of(parts, name, told)


def _of(parts: Column, name: str, rows: Callable[[Column], Column]) -> Column:
    """``rows`` of the first member of that name; none if there is none."""
    return F.flatten(F.transform(F.slice(F.filter(members(parts), lambda x: x["text"] == name), 1, 1), lambda m: rows(m)))


def properties(parts: Column) -> Column:
    """Core, application and custom properties."""
    head = r"(?s)<(?:[^\s/>:]++:)?+property(\s[^>]*+)>"

    def custom(m: Column) -> Column:
        names = F.filter(F.transform(F.regexp_extract_all(bare(_xml(m)), F.lit(head), F.lit(1)), lambda h: attribute_of(attributes_in(h), "name")), lambda n: n.isNotNull())
        first = one("Document properties", "Custom properties", F.concat(m["n"].cast("string"), F.lit(" bytes")))
        return F.concat(F.array(first), _each(names, lambda n: one("Document properties", "Custom property", shortened(n, 180))))

    return F.concat(
        _properties(parts, "docProps/core.xml", "Core properties", CORE), _properties(parts, "docProps/app.xml", "App properties", APP), _of(parts, "docProps/custom.xml", custom)
    )


def _authors(own: Column, attribute: str) -> Column:
    """Distinct values of an attribute over arrays of attributes, sorted and joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.filter(F.transform(own, lambda x: values_of(x, attribute)), lambda a: a.isNotNull())))), ", ")


def docx_review(parts: Column) -> Column:
    edited = F.filter(members(parts), lambda m: F.rlike(m["text"], F.lit(EDITED)))
    comments = F.filter(members(parts), lambda m: F.rlike(lowered(m["text"]), F.lit(REMOVED["docx"])))
    read = lambda m: bound(bare(_xml(m)), lambda plain: F.struct(
        m["text"].alias("name"), count_tags(plain, "ins", "moveTo").alias("ins"), count_tags(plain, "del", "moveFrom").alias("del"), attributes(plain).alias("own")
    ))

    def told(x: Column) -> Column:
        ids = F.size(F.filter(x["own"], lambda a: F.startswith(F.substring_index(a["name"], ":", -1), F.lit("rsid"))))
        counts = (("Tracked insertions in ", x["ins"]), ("Tracked deletions in ", x["del"]), ("Revision IDs in ", ids))
        return F.concat(*[_when(n > 0, one("Review data", F.concat(F.lit(label), x["name"]), F.concat(n.cast("string"), F.lit(" present; removed during DOCX cleaning")))) for label, n in counts])

    def rows(both: Column) -> Column:
        authors = _authors(F.transform(F.concat(both["edited"], both["comments"]), lambda x: x["own"]), "author")
        return F.concat(
            F.flatten(F.transform(both["edited"], told)), F.transform(both["comments"], lambda x: one("Review data", F.concat(F.lit("Comments in "), x["name"]), "Present; removed during DOCX cleaning")),
            bound(authors, lambda a: _when(a != "", one("Review data", "Review authors", a))),
        )

    return bound(F.struct(F.transform(edited, read).alias("edited"), F.transform(comments, read).alias("comments")), rows)


def _review_parts(parts: Column, kind: str) -> Column:
    own = F.filter(members(parts), lambda m: F.rlike(lowered(m["text"]), F.lit(REMOVED[kind])))
    category = "EPUB metadata" if kind == "epub" else "Review data"
    return F.transform(own, lambda m: one(category, m["text"], f"Present; removed during {kind.upper()} cleaning"))


def _annotations(parts: Column, name: str) -> Column:
    def told(plain: Column) -> Column:
        n, authors = count_tags(plain, "annotation"), _authors(F.array(attributes(plain)), "creator")
        return F.concat(
            _when(F.coalesce(n > 0, F.lit(False)), one("Review data", f"Annotations in {name}", F.concat(n.cast("string"), F.lit(" present; removed during ODF cleaning")))),
            bound(authors, lambda a: _when(plain.isNotNull() & (a != ""), one("Review data", f"Review authors in {name}", a))),
        )

    return _of(parts, name, lambda m: bound(bare(_xml(m)), told))


def odf_entries(parts: Column) -> Column:
    return F.concat(_properties(parts, "meta.xml", "ODF metadata", ODF), _annotations(parts, "content.xml"), _annotations(parts, "settings.xml"))


def epub_entries(parts: Column) -> Column:
    """Dublin Core elements, identifiers, meta and link tags of the package, in the order of the text, and parts that go."""
    pattern = r"(?s)<(?:[^\s/>:]+:)?(" + "|".join((*DUBLIN, "identifier", "meta", "link")) + r")((?:\s(?:[^>\"'/]++|\"[^\"]*+\"|'[^']*+'|/(?!>))*+)?)(/?)>(?:([^<]*)</(?:[^\s/>:]+:)?\1\s*>)?"

    def row(x: Column) -> Column:
        tag, text = x["tag"], x["text"]
        own = lambda k: attribute_of(x["own"], k)
        labelled = lambda lead, *keys: F.coalesce(*[F.concat(F.lit(f"{lead} "), shortened(own(k), 80)) for k in keys], F.lit(lead))
        stays = F.startswith(x["property"], F.lit("rendition:")) | F.startswith(x["property"], F.lit("media:")) | (x["name"] == "cover")
        return (
            F.when(tag.isin(*DUBLIN), one("EPUB metadata", tag, F.coalesce(text, F.lit("Present"))))
            .when((tag == "identifier") & (text != NO_IDENTIFIER), one("EPUB metadata", tag, text))
            .when((tag == "meta") & (x["property"] == "dcterms:modified"), F.when(text != NO_TIME, one("EPUB metadata", "dcterms:modified", text)))
            .when((tag == "meta") & ~stays, one("EPUB metadata", labelled("meta", "property", "name"), F.coalesce(text, own("content"), F.lit("Present"))))
            .when(tag == "link", one("EPUB metadata", labelled("link", "rel"), F.coalesce(own("href"), F.lit("Present"))))
        )

    def read(t: Column) -> Column:
        text = shortened(trimmed(decode_entities(F.regexp_extract(t, pattern, 4))), 180)
        closed = F.regexp_extract(t, pattern, 3) == ""
        first = F.struct(F.regexp_extract(t, pattern, 1).alias("tag"), attributes_in(F.regexp_extract(t, pattern, 2)).alias("own"), F.when(closed, bound(text, lambda x: F.nullif(x, F.lit("")))).alias("text"))
        low = lambda x, k: lowered(trimmed(F.coalesce(attribute_of(x["own"], k), F.lit(""))))
        return bound(first, lambda x: F.struct(x["tag"].alias("tag"), x["own"].alias("own"), x["text"].alias("text"), low(x, "property").alias("property"), low(x, "name").alias("name")))

    def told(path: Column) -> Column:
        found = F.regexp_extract_all(bare(_xml(_member(parts, path))), F.lit(pattern), F.lit(0))
        head = lambda n: _when(n > 0, one("EPUB metadata", "Package metadata", F.concat(n.cast("string"), F.lit(" removable entries in "), path)))
        return bound(F.filter(F.transform(F.transform(found, read), row), lambda r: r.isNotNull()), lambda rows: F.concat(head(F.size(rows)), rows))

    return F.concat(F.coalesce(bound(package_path(parts), told), empty()), _review_parts(parts, "epub"))


def document_entries(file_type: Column, parts: Column) -> Column:
    """All entries of a ZIP document but those of packaged images (see ``nested``)."""
    rest = (
        F.when(file_type == "docx", docx_review(parts)).when(file_type == "xlsx", _review_parts(parts, "xlsx")).when(file_type == "pptx", _review_parts(parts, "pptx"))
        .when(file_type == "epub", epub_entries(parts)).otherwise(odf_entries(parts))
    )
    return F.concat(properties(parts), rest)

