"""What cleaning an SVG would remove, told by expressions over its parts (see ``walkers.markup``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from partwise.functions.text import bound, decode_css, decode_entities, local_name, lowered, trimmed, upto
from partwise.operators.documents import empty, one
from partwise.operators.xml import COMMENT, INSTRUCTION

#: Prefixes and names of attributes that editors leave.
EDITOR_PREFIXES = ("inkscape:", "sodipodi:", "adobe:", "sketch:", "serif:", "figma:", "dc:", "cc:")
EDITOR_NAMES = ("xmlns:inkscape", "xmlns:sodipodi", "xmlns:adobe", "xmlns:sketch")
#: Attributes whose value is an address, those that can animate to one, and those that can hold a CSS reference.
URL_NAMES = ("href", "src", "data", "poster", "action", "formaction")
ANIMATED_NAMES = ("to", "from", "values", "by")
CSS_NAMES = ("style", "fill", "stroke", "filter", "clip-path", "mask", "marker-start", "marker-mid", "marker-end", "cursor")
#: Parts that go whatever they hold.
GONE = ("COMMENT", "INSTRUCTION", "METADATA", "TITLE", "ACTIVE", "CLOSING")
_REMOTE = r"^(http:|https:|//|ftp:|file:|javascript:|mailto:)|^[^/:]*:"
# Each alternative is possessive: the matcher neither recurses nor goes back, whatever the text.
_QUOTED = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_SVG_NAME = r"<[ \t\n\r]*+(?:[^ \t\n\r/<>:]++:)*+(?i:svg)(?=[ \t\n\r/>])"
_BEFORE = rf"(?:[^<]++|<!--.*?-->|<(?!!--)[?!]{_QUOTED}>|(?!{_SVG_NAME})<(?![?!]))*+"
#: Tags that have the name and do not end, passed over before one that does: as each is read to the end of the text, no more are.
MOST_OPEN = 8


def svg_text(data: Column) -> Column:
    """The text without a byte order mark; null unless it is UTF-8."""
    return F.try_validate_utf8(F.when(F.startswith(data, F.unhex(F.lit("EFBBBF"))), F.substring(data, 4, 1 << 30)).otherwise(data).cast("string"))


def is_svg(data: Column) -> Column:
    """Whether an ``svg`` element opens in a UTF-8 text, after comments and declarations that end; one that does not end hides the rest."""
    return F.coalesce(F.rlike(svg_text(data), F.lit(rf"(?s)\A(?:{_BEFORE}{_SVG_NAME}(?!{_QUOTED}>)){{0,{MOST_OPEN}}}+{_BEFORE}{_SVG_NAME}{_QUOTED}>")), F.lit(False))


def comments(text: Column) -> Column:
    """(n, bytes) of the comments that end."""
    found = F.regexp_extract_all(upto(text, "-->"), F.lit(COMMENT), F.lit(0))
    return F.struct(F.size(found).alias("n"), F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x)).alias("bytes"))


def instructions(text: Column) -> Column:
    """Processing instructions but the XML declaration."""
    bodies = F.transform(F.regexp_extract_all(upto(text, "?>"), F.lit(INSTRUCTION), F.lit(1)), lambda t: F.regexp_replace(t, r"(?U)^\s+", ""))
    return F.size(F.filter(bodies, lambda t: (t != "xml") & ~F.startswith(t, F.lit("xml "))))


def _bare(value: Column) -> Column:
    return F.regexp_replace(trimmed(value), "^[\"']+|[\"']+$", "")


def _leaves(value: Column, remote: Callable[[Column], Column]) -> Column:
    stays = lambda v: (v == "") | F.startswith(v, F.lit("#")) | F.startswith(v, F.lit("data:"))
    return bound(_bare(value), lambda v: ~stays(v) & remote(v))


def external_reference(value: Column) -> Column:
    """Whether an address leaves the document: anything but an empty text, a fragment or a data address."""
    return _leaves(value, lambda v: F.rlike(lowered(v), F.lit(_REMOTE)) | ~F.contains(v, F.lit(":")))


def remote_reference(value: Column) -> Column:
    """Whether an address is remote or active; a path inside the document is not."""
    return _leaves(value, lambda v: F.rlike(lowered(v), F.lit(_REMOTE)))


def data_address(value: Column) -> Column:
    return F.startswith(lowered(_bare(value)), F.lit("data:"))


def _read_any(value: Column, holds: Callable[[Column], Column]) -> Column:
    """Whether something holds of a value as it stands, with entities decoded, with CSS escapes decoded, or with both."""
    xml = bound(value, lambda v: F.array(v, decode_entities(v)))
    return F.exists(bound(xml, lambda x: F.concat(x, F.transform(x, lambda v: decode_css(v)))), lambda v: holds(v))


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def _urls(v: Column) -> Column:
    return F.regexp_extract_all(upto(v, ")"), F.lit(r"(?is)url\(([^)]*+)\)"), F.lit(1))


def _open_url(v: Column) -> Column:
    """The place of a ``url(`` that does not close, 0 if there is none."""
    return F.locate("url(", lowered(F.substring_index(v, ")", -1)))


def css_reference(value: Column) -> Column:
    """Whether CSS leaves the document in any reading: by ``url()`` (also one that does not close) or ``@import``."""

    def plain(v: Column) -> Column:
        return F.exists(_urls(v), external_reference) | (_open_url(v) > 0) | F.contains(lowered(v), F.lit("@import"))

    return _read_any(value, plain)


def css_data(value: Column) -> Column:
    """Whether CSS holds a data address in any reading."""

    def plain(v: Column) -> Column:
        rest = F.substr(lowered(F.substring_index(v, ")", -1)), _open_url(v) + 4)
        return data_address(v) | F.exists(_urls(v), data_address) | ((_open_url(v) > 0) & F.contains(rest, F.lit("data:")))

    return _read_any(value, plain)


def attributes(parts: Column) -> Column:
    """(name, value, raw, offset, size) of all attributes, values with and without entities decoded."""
    own = F.filter(parts, lambda x: x["kind"] == "ATTRIBUTE")
    raw = lambda x: x["data"].cast("string")
    return F.transform(own, lambda x: F.struct(x["text"].alias("name"), decode_entities(raw(x)).alias("value"), raw(x).alias("raw"), x["offset"].alias("offset"), x["size"].alias("size")))


def removable(a: Column) -> Column:
    """Whether cleaning removes an attribute: left by an editor, an event handler, or a reference that leaves the document."""
    name, local = a["name"], lowered(local_name(a["name"]))
    editor = name.isin(*EDITOR_NAMES) | _any([F.startswith(name, F.lit(p)) for p in EDITOR_PREFIXES])
    handler = F.rlike(local, F.lit("(?s)^on."))
    address = F.when(local.isin(*URL_NAMES), external_reference(a["value"])).otherwise(
        local.isin(*ANIMATED_NAMES) & F.exists(F.split(a["value"], r"[ \t\n\r\f,;]"), remote_reference)
    )
    return editor | handler | address | css_reference(a["value"])


def data_addresses(parts: Column) -> Column:
    """The undecoded values of address attributes that are data addresses."""
    own = F.filter(attributes(parts), lambda a: lowered(local_name(a["name"])).isin(*URL_NAMES) & data_address(a["value"]))
    return F.transform(own, lambda a: a["raw"])


def opaque_references(parts: Column) -> Column:
    """CSS attributes with data addresses, which nothing can look into."""
    return F.size(F.filter(attributes(parts), lambda a: lowered(local_name(a["name"])).isin(*CSS_NAMES) & css_data(a["value"])))


def external_style(part: Column) -> Column:
    return (part["kind"] == "STYLE") & css_reference(part["data"].cast("string"))


def removed_ranges(parts: Column) -> Column:
    """(start, end) in the file of all that goes as a whole: comments, instructions, elements. They may lie in one another."""
    gone = F.filter(parts, lambda x: x["kind"].isin(*GONE) | external_style(x))
    return F.transform(gone, lambda x: F.struct(x["offset"].alias("start"), (x["offset"] + x["size"]).alias("end")))


def stays(part: Column) -> Column:
    """Whether cleaning keeps a part."""
    attribute = F.struct(part["text"].alias("name"), decode_entities(part["data"].cast("string")).alias("value"))
    return ~(part["kind"].isin(*GONE) | external_style(part) | ((part["kind"] == "ATTRIBUTE") & removable(attribute)))


def svg_entries(parts: Column) -> Column:
    """All entries of an SVG but those of its data addresses (see ``nested``). Texts that are no UTF-8 have none."""
    n = lambda kind: F.size(F.filter(parts, lambda x: x["kind"] == kind))
    counted = (
        ("SVG metadata", "metadata elements", n("METADATA")), ("SVG metadata", "title/description elements", n("TITLE")), ("SVG metadata", "XML comments", n("COMMENT")),
        ("SVG metadata", "Processing instructions", n("INSTRUCTION")), ("SVG active content", "script/foreignObject elements", n("ACTIVE")),
        ("SVG external references", "external style references", F.size(F.filter(parts, external_style))),
        ("SVG metadata", "removable attributes", F.size(F.filter(attributes(parts), removable))),
    )
    rows = [F.when(n > 0, F.array(one(c, name, F.concat(n.cast("string"), F.lit(" present; removed during SVG cleaning"))))).otherwise(empty()) for c, name, n in counted]
    return F.coalesce(F.concat(*rows), empty())
