"""XML and CSS text, base64 and escapes as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The predefined entities of XML.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that stands in the plan once and is told once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), lambda v: fn(v)), 0)


def local_name(name: Column) -> Column:
    """What follows the last colon."""
    return F.substring_index(name, ":", -1)


#: The characters that Unicode calls white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.btrim(text, F.lit(WHITE))


def upto(text: Column, mark: str) -> Column:
    """What goes up to the last mark, with it; empty if there is none. Patterns that end with the mark then find it from wherever they begin."""
    return F.left(text, F.length(text) - F.length(F.substring_index(text, mark, -1)))


def lowered(text: Column) -> Column:
    """A-Z as a-z, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_ascii_ci(data: Column, *needles: str) -> Column:
    """Whether bytes hold one of the ASCII texts in either case; an empty text is in nothing."""
    words = [n for n in needles if n]
    if not words:
        return F.lit(False)
    return F.coalesce(F.rlike(F.decode(data, "ISO-8859-1"), F.lit("(?i)" + "|".join(words))), F.lit(False))


def character(code: Column) -> Column:
    """The character of a code point; empty for numbers that are none."""
    ok = code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit(""))


def _entity(e: Column) -> Column:
    number = F.regexp_extract(e, r"^#\+?([0-9]{1,18})$", 1)
    code = F.coalesce(number.try_cast("long"), F.conv(F.nullif(F.regexp_extract(e, r"^#x\+?([0-9a-fA-F]{1,15})$", 1), F.lit("")), 16, 10).cast("long"), F.lit(-1))
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair]), e)
    return F.when(F.startswith(e, F.lit("#")), character(code)).otherwise(F.coalesce(named, F.concat(F.lit("&"), e, F.lit(";"))))


def decode_entities(text: Column) -> Column:
    """Entities and character references decoded; bad numbers vanish, unknown names and a lone ``&`` stay."""

    def told(own: Column) -> Column:
        between, found = F.split(own, r"(?s)&[^;]*+;"), F.regexp_extract_all(own, F.lit(r"(?s)&([^;]*+);"), F.lit(1))
        return F.array_join(F.zip_with(between, found, lambda t, e: F.concat(t, F.when(e.isNull(), F.lit("")).otherwise(_entity(e)))), "")

    # Behind the last semicolon nothing is an entity.
    whole = lambda t: F.when(F.contains(t, F.lit("&")), F.concat(bound(upto(t, ";"), told), F.substring_index(t, ";", -1))).otherwise(t)
    return bound(text, whole)


def decode_css(text: Column) -> Column:
    """CSS escapes decoded: a backslash and up to six hexadecimal digits with one blank, or a character that stands for itself."""
    escape = r"(?s)\\(?:([0-9a-fA-F]{1,6})[ \t\n\r\f]?|(.)|$)"
    digits, other = (F.regexp_extract_all(text, F.lit(escape), F.lit(k)) for k in (1, 2))
    plain = F.zip_with(digits, other, lambda d, o: F.when(d != "", character(F.conv(d, 16, 10).cast("long"))).otherwise(o))
    return F.array_join(F.zip_with(F.split(text, escape), plain, lambda t, e: F.concat(t, F.coalesce(e, F.lit("")))), "")


def base64_decode(text: Column) -> Column:
    """Bytes of standard base64: white space is skipped, ``=`` ends it, padding may be missing, left-over bits go; null for any other character."""
    body = F.regexp_extract(F.regexp_replace(text, r"[ \t\n\r\f]", ""), r"(?s)^([^=]*)", 1)
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), "A")
    whole = F.substr(F.unbase64(padded), F.lit(1), F.floor(F.length(body) * 6 / 8).cast("int"))
    return F.when(F.rlike(body, F.lit("^[A-Za-z0-9+/]*$")), F.when(body == "", F.unhex(F.lit(""))).otherwise(whole))


def base64_encode(data: Column) -> Column:
    """Standard base64 with padding on one line."""
    return F.regexp_replace(F.base64(data), r"[\r\n]", "")


def class_name(text: Column) -> Column:
    """A CSS class of a text: lower case, and ``-`` for each UTF-16 unit that is no letter, digit, ``_`` or ``-``."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[\x{10000}-\x{10FFFF}]", "--"), r"[^a-z0-9_-]", "-")


def escape_html(text: Column) -> Column:
    """``&``, ``<``, ``>`` and the no-break space as entities."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\u00a0", "&nbsp;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def escape_attribute(text: Column) -> Column:
    """``escape_html``, and quotes as entities."""
    return F.replace(F.replace(escape_html(text), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#39;"))


def shortened(text: Column, n: int) -> Column:
    return bound(text, lambda t: F.when(F.char_length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit("..."))).otherwise(t))
