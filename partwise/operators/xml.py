"""Counts and texts in XML, by patterns over the text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from partwise.functions.text import bound, decode_entities, local_name, shortened, trimmed, upto

# Possessive: the matcher neither recurses nor goes back, so texts may be long and tags broken.
_QUOTED = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
# Inside a tag no "<" stands, as XML has it: a tag that does not end is given up where the next begins.
_INSIDE = r"""(?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+"""
COMMENT = r"(?s)<!--.*?-->"
INSTRUCTION = r"(?s)<\?(.*?)\?>"
_PREFIX = r"(?:[^\s/<>:]++:)*+"
#: An opening or empty tag: group 1 the name, group 2 the attributes.
OPEN_TAG = rf"(?s)<[ \t\n\r]*+([^\s/<>!?]++)({_INSIDE})>"
ATTRIBUTE = r"""(?s)([^=\s]++)[ \t\n\r]*+=[ \t\n\r]*+(?:"([^"]*+)"|'([^']*+)')"""


def bare(xml: Column) -> Column:
    """Without comments, CDATA sections, declarations and instructions, up to the last tag; what is open hides the rest."""
    # One "<" before all ways: what is no tag is passed over character by character.
    hidden = rf"(?s)<(?:!--(?:[^-]++|-(?!->))*+(?:-->)?+|!\[CDATA\[(?:[^\]]++|\](?!\]>))*+(?:\]\]>)?+|[?!]{_QUOTED}(?:>|.*+))"
    told = lambda x: F.when(F.contains(x, F.lit("<!")) | F.contains(x, F.lit("<?")), F.regexp_replace(x, hidden, "")).otherwise(x)
    return bound(bound(xml, told), lambda x: upto(x, ">"))


#: Elements of one name inside one another are told apart to this depth.
NESTED = 4


def element(tag: str) -> str:
    """A pattern for an element of that local name with its end; group 1 what is inside.

    Inside, no tag of the name stands alone: one that is not closed ends the
    attempt where the next one opens, so the time stays linear.
    """
    name = rf"{_PREFIX}{tag}(?=[\s/>])"
    opening, empty, closing = rf"<{name}{_INSIDE}(?<!/)>", rf"<{name}{_INSIDE}(?<=/)>", rf"</\s*+{name}\s*+>"
    other = rf"[^<]++|<(?!/?\s*+{name})|{empty}"
    inside = rf"(?:{other})*+"
    for _ in range(NESTED - 1):
        inside = rf"(?:{other}|{opening}{inside}{closing})*+"
    return rf"(?s){opening}({inside}){closing}"


def _tagged(tag: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(tag).alias("tag"), x.alias("text"))


def texts_of(plain: Column, *tags: str) -> Column:
    """(tag, text) of all elements of these local names in a ``bare`` text, name by name: without tags, entities decoded, trimmed, at most 180 characters; no empty ones."""
    def found(there: Column) -> Column:
        # A name that opens no tag is not searched: most names of a list do not occur.
        each = lambda t: F.when(~F.array_contains(there, t), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(plain, F.lit(element(t)), F.lit(1)))
        return F.concat(*[F.transform(each(t), _tagged(t)) for t in tags])

    untagged = lambda t: F.when(F.contains(t, F.lit("<")), F.regexp_replace(t, rf"(?s)<{_INSIDE}>", "")).otherwise(t)
    value = lambda x: shortened(trimmed(decode_entities(untagged(x["text"]))), 180)
    there = F.regexp_extract_all(plain, F.lit(rf"<{_PREFIX}([^\s/<>:]++)(?=[\s/>])"), F.lit(1))
    clean = F.transform(bound(there, found), lambda x: F.struct(x["tag"].alias("tag"), value(x).alias("text")))
    return F.filter(clean, lambda x: x["text"] != "")


def count_tags(plain: Column, *tags: str) -> Column:
    """Opening and empty tags of these local names in a ``bare`` text."""
    return F.regexp_count(plain, F.lit(rf"(?s)<[ \t\n\r]*+{_PREFIX}(?:{'|'.join(tags)})(?=[\s/>]){_INSIDE}>"))


def _pairs(heads: Column) -> Column:
    pairs = F.flatten(F.transform(heads, lambda h: F.regexp_extract_all(h, F.lit(ATTRIBUTE), F.lit(0))))
    value = lambda a: F.concat(F.regexp_extract(a, ATTRIBUTE, 2), F.regexp_extract(a, ATTRIBUTE, 3))
    return F.transform(pairs, lambda a: F.struct(F.regexp_extract(a, ATTRIBUTE, 1).alias("name"), decode_entities(value(a)).alias("value")))


def attributes(plain: Column) -> Column:
    """All attributes of opening tags of a ``bare`` text: array of (name, value), entities decoded."""
    return _pairs(F.regexp_extract_all(plain, F.lit(OPEN_TAG), F.lit(2)))


def attributes_in(head: Column) -> Column:
    """The attributes of one tag."""
    return _pairs(F.array(head))


def attribute_of(own: Column, name: str) -> Column:
    """Of ``attributes`` the first value of one by local name; null if it is not there."""
    return F.get(F.filter(own, lambda a: local_name(a["name"]) == name), 0)["value"]


def values_of(own: Column, attribute: str) -> Column:
    """Of ``attributes`` the values of one by local name, trimmed, at most 180 characters, without empty ones."""
    own = F.filter(own, lambda a: (local_name(a["name"]) == attribute) & (trimmed(a["value"]) != ""))
    return F.transform(own, lambda a: shortened(trimmed(a["value"]), 180))
