"""Tags of SVG texts, each element with its end by depth: one pass over the bytes, whatever they hold."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from partwise.walkers.part import Part

MOST_BYTES = 32 << 20
TOO_LARGE, NO_TEXT = "SVG file is too large to inspect safely", "SVG must be UTF-8 XML"
#: Elements whose content is no markup.
RAW = (b"script", b"style", b"foreignobject")
ACTIVE = (b"script", b"foreignobject")
_NAME = re.compile(rb"[ \n\r\t]*+([^ \n\r\t/>]++)")
_ATTRIBUTE = re.compile(
    rb"""([ \n\r\t]*+)([^= \n\r\t]++)[ \n\r\t]*+(?:(=)[ \n\r\t]*+(?:"([^"]*+)"|'([^']*+)'|([^ \n\r\t"'][^ \n\r\t]*+)|()))?"""
)


class Tag(NamedTuple):
    """A tag from ``start`` to ``end``; its attributes from ``at`` to ``to``; ``local`` in lower case."""

    start: int
    end: int
    local: bytes
    closing: bool
    empty: bool
    at: int
    to: int


class Markup:
    """Where tags end, told for every ``<`` at once."""

    def __init__(self, text: bytes):
        self.text = text
        x = np.frombuffer(text, np.uint8)
        self.opens = np.flatnonzero(x == 60).tolist()
        at = np.flatnonzero((x == 62) | (x == 34) | (x == 39))
        # From the last one back: a tag ends at the next ">" outside quotes, so a quote goes on where its partner closes it.
        ends, later = array("q", [-1]) * (len(at) + 1), {34: -1, 39: -1}
        kinds = x[at].tolist()
        for k in range(len(at) - 1, -1, -1):
            c = kinds[k]
            if c == 62:
                ends[k] = int(at[k]) + 1
            else:
                ends[k] = ends[later[c] + 1] if later[c] >= 0 else -1
                later[c] = k
        first = np.searchsorted(at, self.opens)
        self.ends = [ends[k] for k in first.tolist()]

    def tag(self, k: int) -> Tag | None:
        """The tag that the k-th ``<`` begins; None if it has no end or no name."""
        text, start, end = self.text, self.opens[k], self.ends[k]
        if end < 0:
            return None
        closing = text[start + 1 : start + 2] == b"/"
        m = _NAME.match(text, start + 1 + closing, end)
        if m is None:
            return None
        empty = text[end - 2 : end] == b"/>"
        return Tag(start, end, m[1].rpartition(b":")[2].lower(), closing, empty, m.end(), max(m.end(), end - 1 - empty))

    def after(self, k: int, place: int) -> int:
        """The first ``<`` from the k-th on that is not before a place."""
        n = len(self.opens)
        while k < n and self.opens[k] < place:
            k += 1
        return k

    def tags(self, comments: bool = True) -> Iterator[Tag]:
        """Tags in order. ``comments`` are passed over as such, else they end like declarations."""
        k, n, text = 0, len(self.opens), self.text
        while k < n:
            start = self.opens[k]
            lead = text[start + 1 : start + 4]
            if comments and lead == b"!--":
                end = text.find(b"-->", start + 4)
                if end < 0:
                    return
                k = self.after(k, end + 3)
            elif lead[:1] in (b"?", b"!"):
                if self.ends[k] < 0 and comments:
                    return
                k = self.after(k, self.ends[k]) if self.ends[k] >= 0 else k + 1
            elif tag := self.tag(k):
                yield tag
                k = self.after(k, tag.end)
            else:
                k += 1

    def elements(self, *names: bytes) -> Iterator[tuple[int, int, int]]:
        """(start, end of the opening tag, end) of the outermost elements of these names; one that is not closed ends with its tag."""
        own = [t for t in self.tags() if t.local in names]
        stacks: dict[bytes, list[int]] = {}
        close: dict[int, int] = {}
        for t in own:
            stack = stacks.setdefault(t.local, [])
            if t.closing:
                if stack:
                    close[stack.pop()] = t.end
            elif not t.empty:
                stack.append(t.start)
        past = 0
        for t in own:
            if not t.closing and t.start >= past:
                past = close.get(t.start, t.end)
                yield t.start, t.end, past

    def raw_elements(self, *names: bytes) -> Iterator[tuple[int, int, int]]:
        """The same for elements whose content is no markup: they end at the next closing tag of their name."""
        places = {p: k for k, p in enumerate(self.opens)}
        lost: set[bytes] = set()
        past = 0
        for t in self._from(lambda: past):
            if t.closing or t.local not in names:
                continue
            end = t.end
            if not t.empty and t.local not in lost:
                end = self._closed(t, places)
                if end < 0:
                    lost.add(t.local)
                    end = t.end
            past = end
            yield t.start, t.end, end

    def _from(self, past) -> Iterator[Tag]:
        """Tags in order; what lies before ``past()`` when the next one is asked for is passed over."""
        k, n, text = 0, len(self.opens), self.text
        while (k := self.after(k, past())) < n:
            start = self.opens[k]
            if text[start + 1 : start + 4] == b"!--":
                end = text.find(b"-->", start + 4)
                if end < 0:
                    return
                k = self.after(k, end + 3)
            elif text[start + 1 : start + 2] in (b"?", b"!"):
                if self.ends[k] < 0:
                    return
                k = self.after(k, self.ends[k])
            elif tag := self.tag(k):
                yield tag
                k = self.after(k, max(tag.end, past()))
            else:
                k += 1

    def _closed(self, tag: Tag, places: dict[int, int]) -> int:
        at = tag.end
        while (at := self.text.find(b"</", at)) >= 0:
            found = self.tag(places[at])
            if found is None:
                at += 2
            elif found.local == tag.local:
                return found.end
            else:
                at = found.end
        return -1

    def attributes(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(start, end, name, value as written) of all attributes of opening tags."""
        for t in self.tags(comments=False):
            if t.closing:
                continue
            for m in _ATTRIBUTE.finditer(self.text, t.at, t.to):
                if m[7] is not None:
                    break  # a value that does not begin or does not end
                yield m.start(), m.end(), m[2], next((v for v in (m[4], m[5], m[6]) if v is not None), b"")


def _spans(text: bytes, head: bytes, tail: bytes) -> Iterator[tuple[int, int]]:
    at = 0
    while (start := text.find(head, at)) >= 0 and (end := text.find(tail, start + len(head))) >= 0:
        at = end + len(tail)
        yield start, at


def svg(b: bytes, faults: list[str]) -> Iterator[Part]:
    """The text without its byte order mark, then inside it: comments, instructions, elements that can go, attributes."""
    lead = 3 if b.startswith(b"\xef\xbb\xbf") else 0
    text = b[lead:]
    yield Part("TEXT", lead, len(text), len(text), text)
    if len(b) > MOST_BYTES:
        faults.append(TOO_LARGE)
    try:
        text.decode()
    except UnicodeDecodeError:
        faults.append(NO_TEXT)
        return
    inside = lambda kind, s, e, **more: Part(kind, lead + s, e - s, e - s, sub=True, **more)
    for s, e in _spans(text, b"<!--", b"-->"):
        yield inside("COMMENT", s, e)
    for s, e in _spans(text, b"<?", b"?>"):
        body = text[s + 2 : e - 2].decode().lstrip()
        yield inside("DECLARATION" if body == "xml" or body.startswith("xml ") else "INSTRUCTION", s, e)
    marks = Markup(text)
    for s, _, e in marks.elements(b"metadata"):
        yield inside("METADATA", s, e)
    for s, _, e in marks.elements(b"title", b"desc"):
        yield inside("TITLE", s, e)
    for s, _, e in marks.raw_elements(*ACTIVE):
        yield inside("ACTIVE", s, e)
    for t in marks.tags():
        if t.closing and t.local in ACTIVE:
            yield inside("CLOSING", t.start, t.end)
    for s, own, e in marks.raw_elements(b"style"):
        yield inside("STYLE", s, e, data=text[own:e])
    for s, e, name, value in marks.attributes():
        yield inside("ATTRIBUTE", s, e, text=name.decode(), data=value)
