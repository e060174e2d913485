"""Periodic runs of words: stretches that repeat a period four times or more.

Every run has, in one of two opposite orders of words, a longest Lyndon word of
the length of its period. So each text is scanned from right to left with a stack
under both orders, each Lyndon word is extended both ways, and suffixes are
compared by a rolling hash and binary search. Only stretches in which every five
words come again near by can hold a run; the others are passed over at once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from partwise.llm.common import map_batches, texts

#: A run has this many words at least, and this many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Of a run with these bounds, each so many words come again at the distance of the period.
GRAM = 5
#: Rounds in which stretches are cut where the next equal words are too far for their length; what is left is scanned.
ROUNDS = 16
#: Words compared one by one before hashes are.
NEAR = 8
_MOD = (1 << 61) - 1
_BASES = (0x1B873593CC9E2D51, 0x0F58476D1CE4E5B9, 0x14D049BB133111EB)

Run = tuple[int, int, int]


def stretches(ids: list[int]) -> list[tuple[int, int]]:
    """(start, end) of the stretches of words outside which no run lies; each run lies in one of them as a whole."""
    n = len(ids) - GRAM + 1
    if n < 2:
        return []
    x = np.array(ids, np.uint64)
    gram = np.zeros(n, np.uint64)
    for k in range(GRAM):
        gram = (gram ^ x[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        gram ^= gram >> np.uint64(29)
    order = np.argsort(gram, kind="stable")
    apart = np.where(gram[order[1:]] == gram[order[:-1]], order[1:] - order[:-1], n)
    near = np.full(n, n, np.int64)
    near[order[:-1]] = apart
    near[order[1:]] = np.minimum(near[order[1:]], apart)
    lengths, cut = np.full(n, len(ids)), None
    for _ in range(ROUNDS):
        edge = np.diff(np.concatenate(([0], (LEAST_TIMES * near <= lengths).view(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        wide = ends - starts >= LEAST_WORDS - GRAM + 1
        now = (starts[wide], ends[wide])
        if cut is not None and len(now[0]) == len(cut[0]) and (now[0] == cut[0]).all() and (now[1] == cut[1]).all():
            break
        cut = now
        lengths = np.zeros(n, np.int64)
        for s, e in zip(*cut, strict=True):
            lengths[s:e] = e - s + GRAM - 1
    return [(int(s), int(e) + GRAM - 1) for s, e in zip(*cut, strict=True)]


class _Told:
    """Words as numbers, with hashes of their beginnings."""

    def __init__(self, x: list[int], base: int):
        self.x, self.n = x, len(x)
        h, p = [0], [1]
        a = 0
        for v in x:
            a = (a * base + v + 1) % _MOD
            h.append(a)
            p.append(p[-1] * base % _MOD)
        self.h, self.p = h, p

    def same(self, i: int, j: int, k: int) -> bool:
        h, p = self.h, self.p[k]
        return (h[i + k] - h[j + k] - (h[i] - h[j]) * p) % _MOD == 0

    def ahead(self, i: int, j: int) -> int:
        """Words that the suffixes at i < j have in common."""
        x, most = self.x, self.n - j
        k = 0
        while k < most and x[i + k] == x[j + k]:
            k += 1
            if k == NEAR:
                break
        else:
            return k
        return self._search(k, most, lambda k: self.same(i, j, k))

    def back(self, i: int, j: int) -> int:
        """Words that agree before i < j, going back."""
        x = self.x
        k = 0
        while k < i and x[i - 1 - k] == x[j - 1 - k]:
            k += 1
            if k == NEAR:
                break
        else:
            return k
        return self._search(k, i, lambda k: self.same(i - k, j - k, k))

    @staticmethod
    def _search(low: int, most: int, same) -> int:
        """The largest k up to most for which same(k) holds, from a k that it holds for: doubling, then halving."""
        high = 2 * low
        while high < most and same(high):
            low, high = high, 2 * high
        if high >= most:
            if same(most):
                return most
            high = most
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if same(mid) else (low, mid)
        return low


def _lyndon_runs(told: _Told) -> set[Run] | None:
    """Runs of the words, or None if a hash misled (two different stretches told as one)."""
    x, n = told.x, told.n
    found: set[Run] = set()
    for sign in (1, -1):
        after = [n] * n
        least: dict[int, int] = {}
        for i in range(n - 1, -1, -1):
            first = x[i]
            j = i + 1
            while j < n:
                if x[j] != first:
                    if sign * (x[j] - first) < 0:
                        break
                else:
                    k = told.ahead(i, j)
                    if j + k == n:
                        break
                    if x[j + k] == x[i + k] or x[j + k - 1] != x[i + k - 1]:
                        return None
                    if sign * (x[j + k] - x[i + k]) < 0:
                        break
                j = after[j]
            after[i] = j
            p = j - i
            if LEAST_TIMES * p > n or least.get(p, n) <= i:
                continue
            right = told.ahead(i, j) if j < n and x[j] == first else 0
            left = told.back(i, j) if i and x[i - 1] == x[j - 1] else 0
            length = left + p + right
            if length >= max(LEAST_WORDS, LEAST_TIMES * p):
                s = i - left
                if x[s : s + length - p] != x[s + p : s + length]:
                    return None
                least[p] = s
                found.add((s, length, p))
    return found


def runs(ids: list[int]) -> list[Run]:
    """(start, length, period) of every run of a text whose words are told as numbers, by start, then period."""
    out = []
    for s, e in stretches(ids):
        x = ids[s:e]
        for base in _BASES:
            if (found := _lyndon_runs(_Told(x, base))) is not None:
                break
        else:
            raise ArithmeticError("hashes of words clash in every base")
        out += [(s + a, length, p) for a, length, p in found]
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, of every tenth document (by checksum) with an end that repeats a few of its words."""
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def told_runs(doc_id: int | None, text: str | None) -> tuple:
    words = planted(doc_id, (text or "").encode().split())
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    found = runs(ids) if len(number) + LEAST_TIMES - 1 <= len(ids) else []
    best: tuple = (None, None, None)
    dropped = bytearray(len(words))
    for s, length, p in found:
        dropped[s + p : s + length] = b"\x01" * (length - p)
        if best[0] is None or length * best[2] > best[1] * p:
            best = (s, length, p)
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    kept = [w for w, d in zip(words, dropped, strict=True) if not d] if found else words
    exponent = 1000 * best[1] // best[2] if found else None
    return doc_id, len(found), *best, exponent, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): its runs, the one with most repetitions, and the text without repetitions.

    Null and empty texts have no words and no run; then start, length, period
    and exponent_milli are null. A null doc_id has no checksum: its text is
    taken as it is. Of runs repeated equally often the first, then that of the
    shorter period is told. Repeated rows are told one by one, other columns are
    not looked at, an empty table gives no rows. Texts of any length: memory
    grows with the words of one text.
    """

    def tell(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            yield [told_runs(*row) for row in batch]

    return map_batches(texts(docs), SCHEMA, tell)
