"""Language by prediction by partial matching: a byte context tree for each language, and the code lengths that it gives to a text.

The trees hold the frozen counts of bytes after contexts of 0 to ORDER bytes. A
byte that a context has not seen costs an escape and is told by the next shorter
context, with what the longer one has seen taken out of it; the last resort is
any byte. So each language gives each text an exact code length in bits, and the
shortest wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.llm.common import discard, map_batches, materialize

ORDER = 4
#: A tree keeps the continuations that are at least one in so many of its language's bytes: for each order as many at most.
SHARE = 1 << 15
#: Continuations in all trees together; with very many languages each tree keeps larger shares only. Bounds what is sent to each task (12 bytes each).
MOST_KEPT = 4_000_000
#: Positions counted or scored at a time.
PIECE = 2_000_000
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_MASK = [np.uint64((1 << 8 * (k + 1)) - 1) for k in range(ORDER + 1)]


def grams(raw: bytes, before: bytes = b"") -> np.ndarray:
    """Each byte with the ORDER bytes before it, as one number: the byte lowest, then the nearest. Spaces stand before the text."""
    x = np.frombuffer((b" " * ORDER + before)[-ORDER:] + raw, np.uint8).astype(np.uint64)
    n = len(raw)
    out = x[ORDER:].copy()
    for k in range(1, ORDER + 1):
        out |= x[ORDER - k : ORDER - k + n] << np.uint64(8 * k)
    return out


def pieces(raw: bytes) -> Iterator[np.ndarray]:
    for at in range(0, len(raw), PIECE):
        yield grams(raw[at : at + PIECE], raw[max(0, at - ORDER) : at])


_COUNTS = pa.schema([("lang", pa.string()), ("depth", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])


def _counted(held: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for lang, parts in held.items():
        keys, n = np.unique(np.concatenate(parts), return_counts=True)
        for k in range(ORDER, -1, -1):
            short, at = np.unique(keys & _MASK[k], return_inverse=True)
            keys, n = short, np.bincount(at, n, len(short)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(np.full(len(keys), k, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n)], schema=_COUNTS)
    held.clear()


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, depth, gram, n) of every byte of every text of ``rows`` (lang, text); tasks add up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        n = 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                for piece in pieces(text.as_py().encode()):
                    held.setdefault(lang.as_py(), []).append(piece)
                    n += len(piece)
                    if n >= 2 * PIECE:
                        yield from _counted(held)
                        n = 0
        yield from _counted(held)

    return rows.mapInArrow(count, "lang string, depth int, gram long, n long").groupBy("lang", "depth", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Tree:
    """For each order: grams seen with their cost in bits, contexts with the cost of escaping from them."""

    grams: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]
    least: float

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """Bits of each full gram."""
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        for k in range(ORDER, -1, -1):
            key = keys[left] & _MASK[k]
            at, there = _find(self.grams[k], key)
            out[left[there]] += self.bits[k][at[there]]
            left, key = left[~there], key[~there]
            at, there = _find(self.contexts[k], key >> np.uint64(8))
            out[left[there]] += self.escapes[k][at[there]]
        out[left] += self.least
        return out


def _find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


def grow(counts: list[tuple[np.ndarray, np.ndarray]]) -> Tree:
    """The tree of (grams in order, counts) for each order from 0.

    In a context seen n times with d kept continuations, one seen c times has
    the chance c / (n + d); the rest is the escape, dealt over the other bytes
    in proportion to their chances in the next shorter context.
    """
    chance: list[np.ndarray] = []
    tree = Tree([], [], [], [], 8.0)
    for k, (keys, n) in enumerate(counts):
        contexts, first, at = np.unique(keys >> np.uint64(8), return_index=True, return_inverse=True)
        kept = np.bincount(at, n, len(contexts))
        d = np.bincount(at, minlength=len(contexts))
        seen = kept
        if k:
            there, known = _find(counts[k - 1][0], contexts)
            seen = np.maximum(kept, np.where(known, counts[k - 1][1][there] if len(counts[k - 1][1]) else 0, 0))
        p = n / (seen + d)[at]
        if k:
            there, known = _find(counts[k - 1][0], keys & _MASK[k - 1])
            shorter = np.where(known, chance[k - 1][there] if len(chance[k - 1]) else 0, 0)
            outside = 1 - np.bincount(at, shorter, len(contexts))
        else:
            outside = 1 - d / 256
        escape = (seen - kept + d) / (seen + d)
        chance.append(p)
        tree.grams.append(keys)
        tree.bits.append(-np.log2(p))
        tree.contexts.append(contexts)
        tree.escapes.append(-np.log2(escape / np.maximum(outside, 1e-9 if k else 1 / 256)))
    return tree


#: Slots (a power of two) of the table of common grams; of grams that meet in a slot one is kept, the others are looked up as rare ones are.
SLOT_BITS = 19


class Languages:
    """Names in order, and the tree of each."""

    def __init__(self, names: list[str], trees: list[Tree]):
        self.names, self.trees = names, trees

    def costs(self, keys: np.ndarray) -> np.ndarray:
        return np.array([t.costs(keys) for t in self.trees])

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)

    @cached_property
    def _common(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gram and row of each slot, and the costs by language and row, of all grams of the highest order."""
        keys = np.unique(np.concatenate([t.grams[ORDER] for t in self.trees]))
        slot_key, slot_row = np.full(1 << SLOT_BITS, np.iinfo(np.uint64).max), np.zeros(1 << SLOT_BITS, np.int32)
        at = self._slot(keys)
        slot_key[at], slot_row[at] = keys, np.arange(len(keys))
        return slot_key, slot_row, self.costs(keys) if len(keys) else np.zeros((len(self.trees), 1))

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text (rows) in each language (columns); each distinct rare gram is looked up once."""
        out = np.zeros((len(texts), len(self.trees)))
        if not out.size:
            return out
        slot_key, slot_row, costs = self._common
        held: list[tuple[int, np.ndarray]] = []
        n = 0

        def add() -> None:
            grams = np.concatenate([g for _, g in held])
            slot = self._slot(grams)
            rare = np.flatnonzero(slot_key[slot] != grams)
            row = slot_row[slot]
            keys, at = np.unique(grams[rare], return_inverse=True)
            starts = np.cumsum([0, *[len(g) for _, g in held]])[:-1]
            for k, told in enumerate(self.costs(keys)):
                bits = costs[k][row]
                bits[rare] = told[at]
                np.add.at(out[:, k], [i for i, _ in held], np.add.reduceat(bits, starts))

        for i, raw in enumerate(texts):
            for piece in pieces(raw):
                held.append((i, piece))
                n += len(piece)
                if n >= PIECE:
                    add()
                    held, n = [], 0
        if held:
            add()
        return out


def _checksum(docs: DataFrame):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame) -> Languages:
    """A tree for each language of the labelled rows of ``docs`` (doc_id, text, lang) that are not held out.

    All their bytes are counted. A tree keeps the continuations above a share
    (SHARE) of its language, a number bounded at every size; what is cut off
    counts as escapes.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~_checksum(docs)).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = materialize(count_grams(rows))
    totals = counts.where("depth = 0").groupBy("lang").agg(F.sum("n").alias("total"))
    share = max(1, min(SHARE, MOST_KEPT // (max(1, totals.count()) * (ORDER + 1))))
    kept = counts.join(F.broadcast(totals), "lang").where(F.col("n") * share >= F.col("total"))
    found = kept.select("lang", "depth", "gram", "n").orderBy("lang", "depth", "gram").toArrow()
    discard(counts)
    lang, depth, gram, n = (found.column(c) for c in ("lang", "depth", "gram", "n"))
    names = sorted(set(lang.unique().to_pylist()))
    code = np.searchsorted(np.array(names), np.array(lang.to_pylist())) if names else np.zeros(0, np.int64)
    depth, gram, n = np.asarray(depth), np.asarray(gram).astype(np.uint64), np.asarray(n)
    trees = []
    for i in range(len(names)):
        own = [(code == i) & (depth == k) for k in range(ORDER + 1)]
        trees.append(grow([(gram[x], n[x]) for x in own]))
    return Languages(names, trees)


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(docs: DataFrame, languages: Languages) -> DataFrame:
    """The language of each row of ``docs`` (doc_id, text), with its share among all languages' chances as score.

    Null texts, texts without a letter, and all texts where no language was
    learned are ``und`` with score 0. Of languages with equal code lengths the
    first by name wins. A null doc_id counts as held out. Repeated rows are told
    one by one, other columns are not looked at, an empty table gives no rows.
    Texts of any length are read in pieces.
    """
    sent = docs.sparkSession.sparkContext.broadcast(languages)

    def tell(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        known: Languages = sent.value
        for batch in batches:
            read = [k for k, row in enumerate(batch) if known.names and row[2] is not None and _LETTER.search(row[2])]
            bits = known.bits([batch[k][2].encode() for k in read])
            out = [(*row[:2], UNKNOWN, 0.0) for row in batch]
            for k, b in zip(read, bits, strict=True):
                best = int(b.argmin())
                out[k] = (*batch[k][:2], known.names[best], float(1 / np.exp2(np.maximum(b[best] - b, -1000)).sum()))
            yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _checksum(docs).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, SCHEMA, tell)


def predicted(docs: DataFrame) -> DataFrame:
    """Languages learned from the rows that are not held out, told for all rows."""
    return identify(docs, fit(docs))
