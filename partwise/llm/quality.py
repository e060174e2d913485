"""Quality rules: word and line counts, and Jensen-Shannon distance to language references."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partwise.llm.common import map_batches, materialize

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
REPEAT = 8
#: Words up to this length (characters) can be common words of a reference.
LONGEST = 24
COMMON = 60
#: A language with fewer words, or with a smaller share of all words than one in so many, has no reference, and its documents are not judged by
#: histograms. The share bounds the references, which all go to each task, at every size of the corpus: 4,000 of about 2 KB.
LEAST_LANGUAGE, LEAST_SHARE = 1_000, 4_000
#: Guards: documents below these sizes are not judged by the histogram in question.
LEAST_BYTES, LEAST_WORDS = 200, 50
#: A document fails if its distance to every reference is above these.
MOST_CLASS, MOST_WORD = 0.32, 0.46
#: Counters hand over their counts when they have so many keys: bounds a task's memory.
FLUSH = 300_000

CLASSES = ["lower", "upper", "digit", "stop", "symbol", "space", "latin", "other"]
_CLASS = np.full(256, 7, np.int64)
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b".,;:!?'\"()-", 3), (SPACE, 5)):
    _CLASS[np.frombuffer(_chars, np.uint8)] = _k
_CLASS[[c for c in range(33, 127) if _CLASS[c] == 7]] = 4
_CLASS[0xC2:0xE0] = 6
#: Following bytes of a UTF-8 character count nowhere.
_CLASS[0x80:0xC0] = 8


def class_counts(raw: bytes) -> np.ndarray:
    """Characters by class."""
    return np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9)[:8]


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence, base 2) of p to each row of q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def repeated(words: list[bytes], size: int = REPEAT) -> int:
    """Words inside windows of ``size`` words that come twice or more, the first included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(h, twice)).tolist()
    exact = Counter(tuple(words[i : i + size]) for i in starts)
    edge = np.zeros(len(words) + 1, np.int64)
    for i in starts:
        if exact[tuple(words[i : i + size])] > 1:
            edge[i] += 1
            edge[i + size] -= 1
    return int((edge.cumsum() > 0).sum())


def base_counts(text: str | None) -> tuple[bytes, list[bytes], tuple[int, int, int, int, int]]:
    """UTF-8 bytes, words, and (words, word characters, symbols, repeated lines, repeated words)."""
    raw = (text or "").encode()
    words = raw.split()
    chars = len(text or "") - (len(raw) - len(raw.translate(None, SPACE)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return raw, words, (len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated(words))


Reference = tuple[str, np.ndarray, list[bytes], np.ndarray]


def _reference(lang: str, classes: list[int], words: list[bytes], counts: list[int], total: int) -> Reference:
    """(language, class histogram, common words, their histogram with all others last)."""
    hist = np.array([*counts, max(0, total - sum(counts))], float)
    return lang, np.array(classes, float) / max(1, sum(classes)), [bytes(w) for w in words], hist / max(1.0, hist.sum())


def reference_table(docs: DataFrame) -> DataFrame:
    """(lang, classes, words, counts, total) of every language with LEAST_LANGUAGE words or more, from all documents.

    Tasks add counts up before the shuffle. The corpus is its own reference: a
    language that is mostly junk makes junk its norm.
    """

    def count(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        found: Counter = Counter()

        def rows() -> list[tuple]:
            out = [(*k, n) for k, n in found.items()]
            found.clear()
            return out

        for batch in batches:
            for lang, text in batch:
                raw = (text or "").encode()
                lang = lang or ""
                found.update({(lang, "class", CLASSES[i].encode()): int(n) for i, n in enumerate(class_counts(raw)) if n})
                words = raw.lower().split()
                found[lang, "all", b""] += len(words)
                for w, n in Counter(words).items():
                    if len(w) <= LONGEST or len(w) <= 4 * LONGEST and len(w.decode()) <= LONGEST:
                        found[lang, "word", w] += n
                if len(found) > FLUSH:
                    yield rows()
        yield rows()

    pairs = docs.select(F.col("lang").cast("string"), F.col("text").cast("string"))
    sums = map_batches(pairs, "lang string, kind string, item binary, n long", count).groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")
    top = sums.withColumn("place", F.row_number().over(best)).where(F.col("place") <= COMMON)
    ranked = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct((-F.col("n")).alias("m"), "item"))))
    own = top.groupBy("lang").agg(
        F.array(*[F.coalesce(F.max(F.when((F.col("kind") == "class") & (F.col("item") == c.encode()), F.col("n"))), F.lit(0)) for c in CLASSES]).alias("classes"),
        ranked("word").alias("w"), F.coalesce(F.max(F.when(F.col("kind") == "all", F.col("n"))), F.lit(0)).alias("total"),
    )
    own = materialize(own)
    words = own.agg(F.sum("total")).first()[0] or 0
    rows = own.where((F.col("total") >= LEAST_LANGUAGE) & (F.col("total") * LEAST_SHARE >= words))
    return rows.select("lang", "classes", F.transform("w", lambda x: x["item"]).alias("words"), F.transform("w", lambda x: -x["m"]).alias("counts"), "total")


def references(table: DataFrame) -> list[Reference]:
    """All references, those of the largest languages first."""
    return [_reference(r["lang"], r["classes"], r["words"], r["counts"], r["total"]) for r in table.orderBy(F.desc("total"), "lang").collect()]


def divergence(raw: bytes, words: list[bytes], refs: list) -> tuple[float | None, float | None]:
    """Smallest distance to a reference by character classes and by common words; None where a guard holds."""
    by_class = by_word = None
    if refs and len(raw) >= LEAST_BYTES:
        counts = class_counts(raw)
        by_class = float(distance(counts / counts.sum(), np.array([r[1] for r in refs])).min())
    if refs and len(words) >= LEAST_WORDS:
        own = Counter(w.lower() for w in words)
        by_word = 1.0
        for _, _, common, hist in refs:
            n = np.array([*[own[w] for w in common], 0], float)
            n[-1] = len(words) - n.sum()
            by_word = min(by_word, float(distance(n / n.sum(), hist)))
    return by_class, by_word


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def quality(docs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Counts, base rules and verdict for each row of ``docs`` (doc_id, text, lang).

    ``kept`` is false if a base rule fails; else false only where a distance
    that its guard lets count is above its limit for the references of all
    languages. A document whose own language has no reference is not judged by
    distances (both are null). Null and empty texts have no words and fail. A
    null language counts as a language of its own. Repeated rows are judged one
    by one; an empty table gives no rows.
    """
    refs = references(reference_table(docs) if table is None else table)
    known = {r[0] for r in refs}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))

    def judge(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            out = []
            for doc_id, text, lang in batch:
                raw, words, counts = base_counts(text)
                failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
                by_class, by_word = divergence(raw, words, refs if lang in known else [])
                far = (by_class is not None and by_class > MOST_CLASS) or (by_word is not None and by_word > MOST_WORD)
                out.append((doc_id, *counts, failed, not failed and not far, by_class, by_word))
            yield out

    return map_batches(rows, SCHEMA, judge)
