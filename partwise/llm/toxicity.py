"""Toxicity: a weighted finite-state grammar of insults, threats, targets, negation and reported speech, scored by clause.

Each of the five is a transducer over word classes; ``compose`` makes one of
them, whose states are what they remember together. A clause is read word by
word: the insult transducer's arcs are words and stems with weights learned from
labelled documents, the others add to the weight of a match or change it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.llm.common import bounded, map_batches, texts

#: Fixed word lists of the grammar.
THREATS = frozenset("kill hurt beat destroy shoot stab burn punish crush töten schlagen tuer frapper matar golpear".split())
TARGETS = frozenset("you your youre u he she they them him her people du dich ihr sie tu te vous toi ils elle usted ustedes ellos".split())
NEGATIONS = frozenset("not no never none nobody isnt arent dont doesnt wasnt nicht kein keine nie ne pas jamais nunca ni".split())
REPORTS = frozenset("said says say wrote writes called calls quoted quote reported according told sagte schrieb dit écrit dijo escribió".split())
INSULTS = frozenset("idiot moron stupid scum trash loser pathetic worthless disgusting clown imbecile dumb".split())

#: Weights of the transducers that act on an insult or threat.
TARGET_BOOST, NEGATED, REPORTED, THREAT_WEIGHT, START_WEIGHT = 1.0, 0.4, 0.6, 3.0, 2.0
#: Words that a negation, a target or a threat verb reaches over.
REACH = 4

#: At most about this many labelled rows are read for fitting; their words bound the arcs.
MOST_LABELLED = 12_000
STEMS = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:,\n|]+")


@dataclass
class Grammar:
    """Arcs (``stem*`` or a whole word) with weights, and the logistic function of a document's clause scores."""

    arcs: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, START_WEIGHT))
    weights: tuple[float, ...] = (-3.0, 1.0, 1.0, 1.0, 0.0)


def arc_weight(word: str, arcs: dict[str, float]) -> float:
    """Weight of the heaviest arc that reads the word; 0 for none."""
    return max(arcs.get(word, 0.0), *(arcs.get(word[:k] + "*", 0.0) if len(word) >= k else 0.0 for k in STEMS))


#: Word classes that the transducers read.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
CLASS = {w: c for c, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}


@dataclass
class Transducer:
    """``arcs`` lead from (state, word class) to (state, factor, bonus, hits): a match weighs factor * (weight of the word + bonus)."""

    start: tuple
    arcs: dict[tuple, tuple[tuple, float, float, int]]

    @property
    def states(self) -> set:
        return {s for s, _ in self.arcs}


def reaching(begins: int, meets: int | None = None, bonus: float = 0.0, hits: int = 0, factor: float = 1.0, ends: bool = False, reach: int | None = REACH) -> Transducer:
    """A transducer that remembers a word of class ``begins`` over the next ``reach`` words (None: to the end of the clause).

    While it remembers, words of class ``meets`` bring ``bonus`` and ``hits``
    (and end it, with ``ends``), and every match weighs ``factor``.
    """
    most = 1 if reach is None else reach
    arcs = {}
    for left in range(most + 1):
        for c in range(6):
            met = left > 0 and c == meets
            after = 0 if met and ends else max(0, left - (reach is not None))
            arcs[(left,), c] = ((most if c == begins else after,), factor if left else 1.0, bonus if met else 0.0, hits if met else 0)
    return Transducer((0,), arcs)


def compose(one: Transducer, two: Transducer) -> Transducer:
    """Both at once: states side by side, factors multiplied, bonuses and hits added. Only states that can be reached."""
    start = one.start + two.start
    arcs, todo, k = {}, [start], len(one.start)
    seen = {start}
    while todo:
        state = todo.pop()
        for c in range(6):
            a, fa, ba, ha = one.arcs[state[:k], c]
            b, fb, bb, hb = two.arcs[state[k:], c]
            arcs[state, c] = (a + b, fa * fb, ba + bb, ha + hb)
            if a + b not in seen:
                seen.add(a + b)
                todo.append(a + b)
    return Transducer(start, arcs)


def clause_grammar() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The composed transducer as tables by state and word class: next state, factor, bonus, hits. State 0 begins."""
    parts = [
        Transducer((0,), {((0,), c): ((0,), 1.0, 0.0, int(c == INSULT)) for c in range(6)}),
        reaching(TARGET, meets=INSULT, bonus=TARGET_BOOST), reaching(INSULT, meets=TARGET, bonus=TARGET_BOOST, ends=True),
        reaching(THREAT, meets=TARGET, bonus=THREAT_WEIGHT, hits=1, ends=True), reaching(NEGATION, factor=NEGATED), reaching(REPORT, factor=REPORTED, reach=None),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = compose(whole, p)
    number = {s: k for k, s in enumerate(sorted(whole.states, key=lambda s: (s != whole.start, s)))}
    tables = [np.zeros((len(number), 6), t) for t in (int, float, float, int)]
    for (s, c), (to, *rest) in whole.arcs.items():
        for table, value in zip(tables, (number[to], *rest), strict=True):
            table[number[s], c] = value
    return tuple(t.tolist() for t in tables)  # type: ignore[return-value]


NEXT, FACTOR, BONUS, HITS = clause_grammar()


def score_clause(words: list[str], arcs: dict[str, float]) -> tuple[float, int]:
    """Weight that the composed transducer gives a clause, and its number of insults and threats."""
    total, hits, state = 0.0, 0, 0
    for w in words:
        weight = arc_weight(w, arcs)
        c = INSULT if weight else CLASS.get(w, OTHER)
        total += FACTOR[state][c] * (weight + BONUS[state][c])
        hits += HITS[state][c]
        state = NEXT[state][c]
    return total, hits


class Scorer:
    """Scores documents; remembers words it has looked up, up to a bound."""

    def __init__(self, grammar: Grammar, remember: int = 400_000):
        self.grammar, self.remember, self.known = grammar, remember, {}

    def _counts(self, token: str) -> bool:
        parts = _WORD.findall(token)
        out = any(w in THREATS or arc_weight(w, self.grammar.arcs) for w in parts)
        if len(self.known) >= self.remember:
            self.known.clear()
        self.known[token] = out
        return out

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """log(1 + sum of clause scores), highest clause score, log(1 + matches), matches for each 100 words."""
        lower = (text or "").lower()
        known, counts = self.known, self._counts
        tokens = lower.split()
        if not any([known[t] if t in known else counts(t) for t in set(tokens)]):
            return 0.0, 0.0, 0.0, 0.0
        total = most = 0.0
        hits = 0
        for clause in _CLAUSE.split(lower):
            s, h = score_clause(_WORD.findall(clause), self.grammar.arcs)
            total, most, hits = total + s, max(most, s), hits + h
        return math.log1p(total), most, math.log1p(hits), 100 * hits / max(1, len(tokens))

    def probability(self, text: str | None) -> float:
        f = (1.0, *self.features(text))
        z = sum(w * x for w, x in zip(self.grammar.weights, f, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _word_features(words: set[str]) -> set[str]:
    return {w for w in words if len(w) > 2} | {w[:k] + "*" for w in words for k in STEMS if len(w) >= k}


def learn_arcs(labelled: DataFrame) -> dict[str, float]:
    """Words and stems that tell toxic documents from others, from (text, toxic).

    A toxic document's word counts once for each distinct clause, so a large
    group of near copies counts like one document. An arc stays if its
    likelihood ratio is beyond what chance makes among so many words.
    """

    def count(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        clean: Counter = Counter()
        for batch in batches:
            out = set()
            for text, toxic in batch:
                lower = (text or "").lower()
                if toxic:
                    for clause in _CLAUSE.split(lower):
                        words = _WORD.findall(clause)
                        mark = hash_of(words)
                        out.update((f, mark, 0) for f in _word_features(set(words)))
                else:
                    clean.update(_word_features(set(_WORD.findall(lower))))
            yield list(out)
            if len(clean) > 400_000:
                yield [(f, None, n) for f, n in clean.items()]
                clean.clear()
        yield [(f, None, n) for f, n in clean.items()]

    n = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return dict(Grammar().arcs)
    rows = map_batches(labelled.select("text", "toxic"), "feature string, mark long, clean long", count)
    sums = rows.groupBy("feature").agg(F.countDistinct("mark").alias("pos"), F.sum("clean").alias("neg"))
    base = pos / (pos + neg)
    odds = F.log((F.col("pos") / (F.col("pos") + F.col("neg"))) / base)
    told = sums.where("pos >= 4").withColumn("told", F.col("pos") * odds)
    kinds = max(1, told.count())
    least = math.log(kinds) + 6
    best = told.where((F.col("told") >= least) & (F.col("neg") <= 0.05 * F.col("pos"))).collect()
    seen = {r["feature"]: r["pos"] for r in best}
    # Where a longer arc reads nearly all that a stem reads, only the longer one stays: a stem must earn its width.
    wide = {f for f in seen if f.endswith("*") and any(g != f and g.startswith(f[:-1]) and n >= 0.9 * seen[f] for g, n in seen.items())}
    arcs = {r["feature"]: math.log((r["pos"] + 0.5) / (r["neg"] + 0.5)) for r in best if r["feature"] not in wide}
    return arcs | {w: max(arcs.get(w, 0.0), START_WEIGHT) for w in INSULTS}


def hash_of(words: list[str]) -> int:
    """A stable 60-bit hash of a clause."""
    h = 1469598103934665603
    for b in " ".join(words).encode():
        h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFF
    return h


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Grammar:
    """Learn arcs and document weights from labelled rows outside the held-out fifth.

    Rows whose crc32(doc_id as text) mod 5 is 0 are never used. Of the others
    about ``most`` are (by a hash of doc_id), so that what comes to the driver
    is bounded: five numbers for each of them.
    """
    usable = labels.where("toxic is not null and doc_id is not null").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, most / max(1, usable.count()))
    usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # One row for each text: copies add nothing to a fit.
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(usable), "doc_id")  # at most about `most` pairs of numbers
    rows = rows.groupBy("text").agg(F.max("toxic").alias("toxic")).select("text", "toxic").persist()
    grammar = Grammar(arcs=learn_arcs(rows))

    def describe(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        scorer = Scorer(grammar)
        for batch in batches:
            yield [(toxic, *scorer.features(text)) for text, toxic in batch]

    got = map_batches(rows.select("text", "toxic"), "toxic int, a double, b double, c double, d double", describe).collect()
    rows.unpersist()
    if len({r["toxic"] for r in got}) == 2:
        x = np.array([[1.0, *r[1:]] for r in got])
        grammar.weights = tuple(logistic(x, np.array([r["toxic"] for r in got], float)))
    return grammar


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the first column is the constant."""
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - y) + penalty @ w)
    return w


def toxicity(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    The score looks at the whole text alone. Null and empty texts, like all texts
    without a match, get the score of no match. Null doc_id: held_out is null.
    Repeated rows are scored one by one; an empty table gives no rows.
    """

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        scorer = Scorer(grammar)
        for batch in batches:
            out = []
            for doc_id, text in batch:
                p = scorer.probability(text)
                out.append((doc_id, p, int(p >= 0.5)))
            yield out

    scored = map_batches(texts(docs), "doc_id long, score double, predicted int", run)
    return scored.select("doc_id", (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0).alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``docs`` without the rows that score as toxic.

    Null and empty texts score as texts without a match and stay; so do all rows
    of an empty or clean table, repeated rows and columns of any name.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(grammar)
        for text in batches:
            yield text.map(lambda t: scorer.probability(None if pd.isna(t) else t)).astype("float64")

    return bounded(docs).where(probability(F.col("text")) < 0.5)
