"""Code lengths against a plain recursion over dictionaries; held-out rows; rows of every kind."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from partwise.llm import languages

DOCS = "doc_id long, text string, lang string"
rng = random.Random(8)
STEMS = {"xx": ["ba", "lo", "ti", "ra", "ne"], "yy": ["sch", "öt", "ung", "ver", "ein"], "zz": ["ko", "ña", "ue", "ción", "ar"]}


def _text(lang, words):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words))


ROWS = [(i, _text(lang, rng.choice([8, 20, 60])), lang) for i, lang in enumerate(rng.choices([*STEMS], k=300))]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


class Plain:
    """Counts of one language by context, and chances by recursion."""

    def __init__(self, texts, share):
        self.counts = [Counter() for _ in range(languages.ORDER + 1)]
        for t in texts:
            raw = b"    " + t.encode()
            for i in range(4, len(raw)):
                for k in range(languages.ORDER + 1):
                    self.counts[k][raw[i - k : i + 1]] += 1
        total = sum(self.counts[0].values())
        self.counts = [{g: n for g, n in c.items() if n * share >= total} for c in self.counts]

    def chance(self, context, byte):
        k = len(context)
        kept = {g[-1]: n for g, n in self.counts[k].items() if g[:-1] == context}
        shorter = (lambda b: self.chance(context[1:], b)) if k else (lambda b: 1 / 256)
        if not kept:
            return shorter(byte)
        seen = max(sum(kept.values()), self.counts[k - 1].get(context, 0) if k else 0)
        if byte in kept:
            return kept[byte] / (seen + len(kept))
        escape = (seen - sum(kept.values()) + len(kept)) / (seen + len(kept))
        return escape * shorter(byte) / (1 - sum(shorter(b) for b in kept))

    def bits(self, text):
        raw = b"    " + text.encode()
        return sum(-math.log2(self.chance(raw[i - 4 : i], raw[i])) for i in range(4, len(raw)))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.mark.parametrize("share", [1 << 15, 150])
def test_code_lengths_equal_plain_recursion(docs, monkeypatch, share):
    monkeypatch.setattr(languages, "SHARE", share)
    monkeypatch.setattr(languages, "PIECE", 300)
    model = languages.fit(docs)
    assert model.names == sorted(STEMS)
    texts = ["ba lo", "öt x", "", "q\U0001f642 ción", *[t for _, t, _ in ROWS[:3]]]
    got = model.bits([t.encode() for t in texts])
    for k, lang in enumerate(model.names):
        plain = Plain([t for i, t, name in ROWS if name == lang and not held(i)], share)
        assert np.allclose(got[:, k], [plain.bits(t) for t in texts])
        every = np.array([languages.grams(bytes([b]), b"a lo")[0] for b in range(256)], np.uint64)
        assert math.isclose(np.exp2(-model.trees[k].costs(every)).sum(), 1, abs_tol=1e-9)


def test_held_out_rows_are_told(docs):
    got = {r["doc_id"]: r for r in languages.predicted(docs).collect()}
    out = [i for i, _, _ in ROWS if held(i)]
    assert len(out) > 40 and all(got[i]["held_out"] for i in out) and len(got) == len(ROWS)
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in ROWS if held(i)) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_labels_of_held_out_rows_change_nothing(spark, docs):
    other = spark.createDataFrame([(i, t, "new" if held(i) else lang) for i, t, lang in ROWS], DOCS)
    rows = lambda d: sorted(map(tuple, languages.predicted(d).collect()))
    assert rows(docs) == rows(other)


def test_edges(spark):
    rows = [(1, _text("xx", 50), "xx"), (2, _text("yy", 50), "yy"), (3, _text("xx", 9), None), (4, None, "xx"), (5, "", "xx"), (6, "12 34 -- ²", "yy"), (None, _text("yy", 30), "yy")]
    rows += [(7, _text("xx", 60_000), "xx"), (2, _text("yy", 50), "yy")]
    got = languages.predicted(spark.createDataFrame([(*r, "c", 1.0) for r in rows], f"{DOCS}, gram string, score double")).collect()
    told = {(r["doc_id"], r["lang_pred"]) for r in got}
    assert len(got) == len(rows) and {(3, "xx"), (4, "und"), (5, "und"), (6, "und"), (None, "yy"), (7, "xx"), (2, "yy")} <= told
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [True]
    assert languages.predicted(spark.createDataFrame([], DOCS)).collect() == []
    alone = languages.predicted(spark.createDataFrame([(1, "words", None)], DOCS)).first()
    assert tuple(alone) == (1, held(1), "und", 0.0)
