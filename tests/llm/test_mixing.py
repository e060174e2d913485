"""The Pareto draw against a plain one, and the last exchange of documents."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from partwise.llm import mixing
from partwise.llm.common import digest_unit

ROWS = [(i, s, n, i) for i, (s, n) in enumerate((s, random.Random(i * 7 + len(s or "")).choice([1, 3, 20, 50, 400])) for i in range(150) for s in ("a", "b", None))]
ROWS += [(900, "a", 30_000, 900), (901, "c", 5_000, 901), (902, "c", 10, 902), (903, "c", 10, 903), (903, "c", 10, 904)]


def plain(rows, rest):
    """Chances, ranks and sample of one source."""
    sure: set = set()
    while True:
        left = max(0.0, rest - sum(n for _, _, n, r in rows if r in sure))
        weighted = sum(math.sqrt(n) * n for _, _, n, r in rows if r not in sure)
        factor = left / weighted if weighted else 0.0
        now = {r for _, _, n, r in rows if factor * math.sqrt(n) >= 1} if weighted else sure
        if now == sure:
            break
        sure = now
    chance = {r: min(1.0, factor * math.sqrt(n)) for _, _, n, r in rows}
    unit = lambda d, s, n: (int(hashlib.md5(f"{d}|{'∅' if s is None else s}|{n}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
    rank = {}
    for d, s, n, r in rows:
        u, p = unit(d, s, n), chance[r]
        x = math.inf if p == 1 else u / (1 - u) / (max(p, 1e-12) / (1 - max(p, 1e-12)))
        rank[r] = 0.0 if p == 1 else x / (1 + x)
    order = sorted(rows, key=lambda x: (rank[x[3]], x[0], x[3]))
    return chance, rank, {x[3] for x in order[: round(sum(chance.values()))]}


def test_sample_equals_a_plain_draw(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 40)
    docs = spark.createDataFrame(ROWS, "doc_id long, source string, size long, row long")
    unit = digest_unit(F.col("doc_id").cast("string"), F.coalesce("source", F.lit("∅")), F.col("size").cast("string"))
    rests = {"a": 9_000.0, "b": 4_000.0, None: 100.0, "c": 5_016.0}
    slim = docs.withColumn("u", unit)
    src = spark.createDataFrame([*rests.items()], "source string, rest double")
    ranked = mixing.ranks(slim, mixing.inclusion(slim, src)).withColumn("bucket", F.floor(F.col("rank") * 11))
    got = {r["row"]: r for r in ranked.collect()}
    sample = {r["row"] for r in mixing.pareto_sample(ranked).collect()}
    for s, rest in rests.items():
        own = [x for x in ROWS if x[1] == s]
        chance, rank, want = plain(own, rest)
        assert all(math.isclose(got[r]["chance"], chance[r], rel_tol=1e-9) and math.isclose(got[r]["rank"], rank[r], rel_tol=1e-9, abs_tol=1e-15) for r in chance), s
        assert sample & set(chance) == want, s
        assert math.isclose(sum(chance[r] * n for _, _, n, r in own), min(rest, sum(x[2] for x in own)), rel_tol=1e-9)
    # One document is most of its source: it is certain, and what it leaves is shared by the others.
    assert got[900]["chance"] < 1 and got[901]["chance"] == 1 and 0 < got[902]["chance"] < 1


def test_last_exchanges_shrink_the_gap():
    r = random.Random(2)
    for _ in range(200):
        steps = np.array([r.choice([-1, 1]) * r.choice([1, 2, 7, 40, 300, 2_000]) * r.randint(1, 3) for _ in range(r.randint(0, 40))], float)
        gap = float(r.randint(-500, 500))
        moved = mixing.exchanged(gap, steps)
        left = gap - steps[moved].sum() if moved else gap
        rest = np.delete(steps, moved)
        assert len(set(moved)) == len(moved) and abs(left) <= abs(gap)
        assert len(moved) >= mixing.MOST_EXCHANGES or not len(rest) or np.abs(left - rest).min() >= abs(left)
    assert mixing.exchanged(5.0, np.array([100.0, -95.0, 1.0])) == [0, 1]
