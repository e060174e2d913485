"""Periodic runs against plain loops over all periods."""

import hashlib
import random
import zlib

from partwise.llm import periodic

DOCS = "doc_id long, text string"
NONE = hashlib.sha256(b"").hexdigest()


def brute(x):
    """Every stretch whose words agree at some distance; a stretch goes to its smallest period."""
    n, out = len(x), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def told(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    digest = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), digest(b" ".join(kept)))


def _texts():
    rng = random.Random(3)
    for k in range(300):
        letters = [*"abcde"][: rng.randint(1, 5)]
        out = []
        while len(out) < rng.randint(0, 80):
            out += [rng.choice(letters) for _ in range(rng.randint(1, 9))] * rng.randint(1, 8)
            if rng.random() < 0.3:
                out += out[-rng.randint(1, 30) :]
        yield k, rng.choice([" ", "\n", " \t\x0b"]).join(out)


def test_runs_equal_brute_force():
    for _, text in _texts():
        x = [ord(w) for w in text.split()]
        assert periodic.runs(x) == brute(x), x
    block = [random.Random(1).randrange(50) for _ in range(37)]
    for x in (block * 9 + [1, 2] * 30 + block[::-1] * 5, [7] * 900, [0, 1] * 400 + [0]):
        assert periodic.runs(x) == brute(x)


def test_hashes_that_clash_are_noticed(monkeypatch):
    monkeypatch.setattr(periodic, "_BASES", (0, periodic._BASES[0]))
    for _, text in _texts():
        x = [ord(w) for w in text.split()]
        assert periodic.runs(x) == brute(x), x


def test_query_rows(spark):
    rows = [*_texts(), (500, None), (501, ""), (502, " \n"), (3, "a b"), (3, "a b"), (600, "é x " * 7), (601, " ".join(map(str, range(30_000))) + " go" * 9)]
    got = periodic.periodic_runs(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((told(*r) for r in rows), key=str)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows) > 10


def test_edges(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], DOCS)).collect() == []
    assert tuple(periodic.periodic_runs(spark.createDataFrame([(None, None)], DOCS)).first()) == (None, 0, None, None, None, None, NONE, NONE)
    extra = spark.createDataFrame([(1, "x " * 8, 5, "y")], f"{DOCS}, start long, period string")
    assert tuple(periodic.periodic_runs(extra).first())[:6] == (1, 1, 0, 8, 1, 8000)
