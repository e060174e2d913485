"""The prefix trie against plain loops: shared starts, blocks of long conversations, nulls, repeated rows."""

import hashlib
import random
import zlib

from partwise.llm import prefix_trie

ROWS = "conv_id long, turn long, role string, text string"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = own.get(c - c % 100, [])[:h] + v[h:]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append((c, d == len(whole)))
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        ended = ",".join(str(c) for c in sorted(c for c, e in m if e))
        out.append((
            min(m)[0], len(k), min(members[k[:-1]])[0] if k else None, len(m), len(children.get(k, [])), sum(x not in children for x in below),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(ended.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def told(spark, rows, schema=ROWS):
    out = prefix_trie.trie(spark.createDataFrame(rows, schema))
    assert out.schema.simpleString() == spark.createDataFrame([], NODE).schema.simpleString()
    return sorted(map(tuple, out.collect()), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "bé", "", None, "🙂c"])) for c in [*range(90, 130), 200, 215, 1000007, -3] for t in range(rng.randint(1, 9))]
    rows += [(c, t, "user", "same") for c in range(300, 340) for t in range(3)]
    rows += [(207, None, "user", "first"), (207, 5, "user", "x"), (207, 5, "user", "x"), (None, 0, "user", "nobody")]
    assert told(spark, rows) == brute(rows)


def test_long_conversations_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    rows = [(c, t, "u", "ab" * (t % 3) if t < cut else str(c)) for c, n, cut in [(100, 30, 30), (101, 30, 17), (102, 30, 9), (103, 3, 3), (104, 31, 30), (17, 9, 9)] for t in range(n)]
    assert told(spark, rows) == brute(rows)


def test_edges(spark):
    assert told(spark, []) == []
    assert told(spark, [(None, 1, "u", "x")]) == []
    # Conversation 1's own turns all come before its share of an absent first one: it has no turn left and ends at the root.
    assert zlib.crc32(b"1") % 6 > 1 and told(spark, [(1, 0, "u", "x")]) == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
    long = [(100, 0, "u", "y" * 3_000_000), (100, 1, "u", "z"), (200, 0, "u", "y" * 3_000_000)]
    assert told(spark, long) == brute(long)
    extra = [(100, 0, "u", "x", 7, "k", 1.5), (100, 1, "v", "y", 8, None, 2.5)]
    assert told(spark, extra, f"{ROWS}, block long, depth string, n double") == brute([r[:4] for r in extra])
