"""Exact Jaccard self-join of word-shingle sets as a metric-space join with pivots.

1. Each document becomes the sorted 64-bit hashes of its shingles; documents
   with equal sets become one node and go on as its representative.
2. A node of n shingles may lack e = floor((1 - t) n) of them in a partner.
   Nodes with more than e shingles that no other node has cannot link and are
   done: first judged by a window of their lowest hashes, packed by hash range,
   then, for those left, by whole sets.
3. The shingles of what is left stand in one order, rare ones first. Two nodes
   that link share one of their first e + 1 in that order. Of the nodes with such
   a shingle the most central (the least share of shingles that no other node
   has) becomes a pivot, and the others meet it: exact distances are computed
   from whole sets, and nodes within r = 1 - t of a pivot are linked through it.
   No nearest pivot is sought: a node belongs to the region of every pivot that
   it meets, so regions overlap where Voronoi regions would meet at boundaries.
4. Regions whose nodes are not in one component go on. Partners x and y in the
   region of p differ in at most E = (1 - t) / (1 + t) (|x| + |y|) shingles. By
   the triangle inequality of the symmetric difference, taken apart into what p
   lacks and what x or y lack of p, they differ in alone(x) + alone(y) +
   | |p - x| - |p - y| | at least. So the region falls into rings by |p - x|,
   each node is replicated to the rings within its window, and only nodes that
   meet in a ring, differ in component and pass this bound (and that of 256-bit
   parity sketches) are compared, by whole sets.
5. Regions join recursively: first the next few pivots from inside, then more in
   each round, with components found again after each, until every node of the
   region has been a pivot or its region is one component.

A dense group is thus a star of members around pivots; copies are rows of one
node, and no group's pairs are listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.llm.common import discard, map_batches, materialize, texts
from partwise.llm.components import components

#: Packed hash ranges hold about so many hashes.
RANGE = 1 << 19
#: Packed rows hold so many hashes at most.
ROW = 1 << 15
#: Up to so many representatives are broadcast (8 bytes each); beyond it the join shuffles.
MOST_BROADCAST = 500_000
#: Up to so many pairs are broadcast (16 bytes each), so that the sets stay where they are.
MOST_PAIRS = 200_000
#: Sets of pivots up to this size (bytes) in all are broadcast.
MOST_PIVOT_BYTES = 8 << 20
#: So many further pivots come from a region in the first round, and so many times more in each later one.
MORE_PIVOTS = 64
#: Shingles or pivots that meet more nodes than this are dealt to several tasks.
HOT = 1_000
#: Rings in the largest distance at which partners can be.
RINGS = 4
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Threshold:
    """Similarity num / den on shingles of ``words`` words."""

    words: int = 4
    num: int = 85
    den: int = 100

    def misses(self, n: int) -> int:
        """Shingles that a set of n may lack in a partner."""
        return (self.den - self.num) * n // self.den

    def own(self, n: int) -> int:
        """Lowest hashes in which a node looks for evidence and partners."""
        e = self.misses(n)
        return min(n, e + 1 + e // 2)

    def window(self, n: int) -> int:
        """Lowest hashes among which a node has whatever its partners look for: a partner has at most n den/num shingles, and n lacks at most misses(n) of its own."""
        e = (self.den - self.num) * n // self.num
        return min(n, e + 1 + e // 2 + self.misses(n))

    def linked(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words make one shingle, none make none. A-Z count as a-z."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _ODD + ids[i : i + len(h)]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32)))


def node_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _spans(v: np.ndarray, most: int | None = None) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values; longer runs than ``most`` come in pieces."""
    if not len(v):
        return []
    edges = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))).tolist()
    spans = zip(edges, [*edges[1:], len(v)], strict=True)
    return list(spans) if most is None else [(k, min(k + most, b)) for a, b in spans for k in range(a, b, most)]


def sizes(docs: DataFrame, t: Threshold) -> DataFrame:
    """(doc_id, n, node) for each document."""

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            sets = [(i, shingles(text, t.words)) for i, text in batch]
            yield [(i, len(s), node_of(s)) for i, s in sets]

    return map_batches(texts(docs), "doc_id long, n long, node long", run)


_PACKED = "bucket int, kind int, win int, keys binary, nodes binary, counts binary"


def _pack(docs: DataFrame, t: Threshold, bits: int) -> DataFrame:
    """Window hashes by range. Kind 0: hashes that one node of the batch has; 1: how many of its own hashes each node shares inside the batch; 2: those hashes, once."""

    def rows(sets: dict[int, np.ndarray]) -> Iterator[tuple]:
        parts = [(s[: t.window(len(s))], t.own(len(s)), node) for node, s in sets.items() if len(s)]
        if not parts:
            return
        keys = (np.concatenate([p[0] for p in parts]) * _ODD) >> np.uint64(32 - bits)
        lengths = np.array([len(p[0]) for p in parts])
        ids = np.array([p[2] for p in parts], np.int64)
        at = np.repeat(np.arange(len(parts)), lengths)
        win = np.arange(len(keys)) - np.repeat(lengths.cumsum() - lengths, lengths) < np.array([p[1] for p in parts])[at]
        order = np.argsort(keys, kind="stable")
        keys, at, win = keys[order], at[order], win[order]
        run = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        count = np.diff(np.append(run, len(keys)))
        each = np.repeat(count, count)

        def split(kind: int, w: int, k: np.ndarray, n: np.ndarray | None) -> Iterator[tuple]:
            bucket = (k >> np.uint64(32)).astype(np.int64)
            low = k.astype(np.uint32)
            for a, b in _spans(bucket, ROW):
                yield int(bucket[a]), kind, w, low[a:b].tobytes(), (n[a:b].tobytes() if n is not None else b""), b""

        for w in (0, 1):
            mine = (each == 1) & (win == bool(w))
            yield from split(0, w, keys[mine], ids[at[mine]])
        shared = np.bincount(at[(each > 1) & win], minlength=len(parts))
        some = np.flatnonzero(shared)
        if len(some):
            yield int(ids[some[0]] % (1 << bits)), 1, 1, b"", ids[some].tobytes(), shared[some].astype(np.int32).tobytes()
        yield from split(2, 0, keys[run[count > 1]], None)

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            sets: dict[int, np.ndarray] = {}
            for _, text in batch:
                s = shingles(text, t.words)
                sets.setdefault(node_of(s), s)
            yield list(rows(sets))

    return map_batches(texts(docs), _PACKED, run)


def _joined(values: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind)


def _by_part(node: np.ndarray, parts: int, columns: dict[str, np.ndarray]) -> pd.DataFrame:
    """The arrays cut into one row for each part that the nodes fall into."""
    part = (node % parts).astype(np.int32)
    order = np.argsort(part, kind="stable")
    spans = _spans(part[order], ROW)
    cut = {name: v[order] for name, v in {"nodes": node, **columns}.items()}
    return pd.DataFrame({"part": [part[order[a]] for a, _ in spans]} | {name: [v[a:b].tobytes() for a, b in spans] for name, v in cut.items()})


def _candidates(docs: DataFrame, known: DataFrame, t: Threshold) -> DataFrame:
    """(node, n, rep) of ``known`` that share enough of their lowest hashes with other nodes.

    Hashes that several nodes of one batch share count once for each batch that
    has a copy of the node: too high at most, never too low.
    """
    e = F.floor(F.col("n") * (t.den - t.num) / t.num)
    total = known.agg(F.sum(F.least(F.col("n"), e + F.floor(e / 2) + 1 + F.floor(F.col("n") * (t.den - t.num) / t.den)))).first()[0] or 0
    bits = max(3, int(total // RANGE).bit_length())
    parts = 1 << bits

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        one, told, many = (pdf[pdf.kind == k] for k in (0, 1, 2))
        low, nodes = _joined(one["keys"], np.uint32), _joined(one.nodes, np.int64)
        wins = np.repeat(one.win.to_numpy(np.uint8), [len(k) // 4 for k in one["keys"]])
        order = np.lexsort((nodes, low))
        low, nodes, wins = low[order], nodes[order], wins[order]
        new = np.concatenate(([True], (low[1:] != low[:-1]) | (nodes[1:] != nodes[:-1]))) if len(low) else np.zeros(0, bool)
        low, nodes, wins = low[new], nodes[new], wins[new]
        uniq, inverse, count = np.unique(low, return_inverse=True, return_counts=True)
        found = ((count > 1) | np.isin(uniq, _joined(many["keys"], np.uint32)))[inverse] & (wins == 1)
        node, at = np.unique(np.concatenate((nodes[found], _joined(told.nodes, np.int64))), return_inverse=True)
        sums = np.bincount(at, np.concatenate((np.ones(found.sum()), _joined(told["counts"], np.int32))), len(node)).astype(np.int32)
        return _by_part(node, parts, {"counts": sums})

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        node, at = np.unique(_joined(pdf.nodes, np.int64), return_inverse=True)
        return pd.DataFrame({"node": node, "found": np.bincount(at, _joined(pdf["counts"], np.int32), len(node)).astype(np.int64)})

    dealt = _pack(docs, t, bits).groupBy("bucket").applyInPandas(find, "part int, nodes binary, counts binary")
    found = dealt.groupBy("part").applyInPandas(gather, "node long, found long")
    misses = F.floor(F.col("n") * (t.den - t.num) / t.den)
    own = F.least(F.col("n"), misses + 1 + F.floor(misses / 2))
    return known.join(found, "node").where(F.col("found") >= own - misses).select("node", "n", "rep")


def _sets(docs: DataFrame, wanted: DataFrame, t: Threshold) -> DataFrame:
    """(node, n, shingles, s0 to s3) of the wanted nodes (node, rep); the four numbers are parities of 256 hash classes."""
    # Groups without any doc_id have the rep null: all texts without one are read for them.
    ids = wanted.select("rep").distinct()
    if wanted.count() <= MOST_BROADCAST:
        ids = F.broadcast(ids)

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            out = []
            for _, text in batch:
                s = shingles(text, t.words)
                odd = np.packbits((np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256) & 1).astype(np.uint8))
                out.append((node_of(s), len(s), s.tobytes(), *odd.view(np.int64).tolist()))
            yield out

    rows = map_batches(texts(docs).join(ids, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi"), "node long, n long, shingles binary, s0 long, s1 long, s2 long, s3 long", run)
    own = wanted.select("node")
    own = F.broadcast(own) if wanted.count() <= MOST_BROADCAST else own
    return materialize(rows.join(own, "node", "left_semi").dropDuplicates(["node"]), "zstd")


def _rare_first(sets: DataFrame) -> DataFrame:
    """(node, keys): the hashes of each node that other nodes have too, rare ones first (ties by hash)."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    bits = max(3, int(total // RANGE).bit_length())
    parts = 1 << bits

    def pack(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            out, held, size = [], [], 0
            for k, (node, raw) in enumerate(batch):
                held.append((node, np.frombuffer(raw, np.uint64)))
                size += len(raw) // 8
                if size > 4 * RANGE or k == len(batch) - 1:
                    keys = (np.concatenate([s for _, s in held]) * _ODD) >> np.uint64(32 - bits)
                    nodes = np.repeat(np.array([n for n, _ in held], np.int64), [len(s) for _, s in held])
                    order = np.argsort(keys, kind="stable")
                    keys, nodes = keys[order], nodes[order]
                    bucket, low = (keys >> np.uint64(32)).astype(np.int64), keys.astype(np.uint32)
                    out += [(int(bucket[a]), low[a:b].tobytes(), nodes[a:b].tobytes()) for a, b in _spans(bucket, ROW)]
                    held, size = [], 0
            yield out

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        low, nodes = _joined(pdf["keys"], np.uint32), _joined(pdf.nodes, np.int64)
        _, inverse, count = np.unique(low, return_inverse=True, return_counts=True)
        each = count[inverse]
        keys = low[each > 1].astype(np.uint64) | np.uint64(pdf.bucket.iloc[0]) << np.uint64(32)
        return _by_part(nodes[each > 1], parts, {"keys": keys, "counts": each[each > 1].astype(np.uint32)})

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, nodes, counts = _joined(pdf["keys"], np.uint64), _joined(pdf.nodes, np.int64), _joined(pdf["counts"], np.uint32)
        order = np.lexsort((keys, counts, nodes))
        keys, nodes = keys[order], nodes[order]
        spans = _spans(nodes)
        return pd.DataFrame({"node": [nodes[a] for a, _ in spans], "keys": [keys[a:b].tobytes() for a, b in spans]})

    packed = map_batches(sets.select("node", "shingles"), "bucket int, keys binary, nodes binary", pack)
    return packed.groupBy("bucket").applyInPandas(find, "part int, nodes binary, keys binary, counts binary").groupBy("part").applyInPandas(gather, "node long, keys binary")


def _prefixes(ranked: DataFrame, t: Threshold) -> DataFrame:
    """(key, node, alone): the first e + 1 hashes of each node that can have a partner; ``alone`` counts the hashes that no other node has."""

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            out = []
            for node, n, raw in batch:
                alone, e = n - len(raw) // 8, t.misses(n)
                if alone <= e:
                    out += [(k, node, alone) for k in np.frombuffer(raw, np.int64)[: e + 1 - alone].tolist()]
                if len(out) > 200_000:
                    yield out
                    out = []
            yield out

    return map_batches(ranked.select("node", "n", "keys"), "key long, node long, alone long", run)


def _met(prefixes: DataFrame, n: DataFrame) -> DataFrame:
    """(node, pivot, n, alone): the pivots that each node meets, itself left out. Shingles that very many nodes have come by broadcast, not in one task."""
    rows = materialize(prefixes.join(n, "node"))
    hot = max(HOT, rows.count() // 50_000)
    share = F.floor(F.col("alone") * 100 / F.col("n"))
    pivots = rows.groupBy("key").agg(F.min(F.struct(share, "node")).alias("p"), F.count("*").alias("m")).where("m > 1").select("key", F.col("p.node").alias("pivot"), "m")
    pivots = materialize(pivots)
    common = F.broadcast(pivots.where(F.col("m") > hot).select("key", "pivot"))
    few = rows.join(common, "key", "left_anti").join(pivots.where(F.col("m") <= hot).select("key", "pivot"), "key")
    met = rows.join(common, "key").select(*few.columns).unionByName(few).where("node <> pivot")
    out = materialize(met.select("node", "pivot", "n", "alone").distinct())
    discard(rows, pivots)
    return out


def _common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common): how many shingles nodes share, from their whole sets."""

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            yield [(a, b, len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))) for a, b, x, y in batch]

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    pairs = pairs.select("a", "b")
    if pairs.count() <= MOST_PAIRS:
        right = right.join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi")
        own = F.broadcast(pairs)
    else:
        right = right.join(pairs.select("b").distinct(), "b", "left_semi")
        own = pairs
    both = left.join(own, "a")
    bytes_ = right.agg(F.sum(F.octet_length("y") + 32)).first()[0] or 0
    if bytes_ <= MOST_PIVOT_BYTES:
        both = both.join(F.broadcast(right), "b")
    else:
        # A node with very many partners is copied to several tasks.
        deal = pairs.groupBy("b").agg((F.floor(F.count("*") / HOT) + 1).cast("int").alias("deal"))
        right = right.join(deal, "b").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("deal") - 1))).drop("deal")
        salted = pairs.join(deal, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("deal")).cast("int").alias("salt"))
        salted = F.broadcast(salted) if pairs.count() <= MOST_PAIRS else salted
        both = left.join(salted, "a").join(right, ["b", "salt"])
    return map_batches(both.select("a", "b", "x", "y"), "a long, b long, common long", run)


def _unlinked(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (pivot, node, ...) with their component so far and the region's size, without regions whose nodes are in one component."""
    own = rows.drop("component", "size").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    cells = own.groupBy("pivot").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"))
    return own.join(cells.where("lo <> hi").select("pivot", "size"), "pivot")


def _met_in_rings(left: DataFrame, t: Threshold) -> DataFrame:
    """Pairs (a, b) of a node and a further pivot (turn up to ``next``) of the same region that may link: see step 4.

    ``lack`` is what a node lacks of the region's pivot.
    """
    most = F.floor(F.col("n") * (t.den - t.num) / t.num)  # differing shingles in the largest partner
    reach = F.greatest(most - F.col("alone"), F.lit(0))
    width = F.greatest(F.floor(F.col("n_pivot") * (t.den - t.num) / (t.num * RINGS)), F.lit(1))
    names = ("node", "n", "alone", "lack", "turn", "component", "s0", "s1", "s2", "s3")
    ringed = left.withColumn("width", width).withColumn("ring", F.floor(F.col("lack") / F.col("width")))
    x = ringed.select("pivot", "ring", *[F.col(c).alias(f"{c}_x") for c in names])
    lo, hi = F.floor(F.greatest(F.col("lack") - reach, F.lit(0)) / F.col("width")), F.floor((F.col("lack") + reach) / F.col("width"))
    q = ringed.where("turn <= next").select("pivot", F.explode(F.sequence(lo, hi)).alias("ring"), *names)
    most_apart = (F.col("n") + F.col("n_x")) * (t.den - t.num)  # over den + num
    sketch = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"s{i}_x"))) for i in range(4)), F.lit(0))
    met = x.join(q, ["pivot", "ring"]).where(
        ((F.col("turn_x") > F.col("turn")) | ((F.col("turn_x") == F.col("turn")) & (F.col("node_x") > F.col("node"))))
        & (F.col("component_x") != F.col("component"))
        & ((F.col("alone") + F.col("alone_x") + F.abs(F.col("lack") - F.col("lack_x"))) * (t.den + t.num) <= most_apart)
        & (F.greatest(F.abs(F.col("n") - F.col("n_x")).cast("long"), sketch.cast("long")) * (t.den + t.num) <= most_apart)
    )
    return met.select(F.least("node", "node_x").alias("a"), F.greatest("node", "node_x").alias("b")).distinct()


def links(docs: DataFrame, t: Threshold, known: DataFrame) -> DataFrame | None:
    """Links (a, b) between nodes that join the same nodes as all links do; None if there are none.

    ``known`` has (node, n, rep).
    """
    wanted = materialize(_candidates(docs, known, t))
    sets = _sets(docs, wanted, t)
    size = wanted.select("node", "n")
    met = _met(_prefixes(_rare_first(sets).join(size, "node"), t), size)
    if met.isEmpty():
        return None
    near = materialize(_common(met.select(F.col("node").alias("a"), F.col("pivot").alias("b")), sets))
    size_of = lambda c, name: size.select(F.col("node").alias(c), F.col("n").alias(name))
    sketches = sets.select("node", "s0", "s1", "s2", "s3")
    at = near.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "common")
    rows = met.join(at, ["node", "pivot"]).join(size_of("pivot", "n_pivot"), "pivot").join(sketches, "node").withColumn("lack", F.col("n_pivot") - F.col("common"))
    linked = lambda a, b: F.col("common") * t.den >= (F.col(a) + F.col(b) - F.col("common")) * t.num
    # Further pivots come in the order of a hash: "turn" in [0, 1), of which "until" has been used up.
    turn = F.pmod(F.xxhash64("node"), F.lit(1 << 40)) / float(1 << 40)
    rows = materialize(rows.withColumn("turn", turn).withColumn("until", F.lit(0.0)))
    found = materialize(rows.where(linked("n", "n_pivot")).select(F.col("node").alias("a"), F.col("pivot").alias("b")))
    discard(met, near)
    pivots_each = MORE_PIVOTS
    while True:
        comps = materialize(components(found))
        left = _unlinked(rows, comps)
        left = materialize(left.withColumn("next", F.col("until") + (1 - F.col("until")) * pivots_each / F.col("size")))
        discard(rows, comps)
        if left.isEmpty():
            discard(sets, wanted, left)
            return found
        pairs = materialize(_met_in_rings(left, t))
        both = _common(pairs, sets).join(size_of("a", "n_a"), "a").join(size_of("b", "n_b"), "b")
        more = materialize(both.where(linked("n_a", "n_b")).select("a", "b"))
        found = found.union(more)
        rows = materialize(left.where("turn > next").withColumn("until", F.col("next")).drop("next"))
        discard(pairs, left)
        pivots_each *= MORE_PIVOTS


def jaccard_components(docs: DataFrame, t: Threshold = Threshold()) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_copies): components of documents linked at the threshold.

    ``component_id`` is the smallest doc_id reachable; ``n_copies`` counts rows
    with an equal set. Null and empty texts, and texts of white space alone,
    have no shingles and stand alone. Repeated rows are copies. Ties do not
    matter: sizes are compared as whole numbers. An empty table gives no rows.
    Sets are told apart by 64-bit digests together with their size.
    """
    members = materialize(sizes(docs, t))
    known = members.where("n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"))
    known = materialize(known)
    found = links(docs, t, known.drop("n_copies"))
    nodes = known
    if found is None:
        nodes = nodes.withColumn("component_id", F.col("rep"))
    else:
        nodes = nodes.join(components(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = nodes.groupBy("component").agg(F.min("rep").alias("component_id"))
        nodes = nodes.join(least, "component")
    out = members.join(nodes.select("node", "n", "component_id", "n_copies"), ["node", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def one_of_each(docs: DataFrame, t: Threshold = Threshold(5, 80, 100)) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id, null last. Rows without shingles stay, but of those that share a doc_id and text one stays.

    Rows are told apart by numbers of their own: doc_id may be null or repeated.
    """
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()))
    slim = numbered.select(F.col("__row").alias("doc_id"), "text")
    found = jaccard_components(slim, t).select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__component"), F.col("n_shingles").alias("__n"))
    rows = numbered.select("__row", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.col("text").isNull().alias("none")).join(found, "__row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row")).alias("first")
    whole = rows.where("__n > 0").groupBy("__component").agg(first).select("first.__row")
    bare = rows.where("__n = 0 and doc_id is not null").groupBy("doc_id", "digest", "none").agg(F.min("__row").alias("__row")).select("__row")
    nameless = rows.where("__n = 0 and doc_id is null").select("__row")
    return numbered.join(whole.union(bare).union(nameless), "__row", "left_semi").select(*docs.columns)
