"""Suffix-array dedup: remove every byte covered by a 200-byte string that starts anywhere else too.

The sort works on a cover of sampled positions, like a difference cover: any
two equal 200-byte strings hold a sampled position at the same place. Here the
cover depends on content (the least hash among the 100-byte grams that start in
the first half of a string), so one shift is enough where a cover by residues
needs many, and a fiftieth of all positions is sampled.

1. Sampled grams are named by hash, sorted by name in packed ranges, and names
   that stand once are left out: no string with such a gram can repeat.
2. The other suffixes are merged in at their sampled position: each sampled
   occurrence brings the block of strings whose cover position it is. Blocks that
   stand more than once (inside repeated passages) are told by a digest.
3. Where a name has different blocks (at the ends of passages), one occurrence of
   each brings its bytes, dealt by the name and 50 more bytes (those after the
   gram for strings that start near it, those before it for the others), so that
   a popular gram is split by its contexts. Strings of one name, place and hash
   stand next to each other after the sort; neighbours are compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.llm.common import discard, map_batches, materialize, texts

LENGTH = 200
GRAM = 100
#: A string's cover position lies among so many grams.
SPAN = LENGTH - GRAM + 1
#: Bytes of context by which the strings of a gram are dealt.
HALF = 50
#: Packed ranges hold about so many sampled grams, packed rows so many at most.
RANGE, ROW = 1 << 19, 1 << 15
#: Bytes of strings that are sorted together.
SORTED = 4 << 20
#: Up to so many document numbers are broadcast (8 bytes each) to leave the other texts where they are.
MOST_IDS = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(raw: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from each position, by doubling."""
    h, power, size = raw.astype(np.uint64) + np.uint64(1), int(_ODD), 1
    out, done = None, 0
    while True:
        if length & size:
            if out is None:
                out = h
            else:
                n = len(raw) - done - size + 1
                out = out[:n] * np.uint64(power) + h[done : done + n]
            done += size
        if done == length:
            break
        h = h[:-size] * np.uint64(power) + h[size:]
        power, size = power * power % (1 << 64), size * 2
    out = out ^ (out >> np.uint64(31))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _sliding(v: np.ndarray, width: int, of) -> np.ndarray:
    """``of`` (minimum or maximum) over each ``width`` values."""
    out, size = v, 1
    while size * 2 <= width:
        out = of(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return of(out[: len(v) - width + 1], out[rest : rest + len(v) - width + 1]) if rest else out


def cover(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all grams, for each start of a 200-byte string the place of its cover position)."""
    h = window_hashes(raw, GRAM)
    least = _sliding(h, SPAN, np.minimum)
    # The leftmost gram with the least hash: the next place at or after the start where that hash stands.
    n = len(least)
    at = np.arange(len(h), dtype=np.int64)
    places = np.flatnonzero(_is_least(h, least))
    nxt = np.searchsorted(places, at[:n])
    found = places[nxt]
    bad = h[found] != least
    while bad.any():
        nxt[bad] += 1
        found[bad] = places[nxt[bad]]
        bad[bad] = h[found[bad]] != least[bad]
    return h, found


def _is_least(h: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Grams that are the least of some window."""
    edge = np.zeros(SPAN - 1, np.uint64)
    most = _sliding(np.concatenate((edge, least, edge)), SPAN, np.maximum)
    return most == h


def node_of(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def members(docs: DataFrame) -> DataFrame:
    """(doc_id, n, node): byte length and digest of each text."""

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            raws = [(i, (t or "").encode()) for i, t in batch]
            yield [(i, len(raw), node_of(raw)) for i, raw in raws]

    return map_batches(texts(docs), "doc_id long, n long, node long", run)


def _spans(v: np.ndarray, most: int = ROW) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values, in pieces of ``most``."""
    if not len(v):
        return []
    edges = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))).tolist()
    return [(k, min(k + most, b)) for a, b in zip(edges, [*edges[1:], len(v)], strict=True) for k in range(a, b, most)]


_PACKED = "bucket int, kind int, keys binary, nodes binary, places binary"


def _sample(docs: DataFrame, bits: int) -> DataFrame:
    """Sampled grams by name range. Kind 0: names that stand once in the batch; 1: places whose names are known to repeat; 2: those names, once."""

    def rows(keys: list, nodes: list, places: list) -> Iterator[tuple]:
        key = np.concatenate(keys) >> np.uint64(32 - bits)
        node, place = np.concatenate(nodes), np.concatenate(places)
        order = np.argsort(key, kind="stable")
        key, node, place = key[order], node[order], place[order]
        run = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(run, len(key)))
        once = np.repeat(count, count) == 1
        for kind, keep in ((0, once), (2, np.isin(np.arange(len(key)), run[count > 1]))):
            k, n, p = key[keep], node[keep], place[keep]
            for a, b in _spans((k >> np.uint64(32)).astype(np.int64)):
                yield int(k[a] >> np.uint64(32)), kind, k[a:b].astype(np.uint32).tobytes(), n[a:b].tobytes() if kind == 0 else b"", p[a:b].tobytes() if kind == 0 else b""
        n, p = node[~once], place[~once]
        for a in range(0, len(n), ROW):
            yield int(n[a] % (1 << bits)), 1, b"", n[a : a + ROW].tobytes(), p[a : a + ROW].tobytes()

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            seen: set[int] = set()
            keys, nodes, places = [], [], []
            for _, text in batch:
                raw = (text or "").encode()
                node = node_of(raw)
                if len(raw) >= LENGTH and node not in seen:
                    seen.add(node)
                    h, found = cover(np.frombuffer(raw, np.uint8))
                    at = np.unique(found)
                    keys.append(h[at])
                    nodes.append(np.full(len(at), node, np.int64))
                    places.append(at.astype(np.int32))
            if keys:
                yield list(rows(keys, nodes, places))

    return map_batches(texts(docs), _PACKED, run)


def _repeated_places(packed: DataFrame, parts: int) -> DataFrame:
    """(node, places): sampled places whose name stands at least twice."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        def of(kind: int, column: str, dtype: type) -> np.ndarray:
            return np.frombuffer(b"".join(pdf[column][pdf.kind == kind]), dtype)

        low, node, place = of(0, "keys", np.uint32), of(0, "nodes", np.int64), of(0, "places", np.int32)
        order = np.lexsort((place, node, low))
        low, node, place = low[order], node[order], place[order]
        new = np.concatenate(([True], (low[1:] != low[:-1]) | (node[1:] != node[:-1]) | (place[1:] != place[:-1]))) if len(low) else np.zeros(0, bool)
        low, node, place = low[new], node[new], place[new]
        uniq, inverse, count = np.unique(low, return_inverse=True, return_counts=True)
        keep = ((count > 1) | np.isin(uniq, of(2, "keys", np.uint32)))[inverse]
        node, place = np.concatenate((node[keep], of(1, "nodes", np.int64))), np.concatenate((place[keep], of(1, "places", np.int32)))
        part = (node % parts).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part, node, place = part[order], node[order], place[order]
        spans = _spans(part)
        return pd.DataFrame({"part": [part[a] for a, _ in spans], "nodes": [node[a:b].tobytes() for a, b in spans], "places": [place[a:b].tobytes() for a, b in spans]})

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        node, place = np.frombuffer(b"".join(pdf.nodes), np.int64), np.frombuffer(b"".join(pdf.places), np.int32)
        order = np.lexsort((place, node))
        node, place = node[order], place[order]
        spans = _spans(node, len(node) or 1)
        return pd.DataFrame({"node": [node[a] for a, _ in spans], "places": [np.unique(place[a:b]).tobytes() for a, b in spans]})

    dealt = packed.groupBy("bucket").applyInPandas(find, "part int, nodes binary, places binary")
    return dealt.groupBy("part").applyInPandas(gather, "node long, places binary")


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text, and the columns of ``wanted``) for the documents that ``wanted`` (doc_id, ...) names, each once."""
    if wanted.count() <= MOST_IDS:  # texts that no one asks for stay where they are
        docs = docs.join(F.broadcast(wanted.select("doc_id")), "doc_id", "left_semi")
    return docs.join(wanted, "doc_id")


def _runs_of(text: str, places: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, places, first start, end of starts, names): the starts whose cover position each place is."""
    raw = text.encode()
    h, found = cover(np.frombuffer(raw, np.uint8))
    at = np.frombuffer(places, np.int32)
    # A place's starts are one run: places do not go back as starts go on.
    return raw, at, np.searchsorted(found, at, "left"), np.searchsorted(found, at, "right"), h[at].view(np.int64)


_BLOCKS = "name long, first int, last int, digest binary, n long, node long, place int, nodes binary, places binary"


def _blocks(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sampled places with repeated names: the starts (before the place) that each covers, and a digest of the bytes of all their strings.

    Places of a batch that agree in all this share a row.
    """

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            rows: dict[tuple, list] = {}
            for text, node, places in batch:
                raw, at, begin, end, names = _runs_of(text, places)
                for p, lo, hi, name in zip(at.tolist(), begin.tolist(), end.tolist(), names.tolist(), strict=True):
                    digest = hashlib.blake2b(raw[lo : hi - 1 + LENGTH], digest_size=16).digest()
                    rows.setdefault((name, p - lo, p - hi + 1, digest), []).append((node, p))
            yield [(*key, len(refs), *min(refs), np.array([n for n, _ in refs], np.int64).tobytes(), np.array([p for _, p in refs], np.int32).tobytes()) for key, refs in rows.items()]

    return map_batches(_fetch(docs, wanted).select("text", "node", "places"), _BLOCKS, run)


_STRINGS = "bucket int, first int, last int, bytes binary, node long, place int, alone boolean"


def _strings(docs: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    """The bytes of one place of each block that shares its name with other blocks.

    Starts up to HALF before the place and starts further off come in two rows.
    """

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            out = []
            for text, node, items in batch:
                raw, at, begin, end, names = _runs_of(text, np.array([x["place"] for x in items], np.int32).tobytes())
                single = np.array([x["alone"] for x in items], bool)
                beside = window_hashes(np.frombuffer(raw, np.uint8), HALF)
                middle = np.clip(at - HALF, begin, end)
                for lo, hi, side in ((begin, middle, at - HALF), (middle, end, at + GRAM)):
                    own = lo < hi
                    lo, hi, p = lo[own], hi[own], at[own]
                    bucket = ((names[own].view(np.uint64) * _ODD ^ beside[side[own]]) % np.uint64(buckets)).tolist()
                    for q, a, b, k, x in zip(p.tolist(), lo.tolist(), hi.tolist(), bucket, single[own].tolist(), strict=True):
                        out.append((k, q - a, q - b + 1, raw[a : b - 1 + LENGTH], node, q, x))
            yield out

    return map_batches(_fetch(docs, wanted).select("text", "node", "items"), _STRINGS, run)


def _equal_neighbours(raw: bytes, at: np.ndarray, row: np.ndarray, offset: np.ndarray, h: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which strings equal another one: ``order`` sorts them by offset and hash, and neighbours are compared in runs of starts."""
    mark = np.zeros(len(at), bool)
    k = np.flatnonzero((h[order][1:] == h[order][:-1]) & (offset[order][1:] == offset[order][:-1]))
    if not len(k):
        return mark
    one, two = order[k], order[k + 1]
    turn = np.lexsort((-offset[one], row[two], row[one]))
    one, two = one[turn], two[turn]
    go = (row[one][1:] == row[one][:-1]) & (row[two][1:] == row[two][:-1]) & (offset[one][1:] == offset[one][:-1] - 1)
    edge = np.flatnonzero(np.concatenate(([True], ~go)))
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(one)], strict=True):
        x, y, n = int(at[one[a]]), int(at[two[a]]), b - a - 1 + LENGTH
        if raw[x : x + n] == raw[y : y + n]:
            mark[one[a:b]] = mark[two[a:b]] = True
        else:  # strings of equal hash that differ: all of that hash and offset are told apart by their bytes
            for i in one[a:b].tolist():
                same: dict[bytes, list[int]] = {}
                for j in np.flatnonzero((h == h[i]) & (offset == offset[i])).tolist():
                    same.setdefault(raw[at[j] : at[j] + LENGTH], []).append(j)
                for found in same.values():
                    mark[found] |= len(found) > 1
    return mark


def _marks(pdf: pd.DataFrame) -> pd.DataFrame:
    """(node, start, stop): runs of strings of blocks that stand alone and that another block has too.

    Equal strings have the same name and the same offset to their place: the
    sort brings them together, and neighbours are compared.
    """
    first, last = pdf["first"].to_numpy(np.int64), pdf["last"].to_numpy(np.int64)
    size, lengths = first - last + 1, pdf["bytes"].map(len).to_numpy(np.int64)
    whole = b"".join(pdf["bytes"])
    row = np.repeat(np.arange(len(pdf)), size)
    step = np.arange(size.sum()) - np.repeat(size.cumsum() - size, size)
    at = (lengths.cumsum() - lengths)[row] + step
    h = window_hashes(np.frombuffer(whole, np.uint8), LENGTH)[at]
    offset = first[row] - step
    mark = _equal_neighbours(whole, at, row, offset, h, np.lexsort((h, offset))) & pdf.alone.to_numpy(bool)[row]
    o, r = offset[mark], row[mark]
    edge = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (o[1:] != o[:-1] - 1)))) if len(r) else np.zeros(0, np.int64)
    end = np.append(edge[1:], len(r))[: len(edge)] - 1
    node, place = pdf.node.to_numpy(np.int64)[r[edge]], pdf.place.to_numpy(np.int64)[r[edge]]
    return pd.DataFrame({"node": node, "start": (place - o[edge]).astype(np.int32), "stop": (place - o[end] + LENGTH).astype(np.int32)})


def _whole(rows: DataFrame) -> DataFrame:
    """(node, start, stop) of all places of blocks that stand more than once."""

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            out = []
            for first, last, nodes, places in batch:
                p = np.frombuffer(places, np.int32)
                out += zip(np.frombuffer(nodes, np.int64).tolist(), (p - first).tolist(), (p - last + LENGTH).tolist(), strict=True)
            yield out

    return map_batches(rows.select("first", "last", "nodes", "places"), "node long, start int, stop int", run)


def repeated_spans(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(node, spans): the removed runs of each text, as packed pairs of int32 (start, stop), not yet for whole copies.

    Blocks that stand more than once are told by their digests. Bytes move for
    one place of each block, and only where its name has other blocks too: at
    the ends of repeated passages.
    """
    total = known.agg(F.sum("n")).first()[0] or 0
    bits = max(3, int(total // 50 // RANGE).bit_length())
    places = _repeated_places(_sample(docs, bits), 1 << bits)
    wanted = materialize(places.join(known, "node").select(F.col("rep").alias("doc_id"), "node", "places"))
    rows = materialize(_blocks(docs, wanted))
    key = ["name", "first", "last", "digest"]
    each = materialize(rows.groupBy(*key).agg(F.sum("n").alias("times"), F.min(F.struct("node", "place")).alias("at")))
    several = each.groupBy("name").agg(F.count("*").alias("blocks"), F.count_if(F.col("times") == 1).alias("single")).where("blocks > 1 and single > 0").select("name")
    asked = each.join(several, "name", "left_semi").select("at.node", "at.place", (F.col("times") == 1).alias("alone"))
    packed = asked.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("place", "alone"))).alias("items"))
    again = materialize(packed.join(known, "node").select(F.col("rep").alias("doc_id"), "node", "items"))
    sampled = again.agg(F.sum(F.size("items"))).first()[0] or 0
    buckets = max(16, int(sampled * 2 * (LENGTH + SPAN / 2) / SORTED))
    edges = _strings(docs, again, buckets).groupBy("bucket").applyInPandas(_marks, "node long, start int, stop int")
    runs = _whole(rows.join(each.where("times > 1").select(*key), key, "left_semi")).union(edges)
    out = materialize(runs.groupBy("node").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans")))
    discard(wanted, rows, each, again)
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, kept, spans): what is left of each text as bytes, and the removed runs [start, stop).

    Null and empty texts, and texts under 200 bytes, lose nothing. Texts that
    have a copy of 200 bytes or more go whole. An empty table gives no rows.
    Repeated rows are copies. What is left may end inside a character, as the
    law speaks of bytes.
    """
    # Rows go by numbers of their own: doc_id may be null, or stand for several texts.
    docs = materialize(texts(docs).select(F.col("doc_id").alias("id"), "text").withColumn("doc_id", F.monotonically_increasing_id()), "zstd")
    all_members = materialize(members(docs))
    known = all_members.groupBy("node", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    known = materialize(known)
    spans = repeated_spans(docs, known.where(F.col("n") >= LENGTH))
    per_node = known.join(spans, "node", "left").select("node", "n", F.col("copies").alias("copies"), "spans")
    told = all_members.join(per_node, ["node", "n"]).where((F.col("n") >= LENGTH) & ((F.col("copies") > 1) | F.col("spans").isNotNull()))
    told = told.select("doc_id", F.when(F.col("copies") == 1, F.col("spans")).alias("spans"), F.lit(True).alias("told")).dropDuplicates(["doc_id"])
    told = materialize(told)
    if told.count() <= MOST_IDS:
        ids = F.broadcast(told.select("doc_id"))
        rest = docs.join(ids, "doc_id", "left_anti").withColumns({"spans": F.lit(None).cast(told.schema["spans"].dataType), "told": F.lit(None).cast("boolean")})
        rows = docs.join(ids, "doc_id", "left_semi").join(told, "doc_id").unionByName(rest)
    else:
        rows = docs.join(told, "doc_id", "left")

    def cut(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            out = []
            for doc_id, text, spans, told in batch:
                raw = (text or "").encode()
                if spans is None:
                    runs = [(0, len(raw))] if told else []
                else:
                    runs = []
                    for x in spans:
                        if runs and x["start"] <= runs[-1][1]:
                            runs[-1] = (runs[-1][0], max(runs[-1][1], x["stop"]))
                        else:
                            runs.append((x["start"], x["stop"]))
                edges = [0, *[e for r in runs for e in r], len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc_id, len(raw), kept, [{"start": a, "stop": b} for a, b in runs]))
            yield out

    return map_batches(rows.select("id", "text", "spans", "told"), "doc_id long, n_bytes long, kept binary, spans array<struct<start:int,stop:int>>", cut)


def repeat_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
