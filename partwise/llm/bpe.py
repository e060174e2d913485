"""Byte-pair encoding and decoding with a pair occurrence index over a partition's distinct words."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from partwise.llm.common import map_batches, texts

#: Texts are gathered up to this many characters, then encoded together; bounds a task's memory (measured: 95 MB, and 310 MB for six times as many).
GATHER = 4 << 20
NONE = np.int32(1 << 30)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> list[str]:
    """The vocabulary writes byte b as this character: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else more))
        more += b not in plain
    return out


class Vocabulary:
    """Merges by rank, as arrays; the words' pattern; the special tokens."""

    def __init__(self, path: str | None = None):
        import regex

        with open(path or vocabulary_path(), encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        chars = _byte_chars()
        back = {c: b for b, c in enumerate(chars)}
        self.byte_ids = np.array([ids[c] for c in chars], np.int32)
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        keys = self.left << 20 | self.right
        self.by_key = np.argsort(keys)
        self.keys = keys[self.by_key]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in ids.items() if all(c in back for c in s)}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        # One ascending pass is right if every merge comes after the merges of its parts.
        rank = {int(m): r for r, m in enumerate(self.made)}
        if any(max(rank.get(int(a), -1), rank.get(int(b), -1)) >= r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True))):
            raise ValueError("merges are not in the order of their parts")

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where there is no merge."""
        want = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.by_key[at], NONE).astype(np.int32)


def encode_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after another, number of ids of each word).

    All words lie in one array of symbols, linked to their neighbours in the
    word. The index maps each pair, by its rank, to its positions; active ranks
    are applied in ascending order, each to all its positions at once, and the
    pairs that change are entered under their new ranks, which are always
    higher than the one applied.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    sym = v.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    n = len(sym)
    ends = lengths.cumsum()
    nxt = np.arange(1, n + 1, dtype=np.int32)
    nxt[ends - 1] = -1
    prv = np.arange(-1, n - 1, dtype=np.int32)
    prv[ends - lengths] = -1
    index: dict[int, list[np.ndarray]] = {}

    def enter(at: np.ndarray) -> None:
        """Put the pairs that start at these positions into the index."""
        r = v.ranks(sym[at], sym[nxt[at]])
        keep = r != NONE
        at, r = at[keep], r[keep]
        if len(at):
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            edges = np.flatnonzero(r[1:] != r[:-1]) + 1
            for one, of in zip(np.split(at, edges), r[np.concatenate(([0], edges))].tolist(), strict=True):
                index.setdefault(of, []).append(one)

    enter(np.flatnonzero(nxt >= 0).astype(np.int32))
    for rank in range(len(v.made)):
        lists = index.pop(rank, None)
        if lists is None:
            continue
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b = v.left[rank], v.right[rank]
        at = at[(sym[at] == a) & (nxt[at] >= 0)]
        at = at[sym[nxt[at]] == b]
        if a == b and len(at) > 1:
            at = np.sort(at)
            free, last = [], -1
            for i in at.tolist():
                if i != last:
                    free.append(i)
                    last = nxt[i]
            at = np.array(free, np.int32)
        if not len(at):
            continue
        gone = nxt[at]
        after = nxt[gone]
        sym[at] = v.made[rank]
        sym[gone] = -1
        nxt[at] = after
        follows = after >= 0
        prv[after[follows]] = at[follows]
        before = prv[at]
        enter(np.concatenate((before[before >= 0], at[nxt[at] >= 0])))
    alive = sym >= 0
    counts = np.add.reduceat(alive, ends - lengths).astype(np.int64) if n else np.zeros(0, np.int64)
    return sym[alive], counts


def encode_texts(batch: list[str], v: Vocabulary) -> list[np.ndarray]:
    """Ids of whole texts; special tokens' strings become their ids, as the library does by default."""
    seen: dict = {}
    number = seen.setdefault
    per_text = []
    for text in batch:
        words: list[int] = []
        for k, part in enumerate(v.cut(text)):
            if k % 2:
                words.append(number((part,), len(seen)))
            elif part:
                words += [number(w, len(seen)) for w in v.words(part)]
        per_text.append(np.array(words, np.int64))
    plain = [w for w in seen if isinstance(w, str)]
    ids, counts = encode_words([w.encode() for w in plain], v)
    if len(plain) < len(seen):  # special tokens take their place among the words
        size = np.ones(len(seen), np.int64)
        own = np.fromiter((isinstance(w, str) for w in seen), bool, len(seen))
        size[own] = counts
        all_ids = np.empty(size.sum(), np.int32)
        spread = np.repeat(own, size)
        all_ids[spread] = ids
        all_ids[~spread] = [v.special[w[0]] for w in seen if not isinstance(w, str)]
        ids, counts = all_ids, size
    starts = counts.cumsum() - counts
    out = []
    for words in per_text:
        size = counts[words]
        out.append(ids[np.repeat(starts[words] - (size.cumsum() - size), size) + np.arange(size.sum())])
    return out


def decode_ids(ids: list[int], v: Vocabulary) -> str:
    """Text of a list of ids; bytes that are no UTF-8 become U+FFFD, ids outside the vocabulary are left out."""
    get = v.bytes_of.get
    return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")


def _gathered(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
    group, size = [], 0
    for batch in batches:
        for row in batch:
            group.append((row[0], row[1] or ""))
            size += len(group[-1][1])
            if size >= GATHER:
                yield group
                group, size = [], 0
    if group:
        yield group


_LOADED: dict[str | None, Vocabulary] = {}


def _load(path: str | None) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) of each whole text. Null and empty texts have no ids. ``path`` must exist on the executors; None is the public one."""

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        v = _load(path)
        for group in _gathered(batches):
            coded = encode_texts([t for _, t in group], v)
            for k in range(0, len(group), 256):
                yield [(i, len(ids), ids) for (i, _), ids in zip(group[k : k + 256], coded[k : k + 256], strict=True)]

    return map_batches(texts(docs), "doc_id long, n_tokens long, ids array<int>", run)


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        v = _load(path)
        for batch in batches:
            yield [(i, decode_ids(ids or [], v)) for i, ids in batch]

    return map_batches(coded.select("doc_id", "ids"), "doc_id long, text string", run)


def bpe_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and decoded again from its ids."""

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        v = _load(path)
        for group in _gathered(batches):
            coded = encode_texts([t for _, t in group], v)
            yield [
                (i, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decode_ids(ids.tolist(), v).encode()).hexdigest())
                for (i, _), ids in zip(group, coded, strict=True)
            ]

    return map_batches(texts(docs), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", run)
