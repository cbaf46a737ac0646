"""Byte-level BPE by merge replay over a batch's distinct words.

All distinct words of a batch lie behind one another as byte symbols in one array. An inverted
index holds, for each token pair that has a rank, the positions where it occurs. Ranks are taken
in order; all positions of a pair are merged together and only the pairs with their left and right
neighbours are looked up again and entered into the index. As words don't touch each other, taking
the smallest rank of the whole batch next merges each word as if it were alone. Words are encoded
once; documents are put together from them. Batches are independent, so memory is bounded, nothing
is shuffled and a lost executor costs no more than its own batches.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasswing.llm.common import short_batches
from glasswing.llm.pieces import PieceCache, groups

NONE = np.int64(1 << 40)
#: Largest vocabulary file that is broadcast.
MOST_BYTES = 64 << 20


def read_ranks(path: str) -> bytes:
    """A rank file's bytes, read by the driver; its size is checked, as it is broadcast."""
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} has over {MOST_BYTES} bytes")
    return data


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Merges:
    """What merge replay needs of a vocabulary: byte ids and the rank that each pair merges to."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.codes = np.array(sorted(pairs), np.int64)
        self.to = np.array([pairs[c] for c in self.codes.tolist()], np.int64)
        # A token that can merge on to one of a lower rank has its occurrences in a word merged one after another.
        self.turns = np.zeros(max(ranks.values()) + 1, bool)
        for x in (self.codes >> 32, self.codes & 0xFFFFFFFF):
            self.turns[x[self.to < x]] = True

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a << 32 | b
        i = np.searchsorted(self.codes, code)
        i[i == len(self.codes)] = 0
        return np.where(self.codes[i] == code, self.to[i], NONE)


def replay(words: list[bytes], merges: Merges) -> list[bytes]:
    """The ids of each word, as little-endian unsigned 32-bit integers; words aren't empty."""
    if not words:
        return []
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    sym = merges.bytes[np.frombuffer(b"".join(words), np.uint8)]
    n, ends = len(sym), np.cumsum(lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[ends - 1] = n
    before[ends - lengths] = n  # position n stands for no neighbour
    rank = np.full(n + 1, NONE)
    inner = np.flatnonzero(after[:n] < n)
    rank[inner] = merges.rank(sym[inner], sym[inner + 1])
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(at: np.ndarray) -> None:
        r = rank[at]
        at, r = at[r < NONE], r[r < NONE]
        if not len(at):
            return
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        for k, part in zip(r[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts) if len(cuts) else [at], strict=True):
            if k in index:
                index[k].append(part)
            else:
                index[k] = [part]
                heappush(heap, k)

    enter(inner)
    heapify(heap)
    while heap:
        r = heappop(heap)
        at = index.pop(r)
        at = at[0] if len(at) == 1 else np.concatenate(at)
        at = at[rank[at] == r]
        if len(at) > 1:
            at = np.unique(at)
            if merges.turns[r]:
                w = word[at]
                first = np.concatenate(([True], w[1:] != w[:-1]))
                if not first.all():
                    index[r] = [at[~first]]
                    heappush(heap, r)
                    at = at[first]
            else:
                goes_on = np.concatenate(([False], after[at[:-1]] == at[1:]))
                if goes_on.any():  # in a run such as aaaa every other pair merges
                    start = np.maximum.accumulate(np.where(goes_on, 0, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - start) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        beyond = after[gone]
        sym[at] = r
        rank[gone] = -1
        after[at] = beyond
        has = beyond < n
        before[beyond[has]] = at[has]
        rank[at] = NONE
        rank[at[has]] = merges.rank(sym[at[has]], sym[beyond[has]])
        prior = before[at]
        had = prior < n
        prior, own = prior[had], at[had]
        rank[prior] = merges.rank(sym[prior], sym[own])
        enter(np.union1d(at, prior))
    alive = rank[:n] >= 0
    ids = sym[alive].astype("<u4").tobytes()
    counts = np.cumsum(np.bincount(word[alive], minlength=len(words))) * 4
    return [ids[a:b] for a, b in zip([0, *counts[:-1].tolist()], counts.tolist(), strict=True)]


class Encoder:
    """Encodes texts as the rank file's own library would: matches of ``pattern``, each by itself."""

    def __init__(self, data: bytes, pattern: str):
        self.merges, self.find = Merges(parse_ranks(data)), regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.cache = PieceCache(self.encode)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Texts to ids; a match that is a token as it stands isn't merged at all."""
        if len(self.known) > 200_000:
            self.known.clear()
        find = self.matches
        found = [[x] if x[1:].isalpha() and x[0] == " " else find(x) for x in texts]
        new = {w for f in found for w in f}.difference(self.known)
        todo = []
        for w in new:
            own = self.merges.ranks.get(w.encode("utf-8", "surrogatepass"))
            if own is None:
                todo.append(w)
            else:
                self.known[w] = own.to_bytes(4, "little")
        for i in range(0, len(todo), 200_000):
            part = todo[i : i + 200_000]
            self.known.update(zip(part, replay([w.encode("utf-8", "surrogatepass") for w in part], self.merges), strict=True))
        of = self.known.__getitem__
        return [of(f[0]) if len(f) == 1 else b"".join(map(of, f)) for f in found]

    def matches(self, text: str) -> list[str]:
        """What the pattern matches; a word before a comma or full stop and a word after a line feed need no pattern."""
        if text[:1] == " " and text[-1] in ",." and text[1:-1].isalpha():
            return [text[:-1], text[-1]]
        if text[:1] == "\n" and text[1:].isalpha():
            return ["\n", text[1:]]
        return self.find(text)

    def __call__(self, texts: list[str]) -> list[bytes]:
        return self.cache(texts)


_made: dict[tuple, object] = {}


def once(kind, data: bytes, *args):
    """One encoder or table for each worker process."""
    key = (kind, hash(data), args)
    if key not in _made:
        _made[key] = kind(data, *args)
    return _made[key]


def _tokens(data: bytes) -> list[bytes]:
    ranks = parse_ranks(data)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def encode(docs: DataFrame, data: bytes, pattern: str, text: str = "text", name: str = "ids") -> DataFrame:
    """Adds the ids of each whole text as ``array<int>``; null and empty texts have none.

    ``data``: the bytes of a rank file, one line of base64 token and rank each, which are broadcast.
    """
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = once(Encoder, shared.value, pattern)
        for batch in batches:
            texts = batch.to_pylist()
            out = []
            for a, b in groups(texts):
                out += encoder(texts[a:b])
            offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, out), np.int64, len(out)) // 4))).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(out), "<i4")))

    return docs.withColumn(name, F.arrow_udf(_typed(of), "array<int>")(F.coalesce(F.col(text), F.lit(""))))


def decode(ids: Column, data: bytes, spark) -> Column:
    """The bytes that ids stand for; no ids give no bytes."""
    shared = spark.sparkContext.broadcast(data)

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = once(_tokens, shared.value).__getitem__
        for batch in batches:
            offsets, values = batch.offsets.to_numpy(), batch.values.to_numpy()
            yield pa.array([b"".join(map(token, values[a:b].tolist())) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())

    return F.arrow_udf(_typed(of), "binary")(ids)


def _typed(of):
    of.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return of
