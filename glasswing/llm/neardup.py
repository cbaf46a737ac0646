"""The near copies that fingerprints miss: an exact set-similarity join over whole texts.

A text's tokens are its distinct shingles of ``SHINGLE`` words. Rows of the same tokens are one class
before anything is compared. Two classes of Jaccard similarity t or more share a token within their
prefixes, the first n - ceil(t n) + 1 of n tokens in one order for all texts, from rare to frequent by
counts in hashed buckets; so candidates from prefixes lose no pair. Length, place and
bitmaps of parities discard candidates that can't reach t. Of those that stay, bitmaps as wide as the
texts have tokens are compared before any text is moved, and the rest are verified on all tokens.

Only components matter, and links found before, as by fingerprints, are given. At tokens whose
classes are not yet in one component, each class is first compared with one class, the lead, and
then with a few more. Last, the classes outside a token's largest component are compared with all
that other components have there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glasswing.llm.common import discard, short_batches, written
from glasswing.llm.components import connected_components

SHINGLE, SIMILARITY = 5, 0.8
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Leads of a token in each round after the first, and how many such rounds.
LEADS, ROUNDS = 8, 2
#: Rows of one or two numbers of 8 bytes that are broadcast at most, so that texts aren't shuffled to pick a few of them; more are joined by shuffle.
BROADCAST = 500_000
#: Buckets of token counts, and how many of them are one row of the counts' table.
BUCKETS, ROW = 1 << 18, 1 << 10


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashed shingles of a text, sorted; words are those of ``simhash.fingerprint``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(shingle, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = (out ^ h[j : j + n]) * MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def needed(n: int, similarity: float) -> int:
    return int(np.ceil(n * similarity - 1e-9))


def wide_parities(h: np.ndarray) -> bytes:
    """Of each value of a token's last bits, whether an odd number of tokens has it: one bit for each token, or up to twice as many."""
    size = 1 << max(8, (len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """How many parities of two texts differ at least; the wider bitmap is folded to the other's width."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) < len(b):
        a, b = b, a
    return int(np.bitwise_count(np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0) ^ b).sum(dtype=np.int64))


def bucket_ranks(docs: DataFrame, shingle: int) -> np.ndarray:
    """The logarithm of each bucket's number of tokens, as bytes."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            every = np.concatenate([shingles(text, shingle) for text in batch.text] or [shingles(None)])
            counts += np.bincount((every & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        for b in np.flatnonzero(counts.reshape(-1, ROW).any(1)):
            yield pd.DataFrame({"b": [b], "c": [counts[b * ROW : (b + 1) * ROW]]})

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        c = np.stack(rows.c.to_list()).sum(0)
        return pd.DataFrame({"b": rows.b[:1].to_list(), "r": [np.floor(np.log2(c + 1) * 6).astype(np.uint8).tobytes()]})

    ranks = np.zeros((BUCKETS // ROW, ROW), np.uint8)
    for r in docs.select("text").mapInPandas(count, "b int, c array<long>").groupBy("b").applyInPandas(total, "b int, r binary").collect():
        ranks[r.b] = np.frombuffer(bytes(r.r), np.uint8)
    return ranks.ravel()


def with_prefixes(docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Adds ``_s``: the class in 128 bits, the number of tokens, the prefix, the parities and the wide ones of each text.

    The 256 parities say of each value of a token's first byte whether an odd number of tokens has it.
    """
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(bucket_ranks(docs, shingle))

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ranks = shared.value
        for batch in batches:
            out = []
            for text in batch:
                h = shingles(text, shingle)
                o = h[np.lexsort((h, ranks[(h & np.uint64(BUCKETS - 1)).astype(np.int64)]))]
                p = o[: len(o) - needed(len(o), similarity) + 1].view(np.int64)
                odd = np.packbits(np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=256) & 1).view(np.int64)
                out.append((xxhash.xxh128_hexdigest(h.tobytes()), len(h), p, odd, wide_parities(h)))
            yield pd.DataFrame(out, columns=["c", "n", "p", "odd", "wide"])

    return docs.withColumn("_s", F.pandas_udf(of, "c string, n int, p array<long>, odd array<long>, wide binary")(F.coalesce(F.col("text"), F.lit(""))))


def possible(x: str, y: str, similarity: float) -> Column:
    """Whether two classes that share a token can be similar: length, place, parities.

    As many parities differ at most as there are tokens that only one of the two has.
    """
    nx, ny, ix, iy = (F.col(f"{s}.{k}") for k in ("n", "i") for s in (x, y))
    least = F.ceil((nx + ny) * F.lit(similarity / (1 + similarity)) - 1e-9)
    reach = F.least(ix, iy) + 1 + F.least(nx - ix - 1, ny - iy - 1)
    odd = sum((F.bit_count(F.col(f"{x}.odd")[j].bitwiseXOR(F.col(f"{y}.odd")[j])) for j in range(4)), F.lit(0))
    return (odd <= nx + ny - 2 * least) & (ny >= nx * F.lit(similarity) - 1e-9) & (nx >= ny * F.lit(similarity) - 1e-9) & (reach >= least)


def close(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose wide parities don't rule out that they are similar, as ``possible`` has it."""

    def of(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for xs, ys, most in batches:
            yield pd.Series([differing(x, y) <= k for x, y, k in zip(xs, ys, most, strict=True)], dtype=bool)

    side = lambda s: texts.select(F.col("r").alias(s), F.struct("n", "wide").alias(f"v{s}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    both = F.col("va.n") + F.col("vb.n")
    most = both - 2 * F.ceil(both * F.lit(similarity / (1 + similarity)) - 1e-9)
    return met.where(F.pandas_udf(of, "boolean")(F.col("va.wide"), F.col("vb.wide"), most)).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The links ``(a, b)`` among pairs of classes that are similar on all tokens; ``texts(r, text, n, wide)`` has all of them."""

    def alike(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        of = lru_cache(64)(lambda text: shingles(text, shingle))
        for xs, ys in batches:
            out = []
            for x, y in zip(map(of, xs), map(of, ys), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both >= (len(x) + len(y) - both) * similarity - 1e-9)
            yield pd.Series(out, dtype=bool)

    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = written(close(pairs, texts, similarity), "neardup-pairs")
    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("r")).distinct(), "neardup-asked")
    few = asked.count() <= BROADCAST
    met = texts.join(F.broadcast(asked) if few else asked, "r", "left_semi")
    met = written(met.select("r", F.coalesce("text", F.lit("")).alias("t")), "neardup-texts")
    some = F.broadcast(pairs) if pairs.count() <= BROADCAST else pairs
    rows = some.join(met.toDF("b", "tb"), "b").join(met.toDF("a", "ta"), "a")
    links = rows.select("a", "b", F.pandas_udf(alike, "boolean")(F.col("ta"), F.col("tb")).alias("y")).where("y")
    out = written(links.select("a", "b"), "neardup-links")
    discard(pairs, asked, met)
    return out


def mixed(posted: DataFrame, found: DataFrame) -> DataFrame:
    """``(x, v, label)`` of the tokens whose classes are not all in one component of the links found."""
    found = connected_components(found)
    label = found.select(F.col("node").alias("_v"), "label")
    rows = posted.join(label, F.col("v.r") == F.col("_v"), "left").select("x", "v", F.coalesce("label", "v.r").alias("label"))
    some = rows.groupBy("x").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("x")
    out = written(rows.join(some, "x", "left_semi"), "neardup-mixed")
    discard(found)
    return out


def links(classes: DataFrame, texts: DataFrame, similarity: float, shingle: int, found: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that span the components of ``classes(r, n, p, odd)``; ``texts(r, text, n, wide)`` has all of them.

    ``found``: verified links to begin with. Where they join all classes of a token, nothing is compared.
    """
    firsts = classes.select("r", "n", F.posexplode("p").alias("i", "x")).select("x", F.struct("r", "n", "i").alias("v"))
    met = firsts.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("x"))).where("k > 1")
    met = written(met.select(F.col("v.r").alias("r"), "x", "v.n", "v.i"), "neardup-met")
    posted = met.join(classes.select("r", "odd"), "r")
    posted = written(posted.select("x", F.struct("r", "n", "i", "odd").alias("v")), "neardup-posted")
    discard(met)
    rows = mixed(posted, found)
    led = rows.groupBy("x").agg(F.min_by(F.struct("v", "label"), "v.r").alias("y")).select("x", F.col("y.v").alias("y"), F.col("y.label").alias("other"))
    pairs = rows.join(led, "x").where((F.col("label") != F.col("other")) & possible("v", "y", similarity))
    found = found.unionByName(verified(pairs.select(F.col("v.r").alias("a"), F.col("y.r").alias("b")), texts, similarity, shingle))
    discard(posted)
    many = rows
    for k in range(ROUNDS):
        last, many = many, mixed(many.select("x", "v"), found)
        discard(last)
        one = lambda seed: F.min(F.struct(F.xxhash64("v.r", F.lit(seed)).alias("h"), "v", "label"))
        lead = many.groupBy("x").agg(F.array_distinct(F.transform(F.array(*[one(k * LEADS + j) for j in range(LEADS)]), lambda s: F.struct(s["v"].alias("v"), s["label"].alias("label")))).alias("ys"))
        pairs = many.join(lead, "x").select("v", "label", F.explode("ys").alias("y")).select("v", "label", F.col("y.v").alias("w"), F.col("y.label").alias("other"))
        pairs = pairs.where((F.col("label") != F.col("other")) & possible("v", "w", similarity))
        found = found.unionByName(verified(pairs.select(F.col("v.r").alias("a"), F.col("w.r").alias("b")), texts, similarity, shingle))
    last, many = many, mixed(many.select("x", "v"), found)
    discard(last)
    led = many.groupBy("x").agg(F.mode("label").alias("led"))
    rest = written(many.join(led, "x").where("label != led").select("x", "v", "label"), "neardup-rest")
    pairs = rest.join(many.select("x", F.col("v").alias("w"), F.col("label").alias("other")), "x")
    pairs = pairs.where((F.col("label") != F.col("other")) & possible("v", "w", similarity))
    found = found.unionByName(verified(pairs.select(F.col("v.r").alias("a"), F.col("w.r").alias("b")), texts, similarity, shingle))
    discard(many, rest)
    return found
