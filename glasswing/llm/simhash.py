"""SimHash fingerprints and near-duplicate groups by pivot distance tables.

Fingerprints are linked at ``radius`` or fewer differing bits. Equal fingerprints are one class
before anything is compared. Classes meet in buckets: the 64 bits are cut into blocks, and as at
most ``radius`` blocks can differ, each pair of linked classes agrees on all others, so a bucket
for each choice of blocks that may agree loses nothing. Each fingerprint has a row of Hamming
distances to reference fingerprints (pivots), computed once and carried to its buckets; by the triangle inequality no linked pair
has coordinates further apart than the radius, so pairs are discarded by their largest coordinate
difference, and only survivors are verified bit by bit. A bucket gives out a spanning forest of
its links, not all its pairs, which leaves the components as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasswing.llm import neardup
from glasswing.llm.common import fresh, partitions, short_batches, written
from glasswing.llm.components import connected_components

PIVOTS = 24
#: Runs up to this length are compared by shifting, longer ones by a search from member to member.
SHORT = 8
#: Fingerprints compared at once with all that is left of a long run.
TILE = 128


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text as a signed 64-bit integer.

    Bytes are lower-cased A-Z and cut at ASCII white space, as ``bytes.split`` does. A text of
    fewer words than a shingle is one shingle; null and wordless texts have fingerprint 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    pieces = map(joined.__getitem__, map(slice, starts[:n].tolist(), (ends[min(shingle, len(words)) - 1 :] - 1).tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, name: str = "fp", text: str = "text", shingle: int = 4) -> DataFrame:
    """Adds the fingerprint of each whole text as a long column."""

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(x, shingle) for x in batch], dtype="int64")

    short_batches(docs.sparkSession)
    return docs.withColumn(name, F.pandas_udf(of, "long")(F.coalesce(F.col(text), F.lit(""))))


def blocks_for(n: int) -> int:
    """Blocks to cut 64 bits into, so that a bucket of random fingerprints stays short."""
    return 6 if n < 1 << 25 else 7 if n < 1 << 31 else 8


def masks(blocks: int, radius: int = 4) -> list[int]:
    """A mask, as a signed integer, for each choice of blocks that may agree."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    out = [sum(c) for c in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def pivots(count: int = PIVOTS) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, 1) for i in range(count)], np.uint64)


def linked(a: np.ndarray, ta: np.ndarray, b: np.ndarray, tb: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs of equally long arrays are linked: pivot rows first, then the bits of survivors."""
    left = np.arange(len(a))
    for k in range(ta.shape[1]):
        left = left[np.abs(ta[left, k] - tb[left, k]) <= radius]
    return left[np.bitwise_count(a[left] ^ b[left]) <= radius]


def forest(fps: np.ndarray, tables: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span the components of one long run: what is left is searched from those found."""
    out, rest = [], np.arange(len(fps))
    front = rest[:0]
    while len(rest):
        if not len(front):
            front, rest = rest[:1], rest[1:]
        now, front = front[:TILE], front[TILE:]
        for x in now:
            if not len(rest):
                break
            near = (np.abs(tables[rest, 0] - tables[x, 0]) <= radius).nonzero()[0]
            for k in range(1, tables.shape[1]):
                near = near[np.abs(tables[rest[near], k] - tables[x, k]) <= radius]
            near = near[np.bitwise_count(fps[rest[near]] ^ fps[x]) <= radius]
            if len(near):
                hit = rest[near]
                out.append((np.repeat(fps[x], len(hit)), fps[hit]))
                front = np.concatenate((front, hit))
                rest = np.delete(rest, near)
    return out


def pivot_columns(fp: str, count: int = PIVOTS) -> list[Column]:
    """A fingerprint's row of the pivot table: distances to ``count`` pivots, a byte each, as longs ``t0``, ``t1``, ..."""
    distance = [F.bit_count(F.col(fp).bitwiseXOR(F.lit(int(p)))).cast("long") for p in pivots(count).view(np.int64)]
    byte = [F.shiftleft(d, 8 * (i % 8)) for i, d in enumerate(distance)]
    return [reduce(Column.bitwiseOR, byte[i : i + 8]).alias(f"t{i // 8}") for i in range(0, count, 8)]


def pivot_rows(rows: pd.DataFrame, count: int) -> np.ndarray:
    """The pivot table of rows with ``pivot_columns``, one int8 coordinate for each pivot."""
    longs = np.column_stack([rows[f"t{i}"].to_numpy("<i8") for i in range(-(-count // 8))])
    return np.ascontiguousarray(longs).view(np.int8).reshape(len(rows), -1)[:, :count]


def bucket_links(batches: Iterator[pd.DataFrame], radius: int, count: int) -> Iterator[pd.DataFrame]:
    """Links from rows ``(c, k, fp, t0, ...)`` sorted by ``c, k``; a run may go on over several batches."""
    held: list[pd.DataFrame] = []

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        c, k, fps = rows.c.to_numpy(), rows.k.to_numpy(), rows.fp.to_numpy().view(np.uint64)
        first = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (k[1:] != k[:-1]))))
        length = np.diff(np.append(first, len(fps)))
        run = np.repeat(np.arange(len(first)), length)
        table = pivot_rows(rows, count)
        out = []
        short = np.flatnonzero((np.repeat(length, length) > 1) & (np.repeat(length, length) <= SHORT))
        for s in range(1, SHORT):
            i = short[short + s < len(fps)]
            i = i[run[i] == run[i + s]]
            i = i[linked(fps[i], table[i], fps[i + s], table[i + s], radius)]
            out.append((fps[i], fps[i + s]))
        for r in np.flatnonzero(length > SHORT):
            span = slice(first[r], first[r] + length[r])
            out += forest(fps[span], table[span], radius)
        a, b = (np.concatenate([x[j] for x in out]).view(np.int64) for j in (0, 1))
        return pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    for batch in batches:
        if not len(batch):
            continue
        last = batch.iloc[-1]
        start = int(((batch.c != last.c) | (batch.k != last.k)).to_numpy().nonzero()[0].max(initial=-1)) + 1
        if start:
            yield links(pd.concat([*held, batch.iloc[:start]]))
            held = []
        held.append(batch.iloc[start:])
        if not start and (held[0].c.iloc[0], held[0].k.iloc[0]) != (last.c, last.k):
            yield links(pd.concat(held[:-1]))
            held = held[-1:]
    if held:
        yield links(pd.concat(held))


def near_links(fps: DataFrame, radius: int = 4, count: int = PIVOTS) -> DataFrame:
    """Links ``(a, b)`` that span the components of distinct fingerprints ``fps(fp)``."""
    spark = fps.sparkSession
    keys = masks(blocks_for(fps.count()), radius)
    fps = fps.select("fp", *pivot_columns("fp", count))
    rows = fps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(keys)])).alias("x"), *fps.columns).select("x.c", "x.k", *fps.columns)
    rows = rows.repartition(max(partitions(spark), 8), "c", "k").sortWithinPartitions("c", "k")
    return rows.mapInPandas(lambda it: bucket_links(it, radius, count), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, key: str = "doc_id") -> DataFrame:
    """``(key, fp, component_id)``: one row for each row of ``docs``.

    ``component_id`` is the smallest key reachable over links. Null and wordless texts have
    fingerprint 0 and are linked like any other. Rows that repeat a key stay separate rows; a null
    key is no candidate for the smallest one, and a group of null keys only has a null component.
    An empty table gives an empty result; only ``key`` and ``text`` of the columns are read.
    """
    own = written(with_fingerprint(docs.select(F.col(key), "text"), shingle=shingle).select(key, "fp"), "simhash")
    classes = written(own.groupBy("fp").agg(F.min(key).alias("least")), "simhash-classes")
    label = connected_components(near_links(classes.select("fp"), radius))
    member = label.withColumnRenamed("node", "fp").join(classes, "fp")
    least = member.groupBy("label").agg(F.min("least").alias("component_id"))
    of = member.join(least, "label").select("fp", "component_id")
    of = classes.join(of, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return own.join(of, "fp")


def keep_one(docs: DataFrame, radius: int = 4, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each component of near copies, all its columns; copies have Jaccard similarity of shingles.

    Fingerprints within ``radius`` bits are candidates, which are verified on all shingles. Many pairs
    that are similar enough have more differing bits, so ``neardup.links`` goes on from there and
    finds all others.

    Each row is decided by itself, whether its ``doc_id`` is repeated or null. The row with the
    smallest id stays, nulls last, then the one with the smallest hash of the text. Wordless texts,
    null ones among them, are copies of each other. An empty table gives an empty result. Columns
    of any name stay as they are.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    own = docs.select(F.struct(*rest, F.lit(None).cast("int").alias(*fresh(rest, "none"))).alias("row"), "doc_id", "text")
    own = neardup.with_prefixes(with_fingerprint(own, "_fp", shingle=shingle), similarity, shingle)
    own = written(own.withColumn("_r", F.monotonically_increasing_id()), "neardup")
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), F.xxhash64("text").alias("h"), F.col("_r").alias("r"))
    best = own.groupBy("_s.c").agg(F.min(row).alias("row"), F.min("_fp").alias("fp"), F.max("_s.n").alias("n"))
    best = written(best.select(F.col("row.r").alias("r"), "row", "fp", "n"), "neardup-classes")
    lead = best.where("n > 0").groupBy("fp").agg(F.min("r").alias("b"))
    alike = best.where("n > 0").join(lead, "fp").where("r != b").select(F.col("r").alias("a"), "b")
    near = near_links(lead.select("fp"), radius).join(lead.select(F.col("fp").alias("a"), F.col("b").alias("x")), "a")
    near = near.join(lead.select(F.col("fp").alias("b"), F.col("b").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    texts = own.select(F.col("_r").alias("r"), "text", "_s.n", "_s.wide")
    found = neardup.verified(alike.unionByName(near), texts, similarity, shingle)
    classes = own.select(F.col("_r").alias("r"), "_s.n", "_s.p", "_s.odd").where("n > 0").join(best.select("r"), "r", "left_semi")
    label = connected_components(neardup.links(classes, texts, similarity, shingle, found))
    of = best.join(label.select(F.col("node").alias("r"), "label"), "r").groupBy("label").agg(F.min("row").alias("m")).select(F.col("m.r").alias("r"))
    alone = best.join(label.select(F.col("node").alias("r")), "r", "left_anti").select("r")
    kept = of.unionByName(alone)
    return own.join(kept.withColumnRenamed("r", "_r"), "_r", "left_semi").select(*[F.col("row")[c].alias(c) if c in rest else F.col(c) for c in docs.columns])
