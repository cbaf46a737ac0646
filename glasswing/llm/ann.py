"""Nearest neighbours by additive quantisation.

A vector is written as the sum of one full-dimensional codeword from each codebook. Codebooks
start as k-means on residuals and are then refitted together by least squares; a beam search
chooses the codewords. With the squared norm of the sum stored beside the codes, the distance to a
query, but for the query's own norm, is that norm less twice a sum of table entries. All rows are
scored so against the stated queries, block by block; the best rows are reranked by exact
distances in double precision on the original vectors.

A block gives out only rows that can be among a query's best. The first block gives a bound, the
distance of its own last candidate, which is at least that of all blocks together; ``FAN`` times as
many blocks at a time are held to the bound of those before, so that a query is sent about
``FAN`` times as many rows as it reranks at each of a logarithmic number of levels, however many
blocks there are.

The codebooks are fitted on at most ``SAMPLE`` vectors. Every row is encoded and scored. Of equal
vectors only the ``k + 1`` smallest ids can be among the k nearest, so a block gives out no more
of them; no other row is set aside.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glasswing.llm.common import discard, partitions, written

BOOKS, WORDS, BEAM = 32, 256, 8
SAMPLE = 10_000
#: Rows of an index block, queries of a query block, blocks of a level over those of all before.
BLOCK, QUERIES, FAN = 4_096, 1_024, 4
#: Sweeps over the books for each new coding of the sample.
SWEEPS = 6
#: Rows reranked for each query.
RERANK = 200


def beam_encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (uint8) by beam search: at each codebook the ``beam`` best sums so far are kept."""
    out = np.empty((len(x), len(books)), np.uint8)
    norms = (books**2).sum(2)
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024]
        n = len(part)
        residual, codes, cost = part[:, None, :], np.zeros((n, 1, 0), np.uint8), (part**2).sum(1)[:, None]
        for book, norm in zip(books, norms, strict=True):
            d = cost[:, :, None] - 2 * residual @ book.T + norm
            width = d.shape[1]
            flat = d.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
            from_, word = best // len(book), best % len(book)
            rows = np.arange(n)[:, None]
            residual = residual[rows, from_ if width > 1 else np.zeros_like(from_)] - book[word]
            codes = np.concatenate((codes[rows, from_], word[:, :, None].astype(np.uint8)), axis=2)
            cost = np.take_along_axis(flat, best, 1)
        out[at : at + 1024] = codes[np.arange(n), cost.argmin(1)]
    return out


def total(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[m][codes[:, m]] for m in range(len(books)))


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 2, seed: int = 7) -> np.ndarray:
    """Codebooks (books, words, dimensions) for a sample: residual k-means, then least squares, a book at a time in turn."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    out, residual = np.zeros((books, words, x.shape[1])), x.copy()
    for m in range(books):
        centre = residual[rng.choice(len(x), words, replace=len(x) < words)]
        for _ in range(8):
            near = ((centre**2).sum(1) - 2 * residual @ centre.T).argmin(1)
            count = np.bincount(near, minlength=words)
            sums = np.zeros_like(centre)
            np.add.at(sums, near, residual)
            centre = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], residual[rng.choice(len(x), words)])
        out[m] = centre
        residual = residual - centre[((centre**2).sum(1) - 2 * residual @ centre.T).argmin(1)]
    for _ in range(rounds):
        codes = beam_encode(x, out)
        left = x - total(codes, out)
        for _ in range(SWEEPS):
            for m in range(books):
                own = left + out[m][codes[:, m]]
                count = np.bincount(codes[:, m], minlength=words)
                sums = np.stack([np.bincount(codes[:, m], weights=own[:, d], minlength=words) for d in range(x.shape[1])], 1)
                out[m] = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], out[m])
                left = own - out[m][codes[:, m]]
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, n, v, h)``: rows that take part, ``n`` counting rows that repeat an id, ``h`` a hash of the vector.

    Null vectors, zero ones, those with null or non-finite components and those of another length
    than most take no part.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    rows = rows.where(F.size("v") == (sizes[0]["size"] if sizes else 0))
    again = Window.partitionBy("vec_id").orderBy("v")
    return rows.withColumn("n", F.row_number().over(again)).withColumn("h", F.xxhash64("v")).select("vec_id", "n", "v", "h")


def index(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``(vec_id, n, h, codes, norm)`` for every row of ``rows``."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                codes = beam_encode(np.stack(b.v.to_numpy()), shared.value)
                norm = (total(codes, shared.value) ** 2).sum(1)
                yield pd.DataFrame({"vec_id": b.vec_id, "n": b.n, "h": b.h, "codes": [c.tobytes() for c in codes], "norm": norm})

    return rows.mapInPandas(of, "vec_id long, n int, h long, codes binary, norm double")


def levels(blocks: int) -> list[tuple[int, int]]:
    """Ranges of blocks: the first one, then ``FAN`` times as many as all before."""
    out = [(0, 1)]
    while out[-1][1] < blocks:
        out.append((out[-1][1], min(blocks, out[-1][1] * (1 + FAN))))
    return out


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of each row whose id ``every`` divides.

    ``score`` is the Euclidean distance in double precision; ties go to the smaller id. All
    candidates are returned where there are fewer than k. A row that repeats a query's id is a
    candidate of it and a query of its own; their results stand under the same ``query_id``. An
    empty table, or one without usable rows, gives an empty result. Other columns don't matter.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors), "ann-rows")
    count = rows.count()
    fitted = rows.orderBy(F.xxhash64("vec_id", F.lit(7)), "n").limit(sample).select("v").toPandas()
    dims = len(fitted.v.iloc[0]) if len(fitted) else 1
    books = fit(np.stack(fitted.v.to_numpy())) if len(fitted) else np.zeros((BOOKS, WORDS, dims))
    coded = index(rows.repartition(partitions(spark)), books)  # few rows a task, as each costs much
    blocks = max(1, -(-count // BLOCK))
    coded = written(coded.withColumn("b", F.pmod(F.xxhash64("vec_id", "n", F.lit(3)), F.lit(blocks)).cast("int")), "ann-index")
    queries = rows.where(F.col("vec_id") % every == 0)
    asked = max(1, -(-queries.count() // QUERIES))
    queries = queries.select("vec_id", "n", "v", F.pmod(F.xxhash64("vec_id", "n"), F.lit(asked)).cast("int").alias("qb"))
    shared = spark.sparkContext.broadcast(books)  # doubles: single floats overflow where components are large

    def scored(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        out = {x: [] for x in ("query_id", "qn", "vec_id", "n", "h", "near")}
        if len(q) and len(i):
            i = i.sort_values(["vec_id", "n"], kind="stable")
            i = i[i.groupby("h").cumcount() <= k]
            codes = np.frombuffer(b"".join(i.codes), np.uint8).reshape(len(i), -1)
            ids, ns, hs, norm = i.vec_id.to_numpy(), i.n.to_numpy(), i.h.to_numpy(), i.norm.to_numpy()
            for v, query, qn, most in zip(q.v, q.vec_id, q.n, q.most, strict=True):
                table = shared.value @ np.asarray(v)
                near = norm - 2 * sum(table[m][codes[:, m]] for m in range(codes.shape[1]))
                near[np.isnan(near)] = -math.inf  # where even doubles overflow, a row is reranked rather than lost
                best = np.flatnonzero((near <= most) & ((ids != query) | (ns != qn)))
                best = best[np.argsort(near[best], kind="stable")[:rerank]]
                for name, x in (("query_id", np.full(len(best), query)), ("qn", np.full(len(best), qn)), ("vec_id", ids[best]), ("n", ns[best]), ("h", hs[best]), ("near", near[best])):
                    out[name].append(x)
        return pd.DataFrame({x: np.concatenate(v) if v else [] for x, v in out.items()})

    found, same = None, Window.partitionBy("query_id", "qn", "h").orderBy("vec_id", "n")
    best = Window.partitionBy("query_id", "qn").orderBy("near", "vec_id", "n")
    for first, end in levels(blocks):
        some = queries.withColumn("most", F.lit(math.inf))
        if found is not None:
            bound = found.groupBy(F.col("query_id").alias("vec_id"), F.col("qn").alias("n")).agg(F.max("near").alias("_m"), F.count(F.lit(1)).alias("_k"))
            some = queries.join(bound, ["vec_id", "n"], "left").withColumn("most", F.when(F.col("_k") >= rerank, F.col("_m")).otherwise(F.lit(math.inf))).drop("_m", "_k")
        q = some.withColumn("b", F.explode(F.sequence(F.lit(first), F.lit(end - 1))))
        i = coded.where(F.col("b").between(first, end - 1)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(asked - 1))))
        new = q.groupBy("b", "qb").cogroup(i.groupBy("b", "qb")).applyInPandas(scored, "query_id long, qn int, vec_id long, n int, h long, near double")
        both = new if found is None else new.unionByName(found)
        both = both.withColumn("_s", F.row_number().over(same)).where(F.col("_s") <= k + 1).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= rerank)
        last, found = found, written(both.drop("_s", "_r"), "ann-found")
        if last is not None:
            discard(last)
    found = found.select("query_id", "qn", "vec_id", "n").join(rows.select("vec_id", "n", "v"), ["vec_id", "n"])
    own = queries.select(F.col("vec_id").alias("query_id"), F.col("n").alias("qn"), F.col("v").alias("q"))
    exact = F.sqrt(F.aggregate(F.zip_with("q", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    found = found.join(own, ["query_id", "qn"]).select("query_id", "qn", "vec_id", "n", exact.alias("score"))
    order = Window.partitionBy("query_id", "qn").orderBy("score", "vec_id", "n")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: DuckDB SQL for ``nearest`` by all distances, for vectors that all take part.
ORACLE = """
WITH p AS (SELECT q.vec_id AS query_id, e.vec_id,
                  sqrt(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS score
           FROM {vectors} q JOIN {vectors} e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
