"""Product quantisation in integers: codebooks that are the same on every machine.

Vectors become integers and are cut into parts; each part position has a codebook. A round sends
the codebooks to all tasks, which assign the parts of their Arrow batches: squared distances by
norm expansion, with exact products of 64-bit integers, the first of equally near entries. Each
task sums its parts by entry, the sums are merged by a grouped shuffle, and only they, an integer
for each component of each entry, come to the driver.

Integer arithmetic that wraps is exact wherever the true distance fits, which a bound on the
batch's components proves; batches beyond that bound go through integers of any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasswing.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components at or beyond this are an error, as neither they nor codebooks would be longs for certain.
LARGEST = 1 << 62
#: Rows whose distances are held at once.
ROWS = 2_048
Books = list[np.ndarray]


def bounds(size: int, parts: int) -> list[tuple[int, int]]:
    """Where each part begins and ends; as equal as can be where ``parts`` doesn't divide ``size``."""
    edges = [size * i // parts for i in range(parts + 1)]
    return list(zip(edges, edges[1:], strict=False))


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(row, id, v)``: the rows that take part, ``row`` all columns, ``v`` floors of the scaled components.

    Null vectors and those with null or non-finite components take no part, nor do vectors of
    another length than most, on a tie the longest.
    """
    rows = vectors.select(F.struct("*").alias("row"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.col("e").isNotNull() & F.forall("e", fine))
    sizes = rows.groupBy(F.size("e").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    too_large = F.raise_error(F.lit("a component is too large for 64-bit integers")).cast("long")
    whole = F.transform("e", lambda x: F.when(F.abs(x * scale) < float(LARGEST), F.floor(x * scale)).otherwise(too_large))
    return rows.where(F.size("e") == (sizes[0]["size"] if sizes else 0)).select("row", "id", whole.alias("v"))


def first_books(rows: DataFrame, parts: int, entries: int) -> Books:
    """The parts of the vectors with the smallest ids, ascending, null ids last, equal ids by vector."""
    first = rows.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    v = np.array([r["v"] for r in first], np.int64).reshape(len(first), len(first[0]["v"]) if first else 0)
    return [v[:, a:b] for a, b in bounds(v.shape[1], parts)]


def matrix(column: pa.Array) -> np.ndarray:
    """A list array of equally long lists without nulls as one integer matrix, without a copy."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1 if len(flat) else 0)


def fits(v: np.ndarray, books: Books) -> bool:
    """Whether the distance of any row from any sum of entries is sure to fit in 64 bits."""
    largest = lambda x: max((int(x.max()), -int(x.min()))) if x.size else 0
    return v.shape[1] * (largest(v) + max(map(largest, books))) ** 2 < 1 << 63


def assign(v: np.ndarray, books: Books) -> tuple[np.ndarray, list[int | None]]:
    """The entry of each part and each row's sum of squared distances, None where no long holds it."""
    exact = fits(v, books)
    if not exact:
        v, books = v.astype(object), [b.astype(object) for b in books]
    codes, total = np.empty((len(v), len(books)), np.int64), np.zeros(len(v), v.dtype)
    for m, ((a, b), book) in enumerate(zip(bounds(v.shape[1], len(books)), books, strict=True)):
        norm = (book * book).sum(1)
        for at in range(0, len(v), ROWS):
            x = v[at : at + ROWS, a:b]
            d = (x * x).sum(1)[:, None] - 2 * (x @ book.T) + norm if b > a else np.zeros((len(x), len(book)), v.dtype)
            best = d.argmin(1)
            codes[at : at + ROWS, m] = best
            total[at : at + ROWS] += d[np.arange(len(x)), best]
    return codes, total.tolist() if exact else [x if x < 1 << 63 else None for x in total]


def entry_sums(rows: DataFrame, books: Books) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """The number of parts at each used entry and the sums of their components.

    Sums are carried as two halves, so that neither a task's nor the merged ones can overflow.
    """
    shared, size = rows.sparkSession.sparkContext.broadcast(books), sum(b.shape[1] for b in books)
    parts = bounds(size, len(books))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, out = shared.value, [np.zeros((len(book), 2, b - a + 1), np.int64) for book, (a, b) in zip(shared.value, parts, strict=True)]
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column(0))
            codes, _ = assign(v, books)
            for m, (a, b) in enumerate(parts):
                order = np.argsort(codes[:, m], kind="stable")
                used, first = np.unique(codes[order, m], return_index=True)
                x = np.column_stack((v[order, a:b], np.ones(len(v), np.int64)))
                out[m][used, 0] += np.add.reduceat(x >> 32, first)
                out[m][used, 1] += np.add.reduceat(x & 0xFFFFFFFF, first)
        for m, sums in enumerate(out):
            used = np.flatnonzero(sums[:, 1, -1])
            width = sums.shape[2]
            columns = (np.full(len(used) * width, m), np.repeat(used, width), np.tile(np.arange(width), len(used)), sums[used, 0].ravel(), sums[used, 1].ravel())
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["part", "entry", "at", "high", "low"])

    sums = rows.select("v").mapInArrow(of, "part long, entry long, at long, high long, low long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).alias(c)
    out: dict[tuple[int, int], dict[int, int]] = {}
    for r in sums.groupBy("part", "entry", "at").agg(wide("high"), wide("low")).collect():
        out.setdefault((r["part"], r["entry"]), {})[r["at"]] = (int(r["high"]) << 32) + int(r["low"])
    return {k: (v[len(v) - 1], [v[i] for i in range(len(v) - 1)]) for k, v in out.items()}


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    """The codebooks after so many rounds; entries that no part uses stay as they are."""
    books = first_books(rows, parts, entries)
    for _ in range(rounds):
        new = [b.copy() for b in books]
        for (m, e), (count, sums) in entry_sums(rows, books).items():
            new[m][e] = [s // count for s in sums]
        books = new
    return books


def encode(rows: DataFrame, books: Books) -> DataFrame:
    """``(row, codes, error)`` of ``rows(row, v)``."""
    shared, parts = rows.sparkSession.sparkContext.broadcast(books), len(books)
    schema = rows.select("row", F.array().cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error")).schema

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, error = assign(matrix(batch.column(1)), shared.value)
                offsets = pa.array(np.arange(len(codes) + 1) * parts, pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(codes.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(error, pa.int64())], ["row", "codes", "error"])

    return rows.select("row", "v").mapInArrow(of, schema)


def decode(codes: Column, books: Books) -> Column:
    """The integer vector that codes stand for."""
    entry = lambda b: F.array(*[F.array(*[F.lit(int(x)) for x in e]).cast("array<long>") for e in b])
    return F.concat(*[F.get(entry(b), F.get(codes, m)) for m, b in enumerate(books)])


def as_hex(codes: Column) -> Column:
    """Two hexadecimal digits for each code."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")


def digest(books: Books) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for e in b for x in e).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Books]:
    """The columns of ``vectors`` with ``codes``, ``error`` and ``label_error``, and the codebooks.

    ``error`` is a row's squared distance from what its codes stand for, ``label_error`` its sum over
    the rows of equal ``label``, nulls together; either is null where no long holds it. Rows that
    take no part are left out (see ``usable``). Rows that repeat an id are rows of their own. With
    fewer usable rows than entries a codebook has as many entries as rows; an empty table has empty
    codebooks and gives an empty result. Columns of the three names are replaced; others stay.
    """
    kept = [c for c in vectors.columns if c not in ("codes", "error", "label_error")]
    rows = written(usable(vectors.select(*kept), scale), "codes-vectors")
    books = fit(rows, parts, entries, rounds)
    coded = written(encode(rows, books), "codes")
    label = F.col("row")["label"]
    total = F.sum(F.col("error").cast("decimal(28,0)")).alias("sum")
    sums = coded.groupBy(label.alias("of")).agg(total, F.count_if(F.col("error").isNull()).alias("lost"))
    long = F.when((F.col("lost") == 0) & (F.col("sum") <= (1 << 63) - 1), F.col("sum")).cast("long")
    sums = written(sums.select("of", long.alias("label_error")), "codes-labels")
    out = coded.join(sums, label.eqNullSafe(F.col("of")))
    return out.select(*[F.col("row")[c].alias(c) for c in kept], "codes", "error", "label_error"), books


_NEAR = """
n{k} AS (SELECT vec_id, m, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (
         SELECT x.vec_id, x.m, y.e, list_sum(list_transform(list_zip(x.x, y.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p x JOIN b{k} y USING (m)) GROUP BY vec_id, m)"""
_BOOK = """
b{j} AS (SELECT m, e, coalesce(s.x, b.x) AS x FROM b{k} b LEFT JOIN (
         SELECT m, e, list(v ORDER BY i) AS x FROM (
           SELECT m, e, i, ((sum(v) - (sum(v) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS v FROM (
             SELECT n.m, n.e, unnest(p.x) AS v, unnest(range(1, len(p.x) + 1)) AS i FROM n{k} n JOIN p USING (vec_id, m)) GROUP BY m, e, i) GROUP BY m, e) s USING (m, e))"""
#: DuckDB SQL for the digests of ``compress`` with the usual parameters, for vectors of one length and distinct ids.
ORACLE = (
    """
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM {vectors}
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, m, v[m * len(v) // 16 + 1:(m + 1) * len(v) // 16] AS x FROM k, range(16) r(m)),
o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT 64),
b0 AS (SELECT m, e, x FROM p JOIN o USING (vec_id)),"""
    + ",".join([_NEAR.format(k=0), _BOOK.format(j=1, k=0), _NEAR.format(k=1), _BOOK.format(j=2, k=1), _NEAR.format(k=2)])
    + """,
c AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY m) AS code, sum(d)::BIGINT AS error FROM n2 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY m, e)) FROM b2) AS codebooks_sha256
FROM c JOIN k USING (vec_id)
"""
)
