"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its weight's share of all characters, over its own
characters. A document is repeated as often as the inverted Poisson distribution says for a
number in [0, 1) that is hashed from seed and document id, so a rate of 1.3 gives 1.3 copies in
the mean, and no document's count depends on another's. Copies are then put in the order of a
hashed key over the whole table.

Only the rates of sources are joined to documents. Up to ``MAX_SOURCES`` of them are broadcast;
beyond that they are joined by shuffle, each source salted so that no task gets a hot one whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasswing.llm.common import text_of, uniform, written

#: Most rows of rates that are broadcast; a rate row has under 8 kB.
MAX_SOURCES = 2_000
#: Largest mean that is inverted at once; a larger one is the sum of independent parts.
PART = 200.0
SALTS = 64


def rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, default: float = 1.0) -> DataFrame:
    """``(source, size, rate, parts, cdf)`` for each source of ``docs``, counted over all of them.

    ``weights`` are relative; a source that isn't named has weight ``default``, and a null source
    is a source of its own. A document's size is its characters and one for its end, so that empty
    texts count. ``epochs``: characters in the mixture over characters in ``docs``.
    """
    if weights and min(weights.values()) < 0 or default < 0:
        raise ValueError("weights must not be negative")
    sizes = docs.groupBy("source").agg(F.sum(F.char_length(text_of()).cast("long") + 1).alias("size"))
    named = F.lit(float(default))
    for k, v in sorted((weights or {}).items()):
        named = F.when(F.col("source") == k, F.lit(float(v))).otherwise(named)
    sizes = written(sizes.withColumn("weight", named), "mixing-sizes")
    total, weight = sizes.agg(F.sum("size"), F.sum("weight")).first()
    out = sizes.withColumn("rate", F.lit(float(epochs) * float(total or 0)) * F.col("weight") / F.lit(float(weight or 1) or 1.0) / F.col("size"))
    out = out.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART).cast("int")))
    mean = F.col("rate") / F.col("parts")
    terms = F.sequence(F.lit(1), F.ceil(mean + F.sqrt(mean) * 12 + 30).cast("int"))
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    fold = F.aggregate(terms, start, lambda a, k: F.struct((a.p * mean / k).alias("p"), F.concat(a.cdf, F.array(F.element_at(a.cdf, -1) + a.p * mean / k)).alias("cdf")))
    return out.withColumn("cdf", fold["cdf"]).select("source", "size", "rate", "parts", "cdf")


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 1, default: float = 1.0) -> DataFrame:
    """All columns of ``docs`` with ``copy`` (from 1) and ``shuffle_key``, ordered by the latter.

    Null and empty texts are replicated like any other. Rows that repeat an id repeat equally
    often; a null id counts as the empty string. An empty table gives an empty result. Columns of
    these names in ``docs`` are replaced; columns of any other name stay as they are.
    """
    kept = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    rate = written(rates(docs, weights, epochs, default), "mixing-rates")
    own = rate.select("source", "parts", "cdf")
    rows = docs.select(F.struct(*kept).alias("row"), F.col("source").alias("of"), F.col("doc_id").alias("id"))
    if rate.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES:
        rows = rows.join(F.broadcast(own), F.col("of").eqNullSafe(F.col("source")))
    else:
        salted = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        rows = rows.join(salted, F.col("of").eqNullSafe(F.col("source")) & (F.col("s") == F.col("salt")))

    def drawn(part):
        u = uniform(seed, part, F.col("id"))
        return F.size(F.filter("cdf", lambda c: c <= u))

    count = F.aggregate(F.sequence(F.lit(0), F.col("parts") - 1), F.lit(0), lambda a, part: a + drawn(part))
    rows = rows.select("row", "id", count.alias("n")).where("n > 0").select("row", "id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    key = (uniform(seed, "order", F.col("id"), F.col("copy")) * F.lit(float(1 << 52))).cast("long")
    rows = rows.withColumn("shuffle_key", key).orderBy("shuffle_key", "id", "copy")
    return rows.select(*[F.col("row")[c].alias(c) for c in kept], "copy", "shuffle_key")


#: DuckDB SQL for ``replicate`` with equal weights, one epoch and seed 1.
ORACLE = """
WITH s AS (SELECT source, sum(length(coalesce(text, '')) + 1)::DOUBLE AS size FROM {docs} GROUP BY source),
r AS (SELECT source, (SELECT sum(size) FROM s) / (SELECT count(*) FROM s) / size AS rate FROM s),
p AS (SELECT source, k, CASE WHEN k = 0 THEN exp(-rate) ELSE exp(k * ln(rate) - rate - lgamma(k + 1)) END AS p
      FROM r, range(0, 240) t(k)),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
d AS (SELECT *, ('0x' || substr(md5('1:0:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM {docs}),
n AS (SELECT d.doc_id, d.source, d.text, d.lang, d.n_chars, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM d.source AND c.cdf <= d.u) AS n FROM d)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy,
       ('0x' || substr(md5('1:order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy), 1, 13))::BIGINT AS shuffle_key
FROM n, LATERAL (SELECT unnest(range(1, n + 1)) AS copy)
"""
