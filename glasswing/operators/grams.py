"""Search for parts of texts by an index of their character trigrams.

A text that contains a query contains all its trigrams. The index has a row for each text and
distinct trigram of its lower-case form, sorted by trigram, and how many texts each has. A search
looks up the query's rarest trigrams only, whose rows are found by the statistics of the index's
files, and verifies the texts that have them all. Queries of fewer characters than three are
searched for in the texts themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasswing.operators.search import LIMIT, contains
from glasswing.operators.tables import deleted, materialised

N = 3
#: Trigrams of a query that are looked up, the rarest.
RAREST = 3


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case; none of a null or a shorter one.

    The characters are bound once, as the argument of a function over a list of one list: an
    expression within a function would be computed anew for each place, and long texts are many places.
    """
    low = F.lower(text)
    three = lambda cs: F.transform(F.sequence(F.lit(0), F.size(cs) - N), lambda i: F.concat(*[F.get(cs, i + j) for j in range(N)]))
    own = F.get(F.transform(F.array(F.split(low, "")), lambda cs: F.array_distinct(three(cs))), F.lit(0))
    return F.when(F.char_length(low) >= N, own).otherwise(F.array().cast("array<string>"))


@dataclass
class Index:
    """``postings(gram, key)`` sorted by trigram, ``counts(gram, n)``, and the texts ``(key, text)`` themselves."""

    postings: DataFrame
    counts: DataFrame
    texts: DataFrame

    def candidates(self, query: str) -> DataFrame | None:
        """Keys of the texts that have a query's rarest trigrams; None where the query is too short for any."""
        low = query.lower()
        own = sorted({low[i : i + N] for i in range(len(low) - N + 1)})
        if not own:
            return None
        known = {r["gram"]: r["n"] for r in self.counts.where(F.col("gram").isin(own)).collect()}  # as many as the query has
        rarest = sorted(own, key=lambda g: (known.get(g, 0), g))[:RAREST]
        if any(g not in known for g in rarest):
            return self.postings.select("key").limit(0)
        return self.postings.where(F.col("gram").isin(rarest)).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rarest)).select("key")

    def search(self, query: str) -> DataFrame:
        """``key`` of every text that contains the query in any case; an empty query finds nothing."""
        if not query.strip():
            return self.texts.select("key").limit(0)
        some = self.candidates(query)
        rows = self.texts if some is None else self.texts.join(some, "key", "left_semi")
        return rows.where(contains(F.col("text"), query)).select("key").distinct()


def index(rows: DataFrame, key: str, text: str) -> Index:
    """The index of ``rows``; a key with several texts is found by any of them. Rows with a null key or text aren't found."""
    texts = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).dropna()
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the outer form, as the inner one would be tested for being empty first, and a table, as ranges are sampled: grams are made once
    each = materialised(texts.repartition(n, "key").select("key", F.explode_outer(grams(F.col("text"))).alias("gram")), "grams")
    postings = materialised(each.dropna().repartitionByRange(n, "gram", "key").sortWithinPartitions("gram", "key").select("gram", "key"), "grams")
    deleted(each)
    counts = materialised(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).repartitionByRange(max(1, n // 4), "gram").sortWithinPartitions("gram"), "gram-counts")
    return Index(postings, counts, texts)


def phased(phases: list, key: str, limit: int = LIMIT) -> tuple[DataFrame, int]:
    """``(key, priority)``: matches of phases, each once under its first, the first ``limit`` by priority and key.

    ``phases`` are functions that give a phase's matches, a frame with ``key``; one is called only
    while fewer than ``limit`` are found, and the number of those called is returned, too. Never more
    than ``limit`` keys are held between phases.
    """
    found, count, called = None, 0, 0
    for k, phase in enumerate(phases):
        rows = phase().select(key).distinct()
        if found is not None:
            rows = rows.join(found.select(key), key, "left_anti")
        new = rows.orderBy(key).limit(limit - count).withColumn("priority", F.lit(k + 1))
        found = materialised(new if found is None else found.unionByName(new), "found")
        count, called = found.count(), k + 1
        if count >= limit:
            break
    return found.orderBy("priority", key), called
