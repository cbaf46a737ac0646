import math
from collections import Counter

from pyspark.sql import functions as F

from glasswing.llm import mixing
from glasswing.llm.common import uniform


def poisson(u, rate):
    k, p, cdf = 0, math.exp(-rate), math.exp(-rate)
    while cdf <= u:
        k += 1
        p *= rate / k
        cdf += p
    return k


def test_counts_follow_the_inverted_distribution(spark, docs):
    own = docs.where("doc_id is not null")
    rate = {r.source: r.rate for r in mixing.rates(own).collect()}
    want = Counter()
    for r in own.select("doc_id", "source", uniform(1, 0, F.col("doc_id")).alias("u")).collect():
        want[r.doc_id] += poisson(r.u, rate[r.source])
    got = Counter(r.doc_id for r in mixing.replicate(own).collect())
    assert got == +want


def test_shares_reach_the_targets(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("x" * 9).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("source"))
    got = {r.source: r["count"] for r in mixing.replicate(rows, {"hot": 1.0, "cold": 3.0}, epochs=2.0).groupBy("source").count().collect()}
    assert abs(got["hot"] - 15_000) < 600 and abs(got["cold"] - 45_000) < 1000


def test_large_rates_are_sums_of_parts(spark):
    rows = spark.createDataFrame([(i, "x", "rare") for i in range(20)] + [(100, "y" * 40_000, "big")], "doc_id long, text string, source string")
    assert mixing.rates(rows).where("source = 'rare'").first().parts > 1
    n = mixing.replicate(rows).where("source = 'rare'").count()
    assert abs(n - 20 * 40_041 / 2 / 40) < 700


def test_many_sources_are_joined_without_broadcast(spark, docs, monkeypatch):
    want = sorted(map(str, mixing.replicate(docs).select("doc_id", "source", "shuffle_key").collect()))
    monkeypatch.setattr(mixing, "MAX_SOURCES", 0)
    assert sorted(map(str, mixing.replicate(docs).select("doc_id", "source", "shuffle_key").collect())) == want


def test_order_columns_and_empty_tables(docs, empty):
    out = mixing.replicate(docs, epochs=3.0)
    assert set(out.columns) == {*docs.columns, "shuffle_key"} and dict(out.dtypes)["copy"] == "int"
    keys = [r.shuffle_key for r in out.collect()]
    assert keys == sorted(keys)
    assert mixing.replicate(empty).count() == 0
    assert mixing.replicate(docs, {"s1": 1.0}, default=0.0).select("source").distinct().collect() == [("s1",)]
