"""Scoring embeddings against label embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glasswing.functions.vectors import dot

#: Labels that are broadcast at most; ``blocked`` scores against more of them.
MOST_LABELS = 10_000


def similarities(items: DataFrame, labels: DataFrame, embedding: str = "embedding") -> DataFrame:
    """``items`` with ``labels(label, ord, grp, prototype)`` and their cosine, for unit vectors.

    Every item meets every label of the vocabulary, whose size is checked, in one broadcast array,
    so items are neither shuffled nor repeated before scoring.
    """
    if labels.limit(MOST_LABELS + 1).count() > MOST_LABELS:
        raise ValueError(f"over {MOST_LABELS} labels: score them by blocks")
    vocabulary = labels.agg(F.array_sort(F.collect_list(F.struct("ord", "label", "grp", "prototype"))).alias("l")).scalar()
    each = items.withColumn("_l", F.explode(vocabulary)).where(F.col(embedding).isNotNull())
    return each.withColumns({"label": F.col("_l.label"), "ord": F.col("_l.ord"), "grp": F.col("_l.grp"), "cosine": dot(F.col(embedding), F.col("_l.prototype"))}).drop("_l")


def grouped_tags(scored: DataFrame, key: str, scale: float = 100.0, threshold: float = 0.2) -> DataFrame:
    """The likeliest label of each group: softmax of scaled cosines, the first on a tie, if it reaches the threshold.

    Labels without a group don't take part. A group of n labels always has one of at least 1 / n.
    """
    group = Window.partitionBy(key, "grp")
    rows = scored.where("grp is not null").withColumn("_x", F.col("cosine") * scale)
    rows = rows.withColumn("_e", F.exp(F.col("_x") - F.max("_x").over(group)))
    rows = rows.withColumn("p", F.col("_e") / F.sum("_e").over(group))
    rows = rows.withColumn("_r", F.row_number().over(group.orderBy(F.desc("p"), "ord")))
    return rows.where((F.col("_r") == 1) & (F.col("p") >= threshold)).drop("_x", "_e", "_r")


def plain_tags(scored: DataFrame, threshold: float) -> DataFrame:
    """Labels whose cosine reaches the threshold."""
    return scored.where(F.col("cosine") >= threshold)


def top(rows: DataFrame, key: str, score: str, n: int, tie: str) -> DataFrame:
    """The ``n`` best rows of each key with their ``rank``."""
    w = Window.partitionBy(key).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
