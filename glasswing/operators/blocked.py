"""Scoring against vocabularies of any size, in blocks whose states can be merged.

A block of labels is one array, sent with the tasks, and an item is scored against it within its own
row: no item is repeated or shuffled for that. What a group of labels leaves of an item and a block
is a state: the largest scaled score, the sum of the exponentials less it, and the best label with
its place. States of several blocks are merged by rescaling both sums to the larger maximum, so the
result doesn't depend on how labels are cut. A vocabulary of one block needs no exchange at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasswing.functions.vectors import dot

#: Numbers of a block's embeddings at most, so that what tasks are sent is bounded.
NUMBERS = 1 << 19


def blocks(labels: DataFrame, numbers: int = NUMBERS) -> list[Column]:
    """``labels(label, ord, grp, prototype)`` as arrays by group, each block with at most so many numbers.

    Blocks are cut by a hash of the label's place into as many as the size asks for, so they are
    about equal; each is read by itself, and only one at a time is on the driver.
    """
    size = labels.agg(F.sum(F.size("prototype")).alias("n")).head()["n"] or 0
    n = max(1, -(-2 * size // numbers)) if size > numbers else 1
    part = F.pmod(F.xxhash64("ord", "label"), F.lit(n))
    out = []
    for k in range(n):
        rows = (labels if n == 1 else labels.where(part == k)).groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("ord", "label", "prototype"))).alias("l"))
        out.append(rows.agg(F.array_sort(F.collect_list(F.struct("grp", "l"))).alias("g")).scalar())
    return out


def group_state(embedding: Column, group: Column, scale: float) -> Column:
    """``(grp, top, total, ord, label)`` of one group: the state of its softmax and its first best label."""
    scored = F.transform(group["l"], lambda x: F.struct((dot(embedding, x["prototype"]) * scale).alias("x"), x["ord"].alias("ord"), x["label"].alias("label")))
    best = F.reduce(scored, F.get(scored, F.lit(0)), lambda a, b: F.when((b["x"] > a["x"]) | ((b["x"] == a["x"]) & (b["ord"] < a["ord"])), b).otherwise(a))
    return F.struct(group["grp"].alias("grp"), best.alias("best"), scored.alias("scored"))


def states(items: DataFrame, key: str, block: Column, scale: float = 100.0, embedding: str = "embedding") -> DataFrame:
    """``(key, grp, best, total)`` for each item and group of a block; ``best`` has the scaled score ``x``, ``ord`` and ``label``."""
    rows = items.where(F.col(embedding).isNotNull()).select(F.col(key).alias(key), F.col(embedding).alias("e"), block.alias("b"))
    rows = rows.select(key, F.transform("b", lambda g: group_state(F.col("e"), g, scale)).alias("s"))
    rows = rows.select(key, F.explode("s").alias("s"))
    total = F.aggregate("s.scored", F.lit(0.0), lambda t, x: t + F.exp(x["x"] - F.col("s.best.x")))
    return rows.select(key, "s.grp", "s.best", total.alias("total"))


def merged(parts: list[DataFrame], key: str) -> DataFrame:
    """States of several blocks as one for each item and group."""
    if len(parts) == 1:
        return parts[0]
    rows = reduce(DataFrame.unionByName, parts)
    all_ = rows.groupBy(key, "grp").agg(F.max_by("best", F.struct(F.col("best.x"), -F.col("best.ord"))).alias("best"), F.collect_list(F.struct(F.col("best.x").alias("x"), "total")).alias("l"))
    total = F.aggregate("l", F.lit(0.0), lambda t, s: t + s["total"] * F.exp(s["x"] - F.col("best.x")))
    return all_.select(key, "grp", "best", total.alias("total"))


def grouped_tags(items: DataFrame, labels: DataFrame, key: str, scale: float = 100.0, threshold: float = 0.2, numbers: int = NUMBERS) -> DataFrame:
    """``(key, grp, label, ord, p)``: the likeliest label of each group, if it reaches the threshold.

    Softmax of scaled cosines within the group, the first label on a tie. Labels without a group and
    items without an embedding don't take part. ``key`` must tell items apart where there are several blocks.
    """
    cut = blocks(labels.where("grp is not null"), numbers)
    rows = merged([states(items, key, b, scale) for b in cut], key)
    return rows.select(key, "grp", "best.label", "best.ord", (1 / F.col("total")).alias("p")).where(F.col("p") >= threshold)


def best_labels(items: DataFrame, labels: DataFrame, key: str, n: int, embedding: str = "embedding", numbers: int = NUMBERS) -> DataFrame:
    """``(key, label, ord, cosine, rank)``: each item's ``n`` nearest labels, the first ones on ties.

    A block leaves its ``n`` best in the item's row, and those of several blocks are merged: ``n``
    rows for each item and block are shuffled, however many labels there are.
    """
    first = lambda a, b: F.when(a["c"] > b["c"], -1).when(a["c"] < b["c"], 1).when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)
    parts = []
    for block in blocks(labels, numbers):
        flat = F.flatten(F.transform("g", lambda g: F.transform(g["l"], lambda x: F.struct(dot(F.col("e"), x["prototype"]).alias("c"), x["ord"].alias("ord"), x["label"].alias("label")))))
        rows = items.where(F.col(embedding).isNotNull()).select(F.col(key).alias(key), F.col(embedding).alias("e"), block.alias("g"))
        parts.append(rows.select(key, F.slice(F.array_sort(flat, first), 1, n).alias("b")))
    rows = parts[0]
    if len(parts) > 1:
        rows = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.slice(F.array_sort(F.flatten(F.collect_list("b")), first), 1, n).alias("b"))
    rows = rows.select(key, F.posexplode("b").alias("i", "b"))
    return rows.select(key, "b.label", "b.ord", F.col("b.c").alias("cosine"), (F.col("i") + 1).alias("rank"))
