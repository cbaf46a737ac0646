"""Results of a video's frames merged to results of the video."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def any_person(frames: DataFrame, key: str) -> DataFrame:
    """Whether any frame shows a person, and the highest confidence."""
    return frames.groupBy(key).agg(F.bool_or("has_person").alias("has_person"), F.max("confidence").alias("confidence"))


def highest_tags(frames: DataFrame, key: str, label: str = "label", score: str = "score") -> DataFrame:
    """The highest score of each label; scores that aren't positive don't count."""
    return frames.where(F.col(score) > 0).groupBy(key, label).agg(F.max(score).alias(score))


def first_texts(blocks: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """The first block of each trimmed, non-empty text, in frame order."""
    rows = blocks.withColumn(text, F.trim(text)).where(F.col(text) != "")
    return rows.groupBy(key, text).agg(F.min(order).alias(order))


def first_blocks(blocks: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """The whole first block of each trimmed, non-empty text: its box and confidence, from the frame that had it first."""
    rows = blocks.withColumn(text, F.trim(text)).where(F.col(text) != "")
    whole = F.struct(order, *[c for c in blocks.columns if c not in (key, text, order)])
    return rows.groupBy(key, text).agg(F.min_by(whole, order).alias("_b")).select(key, text, "_b.*")


def joined_text(blocks: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """One text for each key: its distinct texts in frame order, a line each."""
    rows = first_texts(blocks, key, order, text)
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text)))), lambda s: s[text]), "\n").alias(text))


def collapsed(steps: DataFrame, key: str, order: list[str], symbol: str, blank: str) -> DataFrame:
    """Steps without blanks and without repeats of the step before."""
    w = Window.partitionBy(key).orderBy(*order)
    return steps.withColumn("_before", F.lag(symbol).over(w)).where((F.col(symbol) != blank) & ~F.col(symbol).eqNullSafe(F.col("_before"))).drop("_before")
