"""Files of the same content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repeated(files: DataFrame, content: str = "hash") -> DataFrame:
    """Rows whose content occurs more than once, with ``copies``; null contents have no copies.

    Counts are aggregated before the shuffle and joined back. Where the counts are few they are
    broadcast; where they aren't, a content of very many rows is one key of a join, which adaptive
    execution splits, and which ``skew.repeated`` spreads by itself.
    """
    often = files.where(F.col(content).isNotNull()).groupBy(content).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return files.join(often, content)


def groups(files: DataFrame, key: str, size: str, content: str = "hash") -> DataFrame:
    """A row for each repeated content: copies, the first key, its size, and the sizes' sum."""
    rows = files.where(F.col(content).isNotNull()).groupBy(content)
    return rows.agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_key"), F.min_by(size, key).alias("size"), F.sum(size).alias("total_size")).where("copies > 1")


def grouped_files(files: DataFrame, key: str, content: str = "hash") -> DataFrame:
    """Repeated contents with the ordered keys of their files; for reports, where groups are short."""
    return repeated(files, content).groupBy(content).agg(F.array_sort(F.collect_list(key)).alias("files")).orderBy(content)


def present(rows: DataFrame, files: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose file still exists."""
    return rows.join(files.select(*on).distinct(), on, "left_semi")


def either_hash(sha256: Column, crc32: Column) -> Column:
    """The stronger hash that a row has, empty strings counting as none."""
    return F.coalesce(F.nullif(sha256, F.lit("")), F.nullif(crc32, F.lit("")))
