"""Totals of every directory with all that lies below it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasswing.functions.paths import parent


def ancestors(directory: Column) -> Column:
    """A directory and all those above it, the root, an empty path, included."""
    steps = F.filter(F.split(directory, "/"), lambda s: s != "")
    return F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))


def rolled_up(rows: DataFrame, root: str, directory: str, **sums: Column) -> DataFrame:
    """``(root, directory, sums...)``: sums over all rows of each directory and of those below it.

    Rows are summed by their own directory first, then each directory's sums go to its ancestors,
    summed again before that shuffle: what is shuffled are directories, at most their number times
    their depth, however many rows one directory has. Null directories count as the root; null
    values add nothing.
    """
    own = rows.groupBy(F.col(root).alias("_r"), F.coalesce(F.col(directory), F.lit("")).alias("_d")).agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    up = own.select("_r", F.explode(ancestors(F.col("_d"))).alias("_d"), *sums)
    out = up.groupBy("_r", "_d").agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in sums])
    return out.select(F.col("_r").alias(root), F.col("_d").alias(directory), *sums)


def usage(files: DataFrame) -> DataFrame:
    """``(root_id, rel_path, total_size, files, directories)`` of every directory of a listing, the root as an empty path.

    A directory doesn't count among its own directories; one without entries has zeros. Directories
    that only files' paths show have a row, and are counted only where the listing has them.
    """
    is_dir = F.coalesce(F.col("is_dir"), F.lit(False))
    entries = files.select("root_id", parent(F.col("rel_path")).alias("rel_path"), F.when(~is_dir, F.col("size")).alias("s"), F.when(~is_dir, 1).alias("f"), F.when(is_dir, 1).alias("d"))
    none = F.lit(None).cast("int")
    empty = files.where(is_dir).select("root_id", "rel_path", F.lit(None).cast("long").alias("s"), none.alias("f"), none.alias("d"))
    return rolled_up(entries.unionByName(empty), "root_id", "rel_path", total_size=F.col("s"), files=F.col("f"), directories=F.col("d"))


def detections(found: DataFrame) -> DataFrame:
    """``(root_id, rel_path, scanned, with_person)`` of every directory: files looked at in it and below it."""
    rows = found.select("root_id", parent(F.col("rel_path")).alias("rel_path"), F.when(F.col("has_person"), 1).otherwise(0).alias("p"))
    return rolled_up(rows, "root_id", "rel_path", scanned=F.lit(1), with_person=F.col("p"))
