"""Result tables: what is stale, and what takes the place of what."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glasswing.functions.paths import canonical

#: Columns that must agree for a stored row to be fresh, by analyser; person detection ignores its version.
FRESH = {"detection": ["mtime", "size"], "classification": ["mtime", "size", "model_ver"], "ocr": ["mtime", "size", "model_ver"]}
KEY = ["root_id", "rel_path"]


def stale(files: DataFrame, stored: DataFrame, on: list[str], force: bool = False) -> DataFrame:
    """Files without a fresh stored row, or all of them."""
    return files if force else files.join(stored.select(*on), on, "left_anti")


def work(files: DataFrame, stores: dict[str, DataFrame], versions: dict[str, str], force: bool = False) -> DataFrame:
    """Files that any of the enabled analysers must look at, with a flag ``needs_<analyser>`` for each."""
    out = files
    for kind, stored in stores.items():
        rows = files.withColumn("model_ver", F.lit(versions.get(kind)))
        need = stale(rows, stored, KEY + FRESH[kind], force).select(*KEY, F.lit(True).alias(f"needs_{kind}"))
        out = out.join(need, KEY, "left").withColumn(f"needs_{kind}", F.coalesce(f"needs_{kind}", F.lit(False)))
    any_ = F.lit(False)
    for kind in stores:
        any_ = any_ | F.col(f"needs_{kind}")
    return out.where(any_)


def lookup(rows: DataFrame, **key: object) -> DataFrame:
    """The rows of one key, by equality that reaches the scan; a null value is looked up as one."""
    for name, value in key.items():
        rows = rows.where(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    return rows


def empty_as_null(rows: DataFrame, *names: str) -> DataFrame:
    """Text columns as they are stored: empty ones are null."""
    return rows.withColumns({n: F.nullif(F.col(n), F.lit("")) for n in names})


def null_as_empty(rows: DataFrame, *names: str) -> DataFrame:
    """Text columns as they are given out: null ones are empty."""
    return rows.withColumns({n: F.coalesce(F.col(n), F.lit("")) for n in names})


def latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def migrated(rows: DataFrame) -> DataFrame:
    """Rows under canonical keys, of each the one scanned last, on a tie the one whose key was canonical."""
    moved = rows.withColumn("_was", F.col("rel_path")).withColumn("rel_path", canonical(F.col("rel_path")))
    return latest(moved, KEY, F.desc("scanned_at"), F.col("_was") != F.col("rel_path"), F.col("_was")).drop("_was")


def upserted(stored: DataFrame, new: DataFrame, key: list[str] = KEY, order: list[str] | None = None) -> DataFrame:
    """Stored rows with new ones in the place of those with the same key.

    Of new rows that repeat a key the greatest by ``order`` stays, by default by all other columns as
    they stand; it is found before the shuffle ends, so a key of very many rows is no load.
    """
    rest = [c for c in new.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*(order or rest))) if rest else F.lit(None)
    last = new.groupBy(*key).agg(best.alias("_new")).select(*key, *[F.col("_new")[c].alias(c) for c in rest])
    return stored.join(last.select(*key), key, "left_anti").unionByName(last)


def get_or_compute(files: DataFrame, stored: DataFrame, compute: Callable[[DataFrame], DataFrame], key: list[str] = KEY) -> DataFrame:
    """Stored rows of the asked files, and computed ones for those that have none.

    A stored row counts whatever its version. ``compute`` gets the files without one and returns
    rows with the columns of ``stored``; only these files are read.
    """
    there = stored.join(files.select(*key).distinct(), key, "left_semi")
    return there.unionByName(compute(files.join(stored.select(*key), key, "left_anti")).select(*stored.columns))


def as_json(rows: DataFrame, name: str = "json") -> DataFrame:
    """Each row as the JSON text of a response."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def children_replaced(stored: DataFrame, new: DataFrame, parents: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Stored children with all those of rewritten parents replaced, also where there are no new ones."""
    return stored.join(parents.select(*key).distinct(), key, "left_anti").unionByName(new)


def cascaded(children: DataFrame, parents: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Children whose parent exists."""
    return children.join(parents.select(*key).distinct(), key, "left_semi")


def overridden(base: DataFrame, override: DataFrame, name: str = "name", order: str = "ord") -> DataFrame:
    """Rows of ``base`` with those of the same name replaced in their place, and new names after them."""
    last = base.agg(F.coalesce(F.max(order), F.lit(-1)).alias("_last")).scalar()
    place = base.select(name, F.col(order).alias("_place"))
    new = override.join(place, name, "left").withColumn(order, F.coalesce("_place", F.col(order) + last + 1)).drop("_place")
    return base.join(override.select(name), name, "left_anti").unionByName(new)


def queue_status(pending: Column, active: Column) -> Column:
    """Jobs that wait: pending ones that aren't active, never fewer than none."""
    return F.greatest(F.lit(0), pending - active)


def expired(files: DataFrame, days: int, now: Column) -> DataFrame:
    """Cached files older than so many days; all of them for zero."""
    return files.where(F.col("mod_time") < now - F.expr(f"INTERVAL {int(days)} DAYS")) if days > 0 else files
