"""Listings of a directory with what is known of its entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glasswing.functions.media import crc32_in_name
from glasswing.functions.paths import directly_in


def nested_tags(tags: DataFrame, on: list[str]) -> DataFrame:
    """One row for each file with its tags by falling score."""
    by_score = F.array_sort(F.collect_list(F.struct("label", "score")), lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0))
    return tags.groupBy(*on).agg(by_score.alias("tags"))


def without_people(entries: DataFrame, flag: str = "has_person") -> DataFrame:
    """Entries not known to show a person; those never looked at stay."""
    return entries.where(~F.coalesce(F.col(flag), F.lit(False)))


def tagged_or_directories(entries: DataFrame, tags: DataFrame, label: str, on: list[str], least: float = 0.0) -> DataFrame:
    """Directories, and files with a label of at least so high a score."""
    match = tags.where((F.col("label") == label) & (F.col("score") >= least)).select(*on, F.lit(True).alias("_match")).distinct()
    return entries.join(match, on, "left").where(F.col("is_dir") | F.coalesce("_match", F.lit(False))).drop("_match")


def list_directory(files: DataFrame, detections: DataFrame, tags: DataFrame, hashes: DataFrame, texts: DataFrame, directory: str, no_people: bool = False, tag: str | None = None) -> DataFrame:
    """Direct children of a directory with person flag, tags, hashes and text, directories first, then by name.

    The scope is applied to every table before it is joined. A stored CRC-32 goes before one in the name.
    """
    on = ["root_id", "rel_path"]
    here = lambda df: df.where(directly_in(F.col("rel_path"), directory))
    out = here(files).join(here(detections).select(*on, "has_person"), on, "left")
    if no_people:
        out = without_people(out)
    scoped = here(tags)
    if tag:
        out = tagged_or_directories(out, scoped, tag, on)
    out = out.join(nested_tags(scoped, on), on, "left")
    out = out.join(here(hashes).where("sha256 is not null or crc32 is not null").select(*on, "sha256", F.col("crc32").alias("_crc")), on, "left")
    out = out.withColumn("crc32", F.coalesce("_crc", crc32_in_name(F.col("name")))).drop("_crc")
    out = out.join(here(texts).where("text <> ''").select(*on, F.col("text").alias("ocr_text")), on, "left")
    return out.orderBy(F.desc("is_dir"), "name")


def by_locale(entries: DataFrame, name: str = "name", collation: str = "UNICODE") -> DataFrame:
    """Directories first, then names as people order them: by letters before case and accents."""
    return entries.orderBy(F.desc("is_dir"), F.collate(name, collation), name)


def images(files: DataFrame) -> DataFrame:
    """Image files in the order of their names."""
    return files.where("not is_dir and media_type = 'image'").orderBy("name")


def ordered(entries: DataFrame, by: str = "name", descending: bool = False, tie: str = "name") -> DataFrame:
    """Directories first, then by a column, ties by name."""
    return entries.orderBy(F.desc("is_dir"), F.desc(by) if descending else F.asc(by), tie)


def neighbours(rows: DataFrame, scope: str, order: Column | str, key: str) -> DataFrame:
    """Each row's ``previous`` and ``next`` within its scope, around the ends."""
    w = Window.partitionBy(scope).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("previous", F.coalesce(F.lag(key).over(w), F.last(key).over(whole))).withColumn("next", F.coalesce(F.lead(key).over(w), F.first(key).over(whole)))


def between(rows: DataFrame, scope: str, order: str, first: int, last: int) -> DataFrame:
    """Rows of a scope from one place of its order to another, in either direction, from 0."""
    low, high = sorted((first, last))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(scope).orderBy(order)) - 1).where(F.col("_n").between(low, high)).drop("_n")


def first_image(files: DataFrame, cached: str = "cached") -> DataFrame:
    """The image that stands for each directory: the first cached one, else the first, by name."""
    return files.where("media_type = 'image'").groupBy("root_id", "parent").agg(F.min_by("rel_path", F.struct(~F.col(cached), F.col("name"))).alias("rel_path"))


def directories_with_images(files: DataFrame) -> DataFrame:
    return files.where("media_type = 'image'").select("root_id", "parent").distinct()


def directories(entries: DataFrame) -> DataFrame:
    """Only the directories, by name."""
    return entries.where("is_dir").orderBy("name")


def selected(entries: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The entries that a selection names; names of nothing select nothing."""
    return entries.join(keys.select(*on), on, "left_semi")


def selection_summary(entries: DataFrame) -> DataFrame:
    """One row for a selection: bytes of its files, numbers of its files and directories; zeros for none."""
    return disk_usage(entries)


def labels_in_use(tags: DataFrame) -> DataFrame:
    return tags.select("label").distinct().orderBy("label")


def disk_usage(files: DataFrame) -> DataFrame:
    """One row: bytes of files, numbers of files and of directories."""
    return files.agg(F.coalesce(F.sum(F.when(~F.col("is_dir"), F.col("size"))), F.lit(0)).alias("total_size"), F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("directories"))


def detection_status(detections: DataFrame) -> DataFrame:
    """One row: files looked at and files with a person."""
    return detections.agg(F.count(F.lit(1)).alias("scanned"), F.coalesce(F.sum(F.when(F.col("has_person"), 1).otherwise(0)), F.lit(0)).alias("with_person"))


def outcome(results: DataFrame) -> DataFrame:
    """One row: 500 if every item of a bulk operation failed, 207 if some did, else 200."""
    failed = F.col("error").isNotNull()
    return results.agg(F.when(F.coalesce(F.bool_and(failed), F.lit(False)), 500).when(F.coalesce(F.bool_or(failed), F.lit(False)), 207).otherwise(200).alias("status"))
