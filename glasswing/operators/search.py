"""Search over names, tags and recognised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasswing.functions.paths import below

#: Results of a search at most.
LIMIT = 500


def contains(value: Column, query: str) -> Column:
    """Whether a text contains a query in any case; wildcard characters mean themselves."""
    return F.contains(F.lower(value), F.lit(query.lower()))


def merged(phases: list[DataFrame], key: str | list[str], limit: int = LIMIT) -> DataFrame:
    """``(key, priority)``: matches of all phases, each once under its first phase, the first ``limit``.

    Aggregated before the shuffle; the limit is a sorted top that never gathers all matches.
    """
    all_, key = None, [key] if isinstance(key, str) else list(key)
    for k, phase in enumerate(phases):
        rows = phase.select(*key, F.lit(k + 1).alias("priority"))
        all_ = rows if all_ is None else all_.unionByName(rows)
    return all_.groupBy(*key).agg(F.min("priority").alias("priority")).orderBy("priority", *key).limit(limit)


def scoped(rows: DataFrame, root_id: str | None, path: str) -> DataFrame:
    """Rows of one root and below one path; of all where there is none."""
    if root_id is not None:
        rows = rows.where(F.col("root_id") == root_id)
    return rows if path.strip("/") == "" else rows.where(below(F.col("rel_path"), path))


def search(files: DataFrame, tags: DataFrame, texts: DataFrame, query: str, key: list[str] | None = None, limit: int = LIMIT, root_id: str | None = None, path: str = "") -> DataFrame:
    """Files whose name contains a query, then those with such a tag, then those with such a text.

    ``root_id`` and ``path`` bound the search, before anything is joined. Tags and texts of files
    that are gone don't count. An empty query finds nothing. A file's key is its root and path, or
    its path alone where the files have no root.
    """
    key = key or [c for c in ("root_id", "rel_path") if c in files.columns]
    files, tags, texts = (scoped(rows, root_id, path) for rows in (files, tags, texts))
    if not query.strip():
        return files.limit(0).select(*key, F.lit(0).alias("priority"))
    there = files.select(*key)
    by_name = files.where(~F.col("is_dir") & contains(F.col("name"), query))
    by_tag = tags.where(contains(F.col("label"), query)).join(there, key, "left_semi")
    by_text = texts.where(contains(F.col("text"), query)).join(there, key, "left_semi")
    return merged([by_name, by_tag, by_text], key, limit)


def enriched(found: DataFrame, sides: list[DataFrame], on: list[str]) -> DataFrame:
    """Found rows with what other tables hold of them, one set-based left join each, after the limit."""
    for side in sides:
        found = found.join(side, on, "left")
    return found
