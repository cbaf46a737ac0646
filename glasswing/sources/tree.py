"""Directory trees as DataFrames, by a Python data source.

Spark's own file listing leaves out names that begin with an underscore and never reports
directories; this one hides names that begin with a dot only. The driver deals out the root's
subdirectories, each task walks its own, so a large tree is read by many tasks. Roots must be
mounted where executors run.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not, StringStartsWith

from glasswing.functions.media import ARCHIVE, IMAGE, PDF, VIDEO, has_thumbnail
from glasswing.functions.paths import basename, extension, parent

SCHEMA = "root_id string, rel_path string, is_dir boolean, size long, mtime long, mod_time timestamp, depth int, media_type string"

#: Directories that the driver opens before it deals them out.
PARTS = 256
_KINDS = {e: kind for kind, known in (("image", IMAGE), ("video", VIDEO), ("archive", ARCHIVE), ("pdf", PDF)) for e in known}


class RootError(ValueError):
    """A root or a path below it that can't be used."""


class Roots:
    """Named directories in the order of the configuration; their ids are ``root-<number>``."""

    def __init__(self, named: dict[str, str]):
        self.paths: dict[str, str] = {}
        self.names: dict[str, str] = {}
        for i, (name, path) in enumerate(named.items()):
            real = os.path.realpath(path)
            if not os.path.isdir(real):
                raise RootError(f"{path} is no directory")
            self.paths[f"root-{i}"], self.names[f"root-{i}"] = real, name

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, self.names[i], p, k) for k, (i, p) in enumerate(self.paths.items())], "root_id string, name string, path string, ord int")

    def resolve(self, root_id: str, rel: str = "") -> str:
        """The real path of something below a root; nothing leads out of it, symbolic links included."""
        if root_id not in self.paths:
            raise RootError(f"no root {root_id}")
        root = self.paths[root_id]
        inside = os.path.normpath("/" + rel.replace("\\", "/")).lstrip("/")
        real = os.path.realpath(os.path.join(root, inside))
        if real != root and not real.startswith(root.rstrip("/") + "/"):
            raise RootError(f"{rel} leads out of its root")
        return real


class _Part(InputPartition):
    def __init__(self, rel: str, deep: bool):
        self.rel, self.deep = rel, deep


def _entries(path: str) -> Iterator[os.DirEntry]:
    """Entries of a directory but for hidden ones, as they are read; none of one that can't be read."""
    try:
        with os.scandir(path) as found:
            yield from (e for e in found if not e.name.startswith("."))
    except OSError:
        return


def kind_of(name: str) -> str:
    """What ``functions.media.media_type`` gives, for a name in hand."""
    return _KINDS.get(name[name.rfind(".") :].lower() if "." in name else "", "other")


class Bounds:
    """What filters leave of a tree: a prefix, a depth, kinds of entries."""

    def __init__(self) -> None:
        self.prefix, self.exact, self.most, self.least, self.dirs, self.kinds, self.roots = "", None, None, None, None, None, None

    def take(self, f: Filter) -> bool:
        """Whether a filter has been taken up whole; the others stay with Spark."""
        name = getattr(f, "attribute", (None,))[0]
        if isinstance(f, IsNotNull):
            if name == "media_type":  # only directories have none
                return self.take(EqualTo(("is_dir",), False))
            return name in ("root_id", "rel_path", "depth", "is_dir")
        if isinstance(f, StringStartsWith) and name == "rel_path":
            return self._under(f.value)
        if isinstance(f, (EqualTo, In)):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            if name == "rel_path" and len(values) == 1:
                self.exact = values if self.exact is None else self.exact & values
                return self._under(*values)
            if name == "is_dir":
                self.dirs = values if self.dirs is None else self.dirs & values
            elif name == "media_type":
                self.kinds = values if self.kinds is None else self.kinds & values
            elif name == "root_id":
                self.roots = values if self.roots is None else self.roots & values
            elif name == "depth":
                self._deep(min(values), max(values))
                return len(values) == 1
            return name in ("is_dir", "media_type", "root_id")
        if isinstance(f, Not) and isinstance(f.child, EqualTo) and f.child.attribute == ("is_dir",):
            return self.take(EqualTo(("is_dir",), not f.child.value))
        if name == "depth":
            if isinstance(f, (LessThan, LessThanOrEqual)):
                self._deep(None, f.value - isinstance(f, LessThan))
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self._deep(f.value + isinstance(f, GreaterThan), None)
            return isinstance(f, (LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual))
        return False

    def _under(self, prefix: str) -> bool:
        """Prefixes that agree are one; those that don't leave the shorter one, and the filter with Spark."""
        if prefix.startswith(self.prefix):
            self.prefix = prefix
            return True
        return self.prefix.startswith(prefix)

    def _deep(self, least: int | None, most: int | None) -> None:
        if least is not None:
            self.least = least if self.least is None else max(self.least, least)
        if most is not None:
            self.most = most if self.most is None else min(self.most, most)

    def descend(self, rel: str) -> bool:
        """Whether anything wanted can lie below a directory."""
        rel = plain(rel)
        return (self.most is None or depth_of(rel) < self.most) and ((rel + "/").startswith(self.prefix) or self.prefix.startswith(rel + "/") or not rel)

    def wants(self, rel: str, is_dir: bool, kind: str | None) -> bool:
        n = depth_of(rel)
        return rel.startswith(self.prefix) and (self.exact is None or rel in self.exact) and (self.least is None or n >= self.least) and (self.most is None or n <= self.most) and (self.dirs is None or is_dir in self.dirs) and (self.kinds is None or kind in self.kinds)


def plain(rel: str) -> str:
    """The canonical spelling of a path that a walk has made."""
    return rel.replace("\\", "/")


def depth_of(rel: str) -> int:
    return rel.count("/") + 1 if rel else 0


class TreeReader(DataSourceReader):
    """Walks a tree within bounds. ``pushFilters`` takes up the filters that can close directories or spare entries a ``stat``."""

    def __init__(self, options: dict):
        self.root_id, self.root, self.start = options.get("root_id", "root-0"), options["path"], options.get("start", "")
        self.deep, self.stat = (options.get(k, "true").lower() == "true" for k in ("recursive", "stat"))
        self.first, self.opened = options.get("first", ""), options.get("report", "") == "opened"
        self.bounds = Bounds()
        self.bounds.prefix, self.bounds.most = json.loads(options.get("bounds", '["", null]'))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if self.opened or not self.bounds.take(f):
                yield f

    def partitions(self) -> list[InputPartition]:
        """Directories are opened level by level until there are enough of them to deal out whole."""
        if self.bounds.roots is not None and self.root_id not in self.bounds.roots:
            return []
        flat, level = [], [self.start]
        while self.deep and level and len(level) < PARTS and len(flat) < PARTS:
            below = [own for at in level if self.bounds.descend(at) for own, _ in self.directories(at)]
            flat, level = flat + level, [x for x in below if self.bounds.descend(x)]
        return [_Part(at, False) for at in flat] + [_Part(at, self.deep) for at in level]

    def directories(self, rel: str) -> Iterator[tuple[str, os.DirEntry]]:
        return ((own, e) for own, e in self.below(rel) if e.is_dir(follow_symlinks=False))

    def below(self, rel: str) -> Iterator[tuple[str, os.DirEntry]]:
        return ((f"{rel}/{e.name}" if rel else e.name, e) for e in _entries(os.path.join(self.root, rel)))

    def row(self, rel: str, entry: os.DirEntry) -> tuple | None:
        own = entry.is_dir(follow_symlinks=False)
        kind = None if own else kind_of(entry.name)
        rel = plain(rel)
        if not self.bounds.wants(rel, own, kind):
            return None
        size = mtime = at = None
        if self.stat:
            try:
                stat = entry.stat(follow_symlinks=False)
            except OSError:
                return None
            size, mtime = 0 if own else stat.st_size, int(stat.st_mtime)
            at = datetime.fromtimestamp(mtime, timezone.utc)
        return self.root_id, rel, own, size, mtime, at, depth_of(rel), kind

    def read(self, part: _Part) -> Iterator[tuple]:
        """Rows of a part of the tree; with ``first`` at most one of that media type from each directory."""
        left = [part.rel] if part else []  # no part at all where there is nothing to read
        while left:
            rel, done, n = left.pop(), False, 0
            if not self.bounds.descend(rel):
                continue
            for own, e in self.below(rel):
                n += 1
                if part.deep and e.is_dir(follow_symlinks=False) and self.bounds.descend(own):
                    left.append(own)
                if self.opened or done or self.first and kind_of(e.name) != self.first:
                    continue
                row = self.row(own, e)
                if row:
                    yield row
                    done = bool(self.first)
                    if done and not part.deep:
                        break
            if self.opened:
                yield self.root_id, plain(rel), True, n, None, None, depth_of(rel), None


class TreeSource(DataSource):
    """``spark.read.format("tree").option("path", ...)``.

    Options: ``root_id``, ``start``, ``recursive``; ``stat`` false leaves sizes and times null and
    touches no file; ``first`` a media type, of which each directory gives one entry at most;
    ``report`` ``opened`` gives a row for each directory that is opened, with its number of entries.
    """

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def source(spark: SparkSession, roots: Roots, root_id: str, start: str = "", **options: str) -> DataFrame:
    """Rows of the tree source below a directory. Filters on its columns are pushed down to the walk."""
    real = roots.resolve(root_id, start)
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rel = os.path.relpath(real, roots.paths[root_id])
    return spark.read.format("tree").options(path=roots.paths[root_id], root_id=root_id, start="" if rel == "." else rel, **options).load()


def scan(spark: SparkSession, roots: Roots, root_id: str, start: str = "", recursive: bool = True, stat: bool = True) -> DataFrame:
    """Everything below a directory, or only what lies directly in it, as a typed listing.

    Filters on ``rel_path`` (a prefix or one value), ``depth``, ``is_dir``, ``media_type`` and
    ``root_id`` keep the walk out of directories that hold nothing wanted. Without ``stat`` sizes
    and times are null and no file is touched.
    """
    return typed(source(spark, roots, root_id, start, recursive=str(recursive).lower(), stat=str(stat).lower()))


def opened(spark: SparkSession, roots: Roots, root_id: str, prefix: str = "", depth: int | None = None, start: str = "") -> DataFrame:
    """``(rel_path, entries)`` of the directories that a scan opens when it is filtered by a prefix and a depth."""
    rows = source(spark, roots, root_id, start, report="opened", bounds=json.dumps([prefix, depth]))
    return rows.select("rel_path", F.col("size").alias("entries"))


def directories_with(spark: SparkSession, roots: Roots, root_id: str, kind: str = "image", start: str = "") -> DataFrame:
    """``(root_id, rel_path)`` of the directories that hold a file of a media type; no file is touched, and a directory is left at its first such file."""
    rows = source(spark, roots, root_id, start, stat="false", first=kind)
    return rows.where(F.col("media_type") == kind).select("root_id", parent(F.col("rel_path")).alias("rel_path"))


def typed(rows: DataFrame) -> DataFrame:
    """Listing rows with name, parent and what their media type says."""
    name, kind = basename(F.col("rel_path")), F.col("media_type")
    return rows.select("root_id", "rel_path", name.alias("name"), parent(F.col("rel_path")).alias("parent"), "is_dir", (~F.col("is_dir") & (extension(name) == ".zip")).alias("is_zip"), "size", "mtime", "mod_time", "media_type", F.coalesce(has_thumbnail(kind), F.lit(False)).alias("has_thumb"), "depth")


def media_files(files: DataFrame, videos: bool = True) -> DataFrame:
    """Files that analysers look at."""
    return files.where(~F.col("is_dir") & F.col("media_type").isin("image", *(["video"] if videos else [])))


def with_hashes(files: DataFrame, roots: Roots) -> DataFrame:
    """A listing's files with ``sha256`` and ``crc32`` of their bytes, read in pieces; nulls where a file can't be read.

    Files are found by the listing, so names that begin with an underscore count, and rows keep their keys.
    """
    def hashes(ids: pd.Series, rels: pd.Series) -> pd.DataFrame:
        out = []
        for root_id, rel in zip(ids, rels, strict=True):
            sha, crc = hashlib.sha256(), 0
            try:
                with open(roots.resolve(root_id, rel), "rb") as f:
                    while piece := f.read(1 << 20):
                        sha.update(piece)
                        crc = zlib.crc32(piece, crc)
                out.append((sha.hexdigest(), f"{crc:08X}"))
            except (OSError, RootError):
                out.append((None, None))
        return pd.DataFrame(out, columns=["sha256", "crc32"])

    of = F.pandas_udf(hashes, "sha256 string, crc32 string")
    return files.where("not is_dir").withColumn("_h", of("root_id", "rel_path")).withColumns({k: F.col(f"_h.{k}") for k in ("sha256", "crc32")}).drop("_h")
