"""A directory tree as a stream of new and changed files.

An offset is a time of the file system. A batch has the files whose entry or content changed after
its first offset and not after its last, by ``ctime``, which also tells files that were moved in with
an old ``mtime``. A file that changes again later belongs to a later batch, so a batch that is run
again after a restart gives no file twice over the stream's life, unless it changed in between.

Tasks walk subtrees that the driver deals out. Each leaves in the state folder, under the batch's last
offset, what its directories held: a directory whose own time hasn't changed since is not listed
again, its known files are only asked for their times. Where that is missing, as at the first batch
or where subtrees were dealt out otherwise, directories are listed, which changes no result.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from glasswing.sources.tree import Roots, TreeReader, depth_of, kind_of, plain, typed

SCHEMA = "root_id string, rel_path string, is_dir boolean, size long, mtime long, mod_time timestamp, depth int, media_type string, listed boolean"


class _Span(InputPartition):
    def __init__(self, rel: str, deep: bool, after: int, until: int):
        self.rel, self.deep, self.after, self.until = rel, deep, after, until


class ChangesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.root, self.root_id, self.start = options, options["path"], options.get("root_id", "root-0"), options.get("start", "")
        self.state, self.lag = options["state"].removeprefix("file://"), int(options.get("lag_ms", "200")) * 1_000_000
        os.makedirs(self.state, exist_ok=True)

    def initialOffset(self) -> dict:
        return {"ns": 0}

    def latestOffset(self) -> dict:
        """A little before now: the file system's clock is coarser than the system's."""
        return {"ns": time.time_ns() - self.lag}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts = TreeReader(self.options).partitions()
        return [_Span(p.rel, p.deep, start["ns"], end["ns"]) for p in parts]

    def known(self, part: _Span, at: int) -> str:
        key = hashlib.sha256(f"{self.root}\0{part.rel}\0{part.deep}".encode()).hexdigest()
        return f"{self.state}/{key}-{at}.json"

    def read(self, part: _Span) -> Iterator[tuple]:
        try:
            with open(self.known(part, part.after)) as f:
                before = json.load(f)
        except (OSError, ValueError):
            before = {}
        now, left = {}, [part.rel]
        while left:
            rel = left.pop()
            path = os.path.join(self.root, rel)
            try:
                changed = os.stat(path).st_mtime_ns
                listed = before.get(rel, [None])[0] != changed or changed > part.after
                if listed:
                    with os.scandir(path) as found:
                        entries = [(e.name, e.is_dir(follow_symlinks=False)) for e in found if not e.name.startswith(".")]
                else:
                    entries = [tuple(e) for e in before[rel][1]]
            except OSError:  # gone, or not to be read
                continue
            now[rel] = [changed, entries]
            for name, own in entries:
                below = f"{rel}/{name}" if rel else name
                if own:
                    left += [below] * part.deep
                    continue
                try:
                    s = os.stat(os.path.join(self.root, below), follow_symlinks=False)
                except OSError:
                    continue
                if part.after < s.st_ctime_ns <= part.until:
                    yield self.root_id, plain(below), False, s.st_size, int(s.st_mtime), datetime.fromtimestamp(int(s.st_mtime), timezone.utc), depth_of(below), kind_of(name), listed
        draft = f"{self.known(part, part.until)}.{os.getpid()}"
        with open(draft, "w") as f:
            json.dump(now, f)
        os.replace(draft, self.known(part, part.until))

    def commit(self, end: dict) -> None:
        """Forgets what subtrees held at offsets before the one that is done."""
        for name in os.listdir(self.state):
            at = name.rpartition("-")[2].split(".")[0]
            if at.isdigit() and int(at) < end["ns"]:
                try:
                    os.remove(f"{self.state}/{name}")
                except FileNotFoundError:
                    continue


class ChangesSource(DataSource):
    """``spark.readStream.format("tree_changes")`` with options ``path``, ``state``, ``root_id``, ``start``, ``recursive``, ``lag_ms``."""

    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ChangesReader:
        return ChangesReader(dict(self.options))


def changes(spark: SparkSession, roots: Roots, root_id: str, state: str, start: str = "", **options: str) -> DataFrame:
    """A stream of the new and changed files below a directory, as a typed listing.

    ``state`` is a folder that driver and executors share, as are the roots.
    """
    real = roots.resolve(root_id, start)
    spark.dataSource.register(ChangesSource)
    rel = os.path.relpath(real, roots.paths[root_id])
    return typed(spark.readStream.format("tree_changes").options(path=roots.paths[root_id], root_id=root_id, start="" if rel == "." else rel, state=state, **options).load())
