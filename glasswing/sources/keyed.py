"""A keyed table of parents with their children, changed by transactions.

Rows lie in buckets of the key's hash, each bucket's parents and children in Parquet files of their
own. A change merges the touched buckets by Spark joins and writes them through a data source: its
tasks write new files, and only its commit adds a snapshot, one small file that lists the files of
all buckets. Parents and children become visible together by that file. A task that fails leaves the
last snapshot as it was, and the abort deletes what the others wrote. A snapshot's name is its
number and is made exclusively, so of two changes of the same snapshot the second fails.

The folder must be mounted where the driver and the executors run.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from glasswing.functions.paths import canonical
from glasswing.operators.tables import deleted, materialised

KINDS = ("parents", "children")
SIDES = {"parents": "parent", "children": "child"}


class Conflict(RuntimeError):
    """Another change has been committed since the one that failed had read the table."""


def local(path: str) -> str:
    return path.removeprefix("file://")


def snapshots(path: str) -> list[int]:
    """The numbers of all snapshots, ascending."""
    try:
        return sorted(int(n[:-5]) for n in os.listdir(f"{path}/snapshots") if n.endswith(".json"))
    except FileNotFoundError:
        return []


def snapshot(path: str, number: int | None = None) -> dict:
    """``{"number", "files": {bucket: {kind: [names]}}}`` of a snapshot, of the last one, or of the empty table."""
    last = snapshots(path)
    if number is None:
        number = last[-1] if last else 0
    if number == 0:
        return {"number": 0, "files": {}}
    with open(f"{path}/snapshots/{number:012d}.json") as f:
        return json.load(f)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str, str]] = field(default_factory=list)


class KeyedWriter(DataSourceArrowWriter):
    """Writes rows ``(bucket, kind, parent, child)``, sorted by bucket and kind within each partition."""

    def __init__(self, options: dict):
        self.path, self.base, self.touched = options["path"], int(options["base"]), json.loads(options["touched"])

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        out, at, writer = Written(), None, None
        try:
            for batch in batches:
                rows = pa.Table.from_batches([batch])
                places = list(zip(rows["bucket"].to_pylist(), rows["kind"].to_pylist(), strict=True))
                edges = [i for i in range(len(places)) if i == 0 or places[i] != places[i - 1]] + [len(places)]
                for first, end in zip(edges, edges[1:], strict=False):
                    bucket, kind = places[first]
                    part = pa.Table.from_struct_array(rows[SIDES[kind]].slice(first, end - first))
                    if (bucket, kind) != at:
                        if writer:
                            writer.close()
                        name = f"data/{kind}-{bucket}-{uuid.uuid4().hex}.parquet"
                        out.files.append((bucket, kind, name))
                        writer, at = pq.ParquetWriter(f"{self.path}/{name}", part.schema, compression="zstd"), (bucket, kind)
                    writer.write_table(part)
        except BaseException:
            self.remove(out)
            raise
        finally:
            if writer:
                writer.close()
        return out

    def remove(self, message: Written) -> None:
        for _, _, name in message.files:
            if os.path.exists(f"{self.path}/{name}"):
                os.remove(f"{self.path}/{name}")

    def commit(self, messages: list[Written | None]) -> None:
        files = {b: kinds for b, kinds in snapshot(self.path, self.base)["files"].items() if int(b) not in self.touched}
        for bucket, kind, name in (f for m in messages if m for f in m.files):
            files.setdefault(str(bucket), {}).setdefault(kind, []).append(name)
        number, draft = self.base + 1, f"{self.path}/snapshots/{uuid.uuid4().hex}"
        with open(draft, "w") as f:
            json.dump({"number": number, "files": files}, f)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, f"{self.path}/snapshots/{number:012d}.json")
        except FileExistsError:
            self.abort(messages)
            raise Conflict(f"snapshot {number} exists") from None
        finally:
            os.remove(draft)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m:
                self.remove(m)


class KeyedSource(DataSource):
    """``df.write.format("keyed")`` with options ``path``, ``base`` and ``touched``; ``KeyedTable`` gives them."""

    @classmethod
    def name(cls) -> str:
        return "keyed"

    def writer(self, schema: StructType, overwrite: bool) -> KeyedWriter:
        return KeyedWriter(dict(self.options))


class KeyedTable:
    """Parents ``(key..., values...)`` and children ``(key..., fields...)`` in a folder.

    ``parents`` and ``children`` are DDL schemas, both with the columns of ``key`` first. ``paths``
    names key columns that are paths; they are stored in their one canonical spelling. Keys must not
    be null: such rows are left out. The number of buckets is set once, when the folder is made.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], parents: str, children: str, paths: tuple[str, ...] = (), buckets: int = 64):
        self.spark, self.path, self.key, self.paths = spark, local(path), key, paths
        self.schemas = {k: StructType.fromDDL(s) for k, s in zip(KINDS, (parents, children), strict=True)}
        for d in ("data", "snapshots"):
            os.makedirs(f"{self.path}/{d}", exist_ok=True)
        try:
            with open(f"{self.path}/buckets", "x") as f:
                f.write(str(buckets))
        except FileExistsError:
            with open(f"{self.path}/buckets") as f:
                buckets = int(f.read())
        self.buckets = buckets
        spark.dataSource.register(KeyedSource)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.key]), F.lit(self.buckets)).cast("int")

    def read(self, kind: str, number: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """All rows of a kind as of a snapshot, or those of some buckets."""
        files = snapshot(self.path, number)["files"]
        names = [n for b, kinds in files.items() if buckets is None or int(b) in buckets for n in kinds.get(kind, [])]
        if not names:
            return self.spark.createDataFrame([], self.schemas[kind])
        return self.spark.read.schema(self.schemas[kind]).parquet(*[f"file://{self.path}/{n}" for n in names])

    def parents(self, number: int | None = None) -> DataFrame:
        return self.read("parents", number)

    def children(self, number: int | None = None) -> DataFrame:
        return self.read("children", number)

    def get(self, keys: DataFrame) -> DataFrame:
        """The parents of asked keys with ``children``, an array; only their buckets are read."""
        keys = self._spelled(keys.select(*self.key)).distinct()
        some, number = self._touched(keys), snapshot(self.path)["number"]
        fields = [c for c in self.schemas["children"].names if c not in self.key]
        found = self.read("parents", number, some).join(keys, self.key, "left_semi")
        of = self.read("children", number, some).join(keys, self.key, "left_semi")
        return found.join(of.groupBy(*self.key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("children")), self.key, "left")

    def put(self, rows: DataFrame, order: list[str], children: str = "children") -> int:
        """Takes ``rows`` in the place of those with the same key, children included; returns the snapshot's number.

        Of rows that repeat a key the one with the greatest ``order`` stays, on a tie the greatest by
        all values; the winner is found before the shuffle ends, so a key that most rows share is
        no load. ``children`` is an array of structs with the children's fields; null: none.
        """
        values = [c for c in self.schemas["parents"].names if c not in self.key]
        fields = [c for c in self.schemas["children"].names if c not in self.key]
        typed = self._spelled(rows).select(*self.key, F.struct(*order).alias("order"), F.struct(*values).alias("value"), F.col(children).alias("below"))
        best = F.max_by(F.struct("value", "below"), F.struct("order", F.to_json("value"))).alias("best")
        new = materialised(typed.groupBy(*self.key).agg(best).withColumn("bucket", self.bucket()), "keyed-new")
        try:
            parents = new.select(*self.key, "best.value.*")
            below = new.select(*self.key, F.explode("best.below").alias("child")).select(*self.key, *[F.col("child")[c].alias(c) for c in fields])
            return self._change(new, parents, below)
        finally:
            deleted(new)

    def delete(self, keys: DataFrame) -> int:
        """Takes the parents of keys away, and their children with them."""
        keys = self._spelled(keys.select(*self.key)).distinct().withColumn("bucket", self.bucket())
        return self._change(keys, None, None)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes all but the last snapshots and the files that none of those lists; returns how many files went."""
        numbers = snapshots(self.path)
        listed = {n for k in numbers[-keep:] for kinds in snapshot(self.path, k)["files"].values() for names in kinds.values() for n in names}
        for k in numbers[:-keep]:
            os.remove(f"{self.path}/snapshots/{k:012d}.json")
        gone = [n for n in os.listdir(f"{self.path}/data") if f"data/{n}" not in listed]
        for n in gone:
            os.remove(f"{self.path}/data/{n}")
        return len(gone)

    def _spelled(self, rows: DataFrame) -> DataFrame:
        for k in self.paths:
            rows = rows.withColumn(k, canonical(F.col(k)))
        return rows.dropna(subset=self.key)

    def _touched(self, keys: DataFrame) -> set[int]:
        """The buckets of keys: numbers, never more than there are buckets."""
        return {r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect()}

    def _change(self, keys: DataFrame, parents: DataFrame | None, below: DataFrame | None) -> int:
        base, touched = snapshot(self.path)["number"], self._touched(keys)
        new = {"parents": parents, "children": below}
        out = None
        for kind, side in SIDES.items():
            names = self.schemas[kind].names
            rows = self.read(kind, base, touched).join(keys.select(*self.key), self.key, "left_anti").select(*names)
            if new[kind] is not None:
                rows = rows.unionByName(new[kind].select(*[F.col(f.name).cast(f.dataType) for f in self.schemas[kind]]))
            struct = {s: F.struct(*names) if k == kind else F.lit(None).cast(self.schemas[k]) for k, s in SIDES.items()}
            rows = rows.select(self.bucket().alias("bucket"), F.lit(kind).alias("kind"), *[c.alias(s) for s, c in struct.items()])
            out = rows if out is None else out.unionByName(rows)
        out = out.repartition("bucket").sortWithinPartitions("bucket", "kind")
        out.write.format("keyed").options(path=self.path, base=base, touched=json.dumps(sorted(touched))).mode("append").save()
        return base + 1
