"""What the operators of this subpackage share: tables, the shared folder, written intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset, as in tests on a local master, a temporary folder is used.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='glasswing-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Shuffle files go when the job that made them has ended, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: With one, rows that are dealt out by bucket already aren't sorted by it before they are written.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet to the shared folder and reads it back.

    What the write has shuffled is deleted once the table is whole, as nothing else reads it. A frame
    that ``bucketed`` has made is written as a table of buckets.
    """
    spark, key = df.sparkSession, getattr(df, "bucketed_by", None)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    as_table = path.rsplit("/", 1)[1].replace("-", "_")
    before = {k: spark.conf.get(k) for k in (CLEANUP, WRITERS)}
    spark.conf.set(CLEANUP, "true")
    writer = df.write.options(**{"compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.compression.codec.zstd.bufferPool.enabled": "false"})
    try:
        if key is None:
            writer.parquet(path)
        else:
            spark.conf.set(WRITERS, "1")
            writer.option("path", path).format("parquet").bucketBy(partitions(spark), key).saveAsTable(as_table)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path) if key is None else spark.table(as_table)
    out.written_to = path
    if key is not None:
        out.written_as = as_table
    return out


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Has ``written`` make a table of buckets by ``key``, which joins on the key don't shuffle; ``df`` must be dealt out by the key already."""
    df.bucketed_by = key
    return df


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` has made, once all that is made from them is written itself."""
    for t in tables:
        spark = t.sparkSession
        if hasattr(t, "written_as"):
            spark.sql(f"DROP TABLE {t.written_as}")
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def sorted_shuffles(spark: SparkSession) -> Iterator[None]:
    """More than 200 shuffle partitions, from which on a task sorts its rows by partition and writes one file, not one for each partition first; few partitions stay as they are."""
    name, before = "spark.sql.shuffle.partitions", partitions(spark)
    spark.conf.set(name, str(before if before < 64 else max(before, 201)))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


def text_of(col: Column | str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts, joined by colons.

    MD5 because every SQL engine has it; nulls count as the empty string.
    """
    key = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def fresh(taken: list[str], *names: str) -> list[str]:
    """Names for an operator's own columns that none of ``taken`` has, in any case."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        out.append(name)
    return out


def short_batches(spark: SparkSession, rows: int = 500) -> None:
    """Python workers get at most so many rows at once, as a row may hold a very long text."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
