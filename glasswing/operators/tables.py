"""Tables written to the folder that driver and executors share, in the place of cached lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on a local master without one, a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='glasswing-')}"
    return where.rstrip("/")


def materialised(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a Parquet table of its own, which a lost executor doesn't take along."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    out = rows.sparkSession.read.schema(rows.schema).parquet(path)
    out.written_to = path
    return out


def deleted(*tables: DataFrame) -> None:
    """Deletes tables of ``materialised`` once nothing reads them any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
