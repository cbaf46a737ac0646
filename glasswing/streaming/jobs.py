"""Background work as Structured Streaming."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from glasswing.operators.store import stale
from glasswing.operators.tables import shared_folder


def file_stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """New files of a folder of Parquet as a stream; the source waits instead of dropping what is too much."""
    schema = spark.read.parquet(path).schema
    source = path if not path.endswith(".parquet") else f"{path[:-1]}[{path[-1]}]"  # a pattern, as a stream needs one, that only this name fits
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").parquet(source)


def deduplicated(jobs: DataFrame, keys: list[str], at: str = "ts", within: str = "1 hour") -> DataFrame:
    """Jobs of a stream, each key once within a delay; the state of older ones is dropped."""
    return jobs.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def distinct_jobs(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The keys of all jobs in a folder, each once, by a stream that takes what is there and ends.

    Keys are kept for as long as the query runs and survive a restart from its checkpoint.
    """
    folder = f"{shared_folder(spark)}/jobs-{uuid.uuid4().hex}"
    rows = file_stream(spark, path).select(*keys).dropDuplicates(keys)
    out = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


def run_jobs(jobs: DataFrame, read_stored: Callable[[], DataFrame], on: list[str], work: Callable[[DataFrame], None], checkpoint: str, force: bool = False, once: bool = True, enabled: Callable[[], bool] = lambda: True) -> StreamingQuery:
    """For each micro-batch ``work`` on the jobs that have no fresh stored result and come once in it.

    ``enabled`` is asked for each micro-batch, so that work is switched on and off while the stream
    runs; jobs that come while it is off are let go, and are planned again when they are asked for again.
    """

    def batch(df: DataFrame, _: int) -> None:
        if not enabled():
            return
        todo = stale(df.dropDuplicates(on), read_stored(), on, force)
        work(todo)

    writer = jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


class Scan:
    """At most one scan at a time: a new one stops the one before."""

    def __init__(self) -> None:
        self.query: StreamingQuery | None = None

    def start(self, begin: Callable[[], StreamingQuery]) -> StreamingQuery:
        self.stop()
        self.query = begin()
        return self.query

    def stop(self) -> None:
        if self.query is not None and self.query.isActive:
            self.query.stop()

    def status(self) -> dict:
        """Whether a scan runs, and the rows it has taken so far."""
        q = self.query
        return {"running": bool(q and q.isActive), "completed": sum(p["numInputRows"] for p in q.recentProgress) if q else 0}


class Progress(StreamingQueryListener):
    """Counts rows of all queries of a session as they go on."""

    def __init__(self) -> None:
        self.rows, self.failed = 0, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows

    def onQueryTerminated(self, event) -> None:
        self.failed += event.exception is not None


def drained(rows: DataFrame, out: str, checkpoint: str, wait: float = 0.0) -> None:
    """Appends all that a stream has now to a Parquet folder and ends; a restart from the checkpoint goes on from there."""
    time.sleep(wait)
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
