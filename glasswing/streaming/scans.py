"""Scans that can be cancelled, one at a time, with counters.

A scan's jobs carry its tag, so that cancelling ends its Spark jobs and nothing else's. Each scan has
an epoch; a later one ends the one before, and what an old scan still reports or wants to store is
refused, so it can't touch the state of a new one. Rows are worked on slice by slice, each an action
with an observation, whose counts the status shows as slices end.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Status:
    """``state``: idle, running, done, cancelled or failed."""

    epoch: int = 0
    state: str = "idle"
    total: int = 0
    completed: int = 0
    failed: int = 0
    error: str | None = None

    @property
    def running(self) -> bool:
        return self.state == "running"


class Scans:
    """At most one scan at a time. ``store(epoch, rows)`` is called for each slice while its scan is the current one."""

    def __init__(self, spark: SparkSession, name: str = "scan"):
        self.spark, self.name, self.lock = spark, name, threading.RLock()
        self.now, self.thread = Status(), None

    def status(self) -> Status:
        with self.lock:
            return self.now

    def tag(self, epoch: int) -> str:
        return f"{self.name}-{epoch}"

    def start(self, rows: DataFrame, work: Callable[[DataFrame], DataFrame], store: Callable[[int, DataFrame], None], key: list[str], failed: Column | None = None, slices: int = 8) -> int:
        """Begins a scan and returns its epoch; one that runs is cancelled first.

        ``rows`` are cut into slices by the hash of ``key``, nulls included; ``work`` adds the results,
        ``failed`` says of a row of them whether it is an error, by default whether ``error`` isn't null.
        """
        with self.lock:
            self.cancel()
            epoch = self.now.epoch + 1
            self.now = Status(epoch, "running")
        self.thread = InheritableThread(target=self._run, args=(epoch, rows, work, store, key, F.col("error").isNotNull() if failed is None else failed, slices), daemon=True)
        self.thread.start()
        return epoch

    def cancel(self) -> bool:
        """Ends the scan that runs and its Spark jobs; whether there was one."""
        with self.lock:
            if not self.now.running:
                return False
            self.now = replace(self.now, state="cancelled")
            tag = self.tag(self.now.epoch)
        self.spark.sparkContext.cancelJobsWithTag(tag)
        return True

    def wait(self, seconds: float | None = None) -> Status:
        if self.thread:
            self.thread.join(seconds)
        return self.status()

    def _report(self, epoch: int, **change) -> bool:
        """Takes a change of a scan's status, unless another scan or a cancellation has come meanwhile."""
        with self.lock:
            current = self.now.epoch == epoch and self.now.running
            if current:
                self.now = replace(self.now, **change)
            return current

    def _run(self, epoch, rows, work, store, key, failed, slices) -> None:
        sc = self.spark.sparkContext
        sc.addJobTag(self.tag(epoch))
        slot = F.pmod(F.xxhash64(*key), F.lit(slices)).cast("int")
        try:
            if not self._report(epoch, total=rows.count()):
                return
            for k in range(slices):
                seen = Observation(f"{self.name}-{epoch}-{k}")
                part = work(rows.where(slot == k)).observe(seen, F.count(F.lit(1)).alias("completed"), F.count_if(failed).alias("failed"))
                if not self._report(epoch):
                    return
                store(epoch, part)
                got = seen.get
                with self.lock:
                    if not self._report(epoch, completed=self.now.completed + got["completed"], failed=self.now.failed + got["failed"]):
                        return
            self._report(epoch, state="done")
        except Exception as e:  # an unreadable slice or a cancelled job ends this scan alone
            self._report(epoch, state="failed", error=str(e).splitlines()[0] if str(e) else type(e).__name__)
        finally:
            sc.removeJobTag(self.tag(epoch))
