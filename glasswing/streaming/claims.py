"""Claims of jobs as arbitrary state with timers.

A stream of requests is dealt out to shards by the job's key; each shard holds its claimed jobs and
how many there are. A job is claimed once until it is done or its claim expires, whatever asks for it
meanwhile; where a shard is full the request is dropped and reported, and holds nothing. A timer
frees the jobs of workers that were lost, each at the time at which its claim expires.

A batch's requests of a shard are put in order by sorted runs in a temporary file, and outcomes are given
out a frame at a time, so a worker holds as much of a shard of millions of requests as of one of a few.
Each call of the state store goes through a socket. So a shard's jobs lie in buckets that are read when a
job of them is asked for first and written once, when the batch ends or more than ``KNOWN`` jobs were seen;
a shard has one timer, for the claim that expires first.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from itertools import islice
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glasswing.operators.tables import shared_folder

OUT = "job string, at timestamp, seq long, outcome string, depth long"
#: What a state store must be for ``transformWithState``.
STORE = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a frame that a worker gets; other operators lower it for long texts, requests are short.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Each partition of the state has a store of its own, with requests or without.
PARTITIONS = "spark.sql.shuffle.partitions"
SHARDS = 8
#: Requests of a sorted run, and of a piece of it that is read at once and of a frame of outcomes.
RUN, PIECE = 200_000, 10_000
#: Buckets of a shard's jobs, and jobs that are known at once besides those of one bucket.
BUCKETS, KNOWN = 4096, 500_000
#: What a request is ordered by, and what else it has; ``us``: its time in microseconds.
REQUEST = ["us", "seq", "job", "kind"]


def pieces(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    while piece := list(islice(rows, PIECE)):
        yield piece


class Piece:
    """Requests in order, of which those up to a key can be taken."""

    def __init__(self, rows: pa.RecordBatch):
        us, seq, self.job, kind = rows.columns
        self.us, self.none, self.seq, self.kind = us.to_numpy().tolist(), seq.is_null().to_pylist(), seq.fill_null(0).to_numpy().tolist(), kind
        self.rows, self.at, self.last = rows, 0, rows.num_rows

    def key(self, i: int) -> tuple:
        return self.us[i], self.none[i], self.seq[i], self.job[i].as_py()

    def end(self) -> tuple:
        return self.key(self.last - 1)

    def upto(self, key: tuple) -> pa.RecordBatch:
        at, self.at = self.at, bisect_right(range(self.last), key, self.at, key=self.key)
        return self.rows.slice(at, self.at - at)


def merged(runs: list[Iterator[pa.RecordBatch]]) -> Iterator[pa.Table]:
    """Sorted runs as sorted tables; of each run a piece is held."""
    heads = [(Piece(rows), run) for run in runs if (rows := next(run, None)) is not None]
    while heads:
        key = min(piece.end() for piece, _ in heads)  # all that is not held comes after it
        yield in_table([part for piece, _ in heads if (part := piece.upto(key)).num_rows])
        heads = [(piece, run) if piece.at < piece.last else (Piece(rows), run) for piece, run in heads if piece.at < piece.last or (rows := next(run, None)) is not None]


def in_table(parts: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(parts).sort_by([("us", "ascending"), ("seq", "ascending"), ("job", "ascending")])


def in_order(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """The requests of all frames, by time, then by ``seq``, nulls last, then by job; no more than a run and a piece of each other one are held."""
    run, text = (pa.schema([("us", pa.int64()), ("seq", seq), ("job", pa.string()), ("kind", pa.string())]) for seq in (pa.int64(), pa.string()))

    def batches(frame: pd.DataFrame) -> list[pa.RecordBatch]:
        return pa.Table.from_pandas(frame[REQUEST].astype({"seq": object}), text, preserve_index=False).cast(run).to_batches()

    with ExitStack() as files:
        runs, held, total = [], [], 0
        for frame in frames:
            held += batches(frame)
            total += len(frame)
            if total >= RUN:
                file = files.enter_context(tempfile.TemporaryFile())
                with pa.ipc.new_stream(file, run) as out:
                    out.write_table(in_table(held).combine_chunks(), max_chunksize=PIECE)
                runs.append(file)
                held, total = [], 0
        parts = [iter(in_table(held).combine_chunks().to_batches(max_chunksize=PIECE))] if held else []
        for file in runs:
            file.seek(0)
            parts.append(iter(pa.ipc.open_stream(file)))
        for table in merged(parts) if len(parts) > 1 else map(lambda rows: pa.Table.from_batches([rows]), *parts) if parts else ():
            us, seq, job, kind = table.columns
            seqs = seq.to_pylist() if seq.null_count else seq.to_numpy().tolist()
            yield from zip(us.to_numpy().tolist(), seqs, job.to_numpy().tolist(), kind.to_numpy().tolist(), strict=True)


def bucket(job: str) -> int:
    return crc32(job.encode()) % BUCKETS


class Shard:
    """The jobs that a shard holds, for one batch. ``n``: how many they are; ``due``: of each bucket that holds any, when the first of them expires."""

    def __init__(self, held, count):
        self.held, self.count = held, count
        self.stored = count.get() if count.exists() else (0, "{}")
        self.n, self.due = self.stored[0], {int(b): until for b, until in json.loads(self.stored[1]).items()}
        self.timer = self.first()
        self.known, self.read, self.changed = {}, set(), set()

    def first(self) -> int | None:
        return min(self.due.values(), default=None)

    def jobs(self, b: int) -> dict[str, int]:
        return json.loads(self.held.getValue((b,))[0]) if b in self.due else {}

    def put(self, b: int, jobs: dict[str, int]) -> None:
        if jobs:
            self.held.updateValue((b,), (json.dumps(jobs),))
            self.due[b] = min(jobs.values())
        elif b in self.due:
            self.held.removeKey((b,))
            del self.due[b]

    def until(self, job: str) -> int | None:
        """When the claim of a job expires, if it is held."""
        if job not in self.known:
            if len(self.known) >= KNOWN:
                self.write()
            if (b := bucket(job)) not in self.read:
                self.read.add(b)
                self.known |= self.jobs(b)
            self.known.setdefault(job)
        return self.known[job]

    def hold(self, job: str, until: int | None) -> None:
        """Holds a job or, with no time, lets it go."""
        self.known[job] = until
        self.changed.add(job)
        self.n += -1 if until is None else 1

    def write(self) -> None:
        """Writes the buckets whose jobs have changed; none is known from then on."""
        changed = {b: {} for b in map(bucket, self.changed)}
        for job, until in self.known.items() if changed else ():
            if until is not None and (b := bucket(job)) in changed:
                changed[b][job] = until
        for b, jobs in changed.items():
            self.put(b, jobs)
        self.known, self.read, self.changed = {}, set(), set()

    def end(self, handle: StatefulProcessorHandle | None, fired: int | None = None) -> None:
        """Writes what has changed; the timer is that of the claim that expires first. ``fired``: one that is over by itself."""
        self.write()
        if (now := (self.n, json.dumps(self.due))) != tuple(self.stored):
            self.count.update(now)
        if (first := self.first()) != self.timer:
            if self.timer is not None and self.timer != fired:
                handle.deleteTimer(self.timer)
            if first is not None:
                handle.registerTimer(first)


class Claims(StatefulProcessor):
    """One shard. Requests of a batch are taken in the order of their time, then of ``seq``."""

    handle: StatefulProcessorHandle | None = None

    def __init__(self, capacity: int, ttl_ms: int):
        self.capacity, self.ttl = capacity, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "bucket int", "jobs string")
        self.count = handle.getValueState("count", "n long, due string")

    @staticmethod
    def frame(rows: list[tuple]) -> pd.DataFrame:
        job, us, seq, outcome, depth = zip(*rows, strict=True)
        return pd.DataFrame({"job": job, "us": us, "seq": pd.array(seq, "Int64"), "outcome": outcome, "depth": depth})

    def outcomes(self, shard: Shard, requests: Iterator[tuple]) -> Iterator[tuple]:
        for us, seq, job, kind in requests:
            now, until = us // 1000, shard.until(job)
            if until is not None and until <= now:  # before its timer has come
                shard.hold(job, None)
                yield job, until * 1000, None, "expired", shard.n
                until = None
            if kind == "done":
                outcome = "unknown"
                if until is not None:
                    outcome = "released"
                    shard.hold(job, None)
            elif until is not None:
                outcome = "pending"
            elif shard.n >= self.capacity:
                outcome = "dropped"
            else:
                outcome = "claimed"
                shard.hold(job, now + self.ttl)
            yield job, us, seq, outcome, shard.n

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        shard = Shard(self.held, self.count)
        yield from map(self.frame, pieces(self.outcomes(shard, in_order(rows))))
        shard.end(self.handle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        shard, now = Shard(self.held, self.count), timerValues.getCurrentWatermarkInMs()

        def gone() -> Iterator[pd.DataFrame]:
            for b in [b for b, until in shard.due.items() if until <= now]:
                jobs = shard.jobs(b)
                shard.put(b, {job: until for job, until in jobs.items() if until > now})
                yield pd.DataFrame([(until * 1000, None, job, None) for job, until in jobs.items() if until <= now], columns=REQUEST)

        def freed() -> Iterator[tuple]:
            for us, _, job, _ in in_order(gone()):
                shard.n -= 1
                yield job, us, None, "expired", shard.n

        yield from map(self.frame, pieces(freed()))
        shard.end(self.handle, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        """State belongs to the store; there is nothing to close."""


def labels(shards: int) -> list[int]:
    """Numbers whose hash, by which Spark deals out rows, is 0, 1, 2 and so on: shards so called are spread evenly over any number of partitions."""

    def turned(x: int, by: int) -> int:
        return (x >> by | x << 32 - by) & 0xFFFFFFFF

    def label(x: int) -> int:  # the steps of Murmur3 for an int with seed 42, backwards
        x = (x ^ x >> 16) * pow(0xC2B2AE35, -1, 1 << 32) & 0xFFFFFFFF
        x = (x ^ x >> 13 ^ x >> 26) * pow(0x85EBCA6B, -1, 1 << 32) & 0xFFFFFFFF
        x = (((x ^ x >> 16) ^ 4) - 0xE6546B64) * pow(5, -1, 1 << 32) & 0xFFFFFFFF
        x = (turned(x, 13) ^ 42) * pow(0x1B873593, -1, 1 << 32) & 0xFFFFFFFF
        x = turned(x, 15) * pow(0xCC9E2D51, -1, 1 << 32) & 0xFFFFFFFF
        return x - (x >> 31 << 32)

    return [label(x) for x in range(shards)]


def claims(requests: DataFrame, capacity: int = 128, ttl: str = "10 minutes", late: str = "1 minute", shards: int = SHARDS) -> DataFrame:
    """A stream ``(job, at, seq, outcome, depth)`` for a stream ``requests(job, kind, at, seq)``.

    ``kind`` is ``claim`` or ``done``. Outcomes: ``claimed``; ``pending``, where the job is held
    already; ``dropped``, where its shard holds ``capacity`` jobs; ``released`` and, where nothing was
    held, ``unknown``, of a job that is done; ``expired``, with a null ``seq``, where a claim wasn't
    released within ``ttl``. ``depth`` is how many jobs the shard holds then. Null jobs or times are
    left out. Time is that of the requests; those later than ``late`` may be dropped by the watermark.
    """
    spark = requests.sparkSession
    ttl_ms = spark.sql(f"SELECT CAST(unix_millis(TIMESTAMP'1970-01-01 00:00:00 UTC' + INTERVAL {ttl}) AS LONG)").head()[0]
    rows = requests.select(F.col("job").cast("string"), "kind", F.col("at").cast("timestamp"), F.col("seq").cast("long")).where("job is not null and at is not null")
    rows = rows.withColumn("us", F.unix_micros("at")).withColumn("seq", F.col("seq").cast("string"))  # a long with nulls would become a double
    shard = F.get(F.lit(labels(shards)), F.pmod(F.xxhash64("job"), F.lit(shards)).cast("int"))
    rows = rows.withWatermark("at", late).withColumn("shard", shard)
    out = rows.groupBy("shard").transformWithStateInPandas(Claims(capacity, ttl_ms), OUT.replace("at timestamp", "us long"), "Append", "EventTime")
    return out.select("job", F.timestamp_micros("us").alias("at"), "seq", "outcome", "depth")


def outcomes(make: Callable[..., DataFrame], requests: DataFrame, **how) -> DataFrame:
    """The outcomes of all requests that a stream has now, as a table; the state ends with the run."""
    spark = requests.sparkSession
    folder, confs = f"{shared_folder(spark)}/claims-{uuid.uuid4().hex}", {STORE: PROVIDER, BATCH: str(PIECE)}
    confs[PARTITIONS] = str(min(int(spark.conf.get(PARTITIONS)), how.get("shards", SHARDS)))  # more would be empty
    before = {k: spark.conf.get(k, None) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        rows = make(requests, **how)
        rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    return spark.read.schema(OUT).parquet(f"{folder}/out")
