import datetime as dt
import random
import threading
import time

import pandas as pd
from pyspark.sql import functions as F

from glasswing.streaming import claims, jobs, scans

AT = dt.datetime(2024, 1, 1)
SCHEMA = "job string, kind string, at timestamp, seq long"


def brute(requests, capacity, ttl, shard):
    """Outcomes of all requests in one batch: claims expire when a later request of their job finds them late."""
    held, out = {}, []
    for job, kind, at, seq in sorted(requests, key=lambda r: (r[2], r[3])):
        own = held.setdefault(shard[job], {})
        until = own.get(job)
        if until is not None and until <= at:
            del own[job]
            out.append((job, None, "expired", len(own)))
            until = None
        if kind == "done":
            outcome = "unknown" if until is None else "released"
            own.pop(job, None)
        else:
            outcome = "pending" if until is not None else "dropped" if len(own) >= capacity else "claimed"
            if outcome == "claimed":
                own[job] = at + ttl
        out.append((job, seq, outcome, len(own)))
    return out


def stream(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return jobs.file_stream(spark, path)


def shards_of(spark, rows, n):
    df = spark.createDataFrame([(j,) for j in {r[0] for r in rows}], "job string").select("job", F.pmod(F.xxhash64("job"), F.lit(n)).cast("int").alias("s"))
    return {r.job: r.s for r in df.collect()}


def test_outcomes_of_one_batch_equal_brute_force(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"j{rng.randrange(30)}", rng.choice(["claim", "claim", "done"]), AT + dt.timedelta(seconds=rng.randrange(600)), i) for i in range(400)]
    rows += [("hot", "claim", AT + dt.timedelta(seconds=i), 1000 + i) for i in range(300)]
    got = claims.outcomes(claims.claims, stream(spark, str(tmp_path / "in"), rows + [(None, "claim", AT, 1), ("n", "claim", None, 2)]), capacity=5, ttl="90 seconds", shards=3).collect()
    want = brute(rows, 5, dt.timedelta(seconds=90), shards_of(spark, rows, 3))
    assert sorted((r.job, r.seq, r.outcome, r.depth) for r in got if r.seq is not None) == sorted(w for w in want if w[1] is not None)
    assert {(j, d) for j, s, _, d in want if s is None} <= {(r.job, r.depth) for r in got if r.outcome == "expired"}  # timers add those that no later request has found
    assert {"claimed", "pending", "dropped", "released", "unknown"} <= {r.outcome for r in got}


def test_a_timer_frees_the_jobs_of_lost_workers_and_state_survives_a_restart(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.conf.set(claims.STORE, claims.PROVIDER)
    try:
        for step in ([("a", "claim", AT, 1)], [("a", "claim", AT + dt.timedelta(seconds=30), 2), ("b", "claim", AT + dt.timedelta(seconds=31), 3)], [("c", "claim", AT + dt.timedelta(hours=1), 4)], [("a", "claim", AT + dt.timedelta(hours=1, seconds=1), 5)]):
            rows = stream(spark, source, step)
            jobs.drained(claims.claims(rows, ttl="10 minutes", late="0 seconds", shards=1), out, check)
    finally:
        spark.conf.unset(claims.STORE)
    got = [(r.job, r.outcome) for r in spark.read.parquet(out).orderBy("at", F.coalesce("seq", F.lit(0))).collect()]
    assert got == [("a", "claimed"), ("a", "pending"), ("b", "claimed"), ("a", "expired"), ("b", "expired"), ("c", "claimed"), ("a", "claimed")]


def test_an_empty_stream_has_no_outcomes(spark, tmp_path):
    assert claims.outcomes(claims.claims, stream(spark, str(tmp_path / "in"), [])).count() == 0


def failing(df):
    return df.select("id", F.when(F.col("id") % 4 == 0, "bad").alias("error"))


def test_a_scan_counts_what_it_has_done(spark, tmp_path):
    runs, out = scans.Scans(spark), str(tmp_path / "out")
    assert runs.status() == scans.Status() and not runs.cancel()
    runs.start(spark.range(100), failing, lambda epoch, df: df.write.mode("append").parquet(out), ["id"])
    assert runs.wait(120) == scans.Status(1, "done", 100, 100, 25) and spark.read.parquet(out).count() == 100
    runs.start(spark.range(0), failing, lambda epoch, df: df.count(), ["id"], slices=2)
    assert runs.wait(120) == scans.Status(2, "done")


def test_an_error_ends_one_scan_alone(spark):
    runs = scans.Scans(spark)
    runs.start(spark.range(10), lambda df: df.select(F.raise_error(F.lit("torn")).alias("error")), lambda epoch, df: df.collect(), ["id"])
    s = runs.wait(120)
    assert s.state == "failed" and s.error and s.completed == 0
    runs.start(spark.range(10), failing, lambda epoch, df: df.collect(), ["id"])
    assert runs.wait(120).state == "done"


def test_a_new_scan_cancels_the_old_one_which_cannot_touch_its_state(spark):
    runs, stored, began = scans.Scans(spark), [], threading.Event()

    def slow(df):
        began.set()
        wait = F.pandas_udf(lambda s: (time.sleep(60), s)[1], "long")
        return df.select(wait("id").alias("id"), F.lit(None).cast("string").alias("error"))

    runs.start(spark.range(1000), slow, lambda epoch, df: (df.collect(), stored.append(epoch)), ["id"])
    old = runs.thread
    assert began.wait(60)
    time.sleep(1)
    start = time.time()
    epoch = runs.start(spark.range(8), failing, lambda epoch, df: (df.count(), stored.append(epoch)), ["id"], slices=2)
    assert runs.wait(120) == scans.Status(epoch, "done", 8, 8, 2)
    old.join(60)
    assert not old.is_alive() and time.time() - start < 50 and stored == [2, 2]
    assert runs.status().epoch == 2 and not runs._report(1, completed=99) and runs.status().completed == 8


def test_cancelling_leaves_other_jobs_alone(spark):
    runs, began = scans.Scans(spark), threading.Event()

    def slow(df):
        began.set()
        return df.select(F.pandas_udf(lambda s: (time.sleep(60), s)[1], "long")("id").alias("id"), F.lit(None).cast("string").alias("error"))

    runs.start(spark.range(100), slow, lambda epoch, df: df.collect(), ["id"])
    assert began.wait(60)
    time.sleep(0.5)
    assert runs.cancel() and spark.range(10).count() == 10
    assert runs.wait(60).state == "cancelled"


def test_a_shard_of_many_requests_is_put_in_order_by_runs_and_given_out_in_pieces(monkeypatch):
    monkeypatch.setattr(claims, "RUN", 50)
    monkeypatch.setattr(claims, "PIECE", 7)
    rng = random.Random(4)
    rows = [(rng.randrange(40), rng.choice([None, (1 << 60) + k]), f"j{k}", "claim") for k in range(1003)]
    taken = []

    def frames():
        for at in range(0, len(rows), 30):
            taken.append(at)
            yield pd.DataFrame([(u, s if s is None else str(s), j, k) for u, s, j, k in rows[at : at + 30]], columns=claims.REQUEST)

    class Held:
        def exists(self):
            return False

    shard = claims.Claims(0, 1)
    shard.held = shard.count = Held()
    out = list(shard.handleInputRows(("0",), frames(), None))
    assert len(taken) == 34 and {len(f) for f in out} == {7, 1003 % 7}
    got = [tuple(r) for f in out for r in f[["us", "job"]].itertuples(index=False)]
    by = {j: s for _, s, j, _ in rows}
    assert [(u, by[j] is None, by[j] or 0) for u, j in got] == sorted((u, s is None, s or 0) for u, s, _, _ in rows)
    assert {j: None if pd.isna(s) else s for f in out for j, s in zip(f["job"], f["seq"], strict=True)} == by


class Stored(dict):
    """A map, a value and timers as the state store has them, with a count of its calls."""

    calls, n = 0, None

    def exists(self):
        self.calls += 1
        return bool(self) or self.n is not None

    def get(self):
        self.calls += 1
        return self.n

    def update(self, n):
        self.calls += 1
        self.n = n

    def containsKey(self, key):
        self.calls += 1
        return key in self

    def getValue(self, key):
        self.calls += 1
        return self[key]

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self[key]

    def iterator(self):
        self.calls += 1
        return iter(list(self.items()))

    def registerTimer(self, at):
        self.calls += 1
        self[at] = True

    def deleteTimer(self, at):
        self.calls += 1
        del self[at]


class Watermark:
    def __init__(self, now):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: now


def one_shard(capacity, ttl):
    shard = claims.Claims(capacity, ttl)
    shard.held, shard.count, shard.handle = Stored(), Stored(), Stored()
    return shard


def taken(shard, rows, watermark=0):
    """What a shard gives out for a batch ``(job, kind, ms, seq)``, and for its timers up to the watermark."""
    frame = pd.DataFrame([(ms * 1000, str(seq), job, kind) for job, kind, ms, seq in rows], columns=claims.REQUEST)
    out = list(shard.handleInputRows(("0",), iter([frame[at : at + 64] for at in range(0, len(frame), 64)]), Watermark(watermark)))
    for at in sorted(t for t in shard.handle if t <= watermark):
        info = Watermark(at)
        out += shard.handleExpiredTimer(("0",), Watermark(watermark), info)
        shard.handle.pop(at, None)
    return [(r.job, r.us // 1000, None if pd.isna(r.seq) else r.seq, r.outcome, r.depth) for f in out for r in f.itertuples(index=False)]


def calls(shard):
    return shard.held.calls + shard.count.calls + shard.handle.calls


def test_calls_of_the_state_store_do_not_grow_with_the_requests_of_a_batch():
    shard, rng = one_shard(1 << 40, 1 << 40), random.Random(5)
    rows = [(f"j{rng.randrange(20)}", rng.choice(["claim", "claim", "done"]), k, k) for k in range(5000)]
    assert len(taken(shard, rows[:2500])) == 2500 and calls(shard) < 100
    assert len(taken(shard, rows[2500:])) == 2500 and calls(shard) < 200 and len(shard.handle) <= 1


def test_one_timer_frees_all_jobs_that_are_late_in_the_order_of_their_time():
    shard = one_shard(1 << 40, 1000)
    taken(shard, [(f"j{k:04}", "claim", k // 2, k) for k in reversed(range(600))])
    before, got = calls(shard), taken(shard, [("x", "claim", 1300, 1000)], watermark=1249)
    assert got[1:] == [(f"j{k:04}", 1000 + k // 2, None, "expired", 600 - k) for k in range(500)]
    assert calls(shard) - before < 1500 and list(shard.handle) == [1250]
    assert [r[0] for r in taken(shard, [], watermark=5000)] == [f"j{k:04}" for k in range(500, 600)] + ["x"]
    assert not shard.held and not shard.handle


def test_jobs_that_are_written_before_the_batch_ends_are_found_again(monkeypatch):
    rng, plain, tight = random.Random(6), {}, one_shard(9, 90)
    monkeypatch.setattr(claims, "KNOWN", 4)
    monkeypatch.setattr(claims, "BUCKETS", 3)
    monkeypatch.setattr(claims, "RUN", 50)
    monkeypatch.setattr(claims, "PIECE", 7)
    for step in range(6):
        rows, want = [(f"j{rng.randrange(30)}", rng.choice(["claim", "claim", "done"]), step * 200 + rng.randrange(200), step * 300 + k) for k in range(300)], []
        rng.shuffle(rows)
        for job, kind, ms, seq in sorted(rows, key=lambda r: r[2:]):
            if plain.get(job, ms + 1) <= ms:
                want.append((job, plain.pop(job), None, "expired", len(plain)))
            outcome = ("released" if job in plain else "unknown") if kind == "done" else "pending" if job in plain else "dropped" if len(plain) >= 9 else "claimed"
            if outcome == "claimed":
                plain[job] = ms + 90
            elif outcome == "released":
                del plain[job]
            want.append((job, ms, seq, outcome, len(plain)))
        watermark = step * 200 + 250
        for until, job in sorted((u, j) for j, u in plain.items() if u <= watermark):
            del plain[job]
            want.append((job, until, None, "expired", len(plain)))
        assert taken(tight, rows, watermark) == want
    assert {w[3] for w in want} == {"claimed", "pending", "dropped", "released", "unknown", "expired"}


def test_shards_are_spread_evenly_over_partitions(spark):
    df = spark.createDataFrame([(x,) for x in claims.labels(48)], "shard int")
    assert [r[0] for r in df.select(F.hash("shard")).collect()] == list(range(48))
    for n in (4, 8, 12):
        assert {r[0] for r in df.repartition(n, "shard").groupBy(F.spark_partition_id()).count().select("count").collect()} == {48 // n}


def test_requests_come_in_large_frames_though_other_operators_lowered_them(spark, tmp_path):
    seen, before = [], spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        rows = stream(spark, str(tmp_path / "in"), [("a", "claim", AT, 1)])
        made = claims.outcomes(lambda df: (seen.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")), claims.claims(df))[1], rows)
        assert made.count() == 1 and seen == ["10000"] and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "500"
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_no_more_partitions_of_state_than_shards(spark, tmp_path):
    name, seen = "spark.sql.shuffle.partitions", []
    before = spark.conf.get(name)
    try:
        for n, shards in (("20", 3), ("2", 3)):
            spark.conf.set(name, n)
            rows = stream(spark, str(tmp_path / n), [(f"j{k}", "claim", AT, k) for k in range(50)])
            made = claims.outcomes(lambda df, **how: (seen.append(spark.conf.get(name)), claims.claims(df, **how))[1], rows, shards=shards)
            assert made.where("outcome = 'claimed'").count() == 50 and spark.conf.get(name) == n
    finally:
        spark.conf.set(name, before)
    assert seen == ["3", "2"]
