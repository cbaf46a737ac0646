import hashlib
import random
import re

from pyspark.sql import functions as F

from glasswing.llm import iblt, queries


def pieces(text):
    return set(re.findall(r"[^\n]{1,%d}" % iblt.WIDTH, text))


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, out):
    """Rows in descending order of ids, nulls last, ties by text."""
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r)
    for i, (k, t) in enumerate(rows):
        n = rows[(i + 1) % len(rows)][1]
        cut = len(t) // 3
        e = t[: len(t) - cut] + n[:cut]
        want = (len(t), hashlib.sha256(e.encode()).hexdigest(), round(likeness(pieces(t), pieces(e)), 9), round(likeness(pieces(t), pieces(n)), 9))
        assert want in [(r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got[k]], k


def test_equals_exact_sets_on_the_smallest_tables(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy(F.desc("doc_id")).collect()]
    check(rows, queries.op9_iblt(spark, sf_dir).collect())


def test_awkward_rows(docs, empty):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = iblt.compare(docs).collect()
    assert len(out) == len(rows) and iblt.compare(empty).count() == 0
    check(rows, out)
    by_text = {}
    for k, t in rows:
        if [x for x, _ in rows].count(k) == 1:
            by_text.setdefault(t, set()).add(next(r.fingerprint for r in out if r.doc_id == k))
    assert all(len(v) == 1 for v in by_text.values())


def test_one_row(spark):
    out = iblt.compare(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()
    check([(5, "abcdef")], out)


def test_differences_of_every_size_are_recovered(spark):
    rng = random.Random(6)
    rows = []
    for n in (0, 1, 3, 10, 40, 200, 1500):
        both = [rng.getrandbits(63) for _ in range(n)]
        a, b = [rng.getrandbits(63) for _ in range(n // 2)], [rng.getrandbits(63) - (1 << 62) for _ in range(n)]
        rows.append((both + a, b + both))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    got = df.select("a", "b", iblt.difference(F.col("a"), F.col("b"), iblt.sketch(F.col("a")), iblt.sketch(F.col("b"))).alias("d")).collect()
    for r in got:
        want = [(x, 1) for x in set(r.a) - set(r.b)] + [(x, -1) for x in set(r.b) - set(r.a)]
        assert sorted((d.key, d.n) for d in r.d) == sorted(want)


def test_small_sketches_fail_and_larger_ones_succeed(spark):
    rows = [(list(range(200)),)]
    df = spark.createDataFrame(rows, "a array<long>")
    none = F.array().cast("array<bigint>")
    assert df.select(iblt.peel(iblt.subtract(iblt.sketch(F.col("a")), iblt.sketch(none))).alias("n")).first().n is None
