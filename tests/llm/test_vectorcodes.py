import hashlib
import math
import random

from glasswing.llm import vectorcodes
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label int, codes string, row string, v string, id string, sum string, of string"


def brute(rows, parts=16, entries=64, rounds=2):
    """``{vec_id: (codes, error, label_error)}`` and the codebooks, with integers of any size."""
    fine = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    fine.sort(key=lambda r: r[0])
    w = len(fine[0][1]) // parts
    books = [[r[1][m * w : m * w + w] for r in fine[:entries]] for m in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    coded = lambda: {r[0]: [near(r[1][m * w : m * w + w], books[m]) for m in range(parts)] for r in fine}
    for _ in range(rounds):
        got = coded()
        for m in range(parts):
            for k in range(len(books[m])):
                own = [r[1][m * w : m * w + w] for r in fine if got[r[0]][m][1] == k]
                if own:
                    books[m][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    got, errors = coded(), {}
    for i, _, label in fine:
        errors[label] = errors.get(label, 0) + sum(d for d, _ in got[i])
    return {i: ([k for _, k in got[i]], sum(d for d, _ in got[i]), errors[label]) for i, _, label in fine}, books


def rows_of(seed, n, dims=32, scale=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, scale) for _ in range(dims)], rng.choice([None, 1, 2])) for i in rng.sample(range(10 * n), n)]


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, *"abcdef") for r in rows], SCHEMA)
    out, books = vectorcodes.compress(df, **how)
    return out, {r["vec_id"]: (r["codes"], r["error"], r["label_error"]) for r in out.collect()}, [[[int(x) for x in e] for e in b] for b in books]


def test_equals_brute_force(spark):
    rows = rows_of(1, 200) + [(9001, None, 1), (9002, [None] * 32, 1), (9003, [math.nan] * 32, 1), (9004, [math.inf] + [0.0] * 31, 2), (9005, [0.0] * 32, None)]
    out, got, books = run(spark, rows)
    want, want_books = brute(rows)
    assert got == want and books == want_books
    assert out.where("row = 'b' and v = 'c' and id = 'd'").count() == len(want)
    assert vectorcodes.digest(books) == hashlib.sha256(",".join(str(x) for b in want_books for e in b for x in e).encode()).hexdigest()


def test_large_components_are_exact(spark):
    rows = [(i, [x * 1e9 if i % 2 else x * 1e7 for x in v], label) for i, v, label in rows_of(2, 90)]
    _, got, books = run(spark, rows)
    want, want_books = brute(rows)
    assert books == want_books
    fits = lambda x: x if x < 1 << 63 else None
    assert {i: (c, e) for i, (c, e, _) in got.items()} == {i: (c, fits(e)) for i, (c, e, _) in want.items()}


def test_ties_equal_rows_and_few_rows(spark):
    rows = [(i, [0.5] * 16, None) for i in range(5)] + [(5, [-0.501] * 16, 1)]
    _, got, books = run(spark, rows)
    assert got == brute(rows)[0] and len(books[0]) == 6 and got[3][0] == [0] * 16
    twice = [rows[0]] * 3
    out, _, _ = run(spark, twice)
    assert out.count() == 3


def test_lengths_and_empty_tables(spark):
    out, got, _ = run(spark, [(1, [1.0] * 16, 1), (2, [1.0] * 16, 1), (3, [1.0] * 5, 1)])
    assert set(got) == {1, 2}
    assert run(spark, [])[1] == {} and run(spark, [(1, None, 1)])[1] == {}
    short, got, books = run(spark, [(1, [1.0, 2.0], 1), (2, [3.0, -1.0], None)], parts=4)
    assert got[1][1] == 0 and len(books) == 4


def test_decode_gives_the_entries(spark):
    out, got, books = run(spark, rows_of(3, 80))
    first = out.select("vec_id", "codes", vectorcodes.decode(F.col("codes"), books).alias("d")).head()
    assert list(first["d"]) == [x for m, c in enumerate(first["codes"]) for x in books[m][c]]


def test_a_hot_label(spark):
    rows = [(i, v, 1) for i, v, _ in rows_of(4, 150)]
    _, got, _ = run(spark, rows)
    assert {x for _, _, x in got.values()} == {sum(e for _, e, _ in got.values())}
