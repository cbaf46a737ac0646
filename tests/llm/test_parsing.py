import random

import pytest
from glasswing.llm import parsing
from pyspark.sql import functions as F

LAST = (1 << 63) - 1


def brute(rows):
    """For each row ``(doc_id, text)``: words, removed words and the kept ones, by a table of all windows."""
    words = [(LAST if i is None else i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            least[g] = min(i, least.get(g, i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def ours(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in df.collect())


def theirs(rows):
    return sorted((i is None, i or 0, *b) for (i, _), b in zip(rows, brute(rows), strict=True))


def passages(seed, n=60):
    """Texts of shared passages, near copies, repeats within a text and words that are always there."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(4))
    shared = [[word() for _ in range(rng.randrange(10, 90))] for _ in range(6)]
    out = []
    for i in range(n):
        t = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(shared)
            a = rng.randrange(len(p))
            t += p[a : a + rng.randrange(5, 60)] if rng.random() < 0.7 else [word() for _ in range(rng.randrange(1, 40))]
            if rng.random() < 0.2:
                t += ["x"] * rng.randrange(1, 40)
        out.append((i, rng.choice([" ", "\n", " \t "]).join(t)))
    out += [(n + k, out[k % 7][1]) for k in range(25)]
    return rng.sample(out, len(out))


@pytest.mark.parametrize("split", [2000, 3, 0])
def test_equals_the_table_of_all_windows(spark, split):
    for seed in (1, 2):
        rows = passages(seed)
        assert ours(parsing.dedup(spark.createDataFrame(rows, "doc_id long, text string"), split=split)) == theirs(rows)


def test_awkward_documents_and_clashing_columns(spark, docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    clash = docs.withColumns({c: F.lit("y") for c in ("row", "h", "o", "t", "a", "b", "f", "th", "to", "x", "w", "at", "n_words", "spans")})
    out = parsing.dedup(clash)
    assert ours(out) == theirs(rows)
    assert out.where("row = 'y' and h = 'y' and keep = 'x' and w = 'y'").count() == len(rows)
    assert parsing.dedup(empty).count() == 0


def test_a_hot_passage_and_repeated_rows(spark):
    p = " ".join(f"hot{i}" for i in range(60))
    rows = [(i, f"{p} tail{i}" if i % 3 else p) for i in range(300)] + [(5, f"{p} tail5")] * 20
    assert ours(parsing.dedup(spark.createDataFrame(rows, "doc_id long, text string"), split=20)) == theirs(rows)


def test_spans_are_the_removed_words(spark):
    p = " ".join(f"w{i}" for i in range(20))
    out = {r.doc_id: r for r in parsing.dedup(spark.createDataFrame([(1, p), (2, f"a b {p} c"), (3, "one two")], "doc_id long, text string")).collect()}
    assert [tuple(s) for s in out[2].spans] == [(2, 22)] and out[2].kept == "a b c" and out[1].n_removed == out[3].n_removed == 0


def test_a_very_long_text_is_split_in_pieces(monkeypatch):
    monkeypatch.setattr(parsing, "PIECE", 10)
    text = b"  one two\tthree four-and-a-half  \n five" * 5
    assert [w for p in parsing.pieces(text) for w in p] == text.split()


def test_factors_are_greedy_and_looked_up_at_their_boundaries():
    reference = [1, 2, 3, None, 7, 8]
    index = {1: 0, 2: 1, 3: 2, 7: 4, 8: 5}
    assert parsing.factors([9, 2, 3, 7, 8, 8, 5], reference, index) == [(1, 3), (3, 5), (5, 6)]
    assert parsing.factors([], reference, index) == []


def test_split_anchors_give_a_row_for_a_stretch_at_most(spark, monkeypatch):
    """Windows that are copies each were rows of their own, as many as a stretch has."""
    counts, write = {}, parsing.written

    def spied(df, name):
        out = write(df, name)
        if name == "parse-stretches":
            counts[name] = out.where("t is not null and c is not null").count()
        elif name == "parse-short":
            counts[name], counts["long"] = out.count(), out.where("array_max(transform(f, x -> x.n)) > 1").count()
        return out

    rng = random.Random(5)
    passage = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = [(i, " ".join([f"a{i}"] * 3 + passage[rng.randrange(20) : 60 - rng.randrange(20)] + [f"z{i}"] * 3)) for i in range(60)]
    monkeypatch.setattr(parsing, "written", spied)
    assert ours(parsing.dedup(spark.createDataFrame(rows, "doc_id long, text string"), split=0)) == theirs(rows)
    assert 0 < counts["parse-short"] <= counts["parse-stretches"] and counts["long"] > 0
