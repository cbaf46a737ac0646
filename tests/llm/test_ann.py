import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from glasswing.llm import ann, queries
from glasswing.llm.common import written


def brute(rows, every=100, k=10):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for q in ids[ids % every == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        out[int(q)] = [(int(ids[j]), d[j]) for j in np.lexsort((ids, d)) if ids[j] != q][:k]
    return out


def recall(out, want):
    got = {}
    for r in out:
        got.setdefault(r.query_id, []).append(r.vec_id)
    return np.mean([len({i for i, _ in w} & set(got.get(q, []))) / max(1, len(w)) for q, w in want.items()])


def test_recall_on_the_tables(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.1"):
        pytest.skip("no test data")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    out, want = queries.op6_ann(spark, "/root/testdata/sf0.1").collect(), brute(rows)
    assert recall(out, want) >= 0.9
    scores = {q: dict(w) for q, w in want.items()}
    assert all(abs(r.score - scores[r.query_id][r.vec_id]) < 1e-12 for r in out if r.vec_id in scores[r.query_id])
    assert sorted((r.query_id, r["rank"]) for r in out) == [(q, n) for q in sorted(want) for n in range(1, 11)]


def test_recall_on_vectors_not_fitted(spark, monkeypatch, tmp_path):
    """Many more rows than are reranked, and queries that the codebooks haven't seen."""
    x = np.random.default_rng(5).normal(size=(50_000, 48)).astype(np.float32)
    rows = list(enumerate(x.tolist()))
    made = pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 48).cast(pa.list_(pa.float32()))})
    pq.write_table(made, tmp_path / "v.parquet")
    df = spark.read.parquet(f"file://{tmp_path}/v.parquet")
    sent = []
    monkeypatch.setattr(ann, "written", lambda t, name: sent.append((name, out := written(t, name))) or out)
    out = ann.nearest(df, every=1000, sample=3_000).collect()
    found = recall(out, brute(rows, every=1000))
    print("recall", found)
    assert found >= 0.9 and ann.RERANK < 0.01 * len(x)
    assert [t.count() for name, t in sent[-1:]] == [50 * ann.RERANK]


def test_few_blocks_at_a_time():
    for blocks in (1, 2, 9, 10, 1000):
        got = ann.levels(blocks)
        assert got[0] == (0, 1) and got[-1][1] == blocks and all(a[1] == b[0] for a, b in zip(got, got[1:]))
        assert len(got) <= 1 + np.ceil(np.log(blocks) / np.log(1 + ann.FAN))


def test_copies_ties_and_rows_without_part(spark):
    rng = np.random.default_rng(1)
    one = rng.normal(size=8).tolist()
    rows = [(i, one) for i in range(1, 60)] + [(100, one), (200, rng.normal(size=8).tolist()), (200, one)]
    rows += [(300, None), (400, [0.0] * 8), (500, [1.0] * 7 + [None]), (600, [float("nan")] * 8), (700, [float("inf")] * 8), (800, [1.0] * 3), (None, one)]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, n string, h string")
    out = ann.nearest(df).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in out} == {100, 200}
    assert [r.vec_id for r in out if r.query_id == 100] == list(range(1, 11)) and all(r.score == 0 for r in out if r.query_id == 100)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    out = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df).orderBy("rank").collect()]
    assert out == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest(df.limit(0)).count() == 0


def test_beam_search_beats_greedy_codes():
    x = np.random.default_rng(2).normal(size=(600, 16))
    books = ann.fit(x, books=4, words=32)
    error = [((x - ann.total(ann.beam_encode(x, books, b), books)) ** 2).sum() for b in (1, 8)]
    assert error[1] <= error[0]


def test_large_components_lose_no_neighbour(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * (1e25 if i % 2 else 1e150)).tolist()) for i in range(301)]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    v = np.array([r[1] for r in rows])
    for q in (0, 100, 200, 300):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        got = {r.vec_id: r.score for r in out if r.query_id == q}
        assert len(got) == 10 and all(abs(d[i] - s) <= 1e-9 * d[i] for i, s in got.items())
