import numpy as np

from glasswing.llm import quality, queries


def made(spark, n=400):
    good, bad, toxic = "the house by the river stands alone", "BUY!! NOW!! $$$ &&& CLICK!!", "you are stupid worthless"
    rows = [(i, f"{[toxic + ' ' + good, bad, good][i % 3]} w{i} v{i * 7}", int(i % 3 != 1), int(i % 3 == 0)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic")


def test_held_out_documents(spark):
    docs, labels = made(spark)
    out = quality.select(docs, labels.where("doc_id < 250"), tail=0.5).where("doc_id >= 250").collect()
    assert np.mean([r.keep == (r.doc_id % 3 == 2) for r in out]) > 0.98
    means = [np.mean([r.expected_grade for r in out if r.doc_id % 3 == k]) for k in (0, 1, 2)]
    assert means[0] < means[1] < means[2]


def test_thresholds_are_ordered_and_tails_fall(spark):
    docs, labels = made(spark)
    model = quality.train(docs, labels)
    assert (np.diff(model.thresholds) >= 0).all()
    tails = model.tails(np.linspace(-5, 5, 11))
    assert (tails[:, 0] >= tails[:, 1]).all() and (np.diff(tails, axis=0) >= 0).all()


def test_without_ratings_everything_stays(spark, docs, empty):
    none = made(spark)[1].limit(0)
    assert all(r.keep and r.tail_probability is None for r in quality.select(docs, none).collect())
    nulls = spark.createDataFrame([(1, None, 0), (2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.select(docs, nulls).where("not keep").count() == 0
    rated = made(spark)[1]
    out = quality.select(docs, rated)
    assert out.count() == docs.count() and dict(out.dtypes)["keep"] == "boolean"
    assert quality.select(empty, rated).count() == 0


def objective(x, grades, w, theta, l1):
    s = (x @ w)[:, None] - theta[None, :]
    above = (grades[:, None] >= np.arange(1, quality.GRADES)[None, :]).astype(float)
    return (np.logaddexp(0, s) - above * s).sum(1).mean() + l1 * np.abs(w).sum(), above, s


def test_fit_against_another_optimiser():
    """Plain proximal steps with backtracking on a dense table reach no lower loss."""
    rng = np.random.default_rng(2)
    n, m, l1 = 300, 40, 2e-3
    x = (rng.random((n, m)) < 0.15).astype(float)
    x[:, 0] = 1
    true = np.where(rng.random(m) < 0.4, rng.normal(size=m) * 3, 0)
    grades = np.digitize(x @ true + rng.logistic(size=n), [-1.0, 1.5])
    model = quality.fit([np.flatnonzero(r).astype(np.int32) for r in x], grades, l1=l1, rounds=3000)
    got = objective(x, grades, model.weights[:m], model.thresholds, l1)[0]
    w, theta, step = np.zeros(m), np.array([-0.5, 0.5]), 1.0
    for _ in range(6000):
        now, above, s = objective(x, grades, w, theta, l1)
        g = (1 / (1 + np.exp(-s)) - above) / n
        gw, gt = x.T @ g.sum(1), -g.sum(0)
        while True:
            new = w - step * gw
            new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
            new_t = np.maximum.accumulate(theta - step * gt)
            dw, dt = new - w, new_t - theta
            smooth = objective(x, grades, new, new_t, 0)[0]
            if smooth <= objective(x, grades, w, theta, 0)[0] + gw @ dw + gt @ dt + (dw @ dw + dt @ dt) / (2 * step) + 1e-12:
                break
            step /= 2
        w, theta = new, new_t
    assert got <= objective(x, grades, w, theta, l1)[0] + 2e-4
    assert np.corrcoef(x @ w, x @ model.weights[:m])[0, 1] > 0.999


def test_scores_against_plain_sums(spark, docs):
    """The query's score of every row, repeated, null and long ones too, from features one by one; other columns stay."""
    model = quality.train(*made(spark))
    for r in quality.score(docs, model).collect():
        s = sum(model.weights[b] for b in quality.features(r.text or ""))
        tails = 1 / (1 + np.exp(-(s - model.thresholds)))
        assert np.allclose((r.expected_grade, r.tail_probability), (tails.sum(), tails[-1])) and r.keep == "x"
    assert dict(quality.select(docs, made(spark)[1]).dtypes)["keep"] == "boolean"


def test_the_same_model_each_time(spark):
    """Rows that repeat a rated id: one of them counts, whatever the order of rows."""
    docs, labels = made(spark)
    twice = docs.unionByName(docs.selectExpr("doc_id", "concat(text, ' again') AS text")).unionByName(docs)
    a, b = (quality.train(t, labels, sample=100) for t in (twice, twice.repartition(7, "text")))
    assert (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all()


def test_accuracy_on_the_tables(spark):
    import os

    import pytest

    if not os.path.isdir("/root/testdata/sf0.1"):
        pytest.skip("no test data")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = quality.select(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    clean = [r.keep for r in out if r.quality == 1 and r.toxic == 0]
    toxic = [r.keep for r in out if r.toxic == 1]
    poor = [r.keep for r in out if r.quality == 0]
    assert np.mean(clean) > 0.99 and np.mean(toxic) < 0.05 and np.mean(poor) < 0.1
    assert queries.op5_quality(spark, "/root/testdata/sf0.001").count() == 200
