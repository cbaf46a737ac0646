import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glasswing.llm.common import written

from .test_linededup import brute as without_lines
from .test_neardup import brute_groups


def test_stages_against_brute_force(spark, sf_dir):
    """Each stage on its own input: what it keeps, in which columns, and what the last one returns."""
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), "test")
        seen[name] = (before, docs)
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]

    before, after = seen["quality classifier"]
    kept = {r.doc_id for r in after.collect()}
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    right = [(k in kept) == (v == (1, 0)) for k, v in labels.items()]
    assert sum(right) > 0.9 * len(right) and after.exceptAll(before).count() == 0

    before, after = seen["line dedup"]
    rows = [(r.doc_id, r.text) for r in before.orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in after.collect()}
    assert [got[k].text for k, _ in rows] == without_lines(rows)
    assert all(r.n_chars == len(r.text) for r in got.values())

    before, after = seen["simhash near-dedup"]
    rows = before.orderBy("doc_id").collect()
    assert sorted(r.doc_id for r in after.collect()) == sorted({rows[i].doc_id for i in brute_groups([r.text for r in rows])})

    before, after = seen["mixing to target weights"]
    rows = {r.doc_id: r for r in before.collect()}
    size, got = Counter(), Counter(r.doc_id for r in after.collect())
    for r in rows.values():
        size[r.source] += len(r.text) + 1
    for k, r in rows.items():
        rate = sum(size.values()) / len(size) / size[r.source]
        u, n, p = int(hashlib.md5(f"1:0:{k}".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-rate)
        total = p
        while total <= u:
            n, p = n + 1, p * rate / (n + 1)
            total += p
        assert got[k] == n
    assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in rows.values()}

    before, after = seen["byte-level bpe"]
    texts = Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in before.collect())
    assert Counter((r.doc_id, r.decoded_sha256) for r in after.collect()) == texts


def in_order(docs):
    """Rows in the order in which stages compare them: by id, nulls last, then by the text's hash."""
    return docs.orderBy(F.col("doc_id").isNull(), "doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).collect()


def test_awkward_documents(spark, docs, empty, sf_dir):
    """Null, empty and very long texts, repeated rows and ids: each stage against brute force on its own input."""
    pytest.importorskip("public_tokenizers")
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, df: written(stages[name](spark, df, sf_dir), "test")
    own = docs.select(*corpus_pipeline.COLUMNS)
    assert run("quality classifier", own).exceptAll(own).count() == 0

    after = run("line dedup", own)
    distinct = list(dict.fromkeys((r.doc_id, r.text or "") for r in in_order(own)))
    of = dict(zip(distinct, without_lines(distinct), strict=True))
    assert Counter((r.doc_id, r.text) for r in after.collect()) == Counter((r.doc_id, of[r.doc_id, r.text or ""]) for r in own.collect())

    rows = in_order(after)
    alone = run("simhash near-dedup", after)
    assert Counter((r.doc_id, r.text) for r in alone.collect()) == Counter((rows[i].doc_id, rows[i].text) for i in set(brute_groups([r.text for r in rows])))

    before, mixture = alone.collect(), run("mixing to target weights", alone)
    size, want = Counter(), Counter()
    for r in before:
        size[r.source] += len(r.text or "") + 1
    for r in before:
        rate = sum(size.values()) / len(size) / size[r.source]
        u, n, p = int(hashlib.md5(f"1:0:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-rate)
        total = p
        while total <= u:
            n, p = n + 1, p * rate / (n + 1)
            total += p
        want[tuple(r)] += n
    assert Counter(tuple(r) for r in mixture.collect()) == +want

    ids = run("byte-level bpe", own)
    assert Counter((r.doc_id, r.decoded_sha256) for r in ids.collect()) == Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in own.collect())

    table = empty.select(*corpus_pipeline.COLUMNS)
    for name in stages:
        table = run(name, table)
    assert table.count() == 0
