import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glasswing.llm import bpe, queries

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def data():
    return bpe.read_ranks(queries.vocabulary("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(data):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(data), special_tokens={})


@pytest.fixture(scope="module")
def encoder(data):
    return bpe.Encoder(data, P.PATTERN)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abet ,.'\n\t!1é", max_size=80)))
def test_any_text_equals_the_library(encoder, library, text):
    text = text.encode("utf-8", "ignore").decode()
    import numpy as np

    assert np.frombuffer(encoder([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_rows_round_trip(docs, empty, data, library):
    out = queries.bpe_digests(docs, data)
    from collections import Counter

    want = Counter()
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()) == want
    assert queries.bpe_digests(empty, data).count() == 0


def test_query_on_the_smallest_tables(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op10_bpe(spark, sf_dir).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_long_runs(encoder, library):
    import numpy as np

    for text in ("a" * 20_000, "!?" * 5_000, " " * 3_000 + "x", "ab" * 4_000 + "é" * 999):
        assert np.frombuffer(encoder([text])[0], "<u4").tolist() == library.encode_ordinary(text)
