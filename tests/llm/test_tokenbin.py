import functools
import zlib

import numpy as np
import pytest

from glasswing.llm import queries, tokenbin

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def data():
    return tokenbin.vocabulary(queries.vocabulary("byte_bpe_50k.json"))


@functools.cache
def tokenizer(data):
    from tokenizers import Tokenizer

    return Tokenizer.from_buffer(data)


def library(data, text):
    t = tokenizer(data)
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def test_files_equal_the_library(spark, sf_dir, data):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got, start = {r.doc_id: r for r in queries.op8_tokenbin(spark, sf_dir).collect()}, 0
    for r in rows:
        ids = library(data, r.text)
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_parts_equal_the_library(data, monkeypatch):
    """Special tokens' strings, spaces that touch, punctuation, other scripts, and a cache that overflows."""
    import random

    monkeypatch.setattr(tokenbin, "MOST_WORDS", 50)
    rng, encode = random.Random(3), tokenbin.LibraryEncoder(data)
    some = ["<|endoftext|>", "a<|endoftext|>b", " ", "\n", "  ", "\t", "word", "Word,", "it's", "we'll.", "naïve", "Größe,", "日本語", "😀", "12", "3.4", "x_y", "\u00a0", "", "<|endoftext", "--", "\r\n"]
    for text in ["", *("".join(rng.choice(["", " ", " ", "\n"]) + rng.choice(some) for _ in range(rng.randint(1, 12))) for _ in range(3000))]:
        ids = np.frombuffer(encode(text), "<u4").tolist()
        assert [*ids, 0] == library(data, text), text


def test_awkward_rows_and_reading_one_document(spark, docs, empty, data, tmp_path):
    folder, manifest = tokenbin.write(docs, data, f"file://{tmp_path}/t", shards=3)
    out = tokenbin.read(spark, folder, manifest, "ids").collect()
    assert len(out) == docs.count()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(library(data, r.text))
    got = {}
    for r in sorted(out, key=lambda r: r.start):
        got.setdefault(r.doc_id, []).append(r.ids)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()}
    assert list(got)[0] is None and list(got)[1:] == sorted(k for k in got if k is not None)
    shards = [tokenbin.Shard(folder, m["name"]) for m in manifest]
    assert [x.tolist() for s in shards if (x := s.find(12)) is not None] == texts[12]
    assert all(s.find(999) is None for s in shards)
    assert tokenbin.read(spark, *tokenbin.write(empty, data, f"file://{tmp_path}/e")).count() == 0


def test_another_dictionary_is_refused(spark, sf_dir, data, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, manifest = tokenbin.write(docs, data, f"file://{tmp_path}/d", shards=1)
    assert (tmp_path / "d/dictionary").stat().st_size > 0
    (tmp_path / "d/dictionary").write_bytes(b"x")
    with pytest.raises(ValueError, match="another dictionary"):
        tokenbin.Shard(folder, manifest[0]["name"])
