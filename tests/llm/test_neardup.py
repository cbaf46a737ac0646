import random
from collections import Counter

import numpy as np

import corpus_pipeline
from glasswing.llm import neardup

from .conftest import prose


def brute_set(text):
    words = [w.lower() for w in (text or "").split()]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts):
    """The first place reachable over pairs of Jaccard similarity 0.8 or more, for each text."""
    sets, label = [brute_set(t) for t in texts], np.arange(len(texts))
    near = np.array([[not a | b or len(a & b) >= 0.8 * len(a | b) - 1e-9 for b in sets] for a in sets])
    while True:
        new = np.where(near, label[None, :], len(texts)).min(1)
        if (new == label).all():
            return label
        label = new


def edited(text, words, rng):
    out = text.split()
    for at in rng.sample(range(len(out)), words):
        out[at] = f"edit{rng.randrange(10**9)}"
    return " ".join(out)


def rows_of(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_copies_around_the_threshold(spark, sf_dir):
    """Edits around similarity 0.8, chains of copies, a passage that many share, a large group of copies."""
    rng, texts = random.Random(1), []
    for k in range(60):
        base = prose(rng.randrange(30, 300), 1000 + k)
        texts += [base, edited(base, max(1, len(base.split()) * rng.randrange(0, 5) // 100), rng)]
    for _ in range(8):
        texts.append(edited(texts[-1], 3, rng))
    passage, base = prose(60, 7), prose(120, 8)
    texts += [passage + " " + prose(rng.randrange(5, 40), 2000 + k) for k in range(60)] + [edited(base, 1 + k % 4, rng) for k in range(80)]
    rng.shuffle(texts)
    label = brute_groups(texts)
    assert 3 < len(texts) - len(set(label)) < len(texts) - 20
    out = corpus_pipeline.one_of_each(spark, rows_of(spark, list(enumerate(texts))), sf_dir)
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(label.tolist()))


def test_rows_that_share_an_id_or_have_none(spark, sf_dir):
    """Unlike texts stay whatever their ids, and what stays of a group is one of its own rows."""
    a, b, c = prose(80, 11), prose(80, 12), prose(80, 13)
    rows = [(5, a), (5, b), (3, b), (None, c), (None, prose(80, 14)), (None, None), (None, a), (7, c), (9, ""), (5, a)]
    out = corpus_pipeline.one_of_each(spark, rows_of(spark, rows), sf_dir)
    want = [(5, a), (3, b), (7, c), (None, prose(80, 14)), (9, "")]
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(want)


def test_wide_parities_never_rule_out_more_than_tokens_do():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 3000), dtype=np.uint64))
        b = np.unique(np.concatenate((a[: rng.integers(0, len(a) + 1)], rng.integers(0, 1 << 63, rng.integers(0, 600), dtype=np.uint64))))
        assert neardup.differing(neardup.wide_parities(a), neardup.wide_parities(b)) <= len(np.setxor1d(a, b))


def test_long_texts_that_share_a_passage_are_ruled_out_before_texts_are_moved(spark, sf_dir, monkeypatch):
    passage = prose(1650, 21)
    rows = [(k, passage + " " + prose(350, 30 + k)) for k in range(6)] + [(9, passage + " " + prose(350, 30) + " one more")]
    moved, write = [], neardup.written

    def spied(df, name):
        out = write(df, name)
        if name == "neardup-texts":
            moved.append(out.count())
        return out

    monkeypatch.setattr(neardup, "written", spied)
    out = corpus_pipeline.one_of_each(spark, rows_of(spark, rows), sf_dir)
    assert sorted(r.doc_id for r in out.collect()) == list(range(6))
    assert sum(moved) == 2
