import re

import numpy as np
import xxhash

from glasswing.llm import queries, simhash


def brute_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps, radius=4):
    """The smallest key reachable, for keys with fingerprints, in order of keys."""
    keys, f = list(fps), np.array(list(fps.values()), np.uint64)
    label = np.arange(len(keys))
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= radius
    while True:
        new = np.where(near, label[None, :], len(keys)).min(1)
        if (new == label).all():
            return {k: keys[i] for k, i in zip(keys, label, strict=True)}
        label = new


def test_equals_brute_force_on_the_smallest_tables(spark, sf_dir):
    fps = {r.doc_id: brute_fingerprint(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()}
    want = brute_components(fps)
    out = queries.op7_simhash(spark, sf_dir).collect()
    assert len(out) == len(fps) and all((r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id]) for r in out)


def test_awkward_texts(docs, empty):
    for r in docs.collect():
        assert simhash.fingerprint(r.text) & (1 << 64) - 1 == brute_fingerprint(r.text)
    out = simhash.near_duplicates(docs)
    assert out.count() == docs.count() and simhash.near_duplicates(empty).count() == 0
    of = {(r.doc_id, r.fp): r.component_id for r in out.collect()}
    assert of[2, 0] == of[3, 0] == of[4, 0] == of[None, 0] == 2
    kept = simhash.keep_one(docs)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == docs.columns and len(rows) == len(set(rows)) and simhash.keep_one(empty).count() == 0
    ids = [i for i, _ in rows]
    assert 0 in ids and 1 not in ids and (7, "another text under the same id") in rows and (None, "no id here at all") in rows


def test_links_of_clusters_and_random_fingerprints(spark):
    """Chains, a dense ball in one bucket, and pairs at exactly four and five bits."""
    rng = np.random.default_rng(3)
    fps = set(rng.integers(0, 1 << 64, 3000, dtype=np.uint64).tolist())
    centre = 0x0123456789ABCDEF
    fps |= {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (600, 2))}
    x = 0xFEDCBA9876543210
    for step in range(40):
        for b in rng.choice(64, 4 + step % 2, replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    want = brute_components({f: f for f in fps})
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    from glasswing.llm.components import connected_components

    links = simhash.near_links(spark.createDataFrame(signed, "fp long"))
    label = {r.node & (1 << 64) - 1: r.label & (1 << 64) - 1 for r in connected_components(links).collect()}
    groups, mine = {}, {}
    for f in fps:
        groups.setdefault(want[f], set()).add(f)
        mine.setdefault(label.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))
    assert links.count() < 15 * 4 * len(fps)


def test_pivot_columns_are_the_pivot_table(spark):
    """Distances of 0 and 64 among them, and numbers of pivots that don't fill the last long."""
    rng = np.random.default_rng(5)
    first = int(simhash.pivots(1)[0])
    fps = np.array([0, (1 << 64) - 1, first, ~first & (1 << 64) - 1, *rng.integers(0, 1 << 64, 50, dtype=np.uint64).tolist()], np.uint64)
    rows = spark.createDataFrame([(x,) for x in fps.view(np.int64).tolist()], "fp long")
    for count in (1, 8, 13, 24):
        got = rows.select("fp", *simhash.pivot_columns("fp", count)).toPandas()
        want = np.bitwise_count(got.fp.to_numpy().view(np.uint64)[:, None] ^ simhash.pivots(count)[None, :])
        assert (simhash.pivot_rows(got, count) == want).all() and want.min() == 0 and want.max() == 64


def test_each_number_of_blocks_meets_every_link():
    rng = np.random.default_rng(4)
    for blocks in (5, 6, 7, 8):
        masks = [m & (1 << 64) - 1 for m in simhash.masks(blocks)]
        for _ in range(200):
            flip = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(flip & m == 0 for m in masks)
