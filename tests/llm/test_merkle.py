import hashlib
import zlib

from glasswing.llm import merkle
from glasswing.llm.queries import op12_merkle
from pyspark.sql import functions as F


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(digests):
    """The root and, for each leaf, its siblings level by level as (before, after)."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for p, k in enumerate(at):
            run = digests[k - k % 3 : k - k % 3 + 3]
            paths[p].append((run[: k % 3], run[k % 3 + 1 :]))
        digests = [H(*digests[i : i + 3]) for i in range(0, len(digests), 3)]
        at = [k // 3 for k in at]
    return digests[0], paths


def brute(rows):
    """``(doc_id, leaf, subroot, root, proof, folded, verified)`` of rows ``(doc_id, source, lang, n_chars, text)``."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order, trees = sorted(by, key=lambda s: (s is not None, (s or "").encode())), {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in by[s]])
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for r, path in zip(by[s], trees[s][1], strict=True):
            harmed = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = leaf((*r[:4], r[4].replace("\n", ""))) if harmed else leaf(r)
            for before, after in path + top:
                now = H(*before, now, *after)
            out.append((r[0], leaf(r), trees[s][0], root, H(*[d for b, a in path + top for d in b + a]), now, now == root))
    return sorted(out, key=str)


def ours(spark, docs, monkeypatch):
    monkeypatch.setattr("glasswing.llm.queries.table", lambda *_: docs)
    out = op12_merkle(spark, "")
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in out.collect()), key=str)


def test_query_equals_brute_force(spark, monkeypatch):
    rows = [(i, f"s{i % 5}" if i % 7 else None, "en" if i % 3 else None, i, f"line {i}\nnext é" if i % 4 else None) for i in range(200)]
    rows += [(1000 + i, "hot", None, None, "a\nb") for i in range(250)] + [(5000, "lone", "de", 1, "x\n")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = ours(spark, docs, monkeypatch)
    assert got == brute(rows) and 0 < sum(r[-1] for r in got) < len(rows)


def test_awkward_documents(spark, docs, empty, monkeypatch):
    clash = docs.withColumns({c: F.lit("y") for c in ("p", "n", "s", "h", "row", "kids", "found", "leaf", "of", "path")})
    rows = [tuple(r[c] for c in merkle.FIELDS) for r in docs.collect()]
    assert ours(spark, clash, monkeypatch) == brute(rows)
    assert ours(spark, empty, monkeypatch) == []
    assert merkle.manifest(empty).root is None


def test_one_leaf_is_the_root(spark):
    made = merkle.manifest(spark.createDataFrame([(1, "a", None, None, "t")], "doc_id long, source string, lang string, n_chars long, text string"))
    assert made.root == leaf((1, "a", None, None, "t")) == made.proofs.head()["leaf"]


def test_levels_lie_in_the_store(spark, docs):
    made = merkle.manifest(docs)
    nodes = spark.read.parquet(f"{made.store}/sources")
    assert nodes.where("level = 0").count() == docs.count()
    assert nodes.where("n = 1").count() == docs.select("source").distinct().count()
