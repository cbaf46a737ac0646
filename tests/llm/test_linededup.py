import random
import re
from collections import Counter, defaultdict

import pytest

from glasswing.llm import linededup, queries


def tokens(line):
    w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", line.lower()) if x]
    return w, frozenset(w)


def brute(rows, similarity=0.8):
    """Texts without lines that any earlier line equals or resembles; rows in their order."""
    index, sets, seen, out = defaultdict(list), [], set(), []
    for _, text in rows:
        kept = []
        for line in text.split("\n"):
            w, s = tokens(line)
            if not w:
                kept.append(line)
                continue
            key = " ".join(w)
            if key in seen:
                continue
            seen.add(key)
            shared = Counter(j for x in s for j in index[x])
            if not any(o / (len(s) + len(sets[j]) - o) >= similarity - 1e-9 for j, o in shared.items()):
                kept.append(line)
            for x in s:
                index[x].append(len(sets))
            sets.append(s)
        out.append("\n".join(kept))
    return out


def test_equals_brute_force_on_the_smallest_tables(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = {r.doc_id: r.text for r in queries.op4_linededup(spark, sf_dir).collect()}
    assert [got[k] for k, _ in rows] == brute(rows)


@pytest.mark.parametrize("seed", range(2))
def test_near_copies_of_one_line(spark, seed):
    """A group of near copies, of which some resemble each other and not the first."""
    import random

    rng = random.Random(seed)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            own[rng.randrange(60)] = f"x{rng.randrange(8)}"
        if rng.random() < 0.3:
            base = own
        rows.append((i, " ".join(own) + "\n" + " ".join(own[: rng.randint(1, 9)])))
    got = {r.doc_id: r.text for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k, _ in rows] == brute(rows)


def test_awkward_rows(docs, empty):
    out = linededup.dedup(docs).collect()
    assert len(out) == docs.count() and linededup.dedup(empty).count() == 0
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert by[2][0].text == "" and by[3][0].text == "" and by[4][0].text == "   \n\t "
    assert by[1][0].text == "" and by[1][0].n_removed == 1  # the same words as document 0
    assert len(by[6]) == 2 and by[6][0] == by[6][1] and by[6][0].n_removed == 0  # a repeated row is one document
    assert by[9][0].text == "" and by[9][0].n_removed == 2  # both lines came before; the blank one stays
    assert by[0][0].keep == "x" and by[0][0].fp == "x"
    assert set(linededup.dedup(docs).columns) == set(docs.columns) | {"n_removed"}


def test_one_word_of_thirty(spark):
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k"), (3, "j i h g f e d c b a")]
    long = [f"t{i}" for i in range(30)]
    rows += [(4, " ".join(long)), (5, " ".join(["new", *long[1:]])), (6, " ".join([*long[:15], "other", *long[16:]])), (7, " ".join([*long[:22], *[f"u{i}" for i in range(8)]]))]
    got = {r.doc_id: r.text for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "", 3: "", 4: rows[3][1], 5: "", 6: "", 7: rows[6][1]}
    with pytest.raises(ValueError, match="similarity"):
        linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.4)


@pytest.mark.parametrize("seed", range(3))
def test_frequent_words_and_passages(spark, monkeypatch, seed):
    """With hardly any word rare: pairs of frequent ones, long lists, and lines around one common passage."""
    import random

    monkeypatch.setattr(linededup, "FREQUENT", 2)
    monkeypatch.setattr(linededup, "SHORT", 3)
    monkeypatch.setattr(linededup, "LEADS", 1)
    rng = random.Random(seed)
    words, passage, rows = [f"w{i}" for i in range(40)], [f"p{i}" for i in range(20)], []
    made = [rng.sample(words, rng.randint(1, 30)) for _ in range(60)]
    for i in range(300):
        own = list(rng.choice(made))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            own[rng.randrange(len(own))] = rng.choice(words)
        own = own[: rng.randint(1, len(own))] if rng.random() < 0.3 else own
        rows.append((i, " ".join(own if rng.random() < 0.6 else own[: rng.randint(0, 8)] + passage)))
    got = {r.doc_id: r.text for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k, _ in rows] == brute(rows)


def test_lines_of_few_frequent_words_at_several_similarities(spark):
    rng = random.Random(8)
    lines = [" ".join(rng.sample([f"w{i}" for i in range(7)], rng.randrange(1, 6))) for _ in range(120)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    for similarity in (0.51, 0.6, 0.9):
        gone = {r.doc_id for r in linededup.dedup(df, similarity).where("n_removed > 0").collect()}
        sets = [set(x.split()) for x in lines]
        near = lambda i, j: lines[i] == lines[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity - 1e-9
        assert gone == {i for i in range(len(lines)) if any(near(i, j) for j in range(i))}
    with pytest.raises(ValueError):
        linededup.dedup(df, 0.5)


def test_lines_that_meet_at_a_key_are_shuffled_once(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = linededup.written(spark.sql("SELECT id % 5 AS x, id % 3 AS k, struct(id AS doc, id AS r, 7 AS n) AS v FROM range(20)"), "rows").where("k < 2").select("x", "v")
        pairs = linededup.met_twice(rows)
        assert pairs._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") == 1
        assert linededup.unordered(pairs).where("a < b and n = 14").count() == sum(a % 5 == b % 5 for a in range(20) for b in range(a) if a % 3 < 2 and b % 3 < 2)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_lines_are_split_into_words_once(spark, monkeypatch):
    plans, write = [], linededup.written
    monkeypatch.setattr(linededup, "written", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, name))[1])
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k\nother words")]
    got = {r.doc_id: r.text for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "other words"}
    assert sum("split(" in p and "xxhash64(lambda" in p for p in plans) == 1


@pytest.mark.parametrize("seed", range(2))
def test_lines_about_as_wide_as_the_parities(spark, seed):
    """Near copies, at the limit of the similarity and beyond, of lines of fewer and of more tokens than have twice as many parities."""
    rng = random.Random(seed)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([47, 51, 52, 53, 64, 65, 130, 300]))]
        for _ in range(6):
            own = list(base)
            for k in rng.sample(range(len(own)), rng.choice([0, len(own) // 9, len(own) // 9 + 1])):
                own[k] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own[: len(own) - rng.choice([0, 0, len(own) // 5])])))
    got = {r.doc_id: r.text for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k, _ in rows] == brute(rows)


def test_shared_pairs_are_not_joined_with_their_classes(spark, monkeypatch):
    """Pairs of frequent words have all that is asked of a class from the start, and are written in parts."""
    plans, real = [], linededup.written

    def noted(df, name):
        if name == "lines-posted":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(linededup, "written", noted)
    monkeypatch.setattr(linededup, "FREQUENT", 2)
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in rng.sample(range(30), 12))) for i in range(80)], "doc_id long, text string")
    keys = linededup.line_keys(linededup.line_classes(docs), linededup.SIMILARITY)
    tables = linededup.pair_postings(keys)
    assert len(plans) == len(tables) == linededup.PARTS and not any("Join" in p for p in plans)
    own = {r.r: (r.doc, r.n, r.h, r.s, r.z, r.common) for r in keys.collect()}
    rows, seen = [r for t in tables for r in t.collect()], [{r.x for r in t.select("x").distinct().collect()} for t in tables]
    assert rows and all(seen) and len(set().union(*seen)) == sum(map(len, seen))
    assert all((r.v.doc, r.v.n, r.v.h, r.v.s, r.v.z) == own[r.v.r][:5] for r in rows)
    assert Counter(r.x for r in rows) == {r.x: r.k for r in rows} and min(r.k for r in rows) > 1


def test_classes_are_not_shuffled_again_and_their_table_is_dropped(spark, monkeypatch):
    """What is joined with the classes by their number meets them in their buckets, also where nothing is broadcast."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    shuffles, plans, real = spark.conf.get("spark.sql.shuffle.partitions"), [], linededup.written

    def noted(df, name):
        if name == "lines-compared":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(linededup, "written", noted)
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j k\nother words")]
        got = {r.doc_id: r.text for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {1: rows[0][1], 2: "other words"}
    assert plans and all("Bucketed: true" in p for p in plans)
    assert spark.conf.get("spark.sql.shuffle.partitions") == shuffles
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lines_classes")]
