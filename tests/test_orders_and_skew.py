import random

from pyspark.sql import functions as F

from glasswing.operators import blocked, grams, listing, listing_cache, ordering, regions, rollup, scoring, skew


def test_places_without_a_window_over_a_scope(spark):
    rng = random.Random(1)
    rows = [("hot", rng.randrange(40), "x") for _ in range(400)] + [(None, 3, "y"), (None, None, "y"), ("one", 1, None), ("one", 1, None)]
    df = spark.createDataFrame(rows, "s string, v int, part string")
    out = ordering.numbered(df, ["s"], ["v"], total="n", ranges=8)
    assert out.columns == ["s", "v", "part", "place", "n"]
    got = {}
    for r in out.collect():
        got.setdefault(r.s, []).append((r.place, r.v, r.n))
    for s, own in got.items():
        want = sorted((v is not None, v or 0) for t, v, _ in rows if t == s)
        assert [p for p, _, _ in sorted(own)] == list(range(len(want))) and {n for _, _, n in own} == {len(want)}
        assert [(v is not None, v or 0) for _, v, _ in sorted(own, key=lambda x: x[0])] == want
    down = ordering.numbered(df.where("s = 'hot'"), [], ["v"], descending=[True]).orderBy("place").collect()
    assert [r.v for r in down] == sorted((v for s, v, _ in rows if s == "hot"), reverse=True)
    assert ordering.numbered(df.limit(0), ["s"], ["v"]).count() == 0
    windows = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in x]
    assert windows and all("part" in x or "sum(n" in x for x in windows)


def test_no_task_holds_a_hot_scope(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("s"), "id")
    out = ordering.numbered(df, ["s"], ["id"], ranges=8)
    sizes = [r["count"] for r in spark.read.parquet(ordering_table(out)).groupBy(F.shiftright("m", 33)).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sorted(sizes)[4]
    assert out.where("s = 'hot'").agg(F.max("place")).head()[0] == 13_333


def ordering_table(df):
    return sorted({f.rpartition("/")[0] for f in df.inputFiles()})[0]


def test_neighbours_and_ranges_equal_the_windows(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.choice(["a", "b"]), i, f"k{i}") for i in rng.sample(range(1000), 90)] + [("lone", 1, "z")], "s string, v int, previous string")
    df = df.withColumnRenamed("previous", "k")
    key = lambda rows: sorted(tuple(r) for r in rows.collect())
    assert key(ordering.around(df, ["s"], ["v"], "k")) == key(listing.neighbours(df, "s", "v", "k"))
    assert key(ordering.places(df, ["s"], ["v"], 7, 3)) == key(listing.between(df, "s", "v", 3, 7))
    assert ordering.around(df.limit(0), ["s"], ["v"], "k").count() == 0


def test_heavy_keys_are_found_and_spread(spark):
    df = spark.range(30_000, numPartitions=4).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise((F.col("id") % 5000).cast("string")).alias("hash"), F.col("id").alias("doc"), F.lit("l").alias("z"))
    assert skew.heavy(df, "hash", 0.05) == ["hot"]
    out = skew.repeated(df, share=0.05)
    want = df.where("hash is not null").groupBy("hash").count().where("count > 1")
    assert out.count() == want.agg(F.sum("count")).head()[0] and out.columns == ["hash", "doc", "z", "copies"]
    assert {r.copies for r in out.where("hash = 'hot'").select("copies").distinct().collect()} == {10_000}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spread = skew.repeated(df, share=0.05).groupBy(F.spark_partition_id()).count().collect()
        plain = df.join(want, "hash").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sizes, before = (sorted(r["count"] for r in x) for x in (spread, plain))
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2] and before[-1] > 2 * before[len(before) // 2]


def test_every_kind_of_spread_join_equals_the_plain_one(spark):
    left = spark.createDataFrame([("h", i) for i in range(300)] + [("a", 1), ("b", 2), (None, 3)] + [("b", 2)] * 2, "k string, v int")
    right = spark.createDataFrame([("h", "x"), ("h", "y"), ("a", "z"), (None, "n"), ("c", "w")], "k string, l string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got, want = (sorted(map(str, x.collect())) for x in (skew.join(left, right, "k", how, share=0.3), left.join(right, "k", how)))
        assert got == want, how
    assert skew.join(left.limit(0), right, "k").count() == 0


def listing_rows(spark):
    rows = [("r", "a", True, 0), ("r", "a/b", True, 0), ("r", "a/b/1", False, 5), ("r", "a/2", False, 7), ("r", "empty", True, 0), ("r", "3", False, None), ("s", "x/y/z", False, 1)]
    return spark.createDataFrame(rows, "root_id string, rel_path string, is_dir boolean, size long")


def test_usage_of_every_directory(spark):
    got = {(r.root_id, r.rel_path): tuple(r)[2:] for r in rollup.usage(listing_rows(spark)).collect()}
    assert got == {("r", ""): (12, 3, 3), ("r", "a"): (12, 2, 1), ("r", "a/b"): (5, 1, 0), ("r", "empty"): (0, 0, 0), ("s", ""): (1, 1, 0), ("s", "x"): (1, 1, 0), ("s", "x/y"): (1, 1, 0)}
    assert rollup.usage(listing_rows(spark).limit(0)).count() == 0
    found = spark.createDataFrame([("r", "a/b/1", True), ("r", "a/2", False), ("r", "3", None)], "root_id string, rel_path string, has_person boolean")
    assert {r.rel_path: (r.scanned, r.with_person) for r in rollup.detections(found).collect()} == {"": (3, 1), "a": (2, 1), "a/b": (1, 1)}


def test_a_hot_directory_is_summed_before_the_shuffle(spark):
    files = spark.range(5000).select(F.lit("r").alias("root_id"), F.concat(F.lit("hot/d/"), "id").alias("rel_path"), F.lit(False).alias("is_dir"), F.lit(1).cast("long").alias("size"))
    assert {r.rel_path: r.files for r in rollup.usage(files).collect()} == {"": 5000, "hot": 5000, "hot/d": 5000}


def test_search_by_trigrams_equals_contains(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdeÄß% _") for _ in range(rng.randrange(0, 60))) for _ in range(200)]
    df = spark.createDataFrame([*enumerate(texts), (7, "again abcd"), (500, None), (None, "abc")], "id int, t string")
    index = grams.index(df, "id", "t")
    for query in ("a", "ab", "abc", "ÄSS", "ÄSS", "d_e", "%", "abcd", "nothing of this", "", "  "):
        low = query.lower()
        want = sorted({i for i, t in df.collect() if i is not None and t is not None and query.strip() and low in t.lower()})
        assert sorted(r.key for r in index.search(query).collect()) == want, query
    assert grams.index(df.limit(0), "id", "t").search("abc").count() == 0


def test_rows_read_fall_with_the_rarity_of_the_query(spark):
    df = spark.range(4000).select("id", F.concat(F.lit("common text "), F.when(F.col("id") == 17, "zebra").otherwise("horse")).alias("t"))
    index = grams.index(df, "id", "t")
    read = lambda q: index.postings.where(F.col("gram").isin(sorted({q[i : i + 3] for i in range(len(q) - 2)}, key=lambda g: (index.counts.where(F.col("gram") == g).head()["n"]))[: grams.RAREST])).count()
    assert read("zebra") == 3 and read("common") == 12_000
    assert [r.key for r in index.search("text zebra").collect()] == [17]
    assert "PushedFilters: [IsNotNull(gram), In(gram" in index.candidates("zebra")._jdf.queryExecution().executedPlan().toString() or "In(gram" in index.candidates("zebra")._jdf.queryExecution().executedPlan().toString()


def test_phases_stop_when_the_limit_is_full(spark):
    df, called = spark.range(20), []

    def phase(name, where):
        def run():
            called.append(name)
            return df.where(where)

        return run

    out, n = grams.phased([phase("a", "id < 3"), phase("b", "id < 12"), phase("c", "true")], "id", limit=8)
    assert [(r.id, r.priority) for r in out.collect()] == [(0, 1), (1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (6, 2), (7, 2)]
    assert called == ["a", "b"] and n == 2
    assert grams.phased([phase("d", "false")], "id")[0].count() == 0


def test_blocks_of_labels_equal_one_vocabulary(spark):
    rng = random.Random(4)
    vec = lambda: [rng.gauss(0, 1) for _ in range(6)]
    labels = spark.createDataFrame([(f"l{i}", i, None if i % 7 == 0 else f"g{i % 3}", vec()) for i in range(40)] + [("tie", 99, "g1", None)], "label string, ord int, grp string, prototype array<double>").where("prototype is not null")
    labels = labels.unionByName(labels.where("ord in (4, 5)").withColumn("ord", F.col("ord") + 1000).withColumn("label", F.concat(F.lit("copy"), "label")))
    items = spark.createDataFrame([(i, vec()) for i in range(30)] + [(30, None)], "id int, embedding array<double>")
    want = scoring.grouped_tags(scoring.similarities(items, labels), "id", scale=3.0, threshold=0.3)
    want = {(r.id, r.grp, r.label, round(r.p, 9)) for r in want.collect()}
    top = {(r.id, r.label, r["rank"]) for r in scoring.top(scoring.similarities(items, labels), "id", "cosine", 3, "ord").collect()}
    for numbers in (24, 60, 1 << 19):
        got = blocked.grouped_tags(items, labels, "id", scale=3.0, threshold=0.3, numbers=numbers)
        assert {(r.id, r.grp, r.label, round(r.p, 9)) for r in got.collect()} == want
        assert {(r.id, r.label, r["rank"]) for r in blocked.best_labels(items, labels, "id", 3, numbers=numbers).collect()} == top
    one = blocked.grouped_tags(items, labels, "id")._jdf.queryExecution().executedPlan().toString()
    assert one.split("Subquery")[0].count("Exchange") == 0
    assert blocked.grouped_tags(items, labels.limit(0), "id").count() == 0 and blocked.grouped_tags(items.limit(0), labels, "id").count() == 0


def flood(cells, corners):
    left, out = set(cells), []
    while left:
        todo, own = [left.pop()], set()
        while todo:
            y, x = todo.pop()
            own.add((y, x))
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if (corners or not (dy and dx)) and (y + dy, x + dx) in left:
                        left.remove((y + dy, x + dx))
                        todo.append((y + dy, x + dx))
        out.append(own)
    return out


def test_regions_of_many_bitmaps(spark):
    rng = random.Random(5)
    images = {i: {(y, x) for y in range(12) for x in range(15) if rng.random() < 0.1 * i} for i in range(8)}
    images[8] = {(y, x) for y in range(30) for x in range(30) if (y % 4 == 0) or (x == 29 and y % 8 < 4) or (x == 0 and y % 8 >= 4)}  # one long snake
    cells = [(i, y, x) for i, c in images.items() for y, x in c]
    df = spark.createDataFrame(cells + cells[:5] + [(1, None, 3)], "image int, y int, x int")
    for corners in (True, False):
        found = regions.regions(regions.runs(df), corners=corners)
        got = {(r.image, r.left, r.top, r.right, r.bottom, r.cells) for r in regions.boxes(found).collect()}
        want = {(i, min(x for _, x in o), min(y for y, _ in o), max(x for _, x in o) + 1, max(y for y, _ in o) + 1, len(o)) for i, c in images.items() for o in flood(c, corners)}
        assert got == want
    assert regions.regions(regions.runs(df.limit(0))).count() == 0
    rows = spark.createDataFrame([(1, 0, [0.9, 0.1, 0.9]), (1, 1, [0.9, 0.9, 0.9]), (2, 0, None)], "image int, y int, v array<double>")
    assert [tuple(r)[1:] for r in regions.boxes(regions.regions(regions.runs_of(rows, "image", "v", 0.3))).collect()] == [(0, 0, 0, 3, 2, 5)]


def test_listing_cache(spark):
    cache, made = listing_cache.ListingCache(most=4), []

    def get(path, *rest, root="r"):
        return cache.get(root, path, lambda: made.append((root, path, *rest)) or spark.range(len(made)), *rest).count()

    assert [get("a/b"), get("/a/./b/"), get("a/b", "tag")] == [1, 1, 2] and len(made) == 2 and cache.hits == 1
    get("a/bc"), get("")
    assert cache.changed("r", "a/b/file") == 3  # the directory twice and the root; a/bc stays
    assert get("a/bc") == 3 and len(made) == 4
    assert get("a/b") == 5 and get("a/b/c", root="s") == 6
    assert cache.changed("r", "a") == 2 and cache.changed("r", "a") == 0
    for p in "vwxyz":
        get(p)
    assert len(cache.held) == 4 and ("s", "a/b/c") not in cache.held
    cache.clear("r")
    assert not cache.held


def test_no_table_of_regions_is_broadcast(spark, monkeypatch):
    plans, write = [], regions.materialised

    def spied(rows, name):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return write(rows, name)

    monkeypatch.setattr(regions, "materialised", spied)
    df = spark.createDataFrame([("i", y, x) for y in range(6) for x in range(9) if (x * y) % 4 < 3], "image string, y int, x int")
    found = regions.regions(regions.runs(df))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)
    assert found.select("region").distinct().count() == 1
