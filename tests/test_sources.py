import pytest

from glasswing.sources import labels, tree
from glasswing.streaming import jobs


@pytest.fixture
def root(tmp_path):
    for name in ("sub/deep", "empty", "dir&name", ".secret"):
        (tmp_path / name).mkdir(parents=True)
    for name in ("_under.jpg", ".dot.jpg", "sub/deep/x.MP4", "sub/_y.txt", "dir&name/file'name.zip", ".secret/z.jpg", "top.pdf"):
        (tmp_path / name).write_bytes(b"12345")
    return tmp_path


def test_tree_scan(spark, root):
    roots = tree.Roots({"media": str(root)})
    rows = {r.rel_path: r for r in tree.scan(spark, roots, "root-0").collect()}
    assert set(rows) == {"sub", "sub/deep", "empty", "dir&name", "_under.jpg", "sub/deep/x.MP4", "sub/_y.txt", "dir&name/file'name.zip", "top.pdf"}
    assert rows["sub/deep/x.MP4"].media_type == "video" and rows["dir&name/file'name.zip"].is_zip and rows["top.pdf"].has_thumb
    assert rows["empty"].is_dir and rows["_under.jpg"].size == 5 and rows["sub/_y.txt"].parent == "sub"
    flat = tree.scan(spark, roots, "root-0", "sub", recursive=False)
    assert {r.rel_path for r in flat.collect()} == {"sub/deep", "sub/_y.txt"}
    deep = tree.scan(spark, roots, "root-0", "sub")
    assert {r.rel_path for r in tree.media_files(deep).collect()} == {"sub/deep/x.MP4"}
    assert roots.frame(spark).first().root_id == "root-0"


def test_paths_stay_below_their_root(root):
    roots = tree.Roots({"media": str(root / "sub")})
    assert roots.resolve("root-0", "../../etc/passwd") == str(root / "sub/etc/passwd")
    (root / "sub/out").symlink_to("/etc")
    with pytest.raises(tree.RootError):
        roots.resolve("root-0", "out/passwd")
    with pytest.raises(tree.RootError):
        roots.resolve("root-9")


def test_label_files(spark, tmp_path):
    made = spark.createDataFrame([("a", 0, "p", "g", [3.0, 4.0]), ("b", 1, "q", None, [0.0, 0.0])], "label string, ord int, prompt string, grp string, prototype array<float>")
    labels.export_labels(made, str(tmp_path / "l.json"), "m", 100.0)
    rows, scale = labels.label_embeddings(spark, str(tmp_path / "l.json"))
    got = rows.orderBy("ord").collect()
    assert scale == 100.0 and [r.grp for r in got] == ["g", None] and abs(got[0].prototype[0] - 0.6) < 1e-6
    assert labels.characters("a\nb\nc\n") == ["", "a", "b", "c", " "]


def test_a_restarted_stream_takes_only_new_jobs(spark, tmp_path):
    source, seen = str(tmp_path / "jobs"), []
    frame = lambda keys: spark.createDataFrame([(k, 1) for k in keys], "rel_path string, mtime int")
    frame("aab").coalesce(1).write.parquet(source)
    done = frame("b")

    def run():
        query = jobs.run_jobs(jobs.file_stream(spark, source), lambda: done, ["rel_path", "mtime"], lambda df: seen.extend(sorted(r.rel_path for r in df.collect())), str(tmp_path / "ck"))
        query.awaitTermination()

    run()
    assert seen == ["a"]
    frame("c").coalesce(1).write.mode("append").parquet(source)
    run()
    assert seen == ["a", "c"]


def test_local_labels_take_the_place_of_base_ones(spark):
    base = "labels: [{name: a, prompt: p, group: g}, {name: b}]"
    rows = lambda *text: [tuple(r) for r in labels.definitions(spark, *text).orderBy("ord").collect()]
    assert rows(base) == [("a", 0, "p", "g"), ("b", 1, "b", "")]
    assert rows(base, "labels: [{name: c}, {name: a, prompt: own}]") == [("a", 0, "own", ""), ("b", 1, "b", ""), ("c", 2, "c", "")]
    for bad in ("labels: []", "labels: [{prompt: x}]", "labels: [{name: a}, {name: a}]"):
        with pytest.raises(ValueError):
            labels.definitions(spark, bad)


def test_work_is_switched_off_while_the_stream_runs(spark, tmp_path):
    source, seen, on = str(tmp_path / "jobs"), [], {"now": False}
    stored = spark.createDataFrame([], "rel_path string")
    for step, name in ((False, "a"), (True, "b")):
        spark.createDataFrame([(name,)], "rel_path string").coalesce(1).write.mode("append").parquet(source)
        on["now"] = step
        jobs.run_jobs(jobs.file_stream(spark, source), lambda: stored, ["rel_path"], lambda df: seen.extend(r.rel_path for r in df.collect()), str(tmp_path / "ck"), enabled=lambda: on["now"]).awaitTermination()
    assert seen == ["b"]
