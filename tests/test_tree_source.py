import os
import time

import pytest
from pyspark.sql import functions as F

from glasswing.sources import changes, tree


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "top"
    for d in ("a/b/c", "a/x", "z/deep/er", "empty"):
        (top / d).mkdir(parents=True)
    for f in ("a/1.jpg", "a/2.JPG", "a/b/3.png", "a/b/c/4.mp4", "a/x/5.txt", "z/deep/er/6.pdf", "z/deep/7.webp", "8.zip", ".h.jpg"):
        (top / f).write_bytes(b"123")
    return top


@pytest.fixture
def roots(root):
    return tree.Roots({"m": str(root)})


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def names(df):
    return sorted(r.rel_path for r in df.collect())


@pytest.mark.parametrize(
    "where",
    ["rel_path like 'a/b%'", "startswith(rel_path, 'a/')", "rel_path = 'a/b/3.png'", "depth <= 2", "depth = 3", "depth > 1 and depth < 4", "is_dir", "not is_dir", "media_type = 'image'", "media_type in ('pdf', 'video')", "media_type = 'image' and startswith(rel_path, 'z')", "root_id = 'root-0'", "root_id = 'root-1'", "startswith(rel_path, 'a/b') and startswith(rel_path, 'z')", "rel_path = 'a' and rel_path = 'z'", "rel_path = 'a/b' and startswith(rel_path, 'a/b/c')", "size = 3 and depth >= 2", "media_type is null", "rel_path is null"],
)
def test_pushed_filters_change_no_result(spark, roots, where):
    all_ = spark.createDataFrame(tree.scan(spark, roots, "root-0").toPandas())
    assert names(tree.scan(spark, roots, "root-0").where(where)) == names(all_.where(where))


def test_the_plan_shows_that_the_source_has_taken_the_filters(spark, roots):
    df = tree.scan(spark, roots, "root-0")
    assert "Filter " not in plan(df.where("startswith(rel_path, 'a/') and depth <= 2 and media_type = 'image' and not is_dir"))
    left = plan(df.where("startswith(rel_path, 'a/') and size > 2 and depth in (1, 3)"))
    assert "size" in left.split("Filter")[1].split("\n")[0] and "startswith" not in left.lower()


def test_directories_that_hold_nothing_wanted_stay_closed(spark, roots):
    opened = lambda **how: names(tree.opened(spark, roots, "root-0", **how))
    assert opened() == ["", "a", "a/b", "a/b/c", "a/x", "empty", "z", "z/deep", "z/deep/er"]
    assert opened(prefix="a/b/") == ["", "a", "a/b", "a/b/c"]
    assert opened(depth=1) == [""]


def test_directories_with_an_image(spark, roots):
    out = tree.directories_with(spark, roots, "root-0")
    assert names(out) == ["a", "a/b", "z/deep"]
    assert names(tree.directories_with(spark, roots, "root-0", "pdf")) == ["z/deep/er"]
    row = tree.scan(spark, roots, "root-0", stat=False).where("rel_path = 'a/1.jpg'").first()
    assert row["size"] is None and row["mtime"] is None and row["media_type"] == "image"


def batches(spark, roots, tmp_path):
    """What one run until nothing is left gives: files, and whether their directory was listed."""
    seen = []
    rows = spark.readStream.format("tree_changes").options(path=roots.paths["root-0"], state=str(tmp_path / "state"), lag_ms="50")
    spark.dataSource.register(changes.ChangesSource)
    time.sleep(0.3)
    query = rows.load().writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    return {r.rel_path: r.listed for r in seen}


def test_a_restarted_stream_takes_up_only_new_and_changed_files(spark, root, roots, tmp_path):
    first = batches(spark, roots, tmp_path)
    assert set(first) == {"a/1.jpg", "a/2.JPG", "a/b/3.png", "a/b/c/4.mp4", "a/x/5.txt", "z/deep/er/6.pdf", "z/deep/7.webp", "8.zip"}
    assert batches(spark, roots, tmp_path) == {}
    (root / "a/x/new.jpg").write_bytes(b"1")
    (root / "z/deep/er/6.pdf").write_bytes(b"changed")
    os.utime(root / "8.zip", (0, 0))
    os.rename(root / "a/1.jpg", root / "empty/moved.jpg")
    got = batches(spark, roots, tmp_path)
    assert got == {"a/x/new.jpg": True, "z/deep/er/6.pdf": False, "8.zip": False, "empty/moved.jpg": True}
    assert batches(spark, roots, tmp_path) == {}


def test_changes_as_a_typed_listing(spark, roots, tmp_path):
    rows = changes.changes(spark, roots, "root-0", str(tmp_path / "s"))
    assert rows.isStreaming and {"name", "parent", "media_type", "has_thumb"} <= set(rows.columns)
