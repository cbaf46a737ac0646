import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glasswing.functions import media
from glasswing.operators import fileops, frames, listing, search, store, tensors, tools
from glasswing.sources import labels, tree


@pytest.fixture
def roots(tmp_path):
    for name in ("vol.", "a", "ab", "sub"):
        (tmp_path / name).mkdir()
    for name, text in (("vol./in.txt", b"12345"), ("_under.jpg", b"under"), ("a/x.jpg", b"x"), ("sub/v.mp4", b"video")):
        (tmp_path / name).write_bytes(text)
    return tree.Roots({"media": str(tmp_path)})


def test_a_folder_that_ends_with_a_dot(spark, roots):
    assert [r.rel_path for r in tree.scan(spark, roots, "root-0", "vol.").collect()] == ["vol./in.txt"]


def test_deep_trees_are_dealt_out(spark, roots, monkeypatch):
    import os

    top = roots.resolve("root-0", "sub")
    for i in range(6):
        os.makedirs(f"{top}/d{i}/e/f")
    whole = {r.rel_path for r in tree.scan(spark, roots, "root-0").collect()}
    assert {f"sub/d{i}/e/f" for i in range(6)} <= whole and "_under.jpg" in whole
    reader = tree.TreeReader({"path": roots.paths["root-0"]})
    assert len(reader.partitions()) > 6
    monkeypatch.setattr(tree, "PARTS", 1)
    assert len(reader.partitions()) == 1


def test_hashes_join_to_the_listing(spark, roots):
    files = tree.scan(spark, roots, "root-0")
    got = {r.rel_path: r.crc32 for r in tree.with_hashes(files, roots).collect()}
    assert set(got) == {"vol./in.txt", "_under.jpg", "a/x.jpg", "sub/v.mp4"} and got["vol./in.txt"] == "CBF53A1C"
    gone = spark.createDataFrame([("root-0", "none.txt", False)], "root_id string, rel_path string, is_dir boolean")
    assert tree.with_hashes(gone, roots).first().sha256 is None


def test_blocks_from_json(spark):
    text = '[{"text": "a", "confidence": 0.5, "x": 0, "y": 0, "w": 1, "h": 1}]'
    assert spark.createDataFrame([(text,)], "j string").select(labels.blocks_of(F.col("j")).alias("b")).first().b[0].text == "a"


def test_copy_beside_a_longer_name(roots):
    top = roots.paths["root-0"]
    assert fileops.copy(f"{top}/a", f"{top}/ab") == f"{top}/ab/a"
    with pytest.raises(ValueError, match="itself"):
        fileops.copy(f"{top}/a", f"{top}/a")


def test_changes_stay_below_their_root(roots, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    (out / "kept.txt").write_text("kept")
    top = roots.paths["root-0"]
    (tree.os.symlink)(str(out), f"{top}/link")
    below = fileops.Below(roots)
    with pytest.raises(tree.RootError):
        below.delete("root-0", "link/kept.txt")
    below.delete("root-0", "link")  # the link itself goes, what it leads to stays
    assert (out / "kept.txt").exists()
    with pytest.raises(ValueError, match="root"):
        below.delete("root-0", "../..", recursive=True)
    with pytest.raises(ValueError, match="root"):
        below.rename("root-0", "/", "other")
    assert below.rename("root-0", "a/x.jpg", "y.jpg").endswith("/a/y.jpg")
    results = below.bulk("move", "root-0", ["a/y.jpg", "a/none", ""], "root-0", "ab")
    assert fileops.status(results) == 207 and results[0].path == "a/y.jpg" and results[2].error
    with pytest.raises(tree.RootError):
        below.bulk("copy", "root-0", ["_under.jpg"], "root-7", "")
    assert fileops.clean(f"{top}/sub", "v.") == 1 and fileops.clean(f"{top}/nowhere") == 0


def test_whole_first_blocks_and_locale_order(spark):
    rows = [("v", 2, "b", 0.9), ("v", 1, " b ", 0.6), ("v", 0, "a", 0.7), ("v", 3, "  ", 0.9)]
    got = frames.first_blocks(spark.createDataFrame(rows, "k string, pos int, text string, confidence double"), "k", "pos").collect()
    assert sorted((r.text, r.pos, r.confidence) for r in got) == [("a", 0, 0.7), ("b", 1, 0.6)]
    names = spark.createDataFrame([("b", False), ("A", False), ("a", False), ("é", False), ("f", False), ("Z", True)], "name string, is_dir boolean")
    assert [r.name for r in listing.by_locale(names).collect()] == ["Z", "a", "A", "b", "é", "f"]


def test_scoped_search_and_get_or_compute(spark):
    key = "root_id string, rel_path string"
    files = spark.createDataFrame([("r", "x/cat.jpg", "cat.jpg", False), ("r", "y/cat.jpg", "cat.jpg", False), ("s", "x/cat.jpg", "cat.jpg", False)], key + ", name string, is_dir boolean")
    none = spark.createDataFrame([], key + ", label string, text string")
    assert [r.rel_path for r in search.search(files, none, none, "CAT", root_id="r", path="x").collect()] == ["x/cat.jpg"]
    stored = spark.createDataFrame([("r", "x/cat.jpg", 1)], key + ", v int")
    got = store.get_or_compute(files.select("root_id", "rel_path"), stored, lambda f: f.withColumn("v", F.lit(2)))
    assert sorted(tuple(r) for r in got.collect()) == [("r", "x/cat.jpg", 1), ("r", "y/cat.jpg", 2), ("s", "x/cat.jpg", 2)]
    assert store.as_json(stored.withColumn("n", F.lit(None).cast("int"))).first()["json"] == '{"root_id":"r","rel_path":"x/cat.jpg","v":1,"n":null}'
    assert stored.select(media.version_tag("linux", F.lit("1.0")), media.short_hash(F.lit("abcdef"), 3)).first()[:] == ("linux-1.0", "abc")


def test_outside_programs(spark, roots):
    videos = spark.createDataFrame([("root-0", "sub/v.mp4", 100.0, 95.0), ("root-0", "sub/none.mp4", None, 1.0)], "root_id string, rel_path string, duration double, target double")

    def tool(args):
        at, path = args[1], args[3]
        if "none" in path or float(at) > 90:
            raise tools.ToolError("no such place")
        return at.encode()

    by = lambda df: {(r.rel_path, r["pos"] if "pos" in df.columns else 0): r for r in df.collect()}
    one = by(tools.frame(videos, roots, tool))
    assert bytes(one["sub/v.mp4", 0].frame) == b"10.00" and one["sub/none.mp4", 0].error == "no such place"
    near = by(tools.frame_near(videos, roots, tool))
    assert float(bytes(near["sub/v.mp4", 0].frame)) <= 90 and near["sub/none.mp4", 0].frame is None
    got = by(tools.frames(videos, roots, tool))
    assert [bytes(got["sub/v.mp4", i].frame) for i in range(4)] == [b"20.00", b"40.00", b"60.00", b"80.00"]
    assert tools.durations(videos.limit(1), roots, lambda a: b" 12.5\n").first().duration == 12.5
    assert bytes(tools.first_pages(videos.limit(1), roots, [lambda a: b"", lambda a: 1 / 0, lambda a: b"page"]).first().page) == b"page"
    assert tools.recognised(videos.limit(1), roots, lambda a: b'[{"text": "hi", "confidence": 1}]').first().blocks[0].text == "hi"
    assert tools.recognised(videos.limit(1), roots, lambda a: b"{}").first().error == "no list of blocks"
    pictures = videos.limit(1).select("root_id", "rel_path", F.lit("k1").alias("cache_key"), F.lit(b"abc").alias("content"))
    path = tools.thumbnails(pictures, lambda x: x[::-1], roots.paths["root-0"]).first().thumb
    assert open(path, "rb").read() == b"cba"
    with pytest.raises(tools.ToolError):
        tools.program("no-such-program", 1)([])


def test_tensors():
    flat = np.full((100, 200, 3), (10, 20, 30), np.uint8)
    x = tensors.for_detection(flat)
    assert x.shape == (1, 3, 640, 640) and x[0, :, 0, 0].max() == 0 and np.allclose(x[0, :, 320, 320] * 255, (10, 20, 30), atol=1e-3)
    assert tensors.for_detection(np.zeros((1300, 10, 3), np.uint8)).shape == (1, 3, 640, 640)
    e = tensors.for_embedding(flat)
    want = (np.array((10, 20, 30)) / 255 - tensors.EMBEDDING_MEAN) / tensors.EMBEDDING_STD
    assert e.shape == (1, 3, 224, 224) and np.allclose(e[0, :, 100, 100], want, atol=1e-5)
    assert tensors.text_size(1920, 1080) == (960, 544) and tensors.text_size(10, 10) == (32, 32) and tensors.text_size(100, 47) == (96, 32)
    assert tensors.for_text(flat).shape == (1, 3, 96, 192)
    assert tensors.line_width(10, 100) == 24 and tensors.line_width(10_000, 10) == 1280 and tensors.line_width(100, 48) == math.ceil(100)
    line = tensors.for_line(np.full((48, 100, 3), 255, np.uint8))
    assert line.shape == (1, 3, 48, 100) and np.allclose(line, 1) and tensors.for_line(np.zeros((0, 5, 3), np.uint8)) is None
    ramp = np.repeat(np.arange(0, 256, 2, dtype=np.uint8)[None, :, None], 4, 0).repeat(3, 2)
    small = tensors.resized(ramp, 64, 2)
    assert small.shape == (2, 64, 3) and np.all(np.diff(small[0, :, 0].astype(int)) > 0) and abs(int(small.mean()) - int(ramp.mean())) <= 1
