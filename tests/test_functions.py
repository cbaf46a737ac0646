import pytest
from pyspark.sql import functions as F

from glasswing.functions import media, paths, vectors


def values(spark, expr, *columns):
    names = [f"c{i}" for i in range(len(columns[0]))]
    return [r[0] for r in spark.createDataFrame(columns, names).select(expr(*[F.col(n) for n in names])).collect()]


def test_canonical_paths(spark):
    cases = {"x": "x", "/x": "x", "./x": "x", "a/../x": "x", "\\a\\b": "a/b", "": "", "/": "", ".": "", "../../etc": "etc", "a//b/./c/": "a/b/c", "a..b/c": "a..b/c"}
    assert values(spark, paths.canonical, *[(k,) for k in cases]) == list(cases.values())


def test_scopes_know_no_wildcards(spark):
    rows = [("a_b/x",), ("axb/x",), ("a_b/c/x",), ("a_b",), ("x",)]
    assert values(spark, lambda k: paths.below(k, "/a_b/"), *rows) == [True, False, True, False, False]
    assert values(spark, lambda k: paths.directly_in(k, "a_b"), *rows) == [True, False, False, False, False]
    assert values(spark, lambda k: paths.directly_in(k, "/"), *rows) == [False, False, False, True, True]
    assert values(spark, paths.parent, *rows) == ["a_b", "axb", "a_b/c", "", ""]


def test_media_types(spark):
    names = ["photo.jpg", "PHOTO.JPG", "image.png", "file.webp", "video.mp4", "movie.mkv", "archive.zip", "doc.pdf", "readme.txt", "Makefile"]
    assert values(spark, media.media_type, *[(n,) for n in names]) == ["image"] * 4 + ["video"] * 2 + ["archive", "pdf", "other", "other"]
    assert values(spark, lambda n: media.has_thumbnail(media.media_type(n)), *[(n,) for n in names]) == [True] * 6 + [False, True, False, False]


def test_checksums(spark):
    names = [("a [0a1B2c3D][DEADbeef].mkv",), ("a [0a1B2c3].mkv",), ("none",)]
    assert values(spark, media.crc32_in_name, *names) == ["DEADBEEF", None, None]
    hello, again, world = values(spark, lambda c: media.sha256_hex(c.cast("binary")), ("hello",), ("hello",), ("world",))
    assert hello == again != world
    assert values(spark, lambda c: media.crc32_hex(c.cast("binary")), ("hello",)) == ["3610A686"]


@pytest.mark.parametrize(("value", "want"), [(0, 32), (10, 32), (16, 32), (48, 64), (47, 32), (960, 960), (970, 960)])
def test_multiples_of_32(spark, value, want):
    assert values(spark, media.multiple_of_32, (float(value),)) == [want]


def test_positions(spark):
    assert values(spark, lambda d: media.spaced_positions(d, 4), (10.0,), (0.0,)) == [[2.0, 4.0, 6.0, 8.0], [1.0] * 4]
    assert values(spark, media.seek_position, (100.0,), (5.0,), (0.0,)) == ["10.00", "0.00", "1"]
    out = values(spark, media.fallback_positions, (100.0, 10.0), (0.0, 1.0), (1.0, 0.0))
    assert out[0] == [10.0, 12.0, 8.0, 15.0, 5.0, 20.0, 0.0, 11.0, 9.0] and out[1] == [1.0, 0.0] and out[2][0] == 0.0 and max(out[2]) <= 1.0


def test_sizes(spark):
    assert values(spark, media.human_size, (5,), (1536,), (3 << 20,), (5 << 30,)) == ["5 B", "1.5 KB", "3.0 MB", "5.0 GB"]


def test_vectors(spark):
    rows = [([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0]), ([1.0, 2.0, 3.0], [1.0, 1.0])]
    assert values(spark, vectors.dot, *rows) == [11.0, 0.0, 3.0]
    assert values(spark, lambda a, b: vectors.normalized(a), *rows)[:2] == [[0.6, 0.8], [0.0, 0.0]]
