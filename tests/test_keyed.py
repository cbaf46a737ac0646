import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from glasswing.sources import keyed

AT = dt.datetime(2024, 1, 1)
PARENTS, CHILDREN = "root_id string, rel_path string, size long, scanned_at timestamp", "root_id string, rel_path string, label string, score double"
ROWS = "root_id string, rel_path string, size long, scanned_at timestamp, children array<struct<label:string,score:double>>"


def table(spark, path, buckets=4):
    return keyed.KeyedTable(spark, str(path), ["root_id", "rel_path"], PARENTS, CHILDREN, ("rel_path",), buckets)


def row(path, labels, size=1, at=0, root="r"):
    return (root, path, size, AT + dt.timedelta(hours=at), None if labels is None else [(x, 0.5) for x in labels])


def put(spark, t, *rows):
    return t.put(spark.createDataFrame(list(rows), ROWS), ["scanned_at"])


def labels(t, number=None):
    return sorted((r.rel_path, r.label) for r in t.children(number).collect())


def test_a_result_takes_the_place_of_the_one_before_with_its_children(spark, tmp_path):
    t = table(spark, tmp_path)
    assert put(spark, t, row("images/tagged.jpg", ["legacy", "stale"]), row("other", ["kept"])) == 1
    assert put(spark, t, row("/images/./tagged.jpg", ["fresh"], at=1)) == 2
    assert labels(t) == [("images/tagged.jpg", "fresh"), ("other", "kept")]
    assert labels(t, 1) == [("images/tagged.jpg", "legacy"), ("images/tagged.jpg", "stale"), ("other", "kept")]
    got = t.get(spark.createDataFrame([("r", "images//tagged.jpg"), ("r", "none")], "root_id string, rel_path string")).collect()
    assert [(r.rel_path, [c.label for c in r.children]) for r in got] == [("images/tagged.jpg", ["fresh"])]
    put(spark, t, row("other", None))
    assert labels(t) == [("images/tagged.jpg", "fresh")] and t.parents().count() == 2


def test_the_last_row_of_a_repeated_key_wins(spark, tmp_path):
    t = table(spark, tmp_path)
    rows = [row("a", [f"n{i}"], size=i, at=i) for i in range(50)] + [row("./a", ["tie"], size=99, at=49), row("b", ["x"])] * 2
    put(spark, t, *rows)
    assert labels(t) == [("a", "tie"), ("b", "x")] and {(r.rel_path, r.size) for r in t.parents().collect()} == {("a", 99), ("b", 1)}


def test_nulls_empty_tables_and_deletes(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.parents().count() == t.children().count() == 0
    put(spark, t)
    assert labels(t) == []
    put(spark, t, row(None, ["x"]), row("a", []), ("r", "b", None, None, [(None, None)]), row("a", ["s"], root="s"))
    assert sorted((r.root_id, r.rel_path, r.size) for r in t.parents().collect()) == [("r", "a", 1), ("r", "b", None), ("s", "a", 1)]
    t.delete(spark.createDataFrame([("s", "a"), ("r", "b"), ("x", "y")], "root_id string, rel_path string"))
    assert labels(t) == [] and t.parents().count() == 1


def files(path):
    return sorted(os.listdir(path / "data"))


def test_a_task_that_fails_half_way_leaves_the_last_snapshot(spark, tmp_path):
    t = table(spark, tmp_path)
    put(spark, t, row("a", ["old"]))
    before, bad = files(tmp_path), [row(f"k{i}", ["new"], size=i) for i in range(200)]
    fails = spark.createDataFrame(bad, ROWS).withColumn("size", F.col("size"))
    fails = fails.withColumn("scanned_at", F.when(F.col("size") == 150, F.raise_error(F.lit("broken")).cast("timestamp")).otherwise(F.col("scanned_at")))
    with pytest.raises(Exception, match="broken"):
        t.put(fails, ["scanned_at"])
    assert labels(t) == [("a", "old")] and files(tmp_path) == before and keyed.snapshots(str(tmp_path)) == [1]
    # the writer itself: one of its tasks gets rows that it can't write
    rows = spark.range(8, numPartitions=4).select(F.col("id").cast("int").alias("bucket"), F.lit("parents").alias("kind"), F.struct(F.when(F.col("id") == 7, F.raise_error(F.lit("torn")).cast("long")).otherwise(F.col("id")).alias("v")).alias("parent"), F.struct("id").alias("child"))
    with pytest.raises(Exception, match="torn"):
        rows.write.format("keyed").options(path=t.path, base=1, touched="[]").mode("append").save()
    assert files(tmp_path) == before and keyed.snapshots(str(tmp_path)) == [1]


def test_of_two_changes_of_one_snapshot_the_second_fails(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    put(spark, t, row("a", ["one"]))
    stale = keyed.snapshot(t.path)
    put(spark, t, row("a", ["two"]))
    before = files(tmp_path)
    monkeypatch.setattr(keyed, "snapshot", lambda path, number=None: stale)
    with pytest.raises(Exception, match="snapshot 2 exists"):
        put(spark, t, row("a", ["three"]))
    monkeypatch.undo()
    assert labels(t) == [("a", "two")] and files(tmp_path) == before


def test_untouched_buckets_keep_their_files_and_vacuum_drops_old_ones(spark, tmp_path):
    t = table(spark, tmp_path, buckets=16)
    put(spark, t, *[row(f"k{i}", ["x"]) for i in range(100)])
    first = keyed.snapshot(t.path)["files"]
    put(spark, t, row("k1", ["y"]))
    second = keyed.snapshot(t.path)["files"]
    assert sum(first[b] == second[b] for b in first) == len(first) - 1
    assert t.vacuum(keep=1) == 2 and dict(labels(t))["k1"] == "y" and t.parents().count() == 100


def test_the_number_of_buckets_is_that_of_the_folder(spark, tmp_path):
    assert table(spark, tmp_path, 4).buckets == table(spark, tmp_path, 9).buckets == 4
