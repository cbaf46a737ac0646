"""Regions of touching cells in many bitmaps at once.

A bitmap is cut into runs, the longest stretches of set cells of a row. Runs of neighbouring rows
that overlap, corners counting or not, are linked, and the regions are the components of these links,
found for all bitmaps together: every run hears the least label around it, then takes that label's own
(pointer jumping), so rounds grow with the logarithm of a region's length, not with its cells.

Labels are small as files, but not in memory, and every round joins them. All joins are therefore sorted
and shuffled by their hint; none of the tables is broadcast by way of the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glasswing.operators.tables import deleted, materialised


def runs(cells: DataFrame, image: str = "image", value: str | None = None) -> DataFrame:
    """``(image, y, x0, x1)`` of set cells ``(image, y, x)``; cells that repeat are one, nulls are none.

    With ``value`` also ``sum``, of that column over a run's cells, of cells that repeat the greatest.
    """
    row = Window.partitionBy(image, "y").orderBy("x")
    rows = cells.dropna(subset=[image, "y", "x"]).groupBy(image, "y", "x").agg(F.max(F.col(value) if value else F.lit(1)).alias("v"))
    out = rows.withColumn("g", F.col("x") - F.row_number().over(row)).groupBy(image, "y", "g").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), *[F.sum("v").alias("sum")] * bool(value))
    return out.drop("g")


def runs_of(rows: DataFrame, image: str, values: str, least: Column | float) -> DataFrame:
    """``(image, y, x0, x1)`` of bitmaps given as rows of numbers ``(image, y, values)``; a cell is set at ``least`` or more."""
    set_ = F.filter(F.transform(F.col(values), lambda v, x: F.when(v >= least, x)), lambda x: x.isNotNull())
    return runs(rows.select(image, "y", F.explode(set_).alias("x")), image)


def regions(found: DataFrame, image: str = "image", corners: bool = True) -> DataFrame:
    """Runs with ``region``, the number in the image's order of its region's first run, from 0.

    Runs of one row never touch. A run meets those of the row above that it overlaps, one cell more
    on each side where corners count; an image's rows are joined by their numbers, so an image of
    very many runs is dealt out by rows.
    """
    near = 1 if corners else 0
    more = ["sum"] * ("sum" in found.columns)
    own = materialised(found.select(F.col(image).alias("i"), "y", "x0", "x1", *more).withColumn("n", F.struct("y", "x0")), "runs")
    up = own.select(F.col("i").alias("j"), (F.col("y") + 1).alias("below"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("n").alias("b"))
    met = own.join(up.hint("merge"), (F.col("i") == F.col("j")) & (F.col("y") == F.col("below")) & (F.col("x0") <= F.col("u1") + near) & (F.col("u0") <= F.col("x1") + near))
    links = met.select("i", F.col("n").alias("a"), "b")
    links = materialised(links.unionByName(links.select("i", F.col("b").alias("a"), F.col("a").alias("b"))), "run-links")
    labels = materialised(own.select("i", F.col("n").alias("a"), F.col("n").alias("label")), "run-labels")
    while True:
        heard = links.join(labels.select("i", F.col("a").alias("b"), "label").hint("merge"), ["i", "b"]).select("i", "a", "label")
        least = heard.unionByName(labels.select("i", "a", "label")).groupBy("i", "a").agg(F.min("label").alias("heard"))
        jump = labels.select("i", F.col("a").alias("heard"), F.col("label").alias("root"))
        step = least.join(jump.hint("merge"), ["i", "heard"]).join(labels.select("i", "a", F.col("label").alias("was")).hint("merge"), ["i", "a"])
        new = materialised(step.select("i", "a", F.least("heard", "root").alias("label"), "was"), "run-labels")
        deleted(labels)
        labels = new
        if labels.where("label <> was").isEmpty():
            break
    first = labels.select("i", "label").distinct().withColumn("region", F.row_number().over(Window.partitionBy("i").orderBy("label")) - 1)
    out = own.join(labels.select("i", F.col("a").alias("n"), "label").hint("merge"), ["i", "n"]).join(first.hint("merge"), ["i", "label"])
    return out.select(F.col("i").alias(image), "y", "x0", "x1", *more, "region")


def boxes(found: DataFrame, image: str = "image", least: int = 1) -> DataFrame:
    """``(image, region, left, top, right, bottom, cells)`` of regions with at least so many cells, ends exclusive; ``total`` where runs have sums."""
    total = [F.sum("sum").alias("total")] * ("sum" in found.columns)
    out = found.groupBy(image, "region").agg(F.min("x0").alias("left"), F.min("y").alias("top"), (F.max("x1") + 1).alias("right"), (F.max("y") + 1).alias("bottom"), F.sum(F.col("x1") - F.col("x0") + 1).alias("cells"), *total)
    return out.where(F.col("cells") >= least)
