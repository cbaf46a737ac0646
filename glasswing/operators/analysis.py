"""Analysers: models run on file bytes in Python workers, everything after them in plain columns.

A model is handed in as a function that makes a scorer, called once in each worker, so that no
model file is needed here; the arithmetic on its output is what this module defines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasswing.operators import regions

# Thresholds of text detection.
BITMAP, BOX, UNCLIP, SIDE = 0.3, 0.6, 1.6, 3
LINE_CONFIDENCE = 0.5

Scorer = Callable[[bytes], dict]
#: The scorers of this worker process by the call of ``analysed`` that wants them.
_scorers: dict[str, Scorer] = {}


def analysed(files: DataFrame, make: Callable[[], Scorer], schema: str, content: str = "content") -> DataFrame:
    """Keys of ``files`` with what one scorer says of each content, all analysers in one pass.

    A content that the scorer fails on has the message in ``error`` and nulls elsewhere. ``make`` is
    called once in each worker process, which keeps its scorer for the call's later tasks. Batches
    are bounded in bytes by ``spark.sql.execution.arrow.maxBytesPerBatch``.
    """
    keys, call = ["root_id", "rel_path"], uuid.uuid4().hex
    names = [x.split()[0] for x in schema.split(", ")]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from glasswing.operators.analysis import _scorers  # the module's own, not a copy of it

        if call not in _scorers:
            _scorers.clear()  # a model of an earlier call is not held beside this one
            _scorers[call] = make()
        scorer = _scorers[call]
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                try:
                    said = scorer(bytes(row[content]))
                    out.append({k: row[k] for k in keys} | {n: said.get(n) for n in names} | {"error": None})
                except Exception as e:  # one bad file must not end the scan
                    out.append({k: row[k] for k in keys} | dict.fromkeys(names) | {"error": str(e)})
            yield pd.DataFrame(out)

    return files.select(*keys, content).mapInPandas(of, f"root_id string, rel_path string, {schema}, error string")


def person(scores: Column, threshold: float = 0.5) -> Column:
    """Whether any anchor's score is above the threshold, and the highest of those."""
    above = F.filter(scores, lambda x: x > threshold)
    return F.struct((F.size(above) > 0).alias("has_person"), F.coalesce(F.array_max(above), F.lit(0.0)).alias("confidence"))


def block_text(blocks: Column) -> Column:
    """The trimmed, non-empty texts of blocks, a line each; blocks of low confidence don't count."""
    sure = F.filter(blocks, lambda b: b["confidence"] >= LINE_CONFIDENCE)
    return F.array_join(F.filter(F.transform(sure, lambda b: F.trim(b["text"])), lambda t: t != ""), "\n")


def relative_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    return F.struct((x0 / width).alias("x"), (y0 / height).alias("y"), ((x1 - x0) / width).alias("w"), ((y1 - y0) / height).alias("h"))


def ctc(probabilities: np.ndarray, charset: list[str]) -> tuple[str, float]:
    """Text and mean probability of a recogniser's steps: the best symbol of each, without blanks and repeats."""
    if not len(probabilities):
        return "", 0.0
    best = probabilities.argmax(axis=1)
    kept = (best != 0) & np.concatenate(([True], best[1:] != best[:-1]))
    if not kept.any():
        return "", 0.0
    return "".join(charset[i] for i in best[kept]).strip(), float(probabilities.max(axis=1)[kept].mean())


def _components(on: np.ndarray) -> np.ndarray:
    """A number for each 8-connected component of a bitmap, -1 elsewhere: the smallest cell, spread until still."""
    label = np.where(on, np.arange(on.size).reshape(on.shape), on.size)
    while True:
        wide = np.pad(label, 1, constant_values=on.size)
        near = np.min([wide[dy : dy + on.shape[0], dx : dx + on.shape[1]] for dy in range(3) for dx in range(3)], axis=0)
        new = np.where(on, near, on.size)
        flat = np.append(new.ravel(), on.size)
        new = flat[new]  # the label's own label
        if (new == label).all():
            return np.where(on, label, -1)
        label = new


def boxes(probability: np.ndarray, width: int, height: int) -> list[tuple[int, int, int, int]]:
    """Boxes of text in a picture from a detector's map, in order of their first cell.

    Components that are small or unlikely are left out; boxes are dilated and clipped to the picture.
    """
    rows, cols = probability.shape
    label = _components(probability > BITMAP)
    out = []
    for k in np.unique(label[label >= 0]):
        ys, xs = np.nonzero(label == k)
        w, h = np.ptp(xs) + 1, np.ptp(ys) + 1
        if min(w, h) < SIDE or probability[ys, xs].mean() < BOX:
            continue
        grow = w * h * UNCLIP / (2.0 * (w + h))
        sx, sy = width / cols, height / rows
        x = np.clip([np.floor((xs.min() - grow) * sx), np.ceil((xs.max() + 1 + grow) * sx)], 0, width).astype(int)
        y = np.clip([np.floor((ys.min() - grow) * sy), np.ceil((ys.max() + 1 + grow) * sy)], 0, height).astype(int)
        if min(x[1] - x[0], y[1] - y[0]) >= SIDE:
            out.append((int(x[0]), int(y[0]), int(x[1]), int(y[1])))
    return out


def text_boxes(maps: DataFrame, image: str = "image") -> DataFrame:
    """``(image, region, left, top, right, bottom)`` of ``maps(image, y, values, width, height)``, rows of detectors' maps.

    What ``boxes`` gives for one map, for many at once and without gathering any: regions of cells
    above the threshold, those left out that are small or unlikely, boxes dilated by their own size,
    scaled to the picture and clipped to it. Null rows and values have no cells.
    """
    size = maps.groupBy(image).agg((F.max("y") + 1).alias("rows"), F.max(F.size("values")).alias("cols"), F.max("width").alias("width"), F.max("height").alias("height"))
    cells = maps.select(image, "y", F.posexplode("values").alias("x", "v")).where(F.col("v") > BITMAP)
    found = regions.boxes(regions.regions(regions.runs(cells, image, "v"), image), image)
    found = found.where(F.least(F.col("right") - F.col("left"), F.col("bottom") - F.col("top")) >= SIDE).where(F.col("total") / F.col("cells") >= BOX).join(size, image)
    w, h = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    found = found.withColumn("grow", w * h * UNCLIP / (2.0 * (w + h)))
    clip = lambda at, step, most: F.greatest(F.lit(0), F.least(step(at), F.col(most))).cast("int")
    sx, sy = F.col("width") / F.col("cols"), F.col("height") / F.col("rows")
    x0, x1 = clip((F.col("left") - F.col("grow")) * sx, F.floor, "width"), clip((F.col("right") + F.col("grow")) * sx, F.ceil, "width")
    y0, y1 = clip((F.col("top") - F.col("grow")) * sy, F.floor, "height"), clip((F.col("bottom") + F.col("grow")) * sy, F.ceil, "height")
    out = found.select(image, "region", x0.alias("left"), y0.alias("top"), x1.alias("right"), y1.alias("bottom"))
    return out.where(F.least(F.col("right") - F.col("left"), F.col("bottom") - F.col("top")) >= SIDE)
