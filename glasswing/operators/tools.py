"""Frames, durations, pages and recognised text by outside programs, run in Python workers.

A program is handed in as a function of its arguments that returns what it wrote to its output or
raises, so that nothing has to be installed here. ``program`` makes one of a command.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasswing.functions.media import fallback_positions, seek_position, spaced_positions
from glasswing.sources.labels import blocks_of
from glasswing.sources.tree import Roots

Tool = Callable[[list[str]], bytes]

# The arguments of outside programs below, and the seconds that one may take.
FRAME_TIMEOUT, PROBE_TIMEOUT, TEXT_TIMEOUT = 30, 10, 60


class ToolError(RuntimeError):
    """A program that isn't there, failed, or wrote nothing that can be used."""


def program(name: str, timeout: int) -> Tool:
    def run(args: list[str]) -> bytes:
        try:
            done = subprocess.run([name, *args], capture_output=True, timeout=timeout)
        except (OSError, subprocess.TimeoutExpired) as e:
            raise ToolError(str(e)) from e
        if done.returncode:
            raise ToolError(done.stderr.decode("utf-8", "replace")[-400:])
        return done.stdout

    return run


def first_of(attempts: list[Callable[[], bytes]]) -> bytes:
    """What the first attempt that succeeds gives; the last one's error if none does."""
    last = ToolError("nothing to try")
    for attempt in attempts:
        try:
            if out := attempt():
                return out
        except Exception as e:  # the next attempt may do
            last = e
    raise last


def grab(tool: Tool, path: str, at: str) -> bytes:
    """One frame of a video as a picture."""
    out = tool(["-ss", at, "-i", path, "-vframes", "1", "-f", "mjpeg", "-"])
    if not out:
        raise ToolError(f"no frame at {at}")
    return out


def _each(files: DataFrame, columns: list[str], schema: str, of: Callable[[dict], list[dict]]) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                keys = {k: row[k] for k in ("root_id", "rel_path")}
                try:
                    out += [keys | dict.fromkeys(names) | x | {"error": None} for x in of(row)]
                except Exception as e:  # one bad file must not end the scan
                    out.append(keys | dict.fromkeys(names) | {"error": str(e)})
            if out:
                yield pd.DataFrame(out, dtype=object)

    return files.select("root_id", "rel_path", *columns).mapInPandas(run, f"root_id string, rel_path string, {schema}, error string")


def durations(videos: DataFrame, roots: Roots, probe: Tool) -> DataFrame:
    """Keys with ``duration`` in seconds; an unreadable one is an ``error`` and null."""

    def of(row: dict) -> list[dict]:
        said = probe(["-v", "error", "-show_entries", "format=duration", "-of", "default=noprint_wrappers=1:nokey=1", roots.resolve(row["root_id"], row["rel_path"])])
        return [{"duration": float(said.decode().strip())}]

    return _each(videos, [], "duration double", of)


def frame(videos: DataFrame, roots: Roots, tool: Tool) -> DataFrame:
    """Keys with one ``frame`` at a tenth of ``duration``."""
    rows = videos.withColumn("_at", seek_position(F.col("duration")))
    return _each(rows, ["_at"], "frame binary", lambda r: [{"frame": grab(tool, roots.resolve(r["root_id"], r["rel_path"]), r["_at"])}])


def frames(videos: DataFrame, roots: Roots, tool: Tool, count: int = 4) -> DataFrame:
    """Keys with ``pos`` and ``frame`` of evenly spaced frames; those that fail are left out, unless all do."""
    rows = videos.withColumn("_at", spaced_positions(F.col("duration"), count))

    def of(row: dict) -> list[dict]:
        path, out, last = roots.resolve(row["root_id"], row["rel_path"]), [], ToolError("no position")
        for i, at in enumerate(row["_at"]):
            try:
                out.append({"pos": i, "frame": grab(tool, path, f"{at:.2f}")})
            except Exception as e:  # the others may do
                last = e
        if not out:
            raise last
        return out

    return _each(rows, ["_at"], "pos int, frame binary", of)


def frame_near(videos: DataFrame, roots: Roots, tool: Tool) -> DataFrame:
    """Keys with the first ``frame`` that succeeds of the positions around ``target``."""
    rows = videos.withColumn("_at", fallback_positions(F.col("duration"), F.col("target")))

    def of(row: dict) -> list[dict]:
        path = roots.resolve(row["root_id"], row["rel_path"])
        return [{"frame": first_of([lambda at=at: grab(tool, path, f"{at:.2f}") for at in row["_at"]])}]

    return _each(rows, ["_at"], "frame binary", of)


def first_pages(files: DataFrame, roots: Roots, tools: list[Tool]) -> DataFrame:
    """Keys with the first ``page`` of a document as a picture, by the first of several programs that can."""
    return _each(files, [], "page binary", lambda r: [{"page": first_of([lambda t=t: t([roots.resolve(r["root_id"], r["rel_path"])]) for t in tools])}])


def recognised(files: DataFrame, roots: Roots, tool: Tool) -> DataFrame:
    """Keys with ``blocks`` of text that a program writes as a JSON list."""

    def of(row: dict) -> list[dict]:
        said = tool([roots.resolve(row["root_id"], row["rel_path"])]).decode()
        if not isinstance(json.loads(said), list):
            raise ToolError("no list of blocks")
        return [{"said": said}]

    return _each(files, [], "said string", of).withColumn("blocks", blocks_of(F.col("said"))).drop("said")


def thumbnails(pictures: DataFrame, encode: Callable[[bytes], bytes], folder: str, content: str = "content") -> DataFrame:
    """Keys with the ``thumb`` that was written for each picture: ``cache_key`` names the file.

    ``encode`` makes the small picture. A file is written under a name of its own and moved into
    place, so a task that runs again leaves no half file; ``folder`` is shared by all executors.
    """

    def of(row: dict) -> list[dict]:
        import os
        import uuid

        path = os.path.join(folder, f"{row['cache_key']}.jpg")
        own = f"{path}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            f.write(encode(bytes(row[content])))
        os.replace(own, path)
        return [{"thumb": path}]

    return _each(pictures, ["cache_key", content], "thumb string", of)
