"""Keys and paths as pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(path: Column) -> Column:
    """One spelling for a path below a root: slashes only, no ``.``, ``..`` resolved, none in front.

    ``..`` never leads above the root. The root itself is the empty string; null stays null.
    """
    steps = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: (s != "") & (s != "."))
    up = lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))
    plain = F.array_join(steps, "/")
    folded = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), up), "/")
    return F.when(F.contains(path, F.lit("..")), folded).otherwise(plain)


def prefix_of(directory: str) -> str:
    """What the keys of everything below a canonical directory begin with."""
    directory = directory.replace("\\", "/").strip("/")
    return f"{directory}/" if directory else ""


def below(key: Column, directory: str) -> Column:
    """Whether a canonical key lies anywhere below a directory; wildcard characters mean themselves."""
    prefix = prefix_of(directory)
    return key.startswith(prefix) & (F.length(key) > len(prefix)) if prefix else key != ""


def directly_in(key: Column, directory: str) -> Column:
    """Whether a canonical key is a direct child of a directory."""
    rest = F.substring(key, len(prefix_of(directory)) + 1, 1 << 30)
    return below(key, directory) & (F.instr(rest, "/") == 0)


def basename(key: Column) -> Column:
    return F.substring_index(key, "/", -1)


def parent(key: Column) -> Column:
    """The directory of a key; that of a top-level one is the empty string."""
    return F.regexp_replace(key, r"/?[^/]*$", "")


def extension(name: Column) -> Column:
    """The lower-case extension with its dot, or the empty string."""
    return F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))


def hidden(key: Column) -> Column:
    """Whether any step of a path begins with a dot."""
    return key.rlike(r"(^|/)\.")
