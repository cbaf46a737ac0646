"""Changes to files; side effects of the driver, planned before they are done."""

from __future__ import annotations

import hashlib
import os
import shutil
from dataclasses import dataclass

from glasswing.sources.tree import Roots


@dataclass(frozen=True)
class Result:
    """What became of one item of a bulk operation."""

    path: str
    target: str | None = None
    error: str | None = None


def digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def free_name(path: str) -> str:
    """The path itself, or with the first number in parentheses that is free before its extension."""
    base, ext = os.path.splitext(path)
    n = 1
    while os.path.lexists(path):
        n += 1
        path = f"{base} ({n}){ext}"
    return path


def plan(source: str, target: str) -> tuple[str, str]:
    """``skip`` if the target has the same content, else ``copy`` or ``rename`` with the path to write."""
    if not os.path.lexists(target):
        return "copy", target
    if os.path.isfile(source) and os.path.isfile(target) and digest(source) == digest(target):
        return "skip", target
    return "rename", free_name(target)


def copy(source: str, directory: str) -> str:
    """Copies a file or a tree into a directory; equal files aren't copied again."""
    target = os.path.join(directory, os.path.basename(source.rstrip("/")))
    if os.path.isdir(source):
        if os.path.commonpath([os.path.realpath(directory), os.path.realpath(source)]) == os.path.realpath(source):
            raise ValueError("a directory can't be copied into itself")
        os.makedirs(target, exist_ok=True)
        for name in sorted(os.listdir(source)):
            copy(os.path.join(source, name), target)
        return target
    what, path = plan(source, target)
    if what != "skip":
        shutil.copy2(source, path)
    return path


def move(source: str, directory: str) -> str:
    """Moves by renaming, across file systems by copying and deleting."""
    target = os.path.join(directory, os.path.basename(source.rstrip("/")))
    if os.path.isfile(source):
        what, target = plan(source, target)
        if what == "skip":
            os.remove(source)
            return target
    elif os.path.lexists(target):
        target = free_name(target)
    return shutil.move(source, target)


def delete(path: str, root: str, recursive: bool = False) -> None:
    """Deletes a file or directory, never the root; a directory that isn't empty only if asked to."""
    if os.path.realpath(path) == os.path.realpath(root):
        raise ValueError("the root can't be deleted")
    if not os.path.isdir(path) or os.path.islink(path):
        os.remove(path)
    elif recursive:
        shutil.rmtree(path)
    else:
        os.rmdir(path)


def rename(path: str, name: str) -> str:
    if not name or name in (".", "..") or "/" in name or "\\" in name:
        raise ValueError(f"{name!r} is no name")
    target = os.path.join(os.path.dirname(path), name)
    if os.path.lexists(target):
        raise FileExistsError(target)
    os.rename(path, target)
    return target


def bulk(what: str, paths: list[str], directory: str) -> list[Result]:
    """Moves or copies each path; one that fails doesn't end the others."""
    act = {"move": move, "copy": copy}[what]
    out = []
    for p in paths:
        try:
            out.append(Result(p, act(p, directory)))
        except (OSError, ValueError) as e:
            out.append(Result(p, error=str(e)))
    return out


def status(results: list[Result]) -> int:
    failed = [r.error is not None for r in results]
    return 500 if failed and all(failed) else 207 if any(failed) else 200


def prune(folder: str, older_than: float, now: float) -> int:
    """Removes files last changed so many seconds ago or longer; directories stay. Returns how many."""
    gone = 0
    for at, _, names in os.walk(folder):
        for name in names:
            path = os.path.join(at, name)
            try:
                if now - os.lstat(path).st_mtime >= older_than:
                    os.remove(path)
                    gone += 1
            except OSError:  # one that can't be read or removed doesn't end the others
                continue
    return gone


def clean(folder: str, prefix: str = "") -> int:
    """Removes what earlier runs have left directly in a folder of temporary files; returns how many."""
    gone = 0
    for e in os.scandir(folder) if os.path.isdir(folder) else ():
        if e.is_file(follow_symlinks=False) and e.name.startswith(prefix):
            os.remove(e.path)
            gone += 1
    return gone


class Below:
    """The same changes for paths below named roots; none leads out of its root."""

    def __init__(self, roots: Roots):
        self.roots = roots

    def path(self, root_id: str, rel: str) -> str:
        """The path of an entry itself: what its directory links to counts, what it links to doesn't."""
        above, name = os.path.split(os.path.normpath("/" + rel.replace("\\", "/")))
        return os.path.join(self.roots.resolve(root_id, above), name) if name else self.roots.resolve(root_id)

    def delete(self, root_id: str, rel: str, recursive: bool = False) -> None:
        delete(self.path(root_id, rel), self.roots.resolve(root_id), recursive)

    def rename(self, root_id: str, rel: str, name: str) -> str:
        path = self.path(root_id, rel)
        if path == self.roots.resolve(root_id):
            raise ValueError("the root can't be renamed")
        return rename(path, name)

    def bulk(self, what: str, root_id: str, rels: list[str], to_root: str, directory: str) -> list[Result]:
        """Moves or copies each path below a root into a directory below another; results name the given paths."""
        into, out = self.roots.resolve(to_root, directory), []
        for rel in rels:
            try:
                if self.path(root_id, rel) == self.roots.resolve(root_id):
                    raise ValueError("the root can't be moved or copied")
                out += [Result(rel, r.target, r.error) for r in bulk(what, [self.path(root_id, rel)], into)]
            except ValueError as e:
                out.append(Result(rel, error=str(e)))
        return out
