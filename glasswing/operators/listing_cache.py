"""Listings kept as tables until something above or below their directory changes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from glasswing.functions.paths import prefix_of
from glasswing.operators.tables import deleted, materialised


def spelled(path: str) -> str:
    """The canonical spelling of a directory."""
    done: list[str] = []
    for step in path.replace("\\", "/").split("/"):
        if step == "..":
            done = done[:-1]
        elif step not in ("", "."):
            done.append(step)
    return "/".join(done)


@dataclass
class ListingCache:
    """Tables by root, directory and what else the listing depends on (a filter, a tag).

    The tables lie in the shared folder; the driver holds their names, at most ``most`` of them, and
    lets the one go that was asked for longest ago.
    """

    most: int = 256
    held: dict[tuple, DataFrame] = field(default_factory=dict)
    hits: int = 0

    def get(self, root_id: str, path: str, make: Callable[[], DataFrame], *rest: object) -> DataFrame:
        """The listing of a directory: the kept one, or what ``make`` gives, which is kept."""
        key = (root_id, spelled(path), *rest)
        found = self.held.pop(key, None)
        self.hits += found is not None
        self.held[key] = materialised(make(), "listing") if found is None else found
        while len(self.held) > self.most:
            deleted(self.held.pop(next(iter(self.held))))
        return self.held[key]

    def changed(self, root_id: str, path: str) -> int:
        """Forgets the listings of a changed directory or file, of all above and of all below it; returns how many."""
        at = spelled(path)
        gone = [k for k in self.held if k[0] == root_id and (at == k[1] or at.startswith(prefix_of(k[1])) or k[1].startswith(prefix_of(at)))]
        for k in gone:
            deleted(self.held.pop(k))
        return len(gone)

    def clear(self, root_id: str | None = None) -> None:
        for k in [k for k in self.held if root_id in (None, k[0])]:
            deleted(self.held.pop(k))
