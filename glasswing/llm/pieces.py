"""Cuts texts where a byte-level pre-tokenizer cuts them too, so that equal pieces are encoded once.

The pre-tokenizer's pattern lets a word take one space before it, and white space that follows
other characters always begins a new match. A text is therefore cut before each space or line
feed that follows a character other than white space. Where two white-space characters touch,
what a match takes depends on both, and the text stays whole.
"""

from __future__ import annotations

import re

TOUCHING = re.compile(r"\s\s")


def cut(text: str) -> list[str]:
    """Parts of a text; all but the first stand for themselves if they begin with a line feed, else with a space before them."""
    if TOUCHING.search(text):
        return [text]
    if "\n" in text:
        text = text.replace("\n", " \n")
    return text.split(" ")


def piece(part: str) -> str:
    """The characters that a part after the first stands for."""
    return part if part[:1] == "\n" else f" {part}"


class PieceCache:
    """Encoded parts of texts, ids as little-endian unsigned 32-bit integers.

    ``encode`` turns a list of distinct strings to a list of such bytes. When ``most`` parts are
    held, they are forgotten and encoded anew; this bounds memory and changes no result.
    """

    def __init__(self, encode, most: int = 300_000):
        self.encode, self.most, self.parts, self.whole = encode, most, {}, {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        cuts = [cut(x) for x in texts]
        if len(self.parts) > self.most:
            self.parts.clear()
        new: set[str] = set()
        for c in cuts:
            new.update(c[1:])
        heads = list(dict.fromkeys(c[0] for c in cuts))
        todo = list(new.difference(self.parts))  # a dict, so that only what is new is gone through
        got = self.encode([piece(x) for x in todo] + heads)
        self.parts.update(zip(todo, got))
        head = dict(zip(heads, got[len(todo) :]))
        of = self.parts.__getitem__
        return [head[c[0]] + b"".join(map(of, c[1:])) for c in cuts]


def groups(texts: list[str], most: int = 2_000_000):
    """Index ranges of texts with about ``most`` characters together."""
    start, total = 0, 0
    for i, x in enumerate(texts):
        total += len(x)
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
