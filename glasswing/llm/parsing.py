"""Substring dedup by relative Lempel-Ziv parsing against reference blocks.

A window is ``WINDOW`` consecutive words of a document, and the windows that it begins are a
document's symbols: a factor of n symbols is a passage of n + WINDOW - 1 words, so every factor is
long enough and no shorter one is ever made. Parsing goes on from symbol to symbol: one that no
reference has is a literal; at any other the longest factor that goes on as the first reference
does is taken, and the symbol at its boundary is looked up anew. So every window is looked up, and
a document's duplicate spans are the words of its factors.

Factoring each document against all references would read the corpus once for each block of it.
References are therefore cut where equal windows are cut too: of a window's ``ANCHOR``-word shingles
the one with the least hash is its anchor, neighbouring windows that share one are a stretch, and
the stretches around equal anchors are one reference block. A window's copies are in its own block,
and against no other block can it be part of a factor. Blocks whose anchor only one text has are
never made. A block's stretches are parsed in the order of ids against those of smaller ids.

Anchors of more than ``SPLIT`` stretches would make blocks without bound. Of their stretches only
the distinct ones are references, each with the smallest id that has it, aggregated before the
shuffle, and these are cut into single windows, each window a block of its own, which has one symbol:
such a block is parsed by its smallest id. A stretch of a greater id than the first of equal ones is
a factor as a whole. Texts that are equal are one text; copies with a greater id lose all words of
all windows without being parsed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasswing.llm.common import discard, partitions, written

WINDOW, ANCHOR = 13, 4
#: Stretches of an anchor's block at most.
SPLIT = 2_000
#: Bytes of a text that are split into words at once, and words that are hashed at once.
PIECE, WORDS = 1 << 20, 400_000
#: Word hashes that a worker holds.
HELD = 1_000_000
#: The order of rows without an id: the last.
LAST = (1 << 63) - 1
SPACES = b" \t\n\x0b\x0c\r"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(WINDOW, 0xD6E8FEB86659FD93, np.uint64))


class WordHashes(dict):
    """The 64-bit hash of each word; forgotten when too many are held, which changes no result."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > HELD:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word, 13)
        return out


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a piece of it at a time, so that a very long text isn't held as words at once."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and text[end] not in SPACES:
            end += 1
        yield text[at:end].split()
        at = end
    yield (text[at:] if at else text).split()


def word_hashes(text: bytes, known: WordHashes) -> np.ndarray:
    parts = [np.fromiter(map(known.__getitem__, words), np.uint64, len(words)) for words in pieces(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive words."""
    n, out = len(h) - k + 1, np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k if n > 0 else 0):
        out *= _ODD
        out += h[j : j + n]
        out ^= out >> np.uint64(29)
    return out


def stretches(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first window and the anchor of each stretch of a text's words, and the number of windows at last."""
    windows = len(h) - WINDOW + 1
    if windows <= 0:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none
    g, wide = shingles(h, ANCHOR), WINDOW - ANCHOR + 1
    least, at = g[:windows].copy(), np.arange(windows)
    for j in range(1, wide):
        other = g[j : j + windows]
        less = other < least
        least[less] = other[less]
        at[less] = np.flatnonzero(less) + j
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return first, least[first], np.append(first[1:], windows)


def grouped(texts: list[bytes], known: WordHashes) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Ranges of texts with about ``WORDS`` words together, and the texts' word hashes."""
    start, held, total = 0, [], 0
    for i, text in enumerate(texts):
        held.append(word_hashes(text, known))
        total += len(held[-1])
        if total >= WORDS:
            yield start, i + 1, held
            start, held, total = i + 1, [], 0
    if held:
        yield start, len(texts), held


def joined(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of several texts by one pass over all their words: text, first window, end, anchor, and all words' windows.

    Stretches begin where a text does, and windows that would go over its end are left out.
    """
    length = np.fromiter(map(len, held), np.int64, len(held))
    begin = np.concatenate(([0], np.cumsum(length)[:-1]))
    h = np.concatenate(held)
    first, anchor, end = stretches(h)
    text = np.searchsorted(begin, first, side="right") - 1
    # a stretch that goes on into the next texts is cut where they begin
    cuts = begin[1:][begin[1:] < max(0, len(h) - WINDOW + 1)]
    cuts = np.setdiff1d(cuts, first)
    if len(cuts):
        of = np.searchsorted(first, cuts, side="right") - 1
        first, anchor = np.concatenate((first, cuts)), np.concatenate((anchor, anchor[of]))
        order = np.argsort(first, kind="stable")
        first, anchor = first[order], anchor[order]
        end = np.append(first[1:], len(h) - WINDOW + 1)
        text = np.searchsorted(begin, first, side="right") - 1
    end = np.minimum(end, begin[text] + length[text] - WINDOW + 1)
    some = first < end
    first, end, anchor, text = first[some], end[some], anchor[some], text[some]
    return text, first - begin[text], end - begin[text], anchor, begin


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(o, h, anchors)`` of rows ``(o, h, text)``: each anchor once, with the number of its stretches."""
    known = WordHashes()
    for batch in batches:
        o, h, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
        for start, end, held in grouped(texts, known):
            text, _, _, anchor, _ = joined(held)
            order = np.lexsort((anchor, text))
            text, anchor = text[order], anchor[order]
            new = np.concatenate(([True], (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1]))) if len(text) else np.zeros(0, bool)
            counts = np.bincount(text[new], minlength=len(held))
            times = np.diff(np.append(np.flatnonzero(new), len(new)))
            each = pa.StructArray.from_arrays([pa.array(signed(anchor[new])), pa.array(times)], ["a", "k"])
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
            yield pa.RecordBatch.from_arrays([o.slice(start, end - start), h.slice(start, end - start), pa.ListArray.from_arrays(offsets, each)], ["o", "h", "anchors"])


def stretches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(a, c, o, t, at, n, w)`` of rows ``(o, t, text, some, many)``.

    For each stretch with an anchor ``a`` in ``some``: its first window's place, their number and
    the windows ``w``. For each stretch of one in ``many``: the same with a hash ``c`` of its
    windows in their place, and once for each ``c`` and group of texts a row without ``t`` that
    has the windows and the smallest ``o``.
    """
    known = WordHashes()
    for batch in batches:
        o, t, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
        flat = [batch.column(i).flatten().to_numpy() for i in (3, 4)]
        edge = [batch.column(i).offsets.to_numpy() - batch.column(i).offsets[0].as_py() for i in (3, 4)]
        for start, stop, held in grouped(texts, known):
            text, first, end, anchor, begin = joined(held)
            windows, a = shingles(np.concatenate(held), WINDOW), signed(anchor)
            own = [f[e[start] : e[stop]] for f, e in zip(flat, edge, strict=True)]
            of = [np.repeat(np.arange(stop - start), np.diff(e[start : stop + 1])) for e in edge]
            yield from stretch_rows(o[start:stop], t[start:stop], text, first, end, a, begin, windows, *[pairs_in(text, a, of[k], own[k]) for k in (0, 1)])


def pairs_in(x1: np.ndarray, x2: np.ndarray, y1: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """Whether each pair ``(x1, x2)`` is one of the distinct pairs ``(y1, y2)``."""
    all1, all2 = np.concatenate((y1, x1)), np.concatenate((y2, x2))
    order = np.lexsort((np.arange(len(all1)), all2, all1))
    s1, s2 = all1[order], all2[order]
    new = np.concatenate(([True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1]))) if len(s1) else np.zeros(0, bool)
    leader = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    out = np.zeros(len(all1), bool)
    out[order] = leader < len(y1)
    return out[len(y1) :]


def stretch_rows(o, t, text, first, end, a, begin, windows, some, many) -> Iterator[pa.RecordBatch]:
    """The rows of ``stretches_of`` for one group of texts; the windows of the i-th begin at ``begin[i]``."""
    names = ["a", "c", "o", "t", "at", "n", "w"]

    def ranges(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = end[s] - first[s]
        return count, np.repeat(begin[text[s]] + first[s] - np.cumsum(count) + count, count) + np.arange(count.sum())

    def rows(s: np.ndarray, c: pa.Array, t: pa.Array, w: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a[s]), c, pa.array(o[text[s]]), t, pa.array(first[s]), pa.array(end[s] - first[s]), w], names)

    s = np.flatnonzero(some)
    if len(s):
        count, index = ranges(s)
        yield rows(s, pa.nulls(len(s), pa.int64()), pa.array(t[text[s]]), lists(signed(windows[index]), count, pa.int64()))
    s = np.flatnonzero(many)
    if len(s):
        count, index = ranges(s)
        begins = np.cumsum(count) - count
        c = np.add.reduceat(windows[index] * _POWERS[np.arange(len(index)) - np.repeat(begins, count)], begins)
        c = signed(c ^ (c >> np.uint64(31)))
        yield rows(s, pa.array(c), pa.array(t[text[s]]), pa.nulls(len(s), pa.list_(pa.int64())))
        order = np.lexsort((o[text[s]], c, a[s]))
        new = np.concatenate(([True], (np.diff(c[order]) != 0) | (np.diff(a[s][order]) != 0)))
        own = order[new]
        count, index = ranges(s[own])
        yield rows(s[own], pa.array(c[own]), pa.nulls(len(own), pa.int64()), lists(signed(windows[index]), count, pa.int64()))


def factors(symbols: list[int], reference: list[int], index: dict[int, int]) -> list[tuple[int, int]]:
    """Ranges of symbols that are factors: greedily the longest that goes on as the first reference does."""
    out, i, n, m = [], 0, len(symbols), len(reference)
    while i < n:
        r = index.get(symbols[i])
        if r is None:
            i += 1
            continue
        start = i
        while i < n and r < m and symbols[i] == reference[r]:
            i, r = i + 1, r + 1
        out.append((start, i))
    return out


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(t, at, n)``: factors of rows ``(a, o, t, at, w)`` sorted by ``a, o``; a block may go on over several batches."""
    block, order, waiting, reference, index = None, None, [], [], {}
    seen: set[tuple[int, ...]] = set()

    def added() -> None:
        for w in waiting:
            for s in w:
                if s not in index:
                    index[s] = len(reference)
                reference.append(s)
            reference.append(None)  # factors don't go from one reference to the next
        waiting.clear()

    for batch in batches:
        out: tuple[list[int], list[int], list[int]] = ([], [], [])
        for a, o, t, at, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if a != block:
                block, order, reference, index = a, o, [], {}
                waiting.clear()
                seen.clear()
            elif o != order:
                added()
                order = o
            for start, end in factors(w, reference, index):
                out[0].append(t)
                out[1].append(at + start)
                out[2].append(end - start)
            if any(s not in index for s in w) and (key := tuple(w)) not in seen:
                seen.add(key)
                waiting.append(w)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["t", "at", "n"])


def removed_words(n: int, copied: bool, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of n words lie in a window of a factor; all where the text is a copy and has a window."""
    if copied:
        return np.full(n, n >= WINDOW)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + length + WINDOW - 1, -1)
    return np.cumsum(edges)[:n] > 0


def kept_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(row, n_words, n_removed, kept, spans)`` of rows ``(row, text, copied, f)``."""
    names, span = ["row", "n_words", "n_removed", "kept", "spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        texts, copied, found = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
        edge = found.offsets.to_numpy() - found.offsets[0].as_py()
        at, length = (found.flatten().field(k).to_numpy() for k in (0, 1))
        start, size, out = 0, 0, ([], [], [], [])
        for i, text in enumerate(texts):
            some = slice(edge[i], edge[i + 1])
            n = sum(map(len, pieces(text)))
            gone = removed_words(n, copied[i], at[some], length[some])
            turns = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])))).tolist()
            stay, done, kept = (~gone).tolist(), 0, []
            for words in pieces(text):
                kept += compress(words, stay[done : done + len(words)]) if turns else words
                done += len(words)
            for column, value in zip(out, (n, int(gone.sum()), b" ".join(kept), [{"start": s, "end": e} for s, e in zip(turns[::2], turns[1::2], strict=True)]), strict=True):
                column.append(value)
            size += len(text)
            if size >= 1 << 22 or i == len(texts) - 1:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, i + 1 - start), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()).cast(pa.string()), pa.array(out[3], span)], names)
                start, size, out = i + 1, 0, ([], [], [], [])


def duplicate_factors(rows: DataFrame, split: int = SPLIT) -> DataFrame:
    """``(h, o, f)``: each text of ``rows(o, h, text)`` with its smallest order and its factors, null if it has none."""
    found = written(rows.mapInArrow(anchors_of, "o long, h binary, anchors array<struct<a:long,k:long>>"), "parse-anchors")
    texts = written(found.groupBy("h").agg(F.min("o").alias("o")).withColumn("t", F.monotonically_increasing_id()), "parse-texts")
    each = found.join(texts, ["h", "o"]).select("t", F.inline("anchors"))
    shared = each.groupBy("a").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.sum("k").alias("k")).where("low <> high")
    shared = written(shared.select(F.col("a").alias("b"), (F.col("k") > split).alias("many")), "parse-shared")
    some, many = (F.collect_set(F.when(c, F.col("a"))) for c in (~F.col("many"), F.col("many")))
    need = each.join(shared, F.col("a") == F.col("b")).groupBy("t").agg(some.alias("some"), many.alias("most"))
    need = written(need.join(texts, "t"), "parse-needed")
    met = rows.join(need, ["h", "o"]).select("o", "t", "text", "some", "most")
    cut = written(met.mapInArrow(stretches_of, "a long, c long, o long, t long, at long, n long, w array<long>"), "parse-stretches")
    discard(found, shared, need)
    whole = cut.where("c is null").select("a", "o", "t", "at", "w").repartition(max(partitions(rows.sparkSession), 8), "a").sortWithinPartitions("a", "o")
    long = written(whole.mapInArrow(parsed, "t long, at long, n long"), "parse-long")
    short = written(split_factors(cut), "parse-short")
    out = long.select("t", F.array(F.struct("at", "n")).alias("f")).unionByName(short)
    out = out.groupBy("t").agg(F.array_sort(F.flatten(F.collect_list("f"))).alias("f"))
    out = written(texts.join(out, "t", "left").select("h", "o", "f"), "parse-factors")
    discard(cut, texts, long, short)
    return out


def split_factors(cut: DataFrame) -> DataFrame:
    """``(t, f)``: the factors ``(at, n)`` of each stretch of ``cut`` whose anchor too many texts have for a block.

    A stretch's factors are one array, and windows that follow each other are one factor, so there is a row
    for a stretch at most, however many windows are factors.
    """
    kinds = cut.where("t is null and c is not null").groupBy("a", "c").agg(F.min("o").alias("first"), F.first("w").alias("w"))
    kinds = written(kinds, "parse-kinds")
    each = kinds.select("a", "c", "first", F.posexplode("w").alias("i", "x"))
    least = each.groupBy(F.col("a").alias("b"), F.col("x").alias("y")).agg(F.min("first").alias("least"))
    late = each.join(least, (F.col("a") == F.col("b")) & (F.col("x") == F.col("y"))).where("first > least")
    late = late.groupBy("a", "c").agg(F.array_sort(F.collect_list(F.col("i").cast("long"))).alias("late"))
    apart = lambda by: F.filter("late", lambda x, k: F.coalesce(F.get("late", k.cast("int") + by) != x + by, F.lit(True)))
    late = late.select("a", "c", F.zip_with(apart(-1), apart(1), lambda x, y: F.struct(x.alias("at"), (y - x + 1).alias("n"))).alias("late"))
    kinds = written(kinds.select("a", "c", "first").join(late, ["a", "c"], "left"), "parse-kinds")
    met = cut.where("t is not null and c is not null").select("a", "c", "o", "t", "at", "n").join(kinds, ["a", "c"])
    own = F.transform("late", lambda f: F.struct((F.col("at") + f["at"]).alias("at"), f["n"].alias("n")))
    return met.select("t", F.when(F.col("o") > F.col("first"), F.array(F.struct("at", "n"))).otherwise(own).alias("f")).where("f is not null")


def dedup(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """The columns of ``docs`` with ``n_words``, ``n_removed``, ``kept`` and ``spans``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A window is ``WINDOW`` consecutive words; a word is
    removed if a window that covers it also starts in a row of a smaller ``doc_id`` (an integer).
    ``kept`` joins the other words by spaces, ``spans`` lists the ranges of removed words, the end
    exclusive. Rows of one id aren't copies of each other; null ids count as the largest long. A
    null text has no words; a text of fewer words than a window loses none. An empty table gives an
    empty result. Columns of the four names are replaced, others stay.
    """
    own = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept", "spans")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*own).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("o"), F.unhex(F.md5(text.cast("binary"))).alias("h"), text.cast("binary").alias("text"))
    first = duplicate_factors(rows.select("o", "h", "text"), split).select(F.col("h").alias("th"), F.col("o").alias("to"), "f")
    met = rows.join(first, (F.col("h") == F.col("th")) & (F.col("o") == F.col("to")), "left")
    met = met.select("row", "text", F.col("th").isNull().alias("copied"), F.coalesce("f", F.array().cast("array<struct<at:long,n:long>>")).alias("f"))
    span = F.array().cast("array<struct<start:long,end:long>>").alias("spans")
    schema = met.select("row", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept"), span).schema
    out = met.mapInArrow(kept_words, schema)
    return out.select(*[F.col("row")[c].alias(c) for c in own], "n_words", "n_removed", "kept", "spans")


#: DuckDB SQL for the digests of ``dedup``, by a table of all windows.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws FROM {docs}),
g AS (SELECT doc_id, k, array_to_string(ws[k:k + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS k FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
c AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS k FROM g JOIN f USING (s) WHERE first < doc_id),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM d),
r AS (SELECT w.doc_id, count(*) AS n_words, count(c.k) AS n_removed, coalesce(string_agg(w.word, ' ' ORDER BY w.k) FILTER (c.k IS NULL), '') AS kept
      FROM w LEFT JOIN c ON c.doc_id = w.doc_id AND c.k = w.k GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
