"""Line dedup by an exact set-similarity join over word tokens, in DataFrame functions only.

A line's tokens are its distinct words, lower-cased. Lines of the same words in the same order are
one class and meet nothing. Tokens are ordered from rare to frequent, by counts in a fixed number
of hashed buckets over all classes, with one end mark after the last. Two lines of Jaccard
similarity t or more share a rare token of their prefixes, the first n - ceil(t n) + 1 of n tokens,
or they share frequent tokens only. Single frequent tokens would have ever longer posting lists as
lines grow in number, so lines meet at pairs of them that are neighbours in the order: few tokens
are only in one of two similar lines, each comes between two common tokens at most once, so near the
front two common tokens have nothing between them in either line (``frequent_pairs``). Of the lines
that meet, the length filter, the positional filter and a bitmap of parities discard those that
can't reach t, and the rest are verified on all their tokens.

A line is removed if an earlier line, whether removed itself or not, is as similar as t or has the
same words. Only whether there is such a line matters, so at keys of many lines a line is first
compared with the earliest one and a few others; lines that this settles, the bulk of any group of
near copies, need no other comparison there. Those still open are compared with all.

A line is split into words once; from then on it is its tokens, and for the keys what ``line_keys``
has of it. Every step is written before the next one reads it, and deleted when nothing reads it any
more. Texts split into lines are exploded by the outer form, as the optimizer would otherwise test
for empty arrays first and split each text twice.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glasswing.llm.common import bucketed, discard, partitions, sorted_shuffles, written

SIMILARITY = 0.8
#: Buckets of token counts, and how many of them are one row while the array is put together.
BUCKETS, ROW = 1 << 22, 1 << 11
#: Tokens in buckets of more occurrences than this are frequent, and lines don't meet at one such token alone.
FREQUENT = 24
#: Posting lists up to this length are compared whole; lines of longer ones at first with so many others.
SHORT, LEADS = 24, 8
#: Lines of so many tokens have twice as many parities; those of 64 tokens have no similar ones of fewer.
WIDE = 52
#: Tables of shared pairs; while one is made, its share of all pairs is on the disk.
PARTS = 3
_HASH = (1 << 56) - 1
_END = 127 << 56
#: White space in a line.
SPACES = " \t\x0b\f\r"


def rank(count: Column) -> Column:
    """A bucket's count on a scale that fits in a byte and stays below the end mark's rank."""
    return F.least(F.lit(126), F.floor(F.log2(count) * 4) + 1).cast("byte")


def blank(line: Column) -> Column:
    """Whether a line has no words; this looks at no more than the white space before the first one."""
    return F.ltrim(line, F.lit(SPACES)) == ""


def plain(line: Column) -> Column:
    """A line's words in lower case with one space between."""
    loose = line.startswith(" ") | line.endswith(" ")
    for space in ("  ", "\t", "\x0b", "\f", "\r"):
        loose = loose | F.contains(line, F.lit(space))
    return F.lower(F.when(loose, F.trim(F.regexp_replace(line, r"\s+", " "))).otherwise(line))


def words(line: Column) -> Column:
    """The hashed words of a plain line."""
    return F.transform(F.split(line, " "), lambda w: F.xxhash64(w))


def tokens(line: Column) -> Column:
    """The distinct hashed words of a plain line."""
    return F.array_distinct(words(line))


def line_classes(docs: DataFrame) -> DataFrame:
    """``(r, at, doc, t)``: each class of lines with its first place, its tokens and the hash of its words as its number.

    Lines are dealt out by that hash before any are merged, as few are equal, and written in buckets of
    it, so what is joined by ``r`` later does not move them again. The order of places is that of
    ``doc_id``, nulls last, then of the text's hash, then of lines.
    ``doc`` is the first part of the place as one number, for a rough comparison.
    """
    rows = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("text")).alias("d"), F.split("text", "\n").alias("ls"))
    rows = rows.select("d", F.posexplode_outer("ls").alias("line", "l")).where(~blank(F.col("l"))).withColumn("l", plain(F.col("l")))
    rows = rows.select(F.xxhash64("l").alias("r"), F.hash("l").alias("b"), F.struct("d.none", "d.doc", "d.text", "line").alias("at"), "l")
    rows = rows.repartition(partitions(docs.sparkSession), "r").groupBy("r", "b").agg(F.min(F.struct("at", "l")).alias("m"))
    out = rows.select("m.at", F.coalesce("m.at.doc", F.lit((1 << 63) - 1)).alias("doc"), tokens(F.col("m.l")).alias("t"), "r")
    return written(bucketed(out, "r"), "lines-classes")


def filled(rows: DataFrame, before: Column, size: int, zeros) -> DataFrame:
    """Sorted structs ``(at, v)`` of column ``x`` as one array of all ``v``, and ``zeros`` where of ``size`` places after ``before`` some have none."""
    rows = rows.withColumn("ends", F.concat(F.array(before.cast("int")), F.transform("x", lambda s: s["at"])))
    parts = F.transform("x", lambda s, i: F.concat(zeros(s["at"] - F.get("ends", i) - 1), s["v"]))
    return rows.withColumn("x", F.concat(F.flatten(parts), zeros(before + size - F.element_at("ends", -1)))).drop("ends")


def token_ranks(classes: DataFrame) -> Column:
    """The logarithm of each bucket's number of tokens in all classes, as one array of bytes."""
    bucket = F.col("w").bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    counted = classes.select(F.explode("t").alias("w")).groupBy(bucket.alias("b")).count()
    zeros = lambda n: F.array_repeat(F.lit(0).cast("byte"), n.cast("int"))
    one = F.struct(F.col("b").alias("at"), F.array(rank(F.col("count"))).alias("v"))
    rows = counted.groupBy((F.col("b") / ROW).cast("int").alias("at")).agg(F.array_sort(F.collect_list(one)).alias("x"))
    rows = filled(rows, F.col("at") * ROW - 1, ROW, zeros)
    rows = rows.agg(F.array_sort(F.collect_list(F.struct("at", F.col("x").alias("v")))).alias("x"))
    return written(filled(rows, F.lit(-1), BUCKETS // ROW, lambda n: zeros(n * ROW)), "lines-ranks").scalar()


def most_missing(n: Column, similarity: float) -> Column:
    """How many tokens of a line may be missing from a similar one, at most."""
    return F.floor(n * F.lit(1 - similarity) + 1e-9).cast("int")


def frequent_pairs(n: Column, h: Column, similarity: float) -> Column:
    """How many pairs of a line's frequent tokens have to be indexed, from the front.

    Let a tokens be only in this line of n and b only in the other, and let both share none of their
    rare tokens, of which this line has h, all among the a. Of the gaps between common tokens at
    most a + b - h aren't empty, so one of the first a + b - h + 1 is empty in both lines, and it
    begins at the frequent token a + b - h + a - h or before. As a + b <= (n - a)(1 - t) / t, that is
    largest where a is. Lines with h > a can't be similar to such a line.
    """
    a = most_missing(n, similarity)
    return F.greatest(F.lit(0), a + F.floor((n - a) * F.lit((1 - similarity) / similarity) + 1e-9).cast("int") + 1 - 2 * h)


def parities(t: Column, half: bool = False) -> Column:
    """Of each value of a token's last six bits, whether an odd number of tokens has it; or of those tokens only whose seventh bit is set."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    if half:
        bit = lambda x: F.call_function("shiftleft", F.shiftright(x, 6).bitwiseAND(F.lit(1)), x.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(t, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(bit(x)))


def line_keys(classes: DataFrame, similarity: float) -> DataFrame:
    """``(r, doc, n, h, s, z, own, common)``: a class's number of tokens, of rare ones, its parities, half of them and what its keys are made of.

    ``own`` has the rare tokens of its prefix; ``common`` has the frequent tokens that begin its pairs, and one more.
    """
    ranked = lambda x: F.get("ranks", x.bitwiseAND(F.lit(BUCKETS - 1))).cast("long")
    code = lambda x: F.coalesce(F.shiftleft(ranked(x), 56).bitwiseOR(F.shiftrightunsigned(x, 8)), F.lit(0).cast("long"))  # noqa: E731  (an array that may hold nulls is sorted by far slower code)
    edge = F.lit((math.floor(math.log2(FREQUENT) * 4) + 2) << 56)  # sorted in between the rare tokens and the others
    ordered = F.sort_array(F.concat(F.transform("t", code), F.array(edge, F.lit(_END))))
    rows = classes.withColumn("ranks", token_ranks(classes)).select("r", "doc", F.size("t").alias("n"), parities(F.col("t")).alias("s"), F.when(F.size("t") >= WIDE, parities(F.col("t"), half=True)).otherwise(0).alias("z"), ordered.alias("o"))
    rows = rows.select("r", "doc", "n", (F.array_position("o", edge) - 1).cast("int").alias("h"), "s", "z", "o")
    own = F.least("h", most_missing(F.col("n"), similarity) + 1)
    count = F.least(frequent_pairs(F.col("n"), F.col("h"), similarity), F.col("n") - F.col("h"))
    common = F.slice("o", F.col("h") + 2, F.when(count > 0, count + 1).otherwise(0))
    return written(rows.select("r", "doc", "n", "h", "s", "z", F.slice("o", F.lit(1), own).alias("own"), common.alias("common")), "lines-keys")


def rare_postings(keys: DataFrame) -> DataFrame:
    """``(x, v)``: the rare tokens by which classes meet; those of one class only meet nothing. A list is no longer than a rare token's count."""
    rows = keys.select("r", "n", "h", "s", "z", F.posexplode("own").alias("i", "a")).where(F.col("a") >= F.lit(2 << 56))
    return rows.select(F.col("a").bitwiseAND(F.lit(_HASH)).alias("x"), F.struct("r", "n", "i", "h", "s", "z").alias("v"))


def pair_postings(keys: DataFrame) -> list[DataFrame]:
    """Written ``(x, k, v)``: the pairs of frequent tokens by which classes meet, and how many classes each has, more than one.

    Rows have all that is asked of a class from the start, as the share of pairs that several classes
    have grows with the lines and a join would add it to ever more of them. Tables of equal shares of
    the pairs, as all rows shuffled at once would need much disk.
    """
    rows = keys.select("doc", "r", "n", "h", "s", "z", "common", F.posexplode("common").alias("at", "a")).where(F.col("at") < F.size("common") - 1)
    x = F.xxhash64("a", F.get("common", F.col("at") + 1)).bitwiseAND(F.lit(_HASH))
    rows = rows.select(x.alias("x"), "doc", "r", "n", (F.col("h") + F.col("at")).alias("i"), "h", "s", "z")
    out = []
    for k in range(PARTS):
        met = rows.where(F.col("x") % PARTS == k).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("x"))).where("k > 1")
        out.append(written(met.select("x", "k", F.struct("doc", "r", "n", "i", "h", "s", "z").alias("v")), "lines-posted"))
    return out


def possible(x: str, y: str, similarity: float) -> Column:
    """Whether two lines that share a key can be similar: length, position, parities.

    At most as many parities differ as there are tokens that only one of the two has. At a pair of
    frequent tokens, both lines' rare tokens count as not shared, or the lines meet at one of these.
    """
    at = lambda k: (F.col(f"{x}.{k}"), F.col(f"{y}.{k}"))
    (nx, ny), (ix, iy), (hx, hy) = at("n"), at("i"), at("h")
    least = F.ceil((nx + ny) * F.lit(similarity / (1 + similarity)) - 1e-9)
    apart = nx + ny - 2 * least
    near = (ny >= nx * F.lit(similarity) - 1e-9) & (nx >= ny * F.lit(similarity) - 1e-9)
    rare = (ix < hx) & (iy < hy)
    reach = F.when(rare, F.least(ix, iy)).when(hx + hy <= apart, F.least(ix - hx, iy - hy)).otherwise(-nx) + F.least(nx - ix, ny - iy)
    (sx, sy), (zx, zy) = at("s"), at("z")
    odd, half = sx.bitwiseXOR(sy), zx.bitwiseXOR(zy)
    unlike = F.when((nx >= WIDE) & (ny >= WIDE), F.bit_count(half) + F.bit_count(odd.bitwiseXOR(half))).otherwise(F.bit_count(odd))
    return (F.col(f"{x}.r") != F.col(f"{y}.r")) & (unlike <= apart) & near & (reach >= least)


def ends(rows: DataFrame) -> DataFrame:
    """``(a, b, n)``: both classes of rows ``(v, w)``, the smaller number first, and the number of tokens of both."""
    return rows.select(F.least("v.r", "w.r").alias("a"), F.greatest("v.r", "w.r").alias("b"), (F.col("v.n") + F.col("w.n")).alias("n"))


def unordered(rows: DataFrame) -> DataFrame:
    """``ends`` of rows ``(v, w)``, each pair once."""
    return ends(rows).distinct()


def met_twice(rows: DataFrame) -> DataFrame:
    """``(v, w)``: all pairs of one key of ``rows(x, v)``, of short lists; both sides are the same columns, so they are shuffled once."""
    p, q = rows.alias("p"), rows.alias("q")
    return p.join(q.hint("shuffle_hash"), F.col("p.x") == F.col("q.x")).select(F.col("p.v").alias("v"), F.col("q.v").alias("w"))


def verified(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The later classes ``r`` of pairs ``(a, b, n)`` that are similar on all tokens.

    The classes that meet are taken out of the buckets first, where they are, so other tokens aren't shuffled.
    """
    met = pairs.select(F.explode(F.array("a", "b")).alias("r")).distinct()
    lines = written(classes.select("r", "at", "t").join(met.hint("shuffle_hash"), "r", "left_semi"), "lines-compared")
    side = lambda s: lines.select(F.col("r").alias(s), F.struct("at", "t").alias(f"v{s}"))
    both = side("a").join(pairs.hint("shuffle_hash"), "a").join(side("b").hint("shuffle_hash"), "b")
    both = both.where(F.size(F.array_intersect("va.t", "vb.t")) * F.lit(1 + similarity) >= F.col("n") * F.lit(similarity) - 1e-9)
    out = written(both.select(F.when(F.col("va.at") > F.col("vb.at"), F.col("a")).otherwise(F.col("b")).alias("r")).distinct(), "lines-removed")
    discard(lines)
    return out


def removed_classes(classes: DataFrame, similarity: float) -> DataFrame:
    """The classes ``r`` of lines that are similar to an earlier line of other words."""
    keys = line_keys(classes, similarity)
    posts = pair_postings(keys)
    posted = reduce(DataFrame.unionByName, posts)
    few, many = posted.where(f"k <= {SHORT}").select("x", "v"), posted.where(f"k > {SHORT}").select("x", "v")
    once = (F.col("w.r") < F.col("v.r")) & possible("v", "w", similarity)
    later = (F.col("w.doc") <= F.col("v.doc")) & possible("v", "w", similarity)
    other = lambda rows: rows.select("x", F.col("v").alias("w"))
    hashed = [F.min(F.struct(F.xxhash64("v.r", F.lit(j)).alias("h"), "v"))["v"].alias(f"w{j}") for j in range(LEADS)]
    leads = many.groupBy("x").agg(F.min("v").alias("w"), *hashed).select("x", F.explode(F.array_distinct(F.array("w", *[f"w{j}" for j in range(LEADS)]))).alias("w"))
    found = [written(unordered(met_twice(rare_postings(keys)).where(once)), "lines-pairs")]
    discard(keys)
    found.append(written(ends(met_twice(few).where(once)).unionByName(ends(many.join(leads, "x").where(later))).distinct(), "lines-pairs"))
    pairs = found[0].unionByName(found[1]).distinct()
    gone = verified(pairs, classes, similarity)
    open_ = many.join(gone.select(F.col("r").alias("_r")).hint("shuffle_hash"), F.col("v.r") == F.col("_r"), "left_anti")
    found.append(written(unordered(open_.join(other(many), "x").where(later)), "lines-pairs"))
    last = verified(found[2], classes, similarity)
    discard(*posts, *found)
    return gone.unionByName(last)


def kept_lines(docs: DataFrame, similarity: float) -> DataFrame:
    """Written ``(_doc, _none, _text, _kept)``: the numbers of the lines with words that each document keeps."""
    classes = line_classes(docs)
    kept = classes.select("r", "at").join(removed_classes(classes, similarity).hint("shuffle_hash"), "r", "left_anti")
    kept = kept.select(F.coalesce("at.doc", F.lit(0)).alias("_doc"), F.col("at.none").alias("_none"), F.col("at.text").alias("_text"), "at.line")
    kept = kept.repartition("_doc", "_none", "_text").groupBy("_doc", "_none", "_text").agg(F.collect_list("line").alias("_kept"))
    out = written(kept, "lines-kept")
    discard(classes)
    return out


def dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """All columns of ``docs``, ``text`` without removed lines, with ``n_lines`` and ``n_removed``.

    Lines without words are kept and match nothing. A null text is empty and has no lines removed.
    Rows that repeat both id and text are one document and keep the same lines; of rows that share
    an id only, the one with the smaller hash of the text comes first, and null ids come last. A
    document that loses all lines stays with an empty text. Columns of these names are replaced.
    """
    if not 0.5 < similarity <= 1:  # at 0.5 two lines may have as many gaps as common tokens
        raise ValueError("similarity must be more than 0.5, and 1 at most")
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs = docs.select(*kept_columns).withColumn("text", F.coalesce("text", F.lit("")))
    with sorted_shuffles(docs.sparkSession):
        kept = kept_lines(docs, similarity)
    rest = [c for c in kept_columns if c != "text"]
    docs = docs.select(F.struct(*rest).alias("row"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null"), F.xxhash64("text").alias("_hash"))
    out = docs.join(kept.hint("shuffle_hash"), (F.col("_id") == F.col("_doc")) & (F.col("_null") == F.col("_none")) & (F.col("_hash") == F.col("_text")), "left")
    out = out.withColumn("_lines", F.split("text", "\n"))
    empty = F.filter(F.transform("_lines", lambda x, i: F.when(blank(x), i)), lambda i: i.isNotNull())
    stay = F.sort_array(F.concat(F.coalesce("_kept", F.array().cast("array<int>")), empty))
    out = out.withColumn("_stay", stay).withColumn("n_lines", F.size("_lines")).withColumn("n_removed", F.size("_lines") - F.size("_stay"))
    out = out.withColumn("text", F.array_join(F.transform("_stay", lambda i: F.get("_lines", i)), "\n"))
    return out.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in kept_columns], "n_lines", "n_removed")


#: DuckDB SQL for ``dedup`` by comparing all lines that share a word.
ORACLE = r"""
WITH s AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
                  unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS line FROM {docs}),
p AS (SELECT doc_id, line, raw, lower(trim(regexp_replace(raw, '[ \t\n\x0b\f\r]+', ' ', 'g'), ' ')) AS l,
             row_number() OVER (ORDER BY doc_id, line) AS o FROM s),
c AS (SELECT l, min(o) AS o FROM p WHERE l <> '' GROUP BY l),
w AS (SELECT o, unnest(list_distinct(string_split(l, ' '))) AS w FROM c),
n AS (SELECT o, count(*) AS n FROM w GROUP BY o),
v AS (SELECT w.o, w.w, n.n FROM w JOIN n USING (o)),
m AS (SELECT DISTINCT o FROM (
        SELECT x.o FROM v x JOIN v y ON x.w = y.w AND y.o < x.o AND y.n >= 0.8 * x.n - 1e-9 AND x.n >= 0.8 * y.n - 1e-9
        GROUP BY x.o, y.o, x.n, y.n HAVING count(*) >= 0.8 * (x.n + y.n - count(*)) - 1e-9)),
k AS (SELECT p.doc_id, p.line, p.raw, p.l = '' OR (c.o = p.o AND m.o IS NULL) AS stays
      FROM p LEFT JOIN c ON c.l = p.l LEFT JOIN m ON m.o = p.o)
SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (stays), '') AS text,
       count(*)::INTEGER AS n_lines, (count(*) FILTER (NOT stays))::INTEGER AS n_removed
FROM k GROUP BY doc_id
"""
