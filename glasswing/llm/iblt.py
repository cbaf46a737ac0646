"""Fingerprints of documents as invertible Bloom lookup sketches of their paragraphs.

A paragraph is a line, longer ones cut after every ``WIDTH`` characters. Its 64-bit digest is put
into three cells of a sketch, one in each third; a cell holds a count, the digests' XOR and the
XOR of their check sums. Subtracting two documents' sketches leaves the digests that only one has.
Peeling recovers them: a cell with count 1 or -1 and the right check sum holds one digest, which is
taken out of its other cells, and so on. A sketch has a fixed size, so peeling fails where too
many digests differ; it is then retried larger, as four sketches that each take the digests with
two certain bits, and of these only those that fail are retried again. Work is in proportion to
the paragraphs, all of it in SQL functions within a document's own row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glasswing.llm.common import partitions, text_of

#: Characters of a paragraph at most, cells in each third of a sketch, rounds of peeling.
WIDTH, THIRD, ROUNDS = 120, 8, 6
#: Times that a failed sketch is retried as four; 4 ** 9 sketches hold over two million differences.
RETRIES = 9
#: Segments of ids by quantile, and buckets of rows at most, whose first ids are broadcast.
SEGMENTS, MOST_BUCKETS = 128, 1 << 16


SIDES = "array<struct<key:bigint,n:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def paragraphs(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"[^\\n]{{1,{WIDTH}}}"), F.lit(0)), lambda p: F.xxhash64(p)))


def check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check"))


def place(key: Column, j: int) -> Column:
    """The cell of a digest in third ``j``; bits of one hash serve all thirds."""
    return F.shiftright(F.xxhash64(key, F.lit("place")), 16 * j).bitwiseAND(F.lit(THIRD - 1)).cast("int") + j * THIRD


def entry(key: Column, sign: Column) -> Column:
    return F.struct(key.alias("key"), check(key).alias("sum"), sign.cast("int").alias("n"), F.array(*[place(key, j) for j in range(3)]).alias("at"))


def put(cell: Column, e: Column, sign: int) -> Column:
    n = cell["n"] + e["n"] if sign > 0 else cell["n"] - e["n"]
    return F.struct(n.alias("n"), cell["key"].bitwiseXOR(e["key"]).alias("key"), cell["sum"].bitwiseXOR(e["sum"]).alias("sum"))


def _third(i: Column) -> Column:
    return F.floor(i / F.lit(THIRD)).cast("int")


def sketch(digests: Column) -> Column:
    """The cells of a set of digests."""
    none = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("sum"))
    fill = lambda es: F.transform(F.sequence(F.lit(0), F.lit(3 * THIRD - 1)), lambda i: let(_third(i), lambda t: F.aggregate(F.filter(es, lambda e: F.get(e["at"], t) == i), none, lambda c, e: put(c, e, 1))))
    return let(F.transform(digests, lambda d: entry(d, F.lit(1))), fill)


def subtract(a: Column, b: Column) -> Column:
    one = lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["sum"].bitwiseXOR(y["sum"]).alias("sum"))
    return F.zip_with(a, b, one)


def side(key: Column, n: Column) -> Column:
    return F.struct(key.alias("key"), n.cast("int").alias("n"))


def peel(cells: Column) -> Column:
    """The digests that a difference holds, with 1 or -1 for the side they are on; null where peeling fails."""

    def step(s: Column) -> Column:
        pure = F.filter(s["cells"], lambda c: (F.abs(c["n"]) == 1) & (check(c["key"]) == c["sum"]))
        found = F.array_distinct(F.transform(pure, lambda c: entry(c["key"], c["n"])))
        take = lambda es: F.struct(F.transform(s["cells"], lambda c, i: let(_third(i), lambda t: F.aggregate(F.filter(es, lambda e: F.get(e["at"], t) == i), c, lambda a, e: put(a, e, -1)))).alias("cells"), F.concat(s["found"], F.transform(es, lambda e: side(e["key"], e["n"]))).alias("found"), (F.size(es) == 0).alias("over"))
        return let(found, take)

    start = F.struct(cells.alias("cells"), F.array().cast(SIDES).alias("found"), F.lit(False).alias("over"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, _: F.when(s["over"], s).otherwise(step(s)))
    empty = lambda s: F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["sum"] == 0))
    return let(done, lambda s: F.when(empty(s), s["found"]))


def part(found: Column, a: Column, b: Column) -> Column:
    """A sketch's outcome; the digests go on only where it failed."""
    none = F.array().cast("array<bigint>")
    keep = lambda n, x: F.when(n.isNull(), x).otherwise(none)
    return let(found, lambda n: F.struct(n.alias("found"), keep(n, a).alias("a"), keep(n, b).alias("b")))


def retried(parts: Column, level: Column) -> Column:
    """Failed sketches as four each, of the digests with the same two bits."""

    def quarter(s: Column, j: Column) -> Column:
        own = lambda x: F.filter(x, lambda d: F.call_function("shiftright", d, 2 * level).bitwiseAND(F.lit(3)) == j)
        return let(F.struct(own(s["a"]).alias("a"), own(s["b"]).alias("b")), lambda q: part(peel(subtract(sketch(q["a"]), sketch(q["b"]))), q["a"], q["b"]))

    split = lambda s: F.when(s["found"].isNotNull(), F.array(s)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: quarter(s, j)))
    return F.when(F.exists(parts, lambda s: s["found"].isNull()), F.flatten(F.transform(parts, split))).otherwise(parts)


def difference(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """The digests that only one of two documents has, from their sketches, larger ones where these fail.

    ``array<struct<key, n>>``: ``n`` is 1 for a digest of the first document and -1 for one of the second.
    """
    start = F.array(part(peel(subtract(cells_a, cells_b)), a, b))
    parts = F.aggregate(F.sequence(F.lit(0), F.lit(RETRIES - 1)), start, lambda s, level: retried(s, level))
    only = lambda x, y, n: F.transform(F.array_except(x, y), lambda d: side(d, F.lit(n)))
    return F.flatten(F.transform(parts, lambda s: F.coalesce(s["found"], F.concat(only(s["a"], s["b"], 1), only(s["b"], s["a"], -1)))))


def likeness(a: Column, b: Column, difference: Column) -> Column:
    """Jaccard likeness from both sizes and the digests that only one has; 1 for two empty sets."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise((both - difference).cast("double") / (both + difference))


def written_out(cells: Column) -> Column:
    """A sketch as a string: for each cell count, digests and check sums in hexadecimal."""
    one = lambda c: F.concat(F.lower(F.hex(c["n"])), F.lit("."), F.lower(F.hex(c["key"])), F.lit("."), F.lower(F.hex(c["sum"])))
    return F.array_join(F.transform(cells, one), " ")


def with_next(docs: DataFrame, key: str, names: list[str], order: str) -> DataFrame:
    """Adds ``next_<name>``: columns of the next row in descending order of the key, after the last the first's.

    Null keys come last; ``order`` breaks ties. Rows are dealt into buckets of neighbouring keys,
    and the first row of each bucket is copied to the bucket before, so nothing is sorted whole.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("_x", F.bitwise_not(F.col(key)))
    bounds = docs.agg(F.percentile_approx("_x", [i / SEGMENTS for i in range(SEGMENTS + 1)], 20_000).alias("b"), F.min("_x").alias("lo"), F.max("_x").alias("hi")).first()
    edges = sorted({bounds["lo"], bounds["hi"], *(bounds["b"] or [])} - {None}) or [0]
    per = max(1, min(MOST_BUCKETS // SEGMENTS, 4 * partitions(spark) // len(edges) + 1))
    at = F.array(*[F.lit(e).cast("long") for e in edges])
    segment = F.size(F.filter(at, lambda e: e <= F.col("_x")))
    docs = docs.withColumn("_segment", segment)
    low = F.element_at(at, F.greatest(F.col("_segment"), F.lit(1)))
    high = F.element_at(at, F.least(F.col("_segment") + 1, F.lit(len(edges))))
    inner = F.least(F.lit(per - 1), F.greatest(F.lit(0), F.floor((F.col("_x") - low).cast("double") / F.greatest(F.lit(1.0), (high - low).cast("double")) * per).cast("int")))
    docs = docs.withColumn("_bucket", F.when(F.col("_x").isNull(), F.lit((len(edges) + 1) * per)).otherwise(F.col("_segment") * per + inner)).drop("_segment")
    first = sorted((r["_bucket"], r["x"]) for r in docs.groupBy("_bucket").agg(F.min("_x").alias("x")).collect())  # a row for each bucket
    if not first:
        return docs.drop("_x", "_bucket").withColumns({f"next_{n}": F.col(n) for n in names})
    guests = [(x, before, False) for (before, _), (_, x) in zip(first, first[1:], strict=False)] + [(first[0][1], first[-1][0], True)]
    guests = spark.range(1).select(F.inline(F.from_json(F.lit(str([{"gx": x, "gb": b} for x, b, _ in guests]).replace("'", '"').replace("None", "null")), "array<struct<gx:long,gb:int>>")))
    copies = docs.join(F.broadcast(guests), docs["_x"].eqNullSafe(guests["gx"])).withColumn("_bucket", F.col("gb")).drop("gx", "gb").withColumn("_guest", F.lit(True))
    rows = docs.withColumn("_guest", F.lit(False)).unionByName(copies)
    w = Window.partitionBy("_bucket").orderBy("_guest", F.col("_x").asc_nulls_last(), order)
    rows = rows.withColumns({f"next_{n}": F.lead(n).over(w) for n in names})
    return rows.where("not _guest").drop("_x", "_bucket", "_guest")


def compare(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document.

    The edited text has its last third of characters replaced by the first as many (or all) of the
    next document's, in descending order of ``doc_id``, rows that repeat an id in order of their
    texts, null ids last, and after the last the first. Null texts are empty. Returns ``doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``; other
    columns don't matter. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", text_of().alias("text")).withColumn("digests", paragraphs(F.col("text")))
    docs = with_next(docs, "doc_id", ["text", "digests"], "text")
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    docs = docs.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring(F.col("next_text"), F.lit(1), cut)))
    docs = docs.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "digests", "next_digests", paragraphs(F.col("edited")).alias("edited_digests"))
    docs = docs.withColumns({f"{n}_cells": sketch(F.col(f"{n}digests")) for n in ("", "edited_", "next_")})
    for name, other in (("edits", "edited_"), ("steps", "next_")):
        docs = docs.withColumn(name, F.size(difference(F.col("digests"), F.col(f"{other}digests"), F.col("_cells"), F.col(f"{other}_cells"))))
    return docs.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written_out(F.col("_cells")).alias("fingerprint"),
        written_out(F.col("edited__cells")).alias("edited_fingerprint"),
        likeness(F.col("digests"), F.col("edited_digests"), F.col("edits")).alias("near_edited"),
        likeness(F.col("digests"), F.col("next_digests"), F.col("steps")).alias("near_next"),
    )
