"""Merkle manifest of a dataset in an external-memory node store.

Leaves are written as sorted runs: dealt out by ranges of source and id, so that a source of very
many rows lies in many runs, and numbered without a window over a source. A node's coordinate is
its source's number, its level and its place there. Each level is a Parquet partition of the store,
made by reading the level below: runs of ``FAN`` consecutive nodes become their digest. A source
whose level has one node has its subroot; subroots, in the order of their sources, are the leaves
of the tree above, which is made in the same way.

Proofs are extracted from the top down. A node's proof is its siblings', then its parent's, so each
level is joined once with the one above by coordinates; a parent's row holds its run, and the rows
that are joined fall to a third from each level to the next.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasswing.llm.common import shared_dir, written
from glasswing.operators.ordering import numbered
from glasswing.plans.catalogue import CRC_TABLE, crc32_sql

FAN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(*values: Column) -> Column:
    """The digest of a row's values: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    text = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def level_path(store: str, tree: str, level: int) -> str:
    return f"{store}/{tree}/level={level}"


def grow(rows: DataFrame, store: str, tree: str) -> list[DataFrame]:
    """Writes the levels of the trees of ``rows(s, p, n, h, ...)`` and returns them with ``kids``.

    ``n`` is the number of nodes of tree ``s`` at that level, ``kids`` the digests below a node;
    leaves keep their other columns. A tree ends at the level where it has one node, and isn't in
    those above.
    """
    spark, levels = rows.sparkSession, []
    level = rows.withColumn("kids", F.array().cast("array<string>"))
    while True:
        path = level_path(store, tree, len(levels))
        level.write.parquet(path)
        levels.append(spark.read.schema(level.schema).parquet(path))
        below = levels[-1].where("n > 1")
        if below.isEmpty():
            return levels
        run = below.groupBy("s", F.expr(f"p div {FAN}").alias("p")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("p", "h")))["h"].alias("kids"))
        level = run.select("s", "p", F.ceil(F.col("n") / FAN).cast("long").alias("n"), digest(F.array_join("kids", "")).alias("h"), "kids")


def with_paths(levels: list[DataFrame], tops: DataFrame, name: str) -> DataFrame:
    """The leaves of ``levels`` with ``top`` and ``path``; ``tops(s, top, path)`` has what stands above each tree.

    ``path`` lists, from the leaf to the top, a node's place in its run and the others of the run.
    """
    out = None
    for k in range(len(levels) - 1, -1, -1):
        rows = levels[k]
        own = [c for c in rows.columns if c != "n"]
        ends = rows.where("n = 1").join(tops, "s").select(*own, "top", "path")
        if out is not None:
            above = out.select(F.col("s").alias("t"), F.col("p").alias("q"), F.col("kids").alias("run"), "top", F.col("path").alias("up"))
            met = rows.where("n > 1").join(above, (F.col("s") == F.col("t")) & (F.expr(f"p div {FAN}") == F.col("q")))
            at = (F.col("p") % FAN).cast("int")
            others = F.filter("run", lambda _, i: i != at)
            met = met.select(*own, "top", F.concat(F.array(F.struct(at.alias("at"), others.alias("others"))), "up").alias("path"))
            ends = met.unionByName(ends)
        out = written(ends, f"merkle-{name}-{k}") if k else ends
    return out.drop("kids")


def proof(path: Column) -> Column:
    """The siblings' digests, level by level, left to right, as one digest."""
    return digest(F.array_join(F.flatten(F.transform(path, lambda x: x["others"])), ""))


def folded(value: Column, path: Column) -> Column:
    """The root that a leaf's digest and its proof give."""
    joined = lambda h, x: digest(F.array_join(F.concat(F.slice(x["others"], F.lit(1), x["at"]), F.array(h), F.slice(x["others"], x["at"] + 1, F.lit(FAN))), ""))
    return F.aggregate(path, value, joined)


@dataclass
class Manifest:
    """``store``: the folder of the nodes; ``root``: the digest of all; ``proofs``: a row for each row of the dataset."""

    store: str
    root: str | None
    proofs: DataFrame


def manifest(docs: DataFrame, **found: Column) -> Manifest:
    """The node store of ``docs`` and, for each row, ``(doc_id, leaf, <found>, subroot, path)``.

    ``found`` gives other versions of a row's text, as expressions over ``docs``: each adds a column
    of that name with the leaf digest of the row with that text, to be folded with the original siblings.

    Within a source rows ascend by id, null ids first, rows of one id by their leaf digest; rows that
    are equal in all fields have neighbouring places and equal leaves. Null sources are one source,
    the first. An empty table has no proofs and the root None. Other columns don't matter.
    """
    spark = docs.sparkSession
    fields = [F.col(c) for c in FIELDS]
    versions = {k: leaf(*fields[:-1], v) for k, v in found.items()}
    leaves = written(docs.select("doc_id", "source", leaf(*fields).alias("leaf"), *[v.alias(k) for k, v in versions.items()]), "merkle-leaves")
    store = f"{shared_dir(spark)}/merkle-{uuid.uuid4().hex}"
    rows = numbered(leaves, ["source"], ["doc_id", "leaf"], name="p", total="n")
    sources = numbered(leaves.select("source").distinct(), [], ["source"], name="s", total="_").select("source", "s", F.col("_").alias("many"))
    rows = rows.withColumnRenamed("source", "of").join(sources, F.col("of").eqNullSafe(F.col("source")))
    rows = rows.select("s", "p", "n", F.col("leaf").alias("h"), F.struct("doc_id", *found).alias("row"))
    trees = grow(rows, store, "sources")
    subroots = reduce(DataFrame.unionByName, [level.where("n = 1").select(F.col("s").alias("p"), "h") for level in trees])
    many, none = subroots.count(), F.array().cast("array<struct<at:int,others:array<string>>>")
    top = grow(subroots.select(F.lit(0).cast("long").alias("s"), "p", F.lit(many).cast("long").alias("n"), "h"), store, "all")
    root = top[-1].head()["h"] if many else None
    start = spark.range(1).select(F.col("id").alias("s"), F.lit(root).alias("top"), none.alias("path"))
    tops = written(with_paths(top, start, "all").select(F.col("p").alias("s"), F.col("h").alias("top"), "path"), "merkle-tops")
    out = with_paths(trees, tops, "sources")
    return Manifest(store, root, out.select("row.doc_id", F.col("h").alias("leaf"), *[F.col("row")[k].alias(k) for k in found], F.col("top").alias("subroot"), "path"))


def without_line_feeds(doc_id: Column, text: Column) -> Column:
    """The text, without its line feeds where 2 divides the CRC-32 of the id; what a careless copy does."""
    harmed = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return F.when(F.coalesce(harmed, F.lit(False)), F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def _value(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_value, (*FIELDS[:-1], text))) + ")"


#: DuckDB SQL for the proofs, folded with texts that have lost line feeds; ids must be distinct.
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf("text")} AS leaf,
                            {_leaf("CASE WHEN " + crc32_sql("d") + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS found
      FROM (SELECT *, hex(encode(doc_id::VARCHAR)) AS d FROM {{docs}}), ({CRC_TABLE})),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n,
             dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM d),
t AS (SELECT 0 AS lv, s, p, n, leaf AS h FROM l
      UNION ALL SELECT lv + 1, s, p // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY p)) FROM t WHERE n > 1 GROUP BY lv, s, p // 3),
u AS (SELECT 0 AS lv, s AS p, count(*) OVER () AS n, h FROM t WHERE n = 1
      UNION ALL SELECT lv + 1, p // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY p)) FROM u WHERE n > 1 GROUP BY lv, p // 3),
o AS (SELECT lv, s, p // 3 AS q, list({{{{'p': p, 'h': h}}}} ORDER BY p) AS run FROM t WHERE n > 1 GROUP BY lv, s, p // 3
      UNION ALL SELECT 1000 + lv, -1, p // 3, list({{{{'p': p, 'h': h}}}} ORDER BY p) FROM u WHERE n > 1 GROUP BY lv, p // 3),
b AS (SELECT doc_id, leaf, s, CASE WHEN n > 1 THEN 0 ELSE 1000 END AS lv, CASE WHEN n > 1 THEN s ELSE -1 END AS tree, CASE WHEN n > 1 THEN p ELSE s END AS p,
             CASE WHEN n > 1 THEN n ELSE (SELECT max(n) FROM u) END AS n, found AS now, '' AS proof FROM l
      UNION ALL
      SELECT doc_id, leaf, b.s, CASE WHEN b.lv < 1000 AND (n + 2) // 3 = 1 THEN 1000 ELSE b.lv + 1 END,
             CASE WHEN (n + 2) // 3 = 1 THEN -1 ELSE tree END,
             CASE WHEN b.lv < 1000 AND (n + 2) // 3 = 1 THEN b.s ELSE p // 3 END,
             CASE WHEN b.lv < 1000 AND (n + 2) // 3 = 1 THEN (SELECT max(n) FROM u) ELSE (n + 2) // 3 END,
             sha256(array_to_string(list_transform(run, lambda x: CASE WHEN x.p = b.p THEN now ELSE x.h END), '')),
             proof || array_to_string(list_transform(list_filter(run, lambda x: x.p <> b.p), lambda x: x.h), '')
      FROM b JOIN o ON o.lv = b.lv AND o.s = b.tree AND o.q = b.p // 3 WHERE n > 1)
SELECT doc_id, leaf, t.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = r.h AS verified
FROM b JOIN t ON t.s = b.s AND t.n = 1 JOIN (SELECT h FROM u WHERE n = 1) r ON true WHERE b.lv >= 1000 AND b.n = 1
"""
