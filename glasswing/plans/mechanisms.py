"""Queries of the operators that keep state: stores, sources, streams, indexes, orders, each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glasswing.functions.paths import canonical, parent
from glasswing.operators import blocked, grams, listing_cache, ordering, regions, rollup, search, skew
from glasswing.operators.tables import materialised, shared_folder
from glasswing.plans.catalogue import CANONICAL, SCORED, documents, flagged, hashed, prototypes, query, read, url_path
from glasswing.sources import changes, keyed, tree
from glasswing.streaming import claims, jobs, scans


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, as the mounted path that Python opens."""
    return f"{keyed.local(shared_folder(spark))}/{name}-{uuid.uuid4().hex}"


TURNS = "SELECT conv_id, turn, role FROM conversations"


@query(
    "keyed_store",
    f"""WITH a AS ({TURNS} WHERE conv_id % 2 <> 0 UNION ALL {TURNS} WHERE conv_id % 2 = 0 AND turn < 2)
SELECT conv_id, turn, role, CASE WHEN conv_id % 2 = 0 THEN 3 ELSE 1 END::BIGINT AS version FROM a WHERE conv_id % 5 <> 0""",
)
def keyed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with their turns: all are put, every other one again in two versions, every fifth is deleted."""
    turns = read(spark, sf_dir, "conversations")
    store = keyed.KeyedTable(spark, own_folder(spark, "keyed"), ["conv_id"], "conv_id long, version long", "conv_id long, turn long, role string", buckets=16)

    def version(rows: DataFrame, n: int) -> DataFrame:
        return rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), "role")).alias("children")).withColumn("version", F.lit(n).cast("long"))

    store.put(version(turns, 1), ["version"])
    some = turns.where("conv_id % 2 = 0")
    store.put(version(some.where("turn < 1"), 2).unionByName(version(some.where("turn < 2"), 3)), ["version"])
    store.delete(turns.where("conv_id % 5 = 0").select(F.col("conv_id").cast("long").alias("conv_id")))
    kind = turns.schema["turn"].dataType
    return store.children().join(store.parents(), "conv_id").select("conv_id", F.col("turn").cast(kind).alias("turn"), "role", "version")


def as_tree(docs: DataFrame, path: str) -> None:
    """Ids as text files in a directory for each language and source, one file for each and call."""
    docs.select(F.col("doc_id").cast("string").alias("value"), "lang", "source").repartition(1, "lang", "source").write.mode("append").partitionBy("lang", "source").text(f"file://{path}")


@query("tree_scan", "SELECT DISTINCT 'lang=' || lang || '/source=' || source AS rel_path, 2 AS depth FROM documents WHERE lang = 'en'")
def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of a written tree below one of its directories, by filters that the walk takes up."""
    path = own_folder(spark, "tree")
    as_tree(documents(spark, sf_dir), path)
    rows = tree.scan(spark, tree.Roots({"documents": path}), "root-0")
    return rows.where("startswith(rel_path, 'lang=en/') and is_dir and depth <= 2").select("rel_path", "depth")


@query("tree_changes", "SELECT DISTINCT 'lang=' || lang || '/source=' || source AS parent, (doc_id % 2)::BIGINT AS batch FROM documents")
def tree_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directories of new files of a written tree, by a stream that is restarted after more were written."""
    path, state = own_folder(spark, "tree"), own_folder(spark, "changes")
    for batch in (0, 1):
        as_tree(documents(spark, sf_dir).where(f"doc_id % 2 = {batch}"), path)
        if batch == 0:
            rows = changes.changes(spark, tree.Roots({"documents": path}), "root-0", f"{state}/state").where("not is_dir and startswith(name, 'part-')").select("parent")
        jobs.drained(rows.withColumn("batch", F.lit(batch).cast("long")), f"{state}/out", f"{state}/checkpoint", 0.5)
    return spark.read.parquet(f"file://{state}/out").distinct()


KINDS = "CASE WHEN event_type = 'purchase' THEN 'done' ELSE 'claim' END"


@query(
    "job_claims",
    f"""WITH e AS (SELECT event_id, user_id, {KINDS} AS kind, lag({KINDS}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
SELECT event_id, user_id::VARCHAR AS job, CASE WHEN kind = 'claim' THEN CASE WHEN was = 'claim' THEN 'pending' ELSE 'claimed' END
       ELSE CASE WHEN was = 'claim' THEN 'released' ELSE 'unknown' END END AS outcome FROM e""",
)
def job_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as jobs: each event asks for the user, one kind of them releases it; no claim is dropped or expires."""
    rows = jobs.file_stream(spark, f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "purchase", "done").otherwise("claim")
    asked = rows.select(F.col("user_id").cast("string").alias("job"), kind.alias("kind"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    out = claims.outcomes(claims.claims, asked, capacity=1 << 40, ttl="36500 days")
    return out.where("seq is not null").select(F.col("seq").alias("event_id"), "job", "outcome")


@query("scan_counts", "SELECT count(*) AS total, count(*) AS completed, count(*) FILTER (n_chars < 100) AS failed FROM documents")
def scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan of all documents counts that can't use short ones."""
    runs, path = scans.Scans(spark), own_folder(spark, "scan")
    short = F.when(F.col("n_chars") < 100, "too short")
    runs.start(documents(spark, sf_dir), lambda df: df.select("doc_id", short.alias("error")), lambda epoch, df: df.write.mode("append").parquet(f"file://{path}"), ["doc_id"], slices=4)
    s = runs.wait()
    if s.state != "done":
        raise RuntimeError(s.error)
    return spark.createDataFrame([(s.total, s.completed, s.failed)], "total long, completed long, failed long")


HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query(
    "directory_usage",
    f"""WITH RECURSIVE p AS (SELECT {HOST} AS root_id, regexp_replace({CANONICAL}, '/?[^/]*$', '') AS rel_path, length(html) AS size FROM pages),
u AS (SELECT root_id, rel_path, sum(size) AS size, count(*) AS files FROM p GROUP BY 1, 2),
a AS (SELECT root_id, rel_path, size, files FROM u
      UNION ALL SELECT root_id, regexp_replace(rel_path, '/?[^/]*$', ''), size, files FROM a WHERE rel_path <> '')
SELECT root_id, rel_path, sum(size)::BIGINT AS total_size, sum(files)::BIGINT AS files, 0::BIGINT AS directories FROM a GROUP BY 1, 2""",
)
def directory_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of every directory of every host with all below it; a page is a file."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    files = read(spark, sf_dir, "pages").select(host.alias("root_id"), canonical(url_path()).alias("rel_path"), F.lit(False).alias("is_dir"), F.char_length("html").cast("long").alias("size"))
    return rollup.usage(files)


@query(
    "directory_detections",
    """WITH f AS (SELECT source, lang, toxic FROM documents JOIN labels USING (doc_id)),
d AS (SELECT '' AS rel_path, toxic FROM f UNION ALL SELECT source, toxic FROM f UNION ALL SELECT source || '/' || lang, toxic FROM f)
SELECT 'documents' AS root_id, rel_path, count(*) AS scanned, count(*) FILTER (toxic = 1) AS with_person FROM d GROUP BY rel_path""",
)
def directory_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents looked at, and with the flag, of every directory ``source/lang`` and those above."""
    rows = flagged(spark, sf_dir).where("has_person is not null")
    return rollup.detections(rows.select(F.lit("documents").alias("root_id"), F.concat_ws("/", "source", "lang", "doc_id").alias("rel_path"), "has_person"))


@query("duplicates_spread", "SELECT doc_id, source, hash, copies FROM (SELECT doc_id, source, sha256(text) AS hash, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents) WHERE copies > 1")
def duplicates_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of repeated content, by a join that spreads heavy contents."""
    return skew.repeated(hashed(spark, sf_dir).select("doc_id", "source", "hash")).select("doc_id", "source", "hash", "copies")


@query("search_indexed", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the t')")
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a query, found by the index of their trigrams."""
    return grams.index(documents(spark, sf_dir), "doc_id", "text").search("The T").select(F.col("key").alias("doc_id"))


@query(
    "search_phases",
    """WITH f AS (SELECT doc_id, 1 AS priority FROM documents WHERE contains(source, 'src1')
UNION ALL SELECT doc_id, 2 FROM documents WHERE contains(lang, 'e')
UNION ALL SELECT doc_id, 3 FROM documents WHERE contains(lower(text), 'the'))
SELECT doc_id, min(priority)::INTEGER AS priority FROM f GROUP BY doc_id ORDER BY 2, 1 LIMIT 500""",
)
def search_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of a search, each run only while the limit isn't reached."""
    docs = documents(spark, sf_dir)
    phase = lambda column, text: lambda: docs.where(search.contains(F.col(column), text))
    return grams.phased([phase("source", "src1"), phase("lang", "e"), phase("text", "the")], "doc_id")[0]


GROUPED = """, e AS (SELECT vec_id, grp, label, exp(100 * (cosine - max(cosine) OVER w)) AS x FROM s WINDOW w AS (PARTITION BY vec_id, grp)),
p2 AS (SELECT vec_id, grp, label, x / sum(x) OVER (PARTITION BY vec_id, grp) AS p, row_number() OVER (PARTITION BY vec_id, grp ORDER BY x DESC, label) AS r FROM e)
SELECT vec_id, grp, label, round(p, 5) AS p FROM p2 WHERE r = 1 AND p >= 0.2"""


@query("label_blocks", SCORED.rstrip().rstrip(",") + GROUPED)
def label_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest label of each group, from states of small blocks of labels."""
    out = blocked.grouped_tags(read(spark, sf_dir, "embeddings"), prototypes(spark, sf_dir), "vec_id", numbers=256)
    return out.select("vec_id", "grp", "label", F.round("p", 5).alias("p"))


@query("nearest_labels", SCORED + "SELECT vec_id, label, round(cosine, 5) AS score, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, label) AS r FROM s) WHERE r <= 3")
def nearest_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's three nearest labels, from the best of small blocks of labels."""
    out = blocked.best_labels(read(spark, sf_dir, "embeddings"), prototypes(spark, sf_dir), "vec_id", 3, numbers=256)
    return out.select("vec_id", "label", F.round("cosine", 5).alias("score"), "rank")


@query(
    "bitmap_regions",
    """WITH RECURSIVE c AS (SELECT vec_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) WHERE embedding[i] >= 0.1::FLOAT),
r AS (SELECT vec_id, y, x, y * 8 + x AS seed FROM c
      UNION SELECT c.vec_id, c.y, c.x, r.seed FROM r JOIN c ON c.vec_id = r.vec_id AND abs(c.y - r.y) <= 1 AND abs(c.x - r.x) <= 1),
l AS (SELECT vec_id, y, x, min(seed) AS seed FROM r GROUP BY 1, 2, 3),
n AS (SELECT *, dense_rank() OVER (PARTITION BY vec_id ORDER BY seed) - 1 AS region FROM l)
SELECT vec_id, region::INTEGER AS region, min(x)::BIGINT AS "left", min(y)::BIGINT AS top, max(x)::BIGINT + 1 AS "right", max(y)::BIGINT + 1 AS bottom, count(*) AS cells FROM n GROUP BY 1, 2""",
)
def bitmap_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of touching cells in bitmaps of eight columns that the vectors' components make."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("embedding") - 1) / 8).cast("int")), lambda y: F.slice("embedding", y * 8 + 1, F.lit(8)))).alias("y", "v"))
    found = regions.regions(regions.runs_of(rows, "vec_id", "v", F.lit(0.1).cast("float")), "vec_id")
    out = regions.boxes(found, "vec_id")
    return out.select("vec_id", "region", *[F.col(c).cast("long").alias(c) for c in ("left", "top", "right", "bottom", "cells")])


@query("cached_listing", "SELECT doc_id, lang, 2::BIGINT AS made FROM documents WHERE source = 'src3' UNION ALL SELECT doc_id, lang, 1 FROM documents WHERE source = 'src1'")
def cached_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of two sources, kept; a change below one has it made again."""
    cache, docs, made = listing_cache.ListingCache(), documents(spark, sf_dir), {"src1": 0, "src3": 0}

    def listing(source: str) -> DataFrame:
        made[source] += 1
        return docs.where(F.col("source") == source).select("doc_id", "lang", F.lit(made[source]).cast("long").alias("made"))

    for source in (*made, *made):
        cache.get("documents", source, lambda s=source: listing(s), "all")
    cache.changed("documents", "src3/some file")
    again = [cache.get("documents", s, lambda s=s: listing(s), "all") for s in made]
    return again[0].unionByName(again[1])
