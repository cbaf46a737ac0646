"""The catalogue's queries over the driver's tables, each with its DuckDB SQL.

Those tables hold no media, so every operator runs on the closest thing: a document is a file, its
source a directory, its text the recognised text, the toxic label the person flag, an embedding an
image's, the first vector of each label a label's embedding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glasswing.functions import media, paths, vectors
from glasswing.operators import duplicates, frames, listing, ordering, scoring, search, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first vector of each label as its embedding; the label modulo 3 is its group."""
    rows = read(spark, sf_dir, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("prototype"))
    return rows.select("label", F.col("label").alias("ord"), (F.col("label") % 3).alias("grp"), "prototype")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return scoring.similarities(items, prototypes(spark, sf_dir))


SCORED = """
WITH p AS (SELECT label, arg_min(embedding, vec_id) AS prototype FROM embeddings GROUP BY label),
s AS (SELECT e.vec_id, p.label, p.label % 3 AS grp,
      list_sum(list_transform(list_zip(e.embedding, p.prototype), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS cosine
      FROM embeddings e CROSS JOIN p)
"""


@query(
    "label_scoring",
    SCORED + """, x AS (SELECT *, exp(cosine * 100 - max(cosine * 100) OVER (PARTITION BY vec_id, grp)) AS e FROM s),
y AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id, grp) AS p FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY vec_id, grp ORDER BY p DESC, label) AS r FROM y)
SELECT vec_id, grp, label, round(p, 4) AS p FROM z WHERE r = 1 AND p >= 0.9""",
)
def label_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.grouped_tags(scored(spark, sf_dir), "vec_id", threshold=0.9).select("vec_id", "grp", "label", F.round("p", 4).alias("p"))


@query("ungrouped_tags", SCORED + "SELECT vec_id, label, round(cosine, 5) AS score FROM s WHERE cosine >= 0.25")
def ungrouped_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.plain_tags(scored(spark, sf_dir), 0.25).select("vec_id", "label", F.round("cosine", 5).alias("score"))


@query("top3_tags", SCORED + "SELECT vec_id, label, round(cosine, 5) AS score, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, label) AS r FROM s) WHERE r <= 3")
def top3_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.top(scored(spark, sf_dir), "vec_id", "cosine", 3, "ord").select("vec_id", "label", F.round("cosine", 5).alias("score"), "rank")


@query("l2_normalize", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS first FROM embeddings")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 5).alias("norm"), F.round(F.get(vectors.normalized(F.col("embedding")), F.lit(0)), 5).alias("first"))


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "source", "lang", "n_chars", media.sha256_hex(F.col("text").cast("binary")).alias("hash"))


@query("duplicates", "SELECT doc_id, source, hash, copies FROM (SELECT doc_id, source, sha256(text) AS hash, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents) WHERE copies > 1")
def repeated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.repeated(hashed(spark, sf_dir)).select("doc_id", "source", "hash", "copies")


@query("duplicate_groups", "SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_key, arg_min(n_chars, doc_id) AS size, sum(n_chars)::BIGINT AS total_size FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.groups(hashed(spark, sf_dir), "doc_id", "n_chars")


@query("duplicates_scoped", "SELECT doc_id, hash, copies FROM (SELECT doc_id, sha256(text) AS hash, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents WHERE lang = 'en') WHERE copies > 1")
def duplicates_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.repeated(hashed(spark, sf_dir).where("lang = 'en'")).select("doc_id", "hash", "copies")


@query("search_text", "SELECT doc_id FROM documents WHERE contains(lower(text), 'tion') ORDER BY doc_id LIMIT 500")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where(search.contains(F.col("text"), "TION")).select("doc_id").orderBy("doc_id").limit(search.LIMIT)


@query("search_unicode", "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'ü')")
def search_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where(search.contains(F.col("text"), "Ü")).select("doc_id", "lang")


PHASES = """
WITH f AS (SELECT doc_id, 1 AS priority FROM documents WHERE contains(lower(source || '/' || doc_id), 'src1')
UNION ALL SELECT doc_id, 2 FROM documents WHERE contains(lower(lang), 'e')
UNION ALL SELECT doc_id, 3 FROM documents WHERE contains(lower(text), 'the')),
m AS (SELECT doc_id, min(priority)::INTEGER AS priority FROM f GROUP BY doc_id ORDER BY 2, 1 LIMIT 500)
"""


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    by_name = docs.where(search.contains(F.concat_ws("/", "source", "doc_id"), "SRC1"))
    return search.merged([by_name, docs.where(search.contains(F.col("lang"), "e")), docs.where(search.contains(F.col("text"), "the"))], "doc_id")


@query("search_three_phase", PHASES + "SELECT * FROM m")
def search_three_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phases(spark, sf_dir)


@query("search_enriched", PHASES + "SELECT m.*, quality, toxic, sha256(text) AS hash FROM m LEFT JOIN labels USING (doc_id) LEFT JOIN documents USING (doc_id)")
def search_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return search.enriched(phases(spark, sf_dir), [labels, hashed(spark, sf_dir).select("doc_id", "hash")], ["doc_id"])


@query(
    "dir_listing",
    """WITH h AS (SELECT doc_id, source, n_chars, sha256(text) AS hash FROM documents),
d AS (SELECT hash, count(*) > 1 AS repeated FROM h GROUP BY hash)
SELECT doc_id, n_chars, toxic = 1 AS has_person, quality, hash, repeated FROM h JOIN d USING (hash) LEFT JOIN labels USING (doc_id) WHERE source = 'src3'""",
)
def dir_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hashed(spark, sf_dir)
    often = rows.groupBy("hash").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    labels = read(spark, sf_dir, "labels")
    here = rows.where("source = 'src3'").join(labels, "doc_id", "left").join(often, "hash")
    return here.select("doc_id", "n_chars", (F.col("toxic") == 1).alias("has_person"), "quality", "hash", "repeated")


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("has_person"))
    return documents(spark, sf_dir).select("doc_id", "source", "lang", "n_chars").join(labels, "doc_id", "left")


@query("no_people_filter", "SELECT doc_id, source FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT coalesce(toxic = 1, false)")
def no_people_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.without_people(flagged(spark, sf_dir)).select("doc_id", "source")


@query("tag_filter_keep_dirs", "SELECT source AS name, true AS is_dir FROM documents GROUP BY source UNION ALL SELECT doc_id::VARCHAR, false FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def tag_filter_keep_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    entries = docs.select(F.col("source").alias("name"), F.lit(True).alias("is_dir")).distinct().unionByName(docs.select(F.col("doc_id").cast("string").alias("name"), F.lit(False).alias("is_dir")))
    tags = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("name"), F.lit("good").alias("label"), F.col("quality").alias("score"))
    return listing.tagged_or_directories(entries, tags, "good", ["name"], 1).select("name", "is_dir")


@query("dir_status", "SELECT source, count(toxic) AS scanned, coalesce(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 0)::BIGINT AS with_person FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def dir_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flagged(spark, sf_dir).groupBy("source")
    return rows.agg(F.count("has_person").alias("scanned"), F.coalesce(F.sum(F.when(F.col("has_person"), 1).otherwise(0)), F.lit(0)).alias("with_person"))


@query("disk_usage", "SELECT source, sum(n_chars)::BIGINT AS total_size, count(*) AS files, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def disk_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy("source").agg(F.sum("n_chars").alias("total_size"), F.count(F.lit(1)).alias("files"), F.countDistinct("lang").alias("langs"))


STORED = "(SELECT doc_id, n_chars + doc_id % 5 // 4 AS n_chars, lang, CASE WHEN doc_id % 3 = 0 THEN 'v1' ELSE 'v2' END AS ver FROM documents WHERE doc_id % 2 = 0)"


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up result table: every other document, some with another size, some of an old version."""
    docs = documents(spark, sf_dir).where("doc_id % 2 = 0")
    return docs.select("doc_id", (F.col("n_chars") + F.expr("doc_id % 5 div 4")).alias("n_chars"), F.when(F.col("doc_id") % 3 == 0, "v1").otherwise("v2").alias("ver"))


@query("stale_plan", f"SELECT d.doc_id, d.n_chars FROM documents d WHERE NOT EXISTS (FROM {STORED} s WHERE s.doc_id = d.doc_id AND s.n_chars = d.n_chars AND s.ver = 'v2')")
def stale_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "n_chars", F.lit("v2").alias("ver"))
    return store.stale(docs, stored(spark, sf_dir), ["doc_id", "n_chars", "ver"]).select("doc_id", "n_chars")


@query("stale_plan_no_version", f"SELECT d.doc_id, d.n_chars FROM documents d WHERE NOT EXISTS (FROM {STORED} s WHERE s.doc_id = d.doc_id AND s.n_chars = d.n_chars)")
def stale_plan_no_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stale(documents(spark, sf_dir).select("doc_id", "n_chars"), stored(spark, sf_dir), ["doc_id", "n_chars"])


@query("keep_latest", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(read(spark, sf_dir, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id")


NEW_TURNS = "(SELECT conv_id, turn + 100 AS turn, role FROM conversations WHERE conv_id % 2 = 0 AND turn < 2)"


@query("upsert_replace_children", f"SELECT conv_id, turn, role FROM conversations WHERE conv_id % 2 <> 0 UNION ALL FROM {NEW_TURNS}")
def upsert_replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    parents = old.where("conv_id % 2 = 0").select("conv_id")
    new = old.where("conv_id % 2 = 0 AND turn < 2").withColumn("turn", F.col("turn") + 100)
    return store.children_replaced(old, new, parents, ["conv_id"])


@query("upsert_rows", "SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, 2, 0 FROM documents WHERE doc_id % 4 = 0")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = documents(spark, sf_dir).where("doc_id % 4 = 0").select("doc_id", F.lit(2).alias("quality"), F.lit(0).alias("toxic"))
    return store.upserted(read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), new, ["doc_id"])


@query("cascade_delete", "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.cascaded(read(spark, sf_dir, "labels").select("doc_id", "quality"), documents(spark, sf_dir).where("lang = 'en'"), ["doc_id"])


@query("tags_of_parents", "SELECT c.conv_id, c.turn, c.role, f.text AS opening FROM conversations c JOIN (SELECT conv_id, text FROM conversations WHERE turn = 0) f USING (conv_id)")
def tags_of_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    parents = turns.where("turn = 0").select("conv_id", F.col("text").alias("opening"))
    return turns.select("conv_id", "turn", "role").join(parents, "conv_id")


@query("frame_max_tags", "SELECT conv_id, role AS label, max((length(text) % 50) / 50.0::DOUBLE) AS score FROM conversations WHERE length(text) % 50 > 0 GROUP BY 1, 2")
def frame_max_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("label"), ((F.char_length("text") % 50) / F.lit(50.0)).alias("score"))
    return frames.highest_tags(rows, "conv_id")


@query("frame_any_max", "SELECT conv_id, bool_or(role = 'system') AS has_person, max(length(text))::BIGINT AS confidence FROM conversations GROUP BY conv_id")
def frame_any_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", (F.col("role") == "system").alias("has_person"), F.char_length("text").cast("long").alias("confidence"))
    return frames.any_person(rows, "conv_id")


@query("frame_distinct_text", "SELECT lang, trim(text) AS text, min(doc_id) AS doc_id FROM documents WHERE trim(text) <> '' GROUP BY 1, 2")
def frame_distinct_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.first_texts(documents(spark, sf_dir).select("lang", "text", "doc_id"), "lang", "doc_id")


@query("frame_joined_text", "SELECT conv_id, string_agg(t, chr(10) ORDER BY turn) AS text FROM (SELECT conv_id, trim(text) AS t, min(turn) AS turn FROM conversations WHERE trim(text) <> '' GROUP BY 1, 2) GROUP BY conv_id")
def frame_joined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.joined_text(read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")


URL_PATH = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '')"


def url_path():
    return F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://[^/]*", "")


EXT = f"lower(regexp_extract({URL_PATH}, '(\\.[^./]*)$', 1))"
KIND = f"CASE WHEN {EXT} IN {media.IMAGE} THEN 'image' WHEN {EXT} IN {media.VIDEO} THEN 'video' WHEN {EXT} = '.zip' THEN 'archive' WHEN {EXT} = '.pdf' THEN 'pdf' ELSE 'other' END"


@query("media_type", f"SELECT page_id, {KIND} AS media_type, {KIND} IN ('image', 'video', 'pdf') AS has_thumb FROM pages")
def media_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = media.media_type(url_path())
    return read(spark, sf_dir, "pages").select("page_id", kind.alias("media_type"), media.has_thumbnail(kind).alias("has_thumb"))


NAMES = "'clip_[' || event_type || '][' || lpad(to_hex(event_id), 8, '0') || '].mkv'"


@query("filename_crc", f"SELECT event_id, upper(list_extract(regexp_extract_all({NAMES}, '\\[([A-Fa-f0-9]{{8}})\\]', 1), -1)) AS crc32 FROM events")
def filename_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("clip_["), "event_type", F.lit("]["), F.lpad(F.hex("event_id"), 8, "0"), F.lit("].mkv"))
    return read(spark, sf_dir, "events").select("event_id", media.crc32_in_name(name).alias("crc32"))


@query("canonical_path", f"SELECT page_id, array_to_string(list_filter(string_split('/./' || {URL_PATH} || '//x/', '/'), lambda s: s NOT IN ('', '.')), '/') AS path FROM pages")
def canonical_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = F.concat(F.lit("\\.\\"), F.replace(url_path(), F.lit("/"), F.lit("\\")), F.lit("//x/"))
    return read(spark, sf_dir, "pages").select("page_id", paths.canonical(spelled).alias("path"))


CANONICAL = f"array_to_string(list_filter(string_split({URL_PATH}, '/'), lambda s: s NOT IN ('', '.')), '/')"


@query("path_scope", f"SELECT page_id FROM pages WHERE starts_with({CANONICAL}, 'en/') AND position('/' IN substr({CANONICAL}, 4)) = 0 AND length({CANONICAL}) > 3")
def path_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").where(paths.directly_in(paths.canonical(url_path()), "/en/")).select("page_id")


@query("host_rollup", "SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, count(*) AS pages FROM pages GROUP BY 1")
def host_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host")).agg(F.count(F.lit(1)).alias("pages"))


@query("cache_key", "SELECT doc_id, substr(sha256(source || ':' || doc_id || ':' || 1700000000 || ':' || n_chars), 1, 32) AS cache_key FROM documents")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", media.cache_key(F.col("source"), F.col("doc_id").cast("string"), F.lit(1700000000), F.col("n_chars")).alias("cache_key"))


#: DuckDB SQL: the CRC-32 table, made from its polynomial (a fixed value), and each text's bytes in hexadecimal digits.
CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t"


def crc32_sql(digits: str, table: str = "t") -> str:
    """DuckDB SQL for the CRC-32 of bytes given in hexadecimal digits."""
    each = f"list_transform(regexp_extract_all({digits}, '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {each}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])))"


@query("hash_crc32", f"SELECT doc_id, upper(printf('%08x', {crc32_sql('h')})) AS crc32, sha256(text) AS sha256 FROM (SELECT doc_id, text, hex(encode(text)) AS h FROM documents), ({CRC_TABLE})")
def hash_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.col("text").cast("binary")
    return documents(spark, sf_dir).select("doc_id", media.crc32_hex(content).alias("crc32"), media.sha256_hex(content).alias("sha256"))


@query("seek_positions", "SELECT doc_id, i::INTEGER AS i, n_chars * (i / 5.0::DOUBLE) AS position, CASE WHEN n_chars <= 0 THEN '1' WHEN n_chars * 0.1::DOUBLE < 1 THEN '0.00' ELSE printf('%.2f', n_chars * 0.1::DOUBLE) END AS seek FROM documents, range(1, 5) t(i)")
def seek_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    duration = F.col("n_chars").cast("double")
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(media.spaced_positions(duration, 4)).alias("i", "position"), media.seek_position(duration).alias("seek"))
    return rows.withColumn("i", F.col("i") + 1)


@query("ctc_collapse", "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE event_type <> 'error' AND event_type IS DISTINCT FROM b")
def ctc_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.collapsed(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", "error").select("event_id", "user_id", "event_type")


@query("sorted_listing", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INTEGER AS place FROM documents")
def sorted_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordering.numbered(documents(spark, sf_dir).select("source", "doc_id", "n_chars"), ["source"], ["n_chars", "doc_id"], descending=[True, False])
    return rows.select("source", "doc_id", (F.col("place") + 1).cast("int").alias("place"))


@query(
    "prev_next",
    """SELECT source, doc_id, coalesce(lag(doc_id) OVER w, max(doc_id) OVER (PARTITION BY source)) AS previous,
coalesce(lead(doc_id) OVER w, min(doc_id) OVER (PARTITION BY source)) AS next FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)""",
)
def prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.around(documents(spark, sf_dir).select("source", "doc_id"), ["source"], ["doc_id"], "doc_id")


@query("range_selection", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents) WHERE n BETWEEN 3 AND 7")
def range_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.places(documents(spark, sf_dir).select("source", "doc_id"), ["source"], ["doc_id"], 7, 3)


@query("distinct_labels", "SELECT DISTINCT role AS label FROM conversations")
def distinct_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.labels_in_use(read(spark, sf_dir, "conversations").select(F.col("role").alias("label")))


@query("human_size", "SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%d B', n_chars) WHEN n_chars < 1048576 THEN printf('%.1f KB', round(n_chars * 10 / 1024.0::DOUBLE) / 10) ELSE printf('%.1f MB', round(n_chars * 10 / 1048576.0::DOUBLE) / 10) END AS size FROM documents")
def human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", media.human_size(F.col("n_chars")).alias("size"))


@query(
    "label_override",
    """WITH b AS (SELECT n_name AS name, n_nationkey AS ord, 'base' AS prompt FROM nation),
o AS (SELECT n_name AS name, 'new' AS prompt, 0 AS k FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT r_name || '!', 'added', r_regionkey FROM region)
SELECT name, ord, prompt FROM b WHERE name NOT IN (SELECT name FROM o)
UNION ALL SELECT o.name, coalesce(b.ord, o.k + 1 + (SELECT max(ord) FROM b))::INTEGER, o.prompt FROM o LEFT JOIN b USING (name)""",
)
def label_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    base = nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"), F.lit("base").alias("prompt"))
    new = nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.lit(0).alias("ord"), F.lit("new").alias("prompt"))
    added = region.select(F.concat("r_name", F.lit("!")).alias("name"), F.col("r_regionkey").alias("ord"), F.lit("added").alias("prompt"))
    return store.overridden(base, new.unionByName(added))


@query("job_dedup_stream", "SELECT DISTINCT user_id, event_type FROM events")
def job_dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glasswing.streaming.jobs import distinct_jobs

    return distinct_jobs(spark, f"{sf_dir}/events.parquet", ["user_id", "event_type"])
