"""The thin queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glasswing.llm import ann, bpe, iblt, linededup, merkle, mixing, parsing, pii, quality, simhash, tokenbin, vectorcodes, warc
from glasswing.llm.common import table

#: The folder of the public vocabulary files; None: where the package of that name is installed.
TOKENIZERS: str | None = None


def vocabulary(name: str) -> str:
    if TOKENIZERS is not None:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source with the same weight, as many characters as the table has."""
    return mixing.replicate(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")

    return out.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)],
        F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.col("found")).alias("spans"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.derive(warc.responses(table(spark, sf_dir, "pages")), key="page_id")
    header = lambda name: F.element_at(F.filter("headers", lambda h: h["name"] == name), 1)["value"]
    return out.select(
        "page_id",
        "record_id",
        "type",
        "uri",
        "date",
        header("WARC-Refers-To").alias("refers_to"),
        header("WARC-Block-Digest").alias("block_digest"),
        header("WARC-Source-Payload-Digest").alias("source_payload_digest"),
        F.octet_length("block").cast("long").alias("content_length"),
        F.to_json("headers").alias("headers"),
        F.decode("block", "UTF-8").alias("content"),
    )


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "expected_grade", "tail_probability", "keep")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_tokenbin(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = tokenbin.vocabulary(vocabulary("byte_bpe_50k.json"))
    folder, manifest = tokenbin.write(table(spark, sf_dir, "documents"), data, end=0)
    return tokenbin.read(spark, folder, manifest)


def op9_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.compare(table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame, data: bytes) -> DataFrame:
    """Adds what the contract asks of ids and of what they decode to; columns of these names are replaced, others stay."""
    import public_tokenizers

    kept = [c for c in docs.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256")]
    out = bpe.encode(docs.select(F.struct(*kept).alias("row"), "text"), data, public_tokenizers.PATTERN)
    out = out.withColumn("decoded", bpe.decode(F.col("ids"), data, docs.sparkSession))
    return out.select(
        *[F.col("row")[c].alias(c) for c in kept],
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digests(docs, bpe.read_ranks(vocabulary("byte_bpe_50k.tiktoken"))).drop("text")


def op11_vectorcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vectorcodes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    digest = F.lit(vectorcodes.digest(books))
    return coded.select("vec_id", vectorcodes.as_hex(F.col("codes")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = merkle.manifest(docs, found=merkle.without_line_feeds(F.col("doc_id"), F.col("text")))
    out = made.proofs.select("doc_id", "leaf", "subroot", F.lit(made.root).alias("root"), merkle.proof(F.col("path")).alias("proof_sha256"), merkle.folded(F.col("found"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = parsing.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_pii": op2_pii,
    "op3_warc": op3_warc,
    "op4_linededup": op4_linededup,
    "op5_quality": op5_quality,
    "op6_ann": op6_ann,
    "op7_simhash": op7_simhash,
    "op8_tokenbin": op8_tokenbin,
    "op9_iblt": op9_iblt,
    "op10_bpe": op10_bpe,
    "op11_vectorcodes": op11_vectorcodes,
    "op12_merkle": op12_merkle,
    "op13_parsing": op13_parsing,
}

ORACLES: dict[str, str] = {
    "op1_mixing": mixing.ORACLE.format(docs="documents"),
    "op6_ann": ann.ORACLE.format(vectors="embeddings"),
    "op4_linededup": linededup.ORACLE.format(docs="documents"),
    "op11_vectorcodes": vectorcodes.ORACLE.format(vectors="embeddings"),
    "op12_merkle": merkle.ORACLE.format(docs="documents"),
    "op13_parsing": parsing.ORACLE.format(docs="documents"),
}
