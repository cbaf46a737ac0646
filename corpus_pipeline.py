"""From raw documents to token ids: quality, repeated lines, near copies, mixture, encoding.

Each stage takes the session, its predecessor's documents and the folder of the tables, and works
on all of them. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glasswing.llm import bpe, linededup, mixing, quality, simhash
from glasswing.llm.common import table, written
from glasswing.llm.queries import bpe_digests, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier keeps."""
    return quality.select(docs, table(spark, sf_dir, "labels")).where("keep").select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line equals or resembles."""
    return linededup.dedup(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles of Jaccard similarity 0.8 or more, by fingerprints first."""
    return simhash.keep_one(docs).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that each source has its share of the mixture, in shuffled order."""
    return mixing.replicate(docs).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the number and the digest of its token ids, and of what they decode to."""
    out = bpe_digests(docs.select(*COLUMNS), bpe.read_ranks(vocabulary("byte_bpe_50k.tiktoken")))
    return out.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_repeated_lines),
    ("simhash near-dedup", one_of_each),
    ("mixing to target weights", mixed),
    ("byte-level bpe", encoded),
]

#: The classifier and the near copies have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{k}")
    return docs
