"""From raw documents to token counts: quality rules, near-duplicates, repeated passages, mixing, encoding.

Part of the subpackage llm. Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm import bpe, mixing, quality_rules, simhash, suffix_dedup
from stockloom.llm.common import materialize, table
from stockloom.llm.queries import _tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Cutoffs are learned from the labels of the documents at hand."""
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"), COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id, a null id after all others."""
    return simhash.one_of_each(docs, COLUMNS)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of passages that start earlier in the corpus. Texts cut to nothing leave."""
    return suffix_dedup.dedup_documents(docs).where(F.col("text") != "").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources in training order: texts as often and as far as it takes them."""
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every text of the mix."""
    return bpe.token_digests(docs, *_tokenizer())


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", simhash_stage),
    ("suffix_array_dedup", suffix_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result of each is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Several stages cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
