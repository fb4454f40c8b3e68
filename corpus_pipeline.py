"""A corpus from raw documents to token ids: toxicity, near duplicates, secrets, source mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm import bpe, minhash, mixing, secrets, toxicity
from matchloom.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels that aren't held out."""
    return toxicity.without_toxic(docs, toxicity.learnt_from(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at a similarity of 0.8 or more the one with the smallest doc_id stays."""
    return minhash.one_of_each(docs, 80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; spans found are replaced by a mask."""
    return secrets.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix draws them: a row per document, pass over its source and output shard, cut to the words taken."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with digests of the ids and of what they decode to."""
    return bpe.encoded(docs, bpe.default_path())


STAGES = [("toxicity", drop_toxic), ("minhash_near_dedup", drop_near_duplicates), ("secret_scans", mask_secrets), ("source_mixing", mix_sources), ("bpe_encoding", encode)]

#: None: SQL can express neither the classifier nor the later stages that depend on what it kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents; each result is written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
