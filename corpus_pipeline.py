"""A corpus from raw documents to packed sequences, one operator a stage.

Every stage takes what its predecessor kept, in the columns of ``documents``,
others included; the last returns pieces of training sequences.

Defined cases: documents with a null or empty text have the classifier's score
of an empty passage, are no near copies, hold no secrets and cost no tokens of
the mix; rows of one doc_id are one document to near-dedup, those without doc_id
all stay; null sources and languages are leaves of their own; an empty table
gives no rows; a text of any length is read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempolink.llm import mixing, neardup, packing, quality, secrets
from tempolink.sources.scratch import Scratch

#: The mix takes this share of the tokens, each document at most once.
SHARE = 0.9


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.drop_copies(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced by a mark."""
    return secrets.mask(docs, secrets.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights' budgets cover."""
    return mixing.mix(docs, domain=mixing.domain_of(F.col("source")), share=SHARE, epochs=1, only_rows=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, with_ids=False)


STAGES = [
    ("quality classifier", keep_good),
    ("near-duplicates", drop_near_copies),
    ("secret scan", mask_secrets),
    ("source mixing", mix_sources),
    ("packing", pack),
]

#: A trained classifier and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is kept in the shared folder until the next is."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.keep(docs)
            scratch.release(docs)
    return docs
