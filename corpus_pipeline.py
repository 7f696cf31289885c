"""The corpus pipeline: five stages, each (spark, docs, sf_dir) -> DataFrame, written as Parquet and read by the next.

Edge cases, for every stage: a null or empty text is a document like another (of equal ones one stays, as texts go; the
near-duplicate stage links none of them); null ids, repeated rows, very long texts, empty tables and columns of whatever
name come through as the operators say. The columns of documents come out as they came in, in their order, whatever
they are called; the last stage returns pieces.

run() deletes a stage's intermediate tables as soon as its result is written, and that result when the next one is; a
stage called by itself leaves its tables in the shared folder until the caller has read what it returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import exact_dedup, near_dedup, packing, secrets, toxicity
from skein.llm.common import table
from skein.llm.queries import tokenizer
from skein.session import remove, saved, scratch, scratch_dropped


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the whole input's labels, doesn't call toxic; columns of docs."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the smallest doc_id stays."""
    return near_dedup.drop_near_duplicates(docs, k=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark in text (n_chars follows)."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Classifier, near-duplicate search, guess costs and token ids have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    folder = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch_dropped(spark):
            docs = saved(stage(spark, docs, sf_dir), f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
