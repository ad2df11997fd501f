"""The corpus pipeline: each stage takes what the one before kept and hands on the columns of documents; the last one
encodes what is left.

Defined results: a null or empty text is kept by every filter (it is neither toxic nor a test passage) but for
near-duplicates, where texts without words are alike; a row without an id is never taken for a duplicate; repeated rows
count as copies, other texts of one id don't; labels that tell nothing reject nothing; an empty table goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skimmer.llm import decontaminate, pieces, secret_scan, simhash, toxicity
from skimmer.llm.common import scratch, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of severity grade 1 or more go."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays: the one of the smallest id, then of the least hash of its text."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of whose words a twentieth or more are in benchmark windows."""
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; values that look like live secrets are masked, and n_chars follows the texts that changed."""
    return secret_scan.redact(docs, length="n_chars")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document, with their piece ids."""
    return pieces.sample_encodings(docs)


STAGES = [
    ("toxicity", toxic),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("secret scan", redacted),
    ("piece encoding", encoded),
]

#: The model, the fingerprints and the sampled pieces are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each one written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = scratch(docs)
    return docs
