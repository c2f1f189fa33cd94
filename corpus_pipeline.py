"""Clean and pack a corpus: reject bad texts, keep one of each near-duplicate group, redact secrets, pack.

All stages take documents with any further columns and return them as they are, whatever their names; all but the last
return the columns of documents. Null texts count as empty and stay null, texts of any length are read whole, empty tables
give empty ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cuelight.llm import packing, quality, secret_scan, simhash
from cuelight.llm.tables import stored, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Null ids and repeated rows are judged by their text like any
    other; without labels nothing is rejected."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of texts of close fingerprints or of similar shingles (five words,
    a similarity of 0.8 or more). Null ids come last, and where rows repeat an id, the least hash of the text decides; null and
    empty texts are one group."""
    return simhash.keep_one(docs, similar=0.8)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated ones too, with a mark of its kind in the place of each secret."""
    return secret_scan.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of 2048 ids; rows that repeat an id, or have none, are packed as often as they
    occur."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality", classify), ("simhash", deduplicate), ("secrets", redact), ("packing", pack)]

#: SQL can express neither the classifier nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each on what the one before kept, written in between."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
