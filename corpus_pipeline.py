"""Corpus pipeline: from raw documents to packed training sequences.

Five stages, each one operator of ``portrisk.llm``: documents scored as toxic go, of equal
texts one row stays, of near-duplicates one document stays, sources are mixed to their
target weights (documents repeat as the mix takes them), and what is left is packed into
sequences of 1024 tokens at most.  Every stage's result is written as Parquet and read again
by the next one.  All but the last return the columns of ``documents``; null texts count as
empty, repeated rows are rows of their own until a deduplication drops them, an empty table
passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portrisk.llm import cuckoo, mixing, packing, simhash, toxicity
from portrisk.llm.common import prepare, stored
from portrisk.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; the model learns from the labels' training folds."""
    prepare(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal after lower-casing A-Z, the one with the greatest doc_id."""
    return cuckoo.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked within 4 fingerprint bits over 4-word shingles, the smallest doc_id."""
    return simhash.without_near_duplicates(docs, shingle=4, radius=4, seed=42)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources 5 : 2 : 1 takes them, 3 times at most."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences of 1024 tokens."""
    found = packing.packed(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))
    return found.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"),
                        "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the fingerprints nor the tokens; the tests hold
#: every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
