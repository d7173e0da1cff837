"""The registered ``opN_<name>`` queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portrisk.llm import (chat, cuckoo, importance, lsh, mixing, packing, prefix_tokens, quality, repair,
                          secret_scan, simhash, templates, toxicity)
from portrisk.llm.common import held_out, prepare


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: 4-word shingles, radius 4."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, radius=4, seed=42)
    return found.select(F.col("id").alias("doc_id"),
                        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest vectors found for every 20th vector by cross-polytope hashing."""
    found = lsh.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by non-negative positive-unlabelled learning; threshold 0.7."""
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.scored(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", "predicted")


def op4_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages after deleting their sites' templates."""
    found = templates.main_texts(_table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents from prefix counts, and whether they exceed 4096."""
    found = prefix_tokens.token_counts(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens",
                        (F.col("n_tokens") > 4096).alias("over_limit"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by a byte-level convolutional network; threshold 0.5."""
    docs = _table(spark, sf_dir, "documents")
    found = quality.scored(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", "predicted")


def op7_cuckoo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicate groups of all documents by a cuckoo-filter index of their digests."""
    found = cuckoo.exact_groups(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                        F.lower(F.hex("digest")).alias("text_sha256"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings, formatted and read back."""
    tricky = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)],
                                 "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    files = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")
    found = chat.digests(chat.read_back(chat.formatted(turns, *files), *files))
    return found.withColumnRenamed("conv", "conv_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document when sources are mixed 5 : 2 : 1, 3 copies at most."""
    plan = mixing.mix_plan(_table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                       (F.col("size") * F.col("copies")).alias("taken"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces packed into sequences of 1024 tokens at most."""
    found = packing.packed(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"),
                           vocabulary("byte_bpe_50k.tiktoken"))
    return found.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"),
                        "sequence_id", "offset")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights of all documents toward ``benchmark``, and the 5 in 100 drawn by them."""
    found = importance.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, in their texts and in encoded layers of them."""
    found = secret_scan.secrets(_table(spark, sf_dir, "documents"))
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(F.col("id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in secret_scan.KINDS],
                        F.sha2(told("base"), 256).alias("base_sha256"), told("found").alias("spans"))


def op13_audit_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest audits that repair all conversations after their rows were damaged."""
    turns = _table(spark, sf_dir, "conversations")
    return repair.report(repair.damaged(turns), turns).withColumnRenamed("id", "conv_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_cross_polytope": op2_cross_polytope,
    "op3_toxicity": op3_toxicity,
    "op4_templates": op4_templates,
    "op5_prefix_tokens": op5_prefix_tokens,
    "op6_quality": op6_quality,
    "op7_cuckoo": op7_cuckoo,
    "op8_chat": op8_chat,
    "op9_mixing": op9_mixing,
    "op10_packing": op10_packing,
    "op11_importance": op11_importance,
    "op12_secret_scan": op12_secret_scan,
    "op13_audit_dp": op13_audit_dp,
}

SQL: dict[str, str] = {
    "op7_cuckoo": cuckoo.SQL,
    "op9_mixing": mixing.SQL,
    "op11_importance": importance.SQL,
    "op13_audit_dp": repair.SQL,
}
