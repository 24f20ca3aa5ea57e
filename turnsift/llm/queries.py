"""The registered queries of this subpackage and, where DuckDB can express them, SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .jaccard_join import link_documents
from .merkle import prove_documents
from .oracles import ORACLE_SQL  # noqa: F401  read by the entry module
from .packing import pack_documents
from .pii import find_personal_data
from .preference import format_pairs, pairs_from_turns
from .sharding import shard_documents
from .simhash import RADIUS, fingerprint_documents
from .simhash_join import near_documents
from .substring_dedup import dedup_substrings
from .suffix_dedup import dedup_suffixes
from .toxicity import score, train
from .vector_codes import compress_vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(_table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"), shards=8)


def op3_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_pairs(pairs_from_turns(_table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["stop"])), ",")
    return out.select("pair_id", "n_prompt_turns", "prompt", "chosen", spans("chosen_mask").alias("chosen_mask"), "rejected", spans("rejected_mask").alias("rejected_mask"))


def tokenizer_files() -> dict:
    """Where the public tokenizer files are; installed beside the library."""
    import public_tokenizers

    return {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), capacity=1024, end_id=2, **tokenizer_files())


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(_table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


TOXIC = 0.5


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = score(docs, train(docs, _table(spark, sf_dir, "labels")))
    return out.withColumn("toxic", F.col("p_toxic") >= TOXIC)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_suffixes(_table(spark, sf_dir, "documents"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(_table(spark, sf_dir, "documents"), radius=RADIUS)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal_data(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prove_documents(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compress_vectors(_table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "code", "error", "label_error", F.sha2(F.col("books").cast("binary"), 256).alias("codebooks_sha256"))


def op13_simhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_sharding": op2_sharding,
    "op3_preference": op3_preference,
    "op4_packing": op4_packing,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_simhash": op9_simhash,
    "op10_pii": op10_pii,
    "op11_merkle": op11_merkle,
    "op12_vector_codes": op12_vector_codes,
    "op13_simhash_join": op13_simhash_join,
}
