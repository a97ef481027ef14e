"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Production reads its key from the cluster's secret store; the registered queries use this one.
PII_KEY = "registered-queries"


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.pii import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op2_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op3_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.quality import judge

    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_sentencepiece_wfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.sentencepiece_wfst import encode

    return encode(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.llm.substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("left_text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """Sharding, packing and pseudonyms hang on hashes that DuckDB lacks, the rest on trained models or automata; tests cover those."""
    return {"op3_quality_cascade": sql.QUALITY, "op4_embedding_near_dedup": sql.EMBEDDINGS, "op8_minhash_near_dedup": sql.MINHASH, "op10_substring_dedup": sql.SUBSTRING}
