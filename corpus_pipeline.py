"""Quality rules, near-dedup, substring dedup, pseudonyms and packing, one after the other over ``documents``.

In every stage but the last a row goes whole or stays with all its columns; only
text and n_chars change.  A null or empty text has no words, so the quality rules
reject it; stages that are given one leave it as it is.  Rows that share an id are
one document: they stay or go together, and take no passages from each other.  A
row with a null id is no copy of any other.  Repeated rows are treated alike.  A
table without rows gives none at any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import minhash, packing, pii, quality, substring
from tidelog.llm.common import drop, written
from tidelog.llm.queries import PII_KEY


def _like(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` with the columns of ``docs``; n_chars follows the text."""
    kind = dict(docs.dtypes)
    if "n_chars" in kind:
        changed = changed.withColumn("n_chars", F.length("text").cast(kind["n_chars"]))
    return changed.select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the cascade reject go."""
    return quality.sieve(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents lose the passages that an earlier one has; those without any stay as they are."""
    carry = [c for c in docs.columns if c not in ("doc_id", "text")]
    return _like(docs, substring.remove_repeats(docs, carry=carry).withColumnRenamed("left_text", "text"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _like(docs, pii.pseudonymise(docs, PII_KEY))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("MinHash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("PII pseudonyms", pseudonyms), ("best-fit packing", best_fit_packing)]
#: Signatures and packing can't be told in SQL; the tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        made = written(stage(spark, docs, sf_dir))
        drop(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
