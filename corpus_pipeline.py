"""The corpus pipeline: language ID, near-duplicates, benchmark passages, mixing to target weights, shards.

Each stage is a function of (spark, docs, sf_dir). What it returns is written as Parquet and read again as the next
stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, hash_ring, language_id, mixing, simhash
from factloom.llm.common import cut

SHARDS = 40


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learnt; texts without a letter, null and empty ones are rejected, and foreign ones.

    Every row is judged by its text alone, so repeated rows stay or go alike.
    """
    return language_id.in_known_language(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates (five-word shingles, similarity 0.8).

    Null and blank texts are one group; null ids come after all others; a repeated row stays once.
    """
    return simhash.without_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    hits = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaked = hits.select(F.col("doc_id").alias("__leaked")).distinct()
    return docs.join(leaked, F.col("doc_id").eqNullSafe(F.col("__leaked")), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A document whose words are taken r times over comes floor(r) times and, with the probability of the rest of r (by
    its hash), once more; so each source has its target's words on the whole, and what the mix leaves out is gone.
    """
    taken = mixing.mix(docs).where("taken > 0").selectExpr("doc_id", "taken / size AS r", "size AS __size")
    copies = taken.groupBy("doc_id", "__size").agg(F.max("r").alias("r")).selectExpr("doc_id AS __doc_id", "__size", "CAST(floor(r) + IF(pmod(xxhash64('copies', doc_id), 1000003) / 1000003 < r - floor(r), 1, 0) AS INT) AS __copies").where("__copies > 0")
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (mixing.word_count(F.col("text")) == F.col("__size"))
    return docs.join(copies, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot."""
    return hash_ring.assign(docs, "doc_id", SHARDS)


STAGES = [("language_id", identified), ("simhash_dedup", deduplicated), ("decontaminate", decontaminated), ("mix", mixed), ("shard", sharded)]

#: SQL cannot express language ID, min-hash candidates or keyed permutations; tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what passes from stage to stage is written to the session's shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
