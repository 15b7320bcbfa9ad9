"""A corpus pipeline: what quality rules keep, one of each near copy, no repeated passages, mixed and encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import minhash, mixing, piece_codec, quality, queries, suffix_radix
from matchloom.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.measures(docs.select(F.struct("*").alias("row"), "text"))
    return judged.where(~quality.base_failed() & quality.passes()).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the smallest id."""
    kept = minhash.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"))
    return rows.join(kept, F.col("_id") == F.col("_kept"), "left").where("_id IS NULL OR _kept IS NOT NULL").select("row.*")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_radix.removed_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.Mix(docs).documents()


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids to train on, with digests of the ids and of what they decode to."""
    return piece_codec.code(docs, queries.vocabulary("piece_bpe_32k.model"), keep=("ids",))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_dedup),
    ("repeated strings", suffix_dedup),
    ("mixing", mix_sources),
    ("piece encoding", encode_pieces),
]

#: No SQL says what the mix draws or how pieces are encoded; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each reads the Parquet table that the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
