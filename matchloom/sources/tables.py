"""Readers of record tables, gold lists, score tables and vectors."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import FLOOR

RECORD = ["entity_id", "business_name", "business_address", "country"]
GOLD = ["source1_entity_id", "matched_entity_ids"]
#: Names under which score parts of a kind may lie; earlier ones win.
SCORE_PATTERNS = ("ce_{kind}_part*.parquet", "ce_{kind}_contested_part*.parquet", "{kind}_part*.parquet")


def read_tsv(spark: SparkSession, path: str, columns: list[str], usecols: list[str] | None = None, quote: str = '"', lines: bool = False) -> DataFrame:
    """A table with a header, all strings; an empty field is an empty string. quote='' takes quotes as they stand.

    With lines, file_at and line_at put the rows in the file's order.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).options(sep="\t", header=True, quote=quote, escape=quote or "\\").csv(path)
    place = [F.col("_metadata.file_block_start").alias("file_at"), F.monotonically_increasing_id().alias("line_at")] if lines else []
    return df.select(*(usecols or columns), *place).fillna("", usecols or columns)


def load_sources(spark: SparkSession, data_dir: str, split: str) -> tuple[DataFrame, DataFrame]:
    """Primary records, and the pool: sources 2 and 3 with their number."""
    read = lambda k: read_tsv(spark, f"{data_dir}/{split}/{split}_source{k}.tsv", RECORD).withColumn("source", F.lit(k).cast("byte"))
    return read(1), read(2).unionByName(read(3))


def load_gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Gold pairs, and the ids of all primary records (those without a match are in the second only)."""
    raw = read_tsv(spark, path, GOLD)
    ids = F.filter(F.split("matched_entity_ids", ","), lambda x: x != "")
    return raw.select(F.col("source1_entity_id").alias("s1_id"), F.explode(ids).alias("pool_id")), raw.select(F.col("source1_entity_id").alias("s1_id"))


def resolved(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Pairs both of whose ids are known records."""
    a, b = s1.select(F.col("entity_id").alias("s1_id")), pool.select(F.col("entity_id").alias("pool_id"))
    return pairs.join(a, "s1_id", "left_semi").join(b, "pool_id", "left_semi")


def load_normalized(spark: SparkSession, directory: str, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    read = lambda k: spark.read.parquet(f"{directory}/s{k}.parquet")
    pick = lambda df: df.select(*columns) if columns else df
    return pick(read(1)), pick(read(2).unionByName(read(3)))


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return bool(found)


def load_scores(spark: SparkSession, directory: str, kind: str, patterns=SCORE_PATTERNS, score: str = "ce_prob") -> DataFrame | None:
    """Score parts of a kind; a pair found under several names counts once, by the earliest. None if there is no file."""
    from ..operators.blends import first_of

    tables = [spark.read.parquet(p).select("s1_id", "pool_id", score) for p in (f"{directory}/{x.format(kind=kind)}" for x in patterns) if _exists(spark, p)]
    return first_of(tables) if tables else None


def read_pairs(spark: SparkSession, pattern: str) -> DataFrame:
    """Scored pairs at or over the floor (the filter reaches the files), their score as lgbm_prob."""
    df = spark.read.parquet(pattern)
    score = "prob" if "prob" in df.columns else "lgbm_prob"
    return df.where(F.col(score) >= FLOOR).withColumnRenamed(score, "lgbm_prob")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids in the first column of a table, header and blank lines left out."""
    lines = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    first = F.trim(F.col(f"`{lines.columns[0]}`"))
    return lines.select(first.alias("id")).where("id <> ''").distinct()


def match_targets(spark: SparkSession, directory: str) -> DataFrame | None:
    """Ids of both pool sources, or None if one of them is missing."""
    paths = [f"{directory}/test_source{k}.tsv" for k in (2, 3)]
    if not all(_exists(spark, p) for p in paths):
        return None
    return read_ids(spark, paths[0]).union(read_ids(spark, paths[1])).distinct().withColumnRenamed("id", "pool_id")


def read_config(path: str) -> dict:
    """A JSON or, where the parser is installed, YAML file."""
    with open(path, encoding="utf-8") as file:
        if path.endswith((".yaml", ".yml")):
            import yaml

            return yaml.safe_load(file)
        return json.load(file)
