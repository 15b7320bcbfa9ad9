"""Writers of answers, stage tables and logs."""

from __future__ import annotations

import json
import subprocess
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_rows(lists: DataFrame, dimension: DataFrame, column: str) -> DataFrame:
    """One row for each primary record: its ids without repeats, in order, joined by commas; none gives an empty field."""
    ids = F.array_join(F.array_distinct("ids"), ",")
    return dimension.join(lists.select("s1_id", ids.alias("_l")), "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce("_l", F.lit("")).alias(column), *[c for c in dimension.columns if c != "s1_id"])


def write_lists(lists: DataFrame, dimension: DataFrame, path: str, column: str, order=("seq",), single: bool = False) -> None:
    """list_rows as a TSV directory in the order of dimension's columns `order`: parts in order, or one file."""
    rows = list_rows(lists, dimension, column).orderBy(*order).select("source1_entity_id", column)
    (rows.coalesce(1) if single else rows).write.mode("overwrite").options(sep="\t", header=True, quote="", emptyValue="").csv(path)


def write_answer(matches: DataFrame, candidates: DataFrame, dimension: DataFrame, directory: str, extra: DataFrame | None = None, order=("seq",), single: bool = False) -> dict:
    """Match and candidate lists, matches kept within the candidates; returns shares of what was written.

    extra: further candidates (s1_id, pool_id), listed after the others.
    """
    pairs, spark = ["s1_id", "pool_id"], matches.sparkSession
    rank = F.col("best_rank") if "best_rank" in candidates.columns else F.lit(0)
    listed = candidates.select(*pairs, rank.cast("long").alias("p"))
    if extra is not None:
        listed = listed.union(extra.select(*pairs, F.lit(2**40).alias("p"))).groupBy(*pairs).agg(F.min("p").alias("p"))
    kept = matches.join(listed.select(*pairs), pairs, "left_semi")
    score = F.negative("prob") if "prob" in kept.columns else F.lit(0.0)
    in_order = lambda df, by: df.groupBy("s1_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(by.alias("p"), "pool_id"))), lambda x: x["pool_id"]).alias("ids"))
    write_lists(in_order(kept, score), dimension, f"{directory}/matching_results.tsv", "matched_entity_ids", order, single)
    write_lists(in_order(listed, F.col("p")), dimension, f"{directory}/candidate_pairs.tsv", "candidate_entity_ids", order, single)
    written = spark.read.schema("id string, ids string").options(sep="\t", header=True, quote="").csv(f"{directory}/matching_results.tsv")
    n_ids = F.when(F.coalesce("ids", F.lit("")) == "", 0).otherwise(F.size(F.split("ids", ",")))
    n, m, k = written.agg(F.count("*"), F.count_if(n_ids > 0), F.coalesce(F.sum(n_ids), F.lit(0))).first()
    return {"records": n, "empty": 1 - m / n if n else 0.0, "matches_per_record": k / n if n else 0.0}


def write_stage(df: DataFrame, path: str, by: str | None = None) -> None:
    """A stage's table; with `by`, rows of a key stay in one file."""
    (df.repartition(by) if by else df).write.mode("overwrite").parquet(path)


def revision() -> str:
    """The short name of the commit that is checked out, empty where there is none."""
    try:
        return subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return ""


def append_log(spark, path: str, change: str, blocking_recall: float | None = None, val_macro_f05: float | None = None, loco_f05: float | None = None, notes: str = "") -> None:
    """A row of metrics added to a log table."""
    row = (time.strftime("%Y-%m-%dT%H:%M"), revision(), change, blocking_recall, val_macro_f05, loco_f05, notes)
    schema = "timestamp string, git_hash string, change string, blocking_recall double, val_macro_f05 double, loco_f05 double, notes string"
    spark.createDataFrame([row], schema).write.mode("append").option("ignoreNullFields", "false").json(path)


def write_note(spark, path: str, **values) -> None:
    """A line of JSON about what lies beside it, on whatever file system the path names."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
