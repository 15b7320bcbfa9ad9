"""Where a pair stands among its rivals: windows over all pairs of a primary record, or of a pool record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scores import FLOOR


def rank_and_gap(df: DataFrame, key: str, score: str, prefix: str) -> DataFrame:
    """Rank of a score in its group (ties share the best rank) and its distance to the best."""
    group = W.partitionBy(key)
    return df.withColumn(f"{prefix}_rank_{score}", F.rank().over(group.orderBy(F.desc(score)))).withColumn(f"{prefix}_gap_{score}", F.max(score).over(group) - F.col(score))


def global_context(cands: DataFrame, scores=("tok_score", "emb_score")) -> DataFrame:
    """Counts on both sides and the pool record's view of each score, over all primary records."""
    out = cands.withColumn("n_cands_s1", F.count("*").over(W.partitionBy("s1_id"))).withColumn("n_s1_per_cand", F.count("*").over(W.partitionBy("pool_id")))
    for s in scores:
        if s in cands.columns:
            out = rank_and_gap(out, "pool_id", s, "cand")
    return out


def score_context(df: DataFrame, score: str, prefix: str, key: str = "s1_id", tie: str = "pool_id") -> DataFrame:
    """rank (ties by id), gap, max, sum, count over one half, and second best (0 if alone) of a score in its group."""
    group = W.partitionBy(key)
    df = df.withColumn(f"{prefix}_rank", F.row_number().over(group.orderBy(F.desc(score), tie)))
    best, second = F.max(score).over(group), F.max(F.when(F.col(f"{prefix}_rank") == 2, F.col(score))).over(group)
    return df.withColumns(
        {
            f"{prefix}_max": best,
            f"{prefix}_gap": best - F.col(score),
            f"{prefix}_sum": F.sum(score).over(group),
            f"{prefix}_n50": F.sum((F.col(score) > 0.5).cast("int")).over(group),
            f"{prefix}_second": F.coalesce(second, F.lit(0.0)),
        }
    )


def pool_context(all_pairs: DataFrame, df: DataFrame, score: str = "prob", floor: float = FLOOR) -> DataFrame:
    """Rivalry for a pool record, judged over all_pairs: how many pairs, the best other one, the margin, whether on top.

    Only the two best rows of a pool record are ranked: all but two of each task's are left out before the shuffle.
    """
    rivals = all_pairs.where(F.col(score) >= floor).select("pool_id", score)
    best = rivals.withColumn("_r", F.row_number().over(W.partitionBy("pool_id").orderBy(F.desc(score)))).where("_r <= 2")
    best = best.groupBy("pool_id").agg(F.max(F.when(F.col("_r") == 1, F.col(score))).alias("_first"), F.max(F.when(F.col("_r") == 2, F.col(score))).alias("_second"))
    known = rivals.groupBy("pool_id").agg(F.count("*").alias("_n")).join(best, "pool_id")
    out = df.join(known, "pool_id", "left")
    first = F.col("_first")
    other = F.when(first.isNull(), F.lit(None).cast("double")).when(F.col(score) >= first, F.coalesce("_second", F.lit(0.0))).otherwise(first)
    out = out.withColumn("pool_n", F.coalesce("_n", F.lit(1))).withColumn("pool_best_other", other)
    out = out.withColumn("pool_margin", F.col(score) - F.col("pool_best_other")).withColumn("pool_is_top", F.coalesce((F.col(score) >= first).cast("int"), F.lit(0)))
    return out.drop("_n", "_first", "_second")
