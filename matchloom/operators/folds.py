"""Samples, folds and batches that come out alike on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scores import fold
from ..functions.text import last_two


def hashed(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def sample(df: DataFrame, n: int, key: str = "s1_id", seed: int = 42) -> DataFrame:
    """n rows, those with the least hashes of their key."""
    return df.withColumn("_h", hashed(F.col(key), seed)).orderBy("_h", key).limit(n).drop("_h")


def fraction(df: DataFrame, share: float, key: str = "s1_id", seed: int = 42) -> DataFrame:
    """About a share of the rows; smaller shares are within larger ones."""
    u = F.conv(F.substring(hashed(F.col(key), seed), 1, 8), 16, 10).cast("double") / 2**32
    return df.where(u < share)


def with_fold(df: DataFrame, n: int = 5, key: str = "s1_id") -> DataFrame:
    return df.withColumn("fold", fold(F.col(key), n))


def halves(df: DataFrame, key: str = "s1_id") -> tuple[DataFrame, DataFrame]:
    """The two halves of fold 0 that cross-fitting uses."""
    return df.where(fold(F.col(key), 10) == 0), df.where(fold(F.col(key), 10) == 5)


def leave_out(df: DataFrame, value: str, key: str = "country") -> tuple[DataFrame, DataFrame]:
    """Rows of all other values of the key, and rows of this one; rows without a value are in neither."""
    return df.where(F.col(key) != value), df.where(F.col(key) == value)


def training_pairs(gold: DataFrame, rounds: int = 3, seed: int = 42) -> DataFrame:
    """Up to `rounds` gold pairs of each record outside the validation fold, in hash order."""
    order = W.partitionBy("s1_id").orderBy(hashed(F.concat_ws("|", "s1_id", "pool_id"), seed), "pool_id")
    return gold.where(fold(F.col("s1_id"), 5) != 0).withColumn("round", F.row_number().over(order)).where(F.col("round") <= rounds)


def area_batches(pairs: DataFrame, size: int, block: str = "country", text: str = "text", seed: int = 42) -> DataFrame:
    """Batches of one block, neighbours in area order, each primary record once in a batch; incomplete ones go.

    Repeats of a record are put in rounds of their own, so that no batch holds it twice. `turn` puts the batches in a
    random order that is the same on every run. A block is numbered by the beginnings of its areas: rows before each
    beginning, then the place within it.
    """
    rounds = pairs.withColumn("round", F.row_number().over(W.partitionBy("s1_id").orderBy("pool_id")))
    placed = rounds.withColumn("area", last_two(F.col(text))).withColumn("_head", F.left("area", F.lit(3)))
    group = [block, "round"]
    before = F.sum("_n").over(W.partitionBy(*group).orderBy("_head").rowsBetween(W.unboundedPreceding, -1))
    heads = placed.groupBy(*group, "_head").agg(F.count("*").alias("_n"))
    total = heads.groupBy(*group).agg(F.sum("_n").alias("_all"))
    heads = heads.withColumn("_before", F.coalesce(before, F.lit(0))).join(total, group)
    within = F.row_number().over(W.partitionBy(*group, "_head").orderBy("area", "s1_id")) - 1
    batch = placed.withColumn("_k", within).join(heads.select(*group, "_head", "_before", "_all"), [*group, "_head"])
    batch = batch.withColumn("batch", F.floor((F.col("_k") + F.col("_before")) / size)).where((F.col("batch") + 1) * size <= F.col("_all"))
    turn = hashed(F.concat_ws("|", F.col(block), "round", "batch"), seed)
    return batch.withColumn("turn", turn).drop("_head", "_k", "_before", "_all")


def hard_pairs(pairs: DataFrame, share: float = 0.1, floor: float = 0.001, seed: int = 42) -> DataFrame:
    """Positives, pairs at or over the floor, and a share of the rest."""
    pick = F.conv(F.substring(hashed(F.concat_ws("|", "s1_id", "pool_id"), seed), 1, 8), 16, 10).cast("double") / 2**32 < share
    return pairs.where((F.col("label") == 1) | (F.col("prob") >= floor) | pick)
