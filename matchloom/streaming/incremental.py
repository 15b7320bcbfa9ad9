"""Batches that arrive one after another: only what is new is computed, then appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def missing(pairs: DataFrame, cached: DataFrame | None) -> DataFrame:
    keys = ["s1_id", "pool_id"]
    return pairs.select(*keys).distinct() if cached is None else pairs.select(*keys).distinct().join(cached.select(*keys), keys, "left_anti")


def extend_cache(spark: SparkSession, pairs: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cache at path, after the pairs that it lacked were computed and appended."""
    from ..sources.tables import _exists

    cached = spark.read.parquet(path) if _exists(spark, path) else None
    compute(missing(pairs, cached)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def follow(stream: DataFrame, path: str, checkpoint: str, compute: Callable[[DataFrame], DataFrame]):
    """A query over a stream of pairs that keeps the cache at path complete; ends when what is there is done."""

    def batch(df: DataFrame, epoch: int) -> None:
        extend_cache(df.sparkSession, df, path, compute)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
