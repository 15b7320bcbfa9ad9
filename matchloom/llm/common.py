"""Shared pieces: the shared folder, written tables, skew-safe group joins, per-worker caches."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import forget, qualified, shared_dir, written  # noqa: F401

#: Hot groups are split over so many tasks at least before anything is joined to their rows.
SALTS = 64


def shuffle_tasks(spark: SparkSession) -> int:
    """Tasks of a shuffle whose rows are small but much work: a number that is given is not lowered for their size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salts(spark: SparkSession) -> int:
    """Over how many tasks a hot group is spread: as many as a shuffle has."""
    return max(SALTS, shuffle_tasks(spark))


def attach_group(df: DataFrame, keys: list[str], spread_by: list[str], **aggs: tuple) -> DataFrame:
    """Rows of df with aggregates of their group, without ever holding one group in one task.

    aggs: name=(partial, final), e.g. first=(F.min("x"), F.min). Groups are pre-aggregated by (keys, salt), then by
    keys; the result goes back once for each salt that the group has, so a hot group is joined in as many tasks as a shuffle has.
    Rows with a null key are dropped: callers keep them apart.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts(df.sparkSession))).cast("int"))
    part = salted.groupBy(*keys, "_salt").agg(*[p.alias(n) for n, (p, _) in aggs.items()])
    whole = part.groupBy(*keys).agg(*[f(n).alias(n) for n, (_, f) in aggs.items()], F.collect_list("_salt").alias("_salts"))
    back = whole.select(*keys, *aggs, F.explode("_salts").alias("_salt"))
    return salted.join(back, [*keys, "_salt"]).drop("_salt")


def worker_cache(name: str, make=dict):
    """An object kept by a Python worker; it outlasts tasks, which unpickle their functions anew.

    A worker keeps one such object at a time (besides one set of powers): an operator's tables go when the next
    operator's work begins, so that a job of many operators needs no more memory than its largest.
    """
    home = sys.modules.setdefault("_matchloom_worker", types.ModuleType("_matchloom_worker"))
    if name != "powers":
        for other in [k for k in vars(home) if not k.startswith("__") and k not in (name, "powers")]:
            delattr(home, other)
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def key_runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list[np.ndarray], bool, int]]:
    """Sorted batches as (columns, long, given): whole runs of equal values of the first column. A run of more than
    `limit` rows comes by itself, in pieces (long) of which `given` rows have come before."""
    held: list[np.ndarray] | None = None
    long_key, given = None, 0
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(c) for c in zip(held, columns)]
        held = None
        if long_key is not None and len(columns[0]):
            end = int(np.searchsorted(columns[0], long_key, side="right"))
            if end:
                yield [c[:end] for c in columns], True, given
                given += end
            columns = [c[end:] for c in columns]
            if len(columns[0]):
                long_key = None
        if not len(columns[0]):
            continue
        begin = int(np.searchsorted(columns[0], columns[0][-1]))
        if begin:
            yield [c[:begin] for c in columns], False, 0
        columns = [c[begin:] for c in columns]
        if len(columns[0]) > limit:
            long_key, given = columns[0][-1], len(columns[0])
            yield columns, True, 0
        else:
            held = columns
    if held is not None:
        yield held, False, 0


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every `width` neighbours, by doubling."""
    n, have = len(x) - width + 1, 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x[:n] if have == width else np.minimum(x[:n], x[width - have :][:n])


def word_list(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, in order; null gives none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(spaced, " "), "")
