"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_group, salts, written

#: A local contraction holds this many links at most before it gives out what it has.
LOCAL_LINKS = 2_000_000
#: So few links, at most, are joined by one task at last (some 100 MB); more take rounds of shuffles until they are.
LAST_LINKS = 250_000


def _contracted(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The nodes of a partition's links and the smallest node of each one's local component, over `most` nodes at a time."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    def found() -> tuple[np.ndarray, np.ndarray]:
        nodes = np.fromiter(parent, np.int64, len(parent))
        return nodes, np.fromiter(map(root, nodes.tolist()), np.int64, len(nodes))

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if most and len(parent) > most:
            yield found()
            parent.clear()
    if parent:
        yield found()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition as stars around the smallest node of each local component."""
    for nodes, roots in _contracted(batches, LOCAL_LINKS):
        hang = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(roots[hang]), pa.array(nodes[hang])], ["a", "b"])


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and component of all links, which are one partition."""
    for found in _contracted(batches, None):
        yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), ["node", "component"])


def _nodes(links: DataFrame) -> DataFrame:
    """node, low and high (its least and greatest neighbours below it), above (a link has it as its lower end)."""
    uppers = links.select(F.col("b").alias("node"), F.col("a").alias("below"), F.lit(False).alias("above"))
    ends = uppers.union(links.select("a", F.lit(None).cast("long"), F.lit(True)))
    return ends.groupBy("node").agg(F.min("below").alias("low"), F.max("below").alias("high"), F.max("above").alias("above"))


def _round(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """A large-star step, then a small-star step; links are (a, b) with a < b, nodes are theirs."""
    # Upper ends go to the least neighbour of the lower one, which is below it or itself; a node of many links is spread.
    salted = links.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(salts(links.sparkSession))).cast("int"))
    moved = salted.select("a", "_salt").distinct().join(nodes.where("above AND low IS NOT NULL").select(F.col("node").alias("a"), "low"), "a")
    large = salted.join(moved, ["a", "_salt"], "left").select(F.col("b").alias("u"), F.coalesce("low", "a").alias("v"))
    down = attach_group(large, ["u"], ["v"], m=(F.min("v"), F.min))
    to_least = down.select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b"))
    return to_least.where("a < b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node reachable) for every node of a link table.

    Self links and null ends are ignored; repeated and reversed links count once. An empty table gives no rows.
    The table that tells whether links are left to move is also what the next round looks up, and at last the result.
    Links are contracted where they are read, so those that are costly to make should be written before; once they are
    LAST_LINKS at most, one task gives the result, since rounds over so few are nothing but tasks that start.
    """
    ordered = links.select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    ) if (a, b) != ("a", "b") else links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"))
    now = written(ordered.mapInArrow(_forest, "a long, b long"), "stars")
    while now.count() > LAST_LINKS:
        nodes = written(_nodes(now), "nodes")
        # nothing changes once every node hangs on a root alone: no a is also some b, and no b has two a
        if not nodes.where("low < high OR (above AND low IS NOT NULL)").limit(1).count():
            return nodes.select("node", F.coalesce("low", "node").alias("component"))
        now = written(_round(now, nodes), "stars")
    return written(now.coalesce(1).mapInArrow(_tree, "node long, component long"), "tree")
