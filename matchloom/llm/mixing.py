"""Mixing sources to target weights in fixed-length blocks of words."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import word_list, written

#: Words of a block; slots of an output shard on average at least; the most output shards, a parameter of the mix;
#: sources that may be broadcast; slots that are filled at once.
BLOCK_WORDS, SHARD_SLOTS, MOST_SHARDS, MOST_SOURCES, CHUNK = 64, 1024, 1024, 100_000, 50_000
WEIGHTS = (5, 2, 1)


def targets(sizes: list[int], weights: list[int], share: Fraction = Fraction(3, 2), most: int = 2) -> list[Fraction]:
    """Each source's target: its weight's part of share * all words, at most `most` times its size.

    What the cap cuts off is shared again by weight among those below it, until none is above.
    """
    left, capped = share * sum(sizes), [False] * len(sizes)
    out = [Fraction(0)] * len(sizes)
    while True:
        free = sum(w for w, c in zip(weights, capped) if not c)
        over = []
        for i, (s, w) in enumerate(zip(sizes, weights)):
            if not capped[i]:
                out[i] = left * w / free
                if out[i] > most * s:
                    over.append(i)
        if not over:
            return out
        for i in over:
            capped[i], out[i] = True, Fraction(most * sizes[i])
            left -= out[i]


def shard_counts(quota: int, shards: int, seed: int, src: int) -> np.ndarray:
    """How many of a source's slots stand in each output shard: multinomial counts that add up to the quota.

    Shards thus hold multinomial counts of the sources, in proportion to the quotas, and each source is drawn by
    itself, wherever it is needed.
    """
    return np.random.default_rng([seed, src]).multinomial(quota, np.full(shards, 1 / shards))


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of index i in the pseudorandom permutation `key` of range(n): a Feistel network walked until it is in range."""
    bits = np.maximum(2, np.ceil(np.log2(np.maximum(n, 2).astype(np.float64) + 1)).astype(np.uint64))
    half = (bits + np.uint64(1)) // np.uint64(2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = i.astype(np.uint64), np.ones(len(i), bool)
    while todo.any():
        left, right, m = x[todo] >> half[todo], x[todo] & mask[todo], mask[todo]
        for step in range(6):
            z = right ^ (key[todo] + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64))
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & m)
        x[todo] = (left << half[todo]) | right
        todo = x >= n.astype(np.uint64)
    return x.astype(np.int64)


class Mix:
    """A mix of docs (doc_id, text, source): its sizes, targets, slots and what they take.

    Rows count one by one, repeated ids and null ids too. A null text has no words; a null source comes last in
    order. Equal runs give equal mixes: order in a source follows a hash of the id, then the id, the size and the
    text's hash. Source totals, one row for each source, come to the driver; nothing else does. most_shards bounds the
    number of output shards, and with it what a task draws for a source; beyond SHARD_SLOTS * most_shards slots
    shards grow instead.
    """

    def __init__(self, docs: DataFrame, block_words: int = BLOCK_WORDS, weights=WEIGHTS, share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 0, most_shards: int = MOST_SHARDS):
        self.docs, self.block = docs, block_words
        t = F.coalesce("text", F.lit(""))
        sized = docs.select("doc_id", "source", F.size(word_list(t)).cast("long").alias("size"), F.xxhash64("text").alias("th"))
        # Rows that agree in all are told apart by a count, so that joins stay one to one; those without words need none.
        # Those may be many, and stay apart as they were read.
        sized = sized.withColumn("id0", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("_apart", F.when(F.col("size") == 0, F.spark_partition_id()).otherwise(-1))
        one = W.partitionBy("id0", "th", "source", "_apart").orderBy("size")
        sized = sized.withColumn("k", F.when(F.col("size") > 0, F.row_number().over(one)).otherwise(0)).drop("_apart")
        self.sized = sized = written(sized, "sizes")
        rows = sized.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
        rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        self.names, self.sizes = [r["source"] for r in rows], [r["s"] for r in rows]
        self.targets = targets(self.sizes, [weights[i % len(weights)] for i in range(len(rows))], share, most)
        self.blocks = [-(-s // block_words) for s in self.sizes]
        quotas = [min(most * b, round(t * b / s)) if s else 0 for t, b, s in zip(self.targets, self.blocks, self.sizes)]
        self.quotas, self.seed = quotas, seed
        self.shards = max(1, min(most_shards, -(-sum(quotas) // SHARD_SLOTS)))
        spark = docs.sparkSession
        table = [(i, n, s, float(t)) for i, (n, s, t) in enumerate(zip(self.names, self.sizes, self.targets))]
        table = spark.createDataFrame(table, "src int, source string, source_size long, target double")
        self.sources = F.broadcast(table) if len(rows) <= MOST_SOURCES else table
        buckets = max(64, sum(r["n"] for r in rows) // 4000)
        known = sized.join(self.sources, sized["source"].eqNullSafe(self.sources["source"])).drop(self.sources["source"])
        known = known.withColumn("bucket", F.pmod(F.xxhash64("id0", "th"), F.lit(buckets)).cast("int"))
        totals = known.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
        before = F.sum("n").over(W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
        totals = totals.select("src", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
        within = F.sum("size").over(W.partitionBy("src", "bucket").orderBy("id0", "size", "th", "k").rowsBetween(W.unboundedPreceding, -1))
        self.placed = known.withColumn("start", F.coalesce(within, F.lit(0))).join(totals, ["src", "bucket"]).withColumn("start", F.col("start") + F.col("base"))

    def slots(self) -> DataFrame:
        """src, shard, slot (number in its source) and block: what stands in each slot of the mix."""
        shards, seed = self.shards, self.seed

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            drawn: tuple[int, np.ndarray] | None = None
            for batch in batches:
                for src, quota, blocks, low in zip(*[c.to_pylist() for c in batch.columns]):
                    if drawn is None or drawn[0] != src:
                        drawn = src, np.cumsum(shard_counts(quota, shards, seed, src))
                    slot = np.arange(low, min(low + CHUNK, quota))
                    n = np.full(len(slot), blocks)
                    key = np.uint64(src << 32) + (slot // blocks).astype(np.uint64) + np.uint64(seed * 0xD6E8FEB86659FD93 % 2**64)
                    columns = np.full(len(slot), src, np.int32), np.searchsorted(drawn[1], slot, side="right"), slot, permuted(slot % blocks, n, key)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["src", "shard", "slot", "block"])

        rows = [(i, q, b) for i, (q, b) in enumerate(zip(self.quotas, self.blocks)) if q]
        chunks = self.docs.sparkSession.createDataFrame(rows, "src int, quota long, blocks long")
        chunks = chunks.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1, F.lit(CHUNK).cast("long"))))
        tasks = max(1, min(100_000, sum(-(-q // CHUNK) for q in self.quotas)))
        return chunks.repartition(tasks, "src", "low").sortWithinPartitions("src", "low").mapInArrow(fill, "src int, shard long, slot long, block long")

    def pieces(self) -> DataFrame:
        """The rows' parts by block: src, block, id0, th, k, from_word, n_words."""
        b = F.lit(self.block)
        parts = self.placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
        low = F.greatest(F.col("block") * b, F.col("start"))
        high = F.least((F.col("block") + 1) * b, F.col("start") + F.col("size"))
        return parts.select("src", "block", "id0", "th", "source", "k", (low - F.col("start")).alias("from_word"), (high - low).alias("n_words"))

    def taken_pieces(self) -> DataFrame:
        """pieces() with times, how often the mix takes each; those that it never takes are left out."""
        times = self.slots().groupBy("src", "block").agg(F.count("*").alias("times"))
        # The blocks come from a small table of sources, by whose size this join must not be planned.
        return self.pieces().join(times.hint("merge"), ["src", "block"])

    def report(self) -> DataFrame:
        """doc_id, source, size, source_size, target, taken for every row."""
        took = self.taken_pieces().groupBy("id0", "th", "src", "k").agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"))
        known = self.sized.join(self.sources, self.sized["source"].eqNullSafe(self.sources["source"])).drop(self.sources["source"])
        return known.join(took, ["id0", "th", "src", "k"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def documents(self) -> DataFrame:
        """The mix as documents with the columns of docs: each row's taken words, a second time where taken twice.

        Runs of words keep the white space between them as the text has it; runs are joined by a line break. Rows of
        which the mix takes nothing are left out.
        """
        docs, columns = self.docs, self.docs.columns
        at, length = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else -1
        parts = self.taken_pieces().groupBy("id0", "th", "source", "k").agg(F.collect_list(F.struct("from_word", "n_words", "times")).alias("parts"))
        parts = parts.select("id0", "th", F.coalesce("source", F.lit("")).alias("s"), F.isnull("source").alias("n"), "k", "parts")
        # The rows travel as one column, so that no name of theirs meets one of ours.
        row, c = F.struct("*").alias("row"), F.col
        keyed = docs.select(row, F.coalesce(c("doc_id").cast("long"), F.lit(-(2**63))).alias("id0"), F.xxhash64("text").alias("th"), F.coalesce("source", F.lit("")).alias("s"), F.isnull("source").alias("n"))
        keyed = keyed.where(F.col("row.text").rlike(r"[^\x20\x09-\x0d]")).withColumn("k", F.row_number().over(W.partitionBy("id0", "th", "s", "n").orderBy("row.text")))
        schema = docs.schema

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import re

            words = re.compile(rb"[^\x20\x09-\x0d]+")
            for batch in batches:
                texts, chars = [], []
                for text, parts in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist()):
                    raw = text.encode()
                    places = [m.span() for m in words.finditer(raw)]
                    runs: list[bytes] = []
                    for time in range(max(p["times"] for p in parts)):
                        end = -1
                        for p in sorted((p for p in parts if p["times"] > time), key=lambda p: p["from_word"]):
                            first, last = p["from_word"], p["from_word"] + p["n_words"]
                            if first == end:
                                start = runs.pop()[1]
                            else:
                                start = places[first][0]
                            runs.append((raw[start : places[last - 1][1]], start))
                            end = last
                    done = b"\n".join(r[0] for r in runs).decode()
                    texts.append(done)
                    chars.append(len(done))
                arrays = list(batch.columns[: len(columns)])
                arrays[at] = pa.array(texts, arrays[at].type)
                if length >= 0:
                    arrays[length] = pa.array(chars, arrays[length].type)
                yield pa.RecordBatch.from_arrays(arrays, columns)

        return keyed.join(parts, ["id0", "th", "s", "n", "k"]).select("row.*", F.col("parts").alias("parts of the mix")).mapInArrow(cut, schema)
