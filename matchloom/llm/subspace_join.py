"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c are 2 - 2 c apart in squared distance. Rotated and cut into blocks of few dimensions, a pair
within that distance keeps within a block's proportional part of it in one block at least. Each block is range-joined
alone, on a grid over its first two dimensions. Rotated vectors travel as whole numbers, so that all comparisons of
distances are exact and come out alike in every block: a pair counts in the first block that it keeps within. There the
whole rounded vectors settle it, but for the few pairs so near the threshold that rounding might tell; those are
verified on the whole vectors in doubles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_group, salts, written
from .components import components

#: Dimensions of a block, rows that are compared at once, pairs that are settled at once.
BLOCK_DIMS, TILE, PAIRS = 8, 4096, 1 << 16
#: Rows of a grid cell that one task compares with each other; larger cells are dealt to tiles.
CELL_ROWS = 16_384
#: Whole numbers that stand for 1.
SCALE = 32767


@cache
def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation: it spreads differences evenly over all blocks."""
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def block_bounds(dims: int) -> list[tuple[int, int]]:
    cuts = np.linspace(0, dims, max(1, dims // BLOCK_DIMS) + 1).astype(int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dims, d1, d2 (a digest of the vector), unit (doubles as bytes; null if it links with nothing) and q
    (the rotated unit vector in whole numbers)."""
    schema = "vec_id long, label string, dims int, d1 long, d2 long, unit binary, q binary"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for vector, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                row = (0, 0, 0, None, None)
                if label is not None and vector and None not in vector:
                    x = np.array(vector, dtype=np.float64)
                    with np.errstate(over="ignore", invalid="ignore"):
                        top = np.abs(x).max()
                        if np.isfinite(top) and top > 0:
                            y = x / top
                            digest = np.frombuffer(xxhash.xxh3_128_digest((x + 0.0).tobytes()), np.int64)
                            unit = y / np.sqrt(y @ y)
                            turned = np.rint(rotation(len(x)).T @ unit * SCALE).astype(np.int16)
                            row = (len(x), int(digest[0]), int(digest[1]), unit.tobytes(), turned.tobytes())
                rows.append(row)
            if rows:
                kinds = pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], ["vec_id", "label", "dims", "d1", "d2", "unit", "q"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label")).mapInArrow(make, schema)


class Limits:
    """Squared distances in whole numbers. Rounding moves a vector by sqrt(dims) / 2 at most, and a pair by twice that."""

    def __init__(self, dims: int, cosine: float):
        far, move = np.sqrt(2 - 2 * cosine) * SCALE, np.sqrt(dims) + 1e-3
        self.bounds = block_bounds(dims)
        #: Reach of each block: no pair at or over cosine is farther apart in all of them.
        self.reach = [int(np.floor(far * np.sqrt((high - low) / dims) + np.sqrt(high - low) + 1e-3)) + 1 for low, high in self.bounds]
        self.sure, self.never = max(0.0, far - move) ** 2, (far + move) ** 2


def _cells(q: np.ndarray, limits: Limits, block: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's own cell of each vector, and (vector, x, y) of the cells after it where its partners may lie."""
    low, high = limits.bounds[block]
    r = limits.reach[block]
    axes = q[:, low : low + 2].astype(np.int64) if high - low > 1 else np.stack([q[:, low].astype(np.int64), np.zeros(len(q), np.int64)], axis=1)
    own = np.floor_divide(axes, 2 * r + 1)
    below, above = np.floor_divide(axes - r, 2 * r + 1), np.floor_divide(axes + r, 2 * r + 1)
    probes = []
    for x in (below[:, 0], own[:, 0], above[:, 0]):
        for y in (below[:, 1], own[:, 1], above[:, 1]):
            after = (x > own[:, 0]) | ((x == own[:, 0]) & (y > own[:, 1]))
            probes.append(np.stack([np.flatnonzero(after), x[after], y[after]], axis=1))
    return own, np.unique(np.concatenate(probes), axis=0)


KEYS = ["label", "dims", "block", "x", "y"]


def dealt(heads: DataFrame, cosine: float, own_only: bool = False) -> DataFrame:
    """label, dims, block, x, y, probe, id, size, q of heads (vec_id, label, dims, size, q): in each block a row for the
    vector's own cell, and probes for later cells within reach."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, dims, sizes = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            raw = batch.column(4)
            for d in np.unique(dims).tolist():
                here = np.flatnonzero(dims == d)
                q = np.frombuffer(b"".join(raw.take(pa.array(here)).to_pylist()), np.int16).reshape(-1, d)
                limits = Limits(d, cosine)
                for block in range(len(limits.bounds)):
                    own, probes = _cells(q, limits, block)
                    parts = [(here, own[:, 0], own[:, 1], False)]
                    if not own_only:
                        parts.append((here[probes[:, 0]], probes[:, 1], probes[:, 2], True))
                    for rows, x, y, probe in parts:
                        n = len(rows)
                        columns = [pa.array(labels[rows], pa.string()), pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, block, np.int32)), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32))]
                        if not own_only:
                            columns += [pa.array(np.full(n, probe)), pa.array(ids[rows]), pa.array(sizes[rows]), raw.take(pa.array(rows))]
                        yield pa.RecordBatch.from_arrays(columns, names)

    keys = "label string, dims int, block int, x int, y int"
    schema = keys if own_only else f"{keys}, probe boolean, id long, size long, q binary"
    names = [c.split()[0] for c in schema.split(", ")]
    return heads.select("vec_id", "label", "dims", "size", "q").mapInArrow(deal, schema)


def tiled(rows: DataFrame, heads: DataFrame, cosine: float) -> DataFrame:
    """Rows of dealt() with their tile (i, j) and slice: a cell of more than CELL_ROWS vectors has a tile for each two
    of its slices, so that one task compares CELL_ROWS with as many at most."""
    crowded = dealt(heads, cosine, own_only=True).groupBy(*KEYS).agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS)
    crowded = written(crowded.select(*KEYS, F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("slices")), "cells")
    zero = F.lit(0).cast("int")
    if not crowded.limit(1).count():
        return rows.select("*", zero.alias("slice"), zero.alias("i"), zero.alias("j"))
    rows = rows.join(crowded, KEYS, "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    place = lambda f: F.when(F.col("probe"), F.col("t")).otherwise(f("slice", "t"))
    return rows.withColumn("i", place(F.least)).withColumn("j", place(F.greatest)).drop("t", "slices")


class Cell:
    """The vectors of a tile: which pairs are links for sure, which cannot be told; sizes of partners, and a forest."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, q: np.ndarray, limits: Limits, block: int):
        self.ids, self.sizes, self.q, self.limits, self.block = ids, sizes.astype(np.float64), q.astype(np.float64), limits, block
        self.linked, self.root = np.zeros(len(ids)), np.arange(len(ids))
        self.open: list[np.ndarray] = []

    def meet(self, a: slice, b: slice, within: bool) -> None:
        """Compares rows a with rows b, or rows a with later ones among them."""
        low, high = self.limits.bounds[self.block]
        p, q = self.q[a, low:high], self.q[b, low:high]
        apart = (p * p).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * p @ q.T
        near = apart <= self.limits.reach[self.block] ** 2
        if within:
            near = np.triu(near, 1)
        i, k = np.nonzero(near)
        i, k = i + a.start, k + b.start
        for some in range(0, len(i), PAIRS):
            self.settle(i[some : some + PAIRS], k[some : some + PAIRS])

    def settle(self, i: np.ndarray, k: np.ndarray) -> None:
        parts = np.add.reduceat((self.q[i] - self.q[k]) ** 2, [low for low, _ in self.limits.bounds], axis=1)
        reach2 = np.array([r**2 for r in self.limits.reach])
        mine = (parts[:, : self.block] > reach2[: self.block]).all(axis=1)  # else an earlier block has the pair
        whole = parts.sum(axis=1)
        link, unsure = mine & (whole <= self.limits.sure), mine & (whole > self.limits.sure) & (whole <= self.limits.never)
        if unsure.any():
            self.open.append(np.stack([self.ids[i[unsure]], self.ids[k[unsure]]], axis=1))
        i, k = i[link], k[link]
        if not len(i):
            return
        n = len(self.ids)
        self.linked += np.bincount(i, self.sizes[k], n) + np.bincount(k, self.sizes[i], n)
        while True:  # both ends take the smaller root, roots follow theirs
            least = np.minimum(self.root[i], self.root[k])
            if (self.root[i] == least).all() and (self.root[k] == least).all():
                return
            for end in (i, k):
                np.minimum.at(self.root, self.root[end], least)
                np.minimum.at(self.root, end, least)
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up

    def told(self) -> Iterator[pa.RecordBatch]:
        """Rows a, b, n: with n > 0 the size of a's partners; with n = 0 a link of the forest; with n = -1 an open pair."""
        some, hung = np.flatnonzero(self.linked), np.flatnonzero(self.root != np.arange(len(self.root)))
        open_ = np.concatenate(self.open) if self.open else np.empty((0, 2), np.int64)
        a = np.concatenate([self.ids[some], self.ids[self.root[hung]], open_[:, 0]])
        b = np.concatenate([self.ids[some], self.ids[hung], open_[:, 1]])
        n = np.concatenate([self.linked[some].astype(np.int64), np.zeros(len(hung), np.int64), np.full(len(open_), -1)])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])


def _cell_tiles(own: list[tuple], probes: list[tuple], key: list, limits: Limits) -> Iterator[pa.RecordBatch]:
    """Compares a tile's own rows with each other (or slice i with slice j) and with its probes."""
    rows = sorted(own, key=lambda r: r[0]) + probes  # r: slice, id, size, q
    ids, sizes = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    cell = Cell(ids, sizes, np.frombuffer(b"".join(r[3] for r in rows), np.int16).reshape(len(rows), -1), limits, key[2])
    i, j = key[5], key[6]
    split, end = (sum(r[0] == i for r in own), len(own)) if i < j else (len(own), len(own))
    tiles = lambda low, high: [slice(k, min(k + TILE, high)) for k in range(low, high, TILE)]
    first = tiles(0, split)
    for n, x in enumerate(first):
        if i == j:
            cell.meet(x, x, True)
            for y in first[n + 1 :]:
                cell.meet(x, y, False)
        for y in tiles(split, end) + tiles(end, len(rows)):
            cell.meet(x, y, False)
    yield from cell.told()


def joined(heads: DataFrame, cosine: float) -> DataFrame:
    """Rows a, b, n as Cell.told() gives them, of all blocks and cells."""
    keys = [*KEYS, "i", "j"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, probes, limits = None, [], [], {}

        def give() -> Iterator[pa.RecordBatch]:
            if own and len(own) + len(probes) > 1:
                limits.setdefault(key[1], Limits(key[1], cosine))
                yield from _cell_tiles(own, probes, key, limits[key[1]])

        for batch in batches:
            for *at, probe, slice_, i, size, q in zip(*[c.to_pylist() for c in batch.columns]):
                if at != key:
                    yield from give()
                    key, own, probes = at, [], []
                if not probe:
                    own.append((slice_, i, size, q))
                elif own:
                    probes.append((slice_, i, size, q))
                    if len(probes) == TILE:  # own rows are compared with each other once, with the last probes
                        yield from _probed(own, probes, key, limits, cosine)
                        probes = []
        yield from give()

    by = tiled(dealt(heads, cosine), heads, cosine).select(*keys, "probe", "slice", "id", "size", "q")
    return by.repartition(*keys).sortWithinPartitions(*keys, "probe").mapInArrow(join, "a long, b long, n long")


def _probed(own: list[tuple], probes: list[tuple], key: list, limits: dict, cosine: float) -> Iterator[pa.RecordBatch]:
    """Own rows compared with probes alone."""
    limits.setdefault(key[1], Limits(key[1], cosine))
    rows = own + probes
    cell = Cell(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.frombuffer(b"".join(r[3] for r in rows), np.int16).reshape(len(rows), -1), limits[key[1]], key[2])
    for k in range(0, len(own), TILE):
        cell.meet(slice(k, min(k + TILE, len(own))), slice(len(own), len(rows)), False)
    yield from cell.told()


def verified(pairs: DataFrame, heads: DataFrame, cosine: float) -> DataFrame:
    """The pairs whose cosine, in doubles, is high enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            dims = np.array([len(x) for x in u])
            keep = np.zeros(len(u), bool)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                p, q = (np.frombuffer(b"".join(s[i] for i in at), np.float64).reshape(len(at), -1) for s in (u, v))
                keep[at] = np.einsum("ij,ij->i", p, q) >= cosine
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], ["a", "b"])

    left = heads.select(F.col("vec_id").alias("a"), F.col("unit").alias("u"))
    right = heads.select(F.col("vec_id").alias("b"), F.col("unit").alias("v"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "u", "v").mapInArrow(check, "a long, b long")


def near_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label).

    Only vectors of equal, non-null labels and equal length are compared. Vectors that are null, empty, zero or hold a
    null or non-finite component link with nothing. Equal vectors are one class and count as linked with each other;
    n_links counts the other rows linked directly. Rows without an id link with nothing. Rows that repeat an id and a
    vector count as other vectors of their class. An empty table gives no rows.
    """
    made = written(prepared(vectors), "vectors")
    good = made.where("unit IS NOT NULL AND vec_id IS NOT NULL")
    keys = ["label", "dims", "d1", "d2"]
    classes = attach_group(good.select("vec_id", *keys), keys, ["vec_id"], rep=(F.min("vec_id"), F.min), size=(F.count("*"), F.sum))
    classes = written(classes, "classes")
    heads = classes.where("vec_id = rep").select(F.col("vec_id"), *keys, "size").distinct()
    heads = written(good.select("vec_id", *keys, "unit", "q").distinct().join(heads, ["vec_id", *keys]), "heads")
    met = written(joined(heads, cosine), "met")
    verified_ = written(verified(met.where("n < 0").select("a", "b"), heads, cosine), "links")
    tree = written(components(met.where("n = 0").select("a", "b").union(verified_)), "tree")
    size = heads.select(F.col("vec_id").alias("node"), "size")
    both = verified_.union(verified_.select("b", "a"))
    counted = met.where("n > 0").select("a", "n").union(both.join(size, both["b"] == size["node"]).select("a", F.col("size").alias("n")))
    linked = counted.groupBy("a").agg(F.sum("n").alias("linked"))
    known = linked.withColumnRenamed("a", "rep").join(tree.withColumnRenamed("node", "rep"), "rep")
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(salts(vectors.sparkSession))).cast("int")
    salted = classes.select("vec_id", *keys, "rep", "size").withColumn("_salt", salt)
    wanted = salted.select("rep", "_salt").distinct().join(known, "rep")
    rows = salted.join(wanted, ["rep", "_salt"], "left")
    n = F.col("size") - 1 + F.coalesce("linked", F.lit(0))
    done = rows.select("vec_id", n.cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rest = made.where("unit IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.union(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
