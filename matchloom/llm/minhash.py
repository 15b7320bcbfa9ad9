"""Near-duplicate documents: MinHash bands give candidates, odd sketches sift them, full sets confirm them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_group, shuffle_tasks, worker_cache, written
from .components import components

#: Samples in BANDS bands of ROWS: a pair of similarity 0.8 is missed with a chance of (1 - 0.8^4)^32 = 5e-8.
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch, and how far below the threshold an estimate may be (five standard deviations of it).
SKETCH_BITS, MARGIN = 512, 0.20
#: Bits of the sketch of whole sets, which settles what the other leaves open.
WIDE_BITS = 4096
#: Rows of a bucket that are compared at once, and pairs of a row that are given out before links are known.
BLOCK, EARLY_PAIRS = 1024, 4
#: Words remembered by a worker.
REMEMBERED = 400_000
U = np.uint64
_MULTIPLIERS = np.random.default_rng(20).integers(1, 2**63, SAMPLES, dtype=np.uint64) * U(2) + U(1)
_OFFSETS = np.random.default_rng(21).integers(0, 2**63, SAMPLES, dtype=np.uint64)


class WordHashes(dict):
    """64-bit hashes of words, computed once each."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of `size` words of a text, A-Z lower-cased.

    A text of fewer words, but at least one, has its whole sequence as its only element.
    """
    words = (text or "").encode(errors="surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.array(list(map(hashes.__getitem__, words)), dtype=np.uint64)
    size, n = min(size, len(h)), len(h)
    out = np.full(n - size + 1, U(size))
    for k in range(size):
        out = mixed(out * U(0x9E3779B97F4A7C15) + h[k : n - size + 1 + k])
    return np.unique(out)


def samples(elements: np.ndarray) -> np.ndarray:
    """The least value of the set under each of SAMPLES hash functions."""
    least = np.full(SAMPLES, ~U(0))
    for i in range(0, len(elements), 512):
        part = elements[i : i + 512]
        values = part[None, :] * _MULTIPLIERS[:, None] + _OFFSETS[:, None]
        values ^= values >> U(29)
        least = np.minimum(least, values.min(axis=1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64) + U(1)
    for k in range(ROWS):
        key = mixed(key * U(0x9E3779B97F4A7C15) + least.reshape(BANDS, ROWS)[:, k])
    return key


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Bits set where an odd number of samples fall, each sample hashed with its place."""
    at = mixed(least + np.arange(SAMPLES, dtype=np.uint64) * U(0xA0761D6478BD642F)) % U(SKETCH_BITS)
    bits = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS).astype(np.uint8) & 1
    return np.packbits(bits)


def estimate(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarities of sketches (rows of 64-bit words), all of left against all of right: a pair differs in
    2 k (1 - J) of k samples, each difference flips a bit, and flips that meet undo each other."""
    odd = np.zeros((len(left), len(right)), np.int32)
    for w in range(left.shape[1]):
        odd += np.bitwise_count(left[:, w, None] ^ right[None, :, w])
    differ = -SKETCH_BITS / 2 * np.log(np.maximum(1 - 2 * np.arange(SKETCH_BITS + 1) / SKETCH_BITS, 1e-9))
    return (1 - differ / (2 * SAMPLES))[odd]


def wide_sketch(elements: np.ndarray) -> np.ndarray:
    """The odd sketch of every element, each as its own sample: sizes of differences, nearly exact."""
    bits = np.bincount((mixed(elements ^ U(0x2545F4914F6CDD1D)) % U(WIDE_BITS)).astype(np.int64), minlength=WIDE_BITS).astype(np.uint8) & 1
    return np.packbits(bits)


def wide_odds(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    odd = np.zeros((len(left), len(right)), np.int32)
    for w in range(left.shape[1]):
        odd += np.bitwise_count(left[:, w, None] ^ right[None, :, w])
    return odd


def wide_limits(total: np.ndarray, least: float) -> np.ndarray:
    """Bits that may differ between sets of so many elements in all, if they are as similar as `least`: the expected
    number and six standard deviations."""
    d = total * (1 - least) / (1 + least)
    e2, e4 = np.exp(-2 * d / WIDE_BITS), np.exp(-4 * d / WIDE_BITS)
    return WIDE_BITS / 2 * (1 - e2) + 6 * np.sqrt(np.maximum(WIDE_BITS / 4 * (1 - e4) - d * e4, 0)) + 1


def cross_pairs(n: np.ndarray, sketch: np.ndarray, c: np.ndarray, first: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs of rows of different components that may be similar, and how many bits of theirs differ.

    n, sketch, c: set sizes, wide sketches and components of rows; first: of two blocks' rows, those of the first, if only
    pairs across blocks count. Such a pair has a row outside of the largest component: no others are compared.
    """
    names, sizes = np.unique(c, return_counts=True)
    inside = c == names[sizes.argmax()]
    sides = [(~inside, np.ones(len(c), bool))] if first is None else [(first & ~inside, ~first), (first & inside, ~first & ~inside)]
    found = [(np.empty(0, np.int64),) * 3]
    for left, right in sides:
        i, j = np.flatnonzero(left), np.flatnonzero(right)
        if not len(i) or not len(j):
            continue
        x, y = n[i, None], n[None, j]
        total, odd = x + y, wide_odds(sketch[i], sketch[j])
        low, high = int(total.min()), int(total.max())
        limits = wide_limits(np.arange(low, high + 1), least)[total - low] if high - low < total.size else wide_limits(total, least)
        hit = (np.minimum(x, y) >= least * np.maximum(x, y) - 1e-9) & (odd <= limits) & (c[i, None] != c[None, j])
        if first is None:
            hit &= inside[None, j] | (i[:, None] < j[None, :])
        a, b = np.nonzero(hit)
        found.append((i[a], j[b], odd[a, b]))
    return tuple(np.concatenate(v) for v in zip(*found))


def features(docs: DataFrame, shingle: int, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, s1 and s2 (a digest of the set), bands, sketch, wide sketch and the bands' bytes of every row."""
    schema = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sketch binary, wide binary, packed binary"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_cache("word_hashes", WordHashes)
        for batch in batches:
            rows: list[tuple] = []
            for t in batch.column(1).to_pylist():
                s = shingle_set(t, shingle, hashes)
                if not len(s):
                    rows.append((0, 0, 0, [], b"", b"", b""))
                    continue
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                least = samples(s)
                keys = band_keys(least).view(np.int64)
                rows.append((len(s), int(digest[0]), int(digest[1]), keys, odd_sketch(least).tobytes(), wide_sketch(s).tobytes(), keys.tobytes()))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(make, schema)


def _near(n: np.ndarray, sketch: np.ndarray, i: slice, j: slice, least: float) -> np.ndarray:
    """Which of rows i and rows j may be similar: by their sizes, and by the sketches' estimate."""
    a, b = n[i, None], n[None, j]
    fits = np.minimum(a, b) >= least * np.maximum(a, b) - 1e-9
    return np.where(fits, estimate(sketch[i], sketch[j]), -1.0)


def spanning_forest(near: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (places of rows) of a forest that joins all rows joined by estimates over least, by the highest ones."""
    m = len(near)
    best, partner, free = np.full(m, -np.inf), np.full(m, -1), np.ones(m, bool)
    a, b = [], []
    for _ in range(m):
        at = int(np.where(free, best, -np.inf).argmax())
        if not free[at] or best[at] <= least:
            at = int(free.argmax())
        else:
            a.append(at)
            b.append(partner[at])
        free[at] = False
        up = near[at] > best
        best[up], partner[up] = near[at][up], at
    return np.array(a, np.int64), np.array(b, np.int64)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Runs of rows with equal first `keys` columns, of sorted batches, as lists of column arrays."""
    held: list[list[np.ndarray]] = []

    def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [np.array(c.to_pylist(), dtype=object) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]

    for batch in batches:
        columns = arrays(batch)
        if not len(columns[0]):
            continue
        change = np.zeros(len(columns[0]), bool)
        for k in range(keys):
            change[1:] |= columns[k][1:] != columns[k][:-1]
        if held:
            change[0] = any(columns[k][0] != held[-1][k][-1] for k in range(keys))
        cuts = np.flatnonzero(change)
        for i, cut in enumerate(cuts):
            before = [c[(cuts[i - 1] if i else 0) : cut] for c in columns]
            held.append(before)
            whole = [np.concatenate(c) for c in zip(*held)]
            if len(whole[0]):
                yield whole
            held = []
        held.append([c[(cuts[-1] if len(cuts) else 0) :] for c in columns])
    if held:
        whole = [np.concatenate(c) for c in zip(*held)]
        if len(whole[0]):
            yield whole


def _words(sketches: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.tolist()), np.uint64).reshape(len(sketches), -1)


def _pairs_batch(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full sets are similar enough: 100 |A & B| >= percent |A | B|.

    pairs: each once. texts: id and t of all documents named. A pair's texts meet in one task, those of a document with many partners in several; sets are made anew there, one
    partner at a time.
    """
    by = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(64)).cast("int"))
    firsts = by.select(F.col("a").alias("hub"), "part").distinct().withColumn("id", F.col("hub"))
    others = by.select(F.col("a").alias("hub"), "part", F.col("b").alias("id"))
    needed = firsts.union(others)
    rows = needed.join(texts.hint("merge"), "id").select("hub", "part", (F.col("id") != F.col("hub")).alias("other"), "id", "t")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_cache("word_hashes", WordHashes)
        hub, mine = None, []  # more than one set only if rows repeat an id
        for batch in batches:
            a, b = [], []
            for h, other, i, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if not other:
                    mine = [*(mine if h == hub else []), shingle_set(t, shingle, hashes)]
                    hub = h
                    continue
                s = shingle_set(t, shingle, hashes)
                if h == hub and any(similar(m, s, percent) for m in mine):
                    a.append(h)
                    b.append(i)
            yield _pairs_batch(a, b)

    return rows.repartition(shuffle_tasks(texts.sparkSession), "hub", "part").sortWithinPartitions("hub", "part", "other", "id").mapInArrow(check, "a long, b long")


def link_classes(found: DataFrame, docs: DataFrame, shingle: int, percent: int, text: str = "text") -> DataFrame:
    """node, component of the representatives (rows of found: rep, n, bands, sketch, wide, packed) that are linked to others.

    Rows of a bucket are compared in blocks by their sketches; a large bucket is dealt to blocks anew in each band.
    Few similar pairs are given out as they are; of many, those of a forest that spans them by their likeliest links
    come first. Once those are confirmed and joined to components, sketches of the whole sets do the same for pairs
    across components, and at last all pairs that these allow are given out.

    Chances that a pair of similarity 0.8 is missed, smaller for any above: 5e-8 that no band has both, 3e-7 that the
    odd sketches' estimate falls five deviations short, 1e-9 that the wide sketches' does by six; 4e-7 in all.
    """
    least = percent / 100
    tasks = shuffle_tasks(docs.sparkSession)
    rows = found.select("rep", "n", "sketch", F.explode("bands").alias("key"))
    shared = attach_group(rows.select("key", "rep"), ["key"], ["rep"], size=(F.count("*"), F.sum)).where("size > 1")
    shared = written(shared, "buckets")
    members = shared.join(found.select("rep", "n", "sketch"), "rep").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    block = F.when(F.col("blocks") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("key", "rep"), F.col("blocks"))).cast("int")
    members = written(members.select("key", "rep", "n", "sketch", "blocks", block.alias("block")), "members")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, rep, n, sketch, blocks in _groups(batches, 2):
            near = _near(n, _words(sketch), slice(None), slice(None), least)
            a, b = np.nonzero(np.triu(near > least - MARGIN, 1))
            open_ = len(a) > EARLY_PAIRS * len(rep)
            if open_:
                a, b = spanning_forest(near, least - MARGIN)
            open_ |= blocks[0] > 1
            a, b, mark = rep[a], rep[b], np.append(np.zeros(len(a), bool), True)
            columns = np.append(np.minimum(a, b), key[0] if open_ else 0), np.append(np.maximum(a, b), blocks[0] if open_ else 0), mark, mark & open_
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "mark", "open"])

    # The texts that may have to be compared, found by one shuffle for all rounds.
    own = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), F.col(text).alias("t"))
    texts = written(own.hint("merge").join(members.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), "texts")

    sorted_ = members.select("key", "block", "rep", "n", "sketch", "blocks").repartition(tasks, "key", "block").sortWithinPartitions("key", "block", "rep")
    marked = "a long, b long, mark boolean, open boolean"  # a mark: a bucket's key and its blocks

    def each_block(buckets: DataFrame) -> DataFrame:
        """key and block of buckets (key, blocks): a bucket's rows are reached through its blocks, so that a large one is not read by one task."""
        return buckets.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"))

    seen = written(sorted_.mapInArrow(first, marked).where("a < b OR open").distinct(), "pairs")
    links = written(confirmed(seen.where("NOT mark").select("a", "b"), texts, shingle, percent), "links")
    tree = components(links)
    unsettled = seen.where("mark").select(F.col("a").alias("key"), F.col("b").alias("blocks"))
    wide = found.select("rep", "wide", "packed")

    def across(whole: bool):
        """Pairs of a tile across components. If they are many: whole gives them all, else those of a forest."""

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, x, y, block, rep, n, sketch, bands, c, blocks in _groups(batches, 3):
                if (c == c[0]).all():
                    continue
                bands = _words(bands).view(np.int64)
                before = bands[:, : int(np.flatnonzero(bands[0] == key[0])[0])]
                a, b, odd = cross_pairs(n, _words(sketch), c, block == x[0] if x[0] != y[0] else None, least)
                new = ~(before[a] == before[b]).any(axis=1)  # a pair belongs to the first bucket that has both
                a, b, odd = a[new], b[new], odd[new]
                open_ = not whole and len(a) > EARLY_PAIRS * len(rep)
                if open_:  # rows of one component hang together already
                    near = np.where(c[:, None] == c[None, :], 2.0, -1.0)
                    near[a, b] = near[b, a] = 1 - odd / (n[a] + n[b])
                    a, b = spanning_forest(near, -0.5)
                    new = c[a] != c[b]
                    a, b = a[new], b[new]
                a, b, mark = rep[a], rep[b], np.append(np.zeros(len(a), bool), True)
                columns = np.append(np.minimum(a, b), key[0] if open_ else 0), np.append(np.maximum(a, b), blocks[0] if open_ else 0), mark, mark & open_
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], ["a", "b", "mark", "open"])

        return pairs

    # Buckets that still hold several components, by the sketches of whole sets: every pair of their blocks is a tile.
    for whole in (False, True):
        if not unsettled.limit(1).count():
            break
        rest = members.join(each_block(unsettled), ["key", "block"], "left_semi").join(tree.withColumnRenamed("node", "rep"), "rep", "left")
        rest = rest.select("key", "rep", "n", "blocks", "block", F.coalesce("component", "rep").alias("c"))
        several = rest.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max("blocks").alias("blocks")).where("low < high")
        tiles = rest.join(each_block(several), ["key", "block"], "left_semi").join(wide, "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        tiles = tiles.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "rep", "n", "wide", "packed", "c", "blocks")
        by = tiles.repartition(tasks, "key", "x", "y").sortWithinPartitions("key", "x", "y", "rep")
        seen = written(by.mapInArrow(across(whole), marked).where("a < b OR open").distinct(), "pairs")
        more = seen.where("NOT mark").select("a", "b")
        if not more.limit(1).count():
            break
        links = tree.select(F.col("component").alias("a"), F.col("node").alias("b")).union(confirmed(more, texts, shingle, percent))
        tree = components(written(links, "links"))
        unsettled = seen.where("mark").select(F.col("a").alias("key"), F.col("b").alias("blocks"))
    return tree


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text).

    Documents with equal sets are one class; classes are linked if 100 |A & B| >= percent |A | B|, confirmed on full
    sets; no pair below is linked, and one at 100 * 0.8 is missed with a chance of 4e-7 (see link_classes).
    component_id is the smallest doc_id reachable by links. A text without words has an empty set and is linked
    with nothing. A row without an id has a null component and is kept. Rows that repeat an id are one document of
    that id if their sets are equal; else links of each of its sets are links of the id. An empty table gives no rows.
    """
    made = written(features(docs, shingle, text), "features")
    full = made.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = attach_group(full.select("doc_id", "n_shingles", "s1", "s2"), ["s1", "s2", "n_shingles"], ["doc_id"], rep=(F.min("doc_id"), F.min))
    classes = written(classes.select("doc_id", "n_shingles", "s1", "s2", "rep"), "classes")
    heads = classes.where("doc_id = rep").select(F.col("doc_id").alias("rep"), "s1", "s2")
    found = full.withColumnRenamed("doc_id", "rep").join(heads, ["rep", "s1", "s2"], "left_semi").dropDuplicates(["rep", "s1", "s2"])
    found = written(found.select("rep", F.col("n_shingles").alias("n"), "bands", "sketch", "wide", "packed"), "heads")
    tree = link_classes(found, docs, shingle, percent, text)
    # A class takes its representative's component; hot classes are spread over tasks.
    salted = classes.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int"))
    wanted = salted.select(F.col("rep").alias("node"), "_salt").distinct().join(tree, "node")
    named = salted.join(wanted.select(F.col("node").alias("rep"), "_salt", "component"), ["rep", "_salt"], "left")
    rest = made.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rows = named.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")).union(rest)
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
