"""Long repeated word passages by compaction of the De Bruijn graph of the corpus.

The graph's nodes are runs of size - 1 words, its edges the windows of `size` words. Of a window's runs of ANCHOR words
the one of least name, the leftmost of equals, is its anchor; equal windows have equal anchors at equal places. Windows
that start one after another and share an anchor travel as one edge from the first node to the last; both nodes and the
length tell an edge's words. Edges:

* that occur in several documents of a batch are replaced at once: what follows one another in both texts is one span;
* that occur in documents of several batches meet under their anchor. Nodes with one such edge in and one out do not
  branch; Spark joins compact the paths through them by pointer doubling, and each document's stretch of a path that
  has its source in one earlier document is one span;
* that share an anchor but not all words are where the graph may branch: their windows are compared word by word.

Names (64 bits) choose what may be equal. Each span is then verified by its source coordinates: the words of the copy
and of its source are cut from the texts and compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import attach_group, forget, key_runs, salts, sliding_least, worker_cache, written
from .spans import by_text, keyed, merged_spans, with_spans

U = np.uint64
#: Words of a window and of an anchor, and words whose names a worker remembers.
SIZE, ANCHOR, REMEMBERED = 50, 20, 400_000
#: Words whose anchors are sought at once; rows of a batch of edges; edges of an anchor that are compared together.
STRETCH, BATCH_ROWS, TOGETHER = 1 << 19, 100_000, 8192
#: Edges that one batch sends to one anchor; what exceeds them is grouped by itself.
LOCAL = 32
#: Kinds of rows: an edge; an edge at an anchor that is frequent in its batch; a span copied within a batch.
EDGE, HOT, COPY = 0, 1, 2


class _Names(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, 7)
        return h


def word_names(text: str) -> np.ndarray:
    known = worker_cache("unit_hashes", _Names)
    return np.array(list(map(known.__getitem__, text.encode().split())), dtype=np.uint64)


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


def run_names(words: np.ndarray, length: int) -> np.ndarray:
    """Names of all runs of `length` words, from names of runs of half the length and so on."""
    x, have, n = words, 1, len(words) - length + 1
    while 2 * have <= length:
        x = scrambled(x[:-have] * U(0x9E3779B97F4A7C15) + x[have:])
        have *= 2
    if have < length:
        x = scrambled(x[:n] * U(0xC2B2AE3D27D4EB4F) + x[length - have :][:n])
    return x


def edges_of(pieces: list[np.ndarray], size: int, k: int) -> tuple[np.ndarray, ...]:
    """Number of the piece, anchor's name, names of the first and last node, count of further windows and first window
    start of every edge of the pieces."""
    words = np.concatenate(pieces)
    lengths = np.array([len(p) for p in pieces])
    anchors, nodes = run_names(words, k), run_names(words, size - 1)
    order = (scrambled(anchors) & ~U(0xFFFFFF)) | np.arange(len(anchors), dtype=np.uint64)
    anchor = (sliding_least(order, size - k + 1) & U(0xFFFFFF)).astype(np.int64)
    piece, ends = np.repeat(np.arange(len(pieces)), lengths)[: len(anchor)], np.cumsum(lengths)
    start = np.flatnonzero(np.arange(len(anchor)) + size <= ends[piece])
    anchor, piece = anchor[start], piece[start]
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])) + 1
    low, high = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(start) - 1]])
    piece = piece[low]
    return piece, anchors[anchor[low]], nodes[start[low]], nodes[start[high] + 1], high - low, start[low] - (ends - lengths)[piece]


def _edges(docs: DataFrame, size: int, k: int) -> DataFrame:
    """key (the anchor's name), begin and end (nodes), more, id, low, th, kind and at of every edge.

    A COPY is a span of words from low on, more + size long, that the document `begin` (text `end`) has at `at`.
    """
    columns = ["key", "begin", "end", "more", "id", "low", "th", "kind", "at"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, given = TaskContext.get().partitionId(), 0

        def give(out: list[list[np.ndarray]]) -> pa.RecordBatch:
            nonlocal given
            given += 1
            key, begin, end, more, i, low, h = (np.concatenate(c) for c in zip(*out))
            label = scrambled(begin * U(3) + scrambled(end + more.astype(np.uint64)))
            order = np.lexsort((low, i, label))
            key, begin, end, more, i, low, h, label = (c[order] for c in (key, begin, end, more, i, low, h, label))
            new = np.concatenate([[True], label[1:] != label[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            copy = i > i[first]
            # What follows one another in a copy and in its source is one span.
            at = np.flatnonzero(copy)
            at = at[np.lexsort((low[at], h[at], i[at]))]
            src = first[at]
            follows = (i[at][1:] == i[at][:-1]) & (h[at][1:] == h[at][:-1]) & (low[at][1:] == low[at][:-1] + more[at][:-1] + 1)
            follows &= (i[src][1:] == i[src][:-1]) & (h[src][1:] == h[src][:-1]) & ((low[at] - low[src])[1:] == (low[at] - low[src])[:-1])
            head = np.flatnonzero(np.concatenate([[True], ~follows])) if len(at) else at
            a, b = at[head], at[np.append(head[1:] - 1, len(at) - 1)] if len(at) else at
            spans = [scrambled(i[a].view(U) * U(5) + low[a].view(U)).view(np.int64), i[first[a]], h[first[a]], low[b] + more[b] - low[a], i[a], low[a], h[a], np.full(len(a), COPY), low[first[a]]]
            key, begin, end, more, i, low, h = (c[~copy] for c in (key, begin, end, more, i, low, h))
            order = np.argsort(key, kind="stable")
            key, begin, end, more, i, low, h = (c[order] for c in (key, begin, end, more, i, low, h))
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size_of = np.diff(np.append(start, len(key)))
            hot = np.repeat(size_of > LOCAL, size_of)
            own = hot.copy()
            own[start] = False
            key = np.where(own, scrambled(key + U(((task << 24) + given) * 0x9E3779B97F4A7C15 % 2**64)), key)
            edges = [key.view(np.int64), begin.view(np.int64), end.view(np.int64), more, i, low, h, np.where(hot, HOT, EDGE), np.zeros(len(key), np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(edges, spans)], columns)

        for batch in batches:
            out: list[list[np.ndarray]] = []
            pieces: list[np.ndarray] = []
            marks: list[tuple[int, int, int]] = []  # id, th and place in its text of each piece
            held = 0

            def sought() -> None:
                piece, key, begin, end, more, low = edges_of(pieces, size, k)
                i, h, at = (np.array(c, dtype=np.int64)[piece] for c in zip(*marks))
                out.append([key, begin, end, more, i, low + at, h])
                pieces.clear()
                marks.clear()

            for i, h, text in zip(*[c.to_pylist() for c in batch.columns]):
                words = word_names(text)
                for at in range(0, len(words) - size + 1, STRETCH):
                    pieces.append(words[at : at + STRETCH + size - 1])
                    marks.append((i, h, at))
                    held += len(pieces[-1])
                    if held >= STRETCH:
                        sought()
                        held = 0
                if sum(len(c[0]) for c in out) > BATCH_ROWS:
                    yield give(out)
                    out.clear()
            if pieces:
                sought()
            if out:
                yield give(out)

    return docs.select("id", "th", "text").mapInArrow(make, ", ".join(f"{c} long" for c in columns))


def _under_anchors(edges: DataFrame) -> DataFrame:
    """Rows kind, key, part, whole, begin, end, more, id, th, low, sid, sth, at.

    EDGE: an edge that a document of a smaller id has: sid, its text sth at `at`. COPY: a span that such a document has.
    HOT: other edges of anchors that edges of several documents share; they are compared in parts of TOGETHER, whole
    if the anchor has one part.
    """
    columns = ["kind", "key", "part", "whole", "begin", "end", "more", "id", "th", "low", "sid", "sth", "at"]

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind, at, key, part, whole, begin, end, more, i, th, low, sid, sth, source) -> pa.RecordBatch:
            values = [np.full(len(i), kind), key, part, whole, begin, end, more, i, th, low, sid, sth, source]
            return pa.RecordBatch.from_arrays([pa.array(v[at]) for v in values], columns)

        head = None  # label, id, th and low of the last edge seen, of its first document, in a long run
        for arrays, long, given in key_runs(batches, 4 * TOGETHER):
            copy = arrays[7] == COPY
            zeros, no = np.zeros(len(copy), np.int64), np.zeros(len(copy), bool)
            if copy.any():
                key, begin, end, more, i, low, th, _, at = arrays
                yield rows(COPY, copy, key, zeros, no, zeros, zeros, more, i, th, low, begin, end, at)
                arrays = [c[~copy] for c in arrays]
            key, begin, end, more, i, low, th, kind, _ = arrays
            n = len(key)
            if not n:
                continue
            zeros, no = np.zeros(n, np.int64), np.zeros(n, bool)
            new = np.ones(n, bool)
            for c in (key, begin, end, more):
                new[1:] = c[1:] != c[:-1] if c is key else new[1:] | (c[1:] != c[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            sid, sth, at = i[first], th[first], low[first]
            if long and given and head and head[0] == (begin[0], end[0], more[0]):
                same = first == 0
                sid, sth, at = (np.where(same, value, c) for value, c in zip(head[1:], (sid, sth, at)))
            head = ((begin[-1], end[-1], more[-1]), sid[-1], sth[-1], at[-1]) if long else None
            copied = i > sid
            if copied.any():
                yield rows(EDGE, copied, key, zeros, no, begin, end, more, i, th, low, sid, sth, at)
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            group = np.repeat(np.arange(len(start)), np.diff(np.append(start, n)))
            least = np.minimum.reduceat(np.where(copied, np.iinfo(np.int64).max, i), start)
            most = np.maximum.reduceat(np.where(copied, np.iinfo(np.int64).min, i), start)
            parted = np.maximum.reduceat(kind, start) == HOT
            parted |= long
            open_ = ~copied & (parted | (least < most))[group]
            if open_.any():
                count = np.add.reduceat(open_, start, dtype=np.int64)
                rank = np.cumsum(open_) - 1 - (np.cumsum(count) - count)[group] + (given if long else 0)
                whole = ~(parted | (count > TOGETHER))[group]
                yield rows(HOT, open_, key, rank // TOGETHER, whole, begin, end, more, i, th, low, zeros, zeros, zeros)

    by = edges.repartition("key").sortWithinPartitions("key", "begin", "end", "more", "id", "low")
    return by.mapInArrow(sift, ", ".join(f"{c} {'boolean' if c == 'whole' else 'long'}" for c in columns))


def paths(edges: DataFrame, made: list[DataFrame] | None = None) -> DataFrame:
    """edge, path, hops and offset of every distinct edge of a table (edge, begin, end, more, sid, sth, at).

    Edges that follow one another through nodes with one edge in and one out are a path, named by its first edge; hops
    and offset are an edge's distance from that, in edges and in words. What also follows one another in one source
    (sid, sth, at) is one stretch at once. Stretches are joined by rounds that double how far each sees; only those that
    do not yet see their path's begin take part. A stretch of a ring is a path of its own. made takes the tables
    written on the way, which may be forgotten once the result has been read.
    """
    made = made if made is not None else []

    def kept(df: DataFrame, purpose: str) -> DataFrame:
        made.append(written(df, purpose))
        return made[-1]

    single = edges.groupBy("edge").agg(F.min(F.struct("sid", "sth", "at", "begin", "end", "more")).alias("e")).select("edge", "e.*")
    single = kept(single, "edges")
    out = single.groupBy(F.col("begin").alias("node")).agg(F.count("*").alias("outs"), F.min("edge").alias("edge"))
    in_ = single.groupBy(F.col("end").alias("node")).agg(F.count("*").alias("ins"), F.min("edge").alias("before"), F.min("more").alias("more_before"))
    plain = out.where("outs = 1").join(in_.where("ins = 1"), "node").where("edge <> before").select("edge", "before", "more_before")
    along = W.partitionBy("sid", "sth").orderBy("at", "edge")
    last = lambda c: F.lag(c).over(along)
    follows = (last("edge") == F.col("before")) & (F.col("at") == last("at") + last("more") + 1)
    placed = single.join(plain, "edge", "left").withColumn("n", F.row_number().over(along)).withColumn("first", ~F.coalesce(follows, F.lit(False)))
    head = F.last(F.when(F.col("first"), F.struct("edge", "at", "n")), ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, 0))
    placed = placed.withColumn("head", head).select(
        "edge", F.col("head.edge").alias("stretch"), (F.col("n") - F.col("head.n")).cast("long").alias("hops"), (F.col("at") - F.col("head.at")).alias("offset"),
        F.when(F.col("first"), F.col("before")).alias("before"), "more_before",
    )
    placed = kept(placed, "stretches")
    joint = placed.where("before IS NOT NULL").select("stretch", F.col("before").alias("edge"), "more_before")
    joint = joint.join(placed.select("edge", F.col("stretch").alias("path"), "hops", "offset"), "edge").where("stretch <> path")
    columns = ["stretch", "path", "hops", "offset"]
    waiting = kept(joint.select("stretch", "path", (F.col("hops") + 1).alias("hops"), (F.col("offset") + F.col("more_before") + 1).alias("offset")), "steps")
    # Stretches that nothing follows are looked up by none: only the others are kept at hand.
    zero = F.lit(0).cast("long")
    begins = waiting.select(F.col("path").alias("stretch")).distinct().join(waiting.select("stretch"), "stretch", "left_anti")
    done = [kept(begins.select("stretch", F.col("stretch").alias("path"), zero.alias("hops"), zero.alias("offset")), "steps")]
    left, seen = waiting.count(), 1
    most = left + 1
    while left and seen <= most:
        known = waiting.withColumn("done", F.lit(False))
        for d in done:
            known = known.union(d.withColumn("done", F.lit(True)))
        ahead = known.select(F.col("stretch").alias("path"), F.col("path").alias("to"), F.col("hops").alias("h"), F.col("offset").alias("o"), "done")
        step = waiting.join(ahead, "path").select("stretch", F.col("to").alias("path"), (F.col("hops") + F.col("h")).alias("hops"), (F.col("offset") + F.col("o")).alias("offset"), "done")
        step = kept(step, "steps")
        done.append(step.where("done").select(columns))
        waiting = step.where("NOT done").select(columns)
        left, seen = waiting.count(), 2 * seen
    found = done[0]
    for d in done[1:]:
        found = found.union(d)
    found = found.select("stretch", "path", F.col("hops").alias("h"), F.col("offset").alias("o"))
    whole = placed.select("edge", "stretch", "hops", "offset").join(found, "stretch", "left")
    return whole.select("edge", F.coalesce("path", "stretch").alias("path"), (F.col("hops") + F.coalesce("h", F.lit(0))).alias("hops"), (F.col("offset") + F.coalesce("o", F.lit(0))).alias("offset"))


def path_spans(edges: DataFrame, size: int, made: list[DataFrame]) -> DataFrame:
    """id, th, start, end, sid, sth, at: the documents' stretches of paths that an earlier document has."""
    named = edges.withColumn("edge", F.xxhash64("begin", "end", "more"))
    placed = named.join(paths(named, made), "edge")
    # In one document and its source, what is as far apart as on the path, without a gap, is one span.
    placed = placed.withColumn("here", F.col("low") - F.col("offset")).withColumn("there", F.col("at") - F.col("offset"))
    alike = ["id", "th", "path", "sid", "sth", "here", "there"]
    gapless = placed.withColumn("island", F.col("hops") - F.dense_rank().over(W.partitionBy(*alike).orderBy("hops")))
    ends = F.max(F.col("low") + F.col("more") + F.lit(size))
    found = gapless.groupBy(*alike, "island").agg(F.min("low").alias("start"), ends.alias("end"), F.min("at").alias("at"))
    return found.select("id", "th", "start", "end", "sid", "sth", "at")


def _cut(spans: DataFrame, open_: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """group, role, whole, id, th, start, end and words: sources (role 0) with the copies (1) that name them, and open
    edges (2) by parts of their anchors.

    A source with many copies goes to several groups, once to each.
    """
    spans = spans.withColumn("salt", F.pmod(F.xxhash64("id", "th", "start"), F.lit(salts(docs.sparkSession))))
    spans = spans.withColumn("n", F.col("end") - F.col("start")).withColumn("group", F.xxhash64("sid", "sth", "at", "n", "salt"))
    role = lambda k: F.lit(k).alias("role")
    yes = F.lit(True).alias("whole")
    copies = spans.select("id", "th", role(1), "group", yes, "start", "end")
    sources = spans.select("sid", "sth", "at", "n", "group").distinct()
    sources = sources.select(F.col("sid").alias("id"), F.col("sth").alias("th"), role(0), "group", yes, F.col("at").alias("start"), (F.col("at") + F.col("n")).alias("end"))
    open_ = open_.select("id", "th", role(2), F.xxhash64("key", "part").alias("group"), "whole", F.col("low").alias("start"), (F.col("low") + F.col("more") + F.lit(size)).alias("end"))
    wanted = copies.union(sources).union(open_).groupBy("id", "th").agg(F.collect_list(F.struct("group", "role", "whole", "start", "end")).alias("wanted"))
    columns = ["group", "role", "whole", "id", "th", "start", "end", "words"]
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            weight = 0
            for i, h, text, wanted in zip(*[c.to_pylist() for c in batch.columns]):
                words = text.encode().split()
                for r in wanted:
                    a, b = r["start"], r["end"]
                    rows.append((r["group"], r["role"], r["whole"], i, h, a, b, b" ".join(words[a:b])))
                    weight += len(rows[-1][-1]) + 100
                    if weight > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], columns)
                        rows, weight = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], columns)

    schema = "group long, role int, whole boolean, id long, th long, start long, end long, words binary"
    return docs.select("id", "th", "text").join(wanted, ["id", "th"]).mapInArrow(cut, schema)


def compared_windows(rows: list[tuple], size: int) -> Iterator[tuple]:
    """(id, th, start, end, None) of the stretches whose windows a document of a smaller id has in the same group, and
    (id, th, start, end, words) of the first windows of groups that are not whole.

    rows: group, role, whole, id, th, start, end, words, in order of group and id.
    """
    first: dict[tuple[int, bytes], int] = {}
    for group, _, whole, i, h, start, end, words in rows:
        ends = [0, *(n + k for k, n in enumerate(accumulate(map(len, words.split(b" "))), 1))]  # where each word begins
        gone = None
        for k in range(end - start - size + 1):
            window = words[ends[k] : ends[k + size] - 1]
            if first.setdefault((group, window), i) < i:
                if gone is None:
                    gone = k
                continue
            if gone is not None:
                yield i, h, start + gone, start + k - 1 + size, None
                gone = None
            if not whole:
                yield i, h, start + k, start + k + size, window
        if gone is not None:
            yield i, h, start + gone, end, None


def _verify(cuts: DataFrame, size: int) -> DataFrame:
    """id, th, start and end of what is to go, without words; and, with words, the windows still to meet other groups'."""
    columns, kinds = ["id", "th", "start", "end", "words"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, source, held = None, None, []
        for batch in batches:
            out: list[tuple] = []
            for r in zip(*[c.to_pylist() for c in batch.columns]):
                if r[1] == 0:
                    named, source = r[0], r[7]
                elif r[1] == 1:
                    if named == r[0] and source == r[7]:
                        out.append((*r[3:7], None))
                else:
                    if len(held) >= 2048 and held[-1][0] != r[0]:
                        out += compared_windows(held, size)
                        held = []
                    held.append(r)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], columns)
        out = list(compared_windows(held, size))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], columns)

    by = cuts.repartition("group").sortWithinPartitions("group", "role", "id", "start")
    return by.mapInArrow(check, "id long, th long, start long, end long, words binary")


def repeated_passages(docs: DataFrame, size: int = SIZE, text: str = "text") -> DataFrame:
    """id, th and spans (start and end, in words) of the texts that have words to lose. Spans may overlap."""
    if not 2 <= size <= STRETCH:
        raise ValueError(f"windows of 2 to {STRETCH} words are compared")
    known = keyed(docs, text)
    met = written(_under_anchors(_edges(known, size, min(ANCHOR, size))), "anchors")
    copied = met.where(F.col("kind") == COPY).select("id", "th", F.col("low").alias("start"), (F.col("low") + F.col("more") + F.lit(size)).alias("end"), "sid", "sth", "at")
    made: list[DataFrame] = []
    spans = written(copied.union(path_spans(met.where(F.col("kind") == EDGE), size, made)).distinct(), "spans")
    forget(*made)
    found = written(_verify(_cut(spans, met.where(F.col("kind") == HOT), known, size), size), "passages")
    forget(met, spans)
    rest = attach_group(found.where("words IS NOT NULL"), ["words"], ["id", "start"], first=(F.min("id"), F.min)).where("id > first")
    columns = ["id", "th", "start", "end"]
    return by_text(found.where("words IS NULL").select(columns).union(rest.select(columns)))


def remove_passages(docs: DataFrame, size: int = SIZE, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, spans (of words, end exclusive) and kept (text) of every row of docs.

    Each word covered by a window of `size` words that also starts in a document with a smaller id is removed; windows
    are judged on the input. Kept words are joined by one space. A null text has no words. A row without an id is
    left whole and makes nothing a repeat; rows that repeat an id are one document. An empty table gives no rows.
    """
    docs = docs.select("doc_id", F.col(text).alias("text"))
    spans = repeated_passages(docs, size)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, some in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words, runs = (t or "").encode().split(), merged_spans(some)
                n, kept, at = len(words), [], 0
                for a, b in runs:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                rows.append((n, n - len(kept), [{"start": a, "end": b} for a, b in runs], b" ".join(kept).decode()))
            if rows:
                kinds = pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], ["doc_id", "n_words", "n_removed", "spans", "kept"])

    schema = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"
    return with_spans(docs.withColumn("doc_id", F.col("doc_id").cast("long")), spans, "text").mapInArrow(cut, schema)
