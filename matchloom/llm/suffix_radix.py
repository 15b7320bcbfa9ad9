"""Repeated byte strings by a depth-limited radix sort of suffixes, most significant digits first.

Suffixes are ordered through `threshold` bytes only; suffixes that agree so far are the repeated windows. Each window is
filed under its anchor, of its runs of ANCHOR bytes the one with the least name, the leftmost of equals: equal windows
have equal anchors at equal places, so a window's first digit is its anchor's bytes. Windows that start one after
another under one anchor make a region, which is one row however many windows it holds.

First pass: buckets of the first digit, known by 64-bit names, are counted; suffixes alone in theirs are done. Names
only choose who goes on: two digits of one name would keep a suffix that could have gone. Second pass: the survivors'
bytes are cut from the texts and go to their bucket; regions of equal bytes are one from here on. Last passes: in a
bucket with several regions, windows are sorted by digits of eight bytes, from the most significant to the threshold;
those alone in their bucket stop, and whoever shares a bucket after the last digit is a repeat of its first member. So
every removal rests on bytes (a text equal to an earlier one goes by its SHA-256). Buckets of many rows are sorted in
parts, and the first windows of each part meet by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_group, key_runs, sliding_least, written
from .spans import by_text, keyed, merged_spans, wider, with_spans

U = np.uint64
#: Length of the strings that count as repeats, and of the anchors, in bytes.
THRESHOLD, ANCHOR = 100, 32
#: Bytes whose anchors are sought at once; rows of a batch of regions; rows of a bucket that are sorted together.
STRETCH, BATCH_ROWS, TOGETHER = 1 << 21, 100_000, 8192
#: Rows that one batch sends to one bucket; what exceeds them makes a bucket of its own.
LOCAL = 32
#: Bytes of regions that a task remembers to recognise copies at once.
REMEMBERED_BYTES = 64 << 20
#: A region's place: start * SPAN + how many more windows it has; texts are shorter than this.
SPAN = 1 << 31


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def eights(raw: bytes) -> np.ndarray:
    """The eight bytes from each place on as one big-endian digit; zeros follow the end."""
    return np.ndarray((len(raw) + 1,), ">u8", raw + bytes(8), strides=(1,))


def digit_places(size: int) -> list[int]:
    """Where the digits of eight bytes of a string begin; the last may overlap the one before."""
    return [*range(0, size - 7, 8), *([size - 8] if size % 8 and size > 8 else [])] or [0]


def names(raw: bytes, size: int) -> np.ndarray:
    """A 64-bit name of the `size` bytes from each place on."""
    digits = eights(raw).astype(np.uint64)
    n = len(raw) - size + 1
    if size < 8:
        return mixed(digits[:n] >> U(64 - 8 * size))
    out = np.full(n, U(size))
    for at in digit_places(size):
        out = mixed(out + digits[at : at + n])
    return out


def regions(pieces: list[bytes], size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the piece, anchor's name, first window start and count of further windows of every region of the pieces."""
    raw = b"".join(pieces)
    lengths = np.array([len(p) for p in pieces])
    name = names(raw, k)
    order = (mixed(name) & ~U(0xFFFFFF)) | np.arange(len(name), dtype=np.uint64)
    anchor = (sliding_least(order, size - k + 1) & U(0xFFFFFF)).astype(np.int64)
    piece, ends = np.repeat(np.arange(len(pieces)), lengths)[: len(anchor)], np.cumsum(lengths)
    start = np.flatnonzero(np.arange(len(anchor)) + size <= ends[piece])
    anchor, piece = anchor[start], piece[start]
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])) + 1
    low, high = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(start) - 1]])
    piece = piece[low]
    return piece, name[anchor[low]], start[low] - (ends - lengths)[piece], high - low


def _digits(docs: DataFrame, size: int, k: int) -> DataFrame:
    """key (the first digit's name), id, th, place and hot of every region.

    Of equal texts in a batch only the first is read. Of many regions of one key in a batch one goes to the key, hot;
    the others share a key of their own.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, given = TaskContext.get().partitionId(), 0

        def give(out: list[list[np.ndarray]]) -> pa.RecordBatch:
            nonlocal given
            given += 1
            key, i, h, place = (np.concatenate(c) for c in zip(*out))
            order = np.argsort(key, kind="stable")
            key, i, h, place = key[order], i[order], h[order], place[order]
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size_of = np.diff(np.append(begin, len(key)))
            hot = np.repeat(size_of > LOCAL, size_of)
            own = hot.copy()
            own[begin] = False
            key = np.where(own, mixed(key + U(((task << 24) + given) * 0x9E3779B97F4A7C15 % 2**64)), key)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (key.view(np.int64), i, h, place, hot)], ["key", "id", "th", "place", "hot"])

        for batch in batches:
            out: list[list[np.ndarray]] = []
            pieces: list[bytes] = []
            marks: list[tuple[int, int, int]] = []  # id, th and place in its text of each piece
            ids, hashes, texts = (c.to_pylist() for c in batch.columns)
            seen: set[int] = set()
            held = 0

            def sought() -> None:
                piece, name, low, more = regions(pieces, size, k)
                i, h, at = (np.array(c, dtype=np.int64)[piece] for c in zip(*marks))
                out.append([name, i, h, (low + at) * SPAN + more])
                pieces.clear()
                marks.clear()

            for r in sorted(range(len(ids)), key=ids.__getitem__):
                if hashes[r] in seen:
                    continue
                seen.add(hashes[r])
                raw = texts[r].encode()
                for at in range(0, len(raw) - size + 1, STRETCH):
                    pieces.append(raw[at : at + STRETCH + size - 1])
                    marks.append((ids[r], hashes[r], at))
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

    return docs.select("id", "th", "text").mapInArrow(make, "key long, id long, th long, place long, hot boolean")


def _survivors(digits: DataFrame) -> DataFrame:
    """key, part, whole, id, th and place of the regions that are not alone in their bucket.

    Equal places of equal texts count once. whole: all rows of the bucket are in this part.
    """

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, place, th, i, hot), long, given in key_runs(batches, 4 * TOGETHER):
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1]) | (th[1:] != th[:-1])
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.add.reduceat(first, begin, dtype=np.int64)
            parted = np.logical_or.reduceat(hot, begin) | long
            group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(key))))[first]
            key, place, th, i = key[first], place[first], th[first], i[first]
            rank = np.arange(len(key)) - (np.cumsum(n) - n)[group] + given
            go = (parted | (n > 1))[group]
            columns = [key, rank // TOGETHER, ~(parted | (n > TOGETHER))[group], i, th, place]
            yield pa.RecordBatch.from_arrays([pa.array(c[go]) for c in columns], ["key", "part", "whole", "id", "th", "place"])

    by = digits.select("key", "place", "th", "id", "hot").repartition("key").sortWithinPartitions("key", "place", "th", "id")
    return by.mapInArrow(sift, "key long, part long, whole boolean, id long, th long, place long")


def _cut(survivors: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """key, part, whole, id, th, start, end and bytes of the survivors.

    A region with the bytes of an earlier one that the task remembers is settled: it has no bytes, and settled regions
    that touch are one row under a key of their own.
    """
    wanted = survivors.groupBy("id", "th").agg(F.collect_list(F.struct("place", "key", "part", "whole")).alias("wanted"))
    columns = ["key", "part", "whole", "id", "th", "start", "end", "bytes"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, int]] = {}
        weight = 0
        for batch in batches:
            rows: list[tuple] = []
            for i, h, text, places in zip(*[c.to_pylist() for c in batch.columns]):
                raw, done = text.encode(), []
                for r in sorted(places, key=lambda r: r["place"]):
                    start, more = divmod(r["place"], SPAN)
                    end = start + more + size
                    content = raw[start:end]
                    first = known.get(content)
                    if first is not None and first < (i, start):
                        if done and done[-1][1] >= start:
                            done[-1][1] = end
                        else:
                            done.append([start, end])
                        continue
                    if weight > REMEMBERED_BYTES:
                        known.clear()
                        weight = 0
                    known[content] = i, start
                    weight += len(content) + 200
                    rows.append((r["key"], r["part"], r["whole"], i, h, start, end, content))
                rows += [(i ^ start << 40, 0, True, i, h, start, end, None) for start, end in done]
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], columns)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], columns)

    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    schema = "key long, part long, whole boolean, id long, th long, start long, end long, bytes binary"
    return docs.select("id", "th", "text").join(wanted, ["id", "th"]).mapInArrow(cut, schema)


def radix_repeats(raw: bytes, start: np.ndarray, bucket: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings of `size` bytes of raw, given by start and bucket, that share their bucket and all their bytes with
    another: their places in `start`, and the numbers of their buckets after the last pass."""
    digits, live = eights(raw), np.arange(len(start))
    for at in digit_places(size):
        digit = digits[start[live] + at].astype(np.uint64)
        if size < 8:
            digit >>= U(64 - 8 * size)
        order = np.lexsort((digit, bucket))
        live, digit, bucket = live[order], digit[order], bucket[order]
        new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (digit[1:] != digit[:-1])])
        bucket = np.cumsum(new) - 1
        several = np.bincount(bucket)[bucket] > 1
        live, bucket = live[several], bucket[several]
        if not len(live):
            break
    return live, bucket


def _sorted_windows(rows: list[tuple], size: int) -> Iterator[list[np.ndarray | list]]:
    """id, th, start, end and bytes: repeats among some whole parts of buckets, which have no bytes, and the first
    windows of parts that are not whole, which have."""
    rows.sort(key=lambda r: (r[0], r[1], r[3], r[5]))
    first: dict[tuple, tuple[int, int]] = {}
    heads: list[tuple] = []
    several: dict[tuple, int] = {}
    gone: list[tuple] = []
    for r in rows:
        group = r[0], r[1]
        if first.setdefault((*group, r[7]), (r[3], r[5])) < (r[3], r[5]):
            gone.append((r[3], r[4], r[5], r[6]))
        else:
            heads.append(r)
            several[group] = several.get(group, 0) + 1
    if gone:
        yield [*map(list, zip(*gone)), [None] * len(gone)]
    heads = [r for r in heads if not r[2] or several[r[0], r[1]] > 1]
    if not heads:
        return
    number = {g: k for k, g in enumerate(several)}
    raw = b"".join(r[7] for r in heads)
    lengths = np.array([len(r[7]) for r in heads])
    n = lengths - size + 1
    owner = np.repeat(np.arange(len(heads)), n)
    offset = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
    at = (np.cumsum(lengths) - lengths)[owner] + offset
    ids, hashes, starts = (np.array([r[k] for r in heads], np.int64)[owner] for k in (3, 4, 5))
    starts = starts + offset
    live, bucket = radix_repeats(raw, at, np.array([number[r[0], r[1]] for r in heads])[owner], size)
    order = np.lexsort((starts[live], ids[live], bucket))
    live, bucket = live[order], bucket[order]
    head = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(live) else live
    head = live[np.repeat(head, np.diff(np.append(head, len(live))))]
    later = np.zeros(len(owner), bool)
    later[live] = (ids[live] > ids[head]) | ((ids[live] == ids[head]) & (starts[live] > starts[head]))
    told = np.flatnonzero(later)
    if len(told):  # windows that follow one another in a region are one span
        new = np.concatenate([[True], (told[1:] != told[:-1] + 1) | (owner[told[1:]] != owner[told[:-1]])])
        low, high = told[new], told[np.append(np.flatnonzero(new)[1:] - 1, len(told) - 1)]
        yield [ids[low], hashes[low], starts[low], starts[high] + size, [None] * len(low)]
    open_ = np.flatnonzero(~later & np.array([not r[2] for r in heads])[owner])
    for some in range(0, len(open_), 20_000):
        k = open_[some : some + 20_000]
        yield [ids[k], hashes[k], starts[k], starts[k] + size, [raw[a : a + size] for a in at[k].tolist()]]


def _compare(cuts: DataFrame, size: int) -> DataFrame:
    """id, th, start and end of what repeats, without bytes; and, with bytes, the windows still to meet other parts'."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def give() -> Iterator[pa.RecordBatch]:
            for columns in _sorted_windows(held, size):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["id", "th", "start", "end", "bytes"])

        for batch in batches:
            settled: list[tuple] = []
            for r in zip(*[c.to_pylist() for c in batch.columns]):
                if r[7] is None:
                    settled.append((*r[3:7], None))
                    continue
                if len(held) >= 4096 and r[:2] != held[-1][:2]:
                    yield from give()
                    held = []
                held.append(r)
            if settled:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*settled), kinds)], ["id", "th", "start", "end", "bytes"])
        if held:
            yield from give()

    by = cuts.repartition("key", "part").sortWithinPartitions("key", "part")
    return by.mapInArrow(compare, "id long, th long, start long, end long, bytes binary")


def repeated_strings(docs: DataFrame, size: int = THRESHOLD, text: str = "text") -> DataFrame:
    """id, th and spans (start and end, in bytes) of the texts that have strings to lose. Spans may overlap.

    A string is repeated if an equal one starts in a document with a smaller id or earlier in the same document.
    """
    if not 0 < size <= STRETCH:
        raise ValueError(f"strings of 1 to {STRETCH} bytes are compared")
    known = keyed(docs, text)
    # A text equal to one of a smaller id goes whole, by its SHA-256.
    whole = known.select("id", "th", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n")).where(F.col("n") >= size)
    copies = attach_group(whole, ["sha"], ["id"], first=(F.min("id"), F.min)).where("first < id").select("id", "th", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))
    survivors = written(_survivors(_digits(known, size, min(ANCHOR, size))), "survivors")
    found = written(_compare(_cut(survivors, known, size), size), "repeats")
    first = F.struct("id", "start")
    rest = attach_group(found.where("bytes IS NOT NULL").withColumn("at", first), ["bytes"], ["id", "start"], first=(F.min("at"), F.min)).where("at > first")
    columns = ["id", "th", "start", "end"]
    return by_text(copies.union(found.where("bytes IS NULL").select(columns)).union(rest.select(columns)))


def cut_bytes(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def whole_characters(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs drawn in to character borders, so that what is left is text."""
    out = []
    for a, b in runs:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, text: str = "text") -> DataFrame:
    """docs' own columns with _n_bytes, _n_removed, _n_spans and _kept (binary) of every row.

    Each byte covered by a string of `threshold` bytes that also starts earlier, in a document with a smaller id or in
    the same one, is removed; strings are judged on the input and never cross documents. A null text is empty. A row
    without an id is left whole and makes nothing a repeat. Rows that repeat an id are one document, equal places in
    them count as one. An empty table gives no rows. Columns of docs by the names of the added ones are replaced.
    """
    docs = docs.drop("_n_bytes", "_n_removed", "_n_spans", "_kept")
    spans = repeated_strings(docs, threshold, text)
    columns = docs.columns
    at = columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, some in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist()):
                raw, runs = (t or "").encode(), merged_spans(some)
                rows.append((len(raw), sum(b - a for a, b in runs), len(runs), cut_bytes(raw, runs)))
            if rows:
                added = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *added], [*columns, "_n_bytes", "_n_removed", "_n_spans", "_kept"])

    return with_spans(docs, spans, text).mapInArrow(cut, wider(docs, "_n_bytes long, _n_removed long, _n_spans long, _kept binary"))


def removed_documents(docs: DataFrame, threshold: int = THRESHOLD, text: str = "text") -> DataFrame:
    """docs with repeats cut out of their texts (whole characters only) and n_chars, if there, counted anew."""
    spans = repeated_strings(docs, threshold, text)
    columns = docs.columns
    at, length = columns.index(text), columns.index("n_chars") if "n_chars" in columns else -1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str | None] = []
            for t, some in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist()):
                if some:
                    raw = t.encode()
                    t = cut_bytes(raw, whole_characters(raw, merged_spans(some))).decode()
                texts.append(t)
            arrays = list(batch.columns[: len(columns)])
            arrays[at] = pa.array(texts, arrays[at].type)
            if length >= 0:
                arrays[length] = pa.array([None if t is None else len(t) for t in texts], arrays[length].type)
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return with_spans(docs, spans, text).mapInArrow(cut, docs.schema)
