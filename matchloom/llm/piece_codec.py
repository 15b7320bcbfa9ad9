"""Encoding with merge-type piece models by backtracking, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_cache

SPACE = "▁"
#: Chunks and pairs remembered by a worker; beyond so many a table starts anew. Bytes that are given out at once.
CHUNKS, REMEMBERED, GIVEN_BYTES = 600_000, 300_000, 16 << 20


class ChunkIds(dict):
    """Ids of chunks, in little-endian 32 bits, worked out once each."""

    def __init__(self, codec: PieceCodec):
        self.codec = codec

    def __missing__(self, chunk: str) -> bytes:
        packed = array("I", self.codec.chunk_ids(chunk)).tobytes()
        if len(chunk) < 64:
            if len(self) >= CHUNKS:
                self.clear()
            self[chunk] = packed
        return packed


class PieceCodec:
    """The ids that the model's library gives, without sampling.

    A text is encoded in chunks between which no piece reaches. In a chunk the longest matching piece is taken at
    each place, as Aho-Corasick finds them; a piece may follow another if merging their joined text gives just these
    two. Where nothing fits, the last piece is shortened or taken back, and a bit says that its end leads nowhere.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        spm = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bos, self.eos = spm.bos_id(), spm.eos_id()
        self.piece = [spm.id_to_piece(i) for i in range(spm.get_piece_size())]
        usual = [i for i in range(len(self.piece)) if not (spm.is_control(i) or spm.is_unknown(i) or spm.is_byte(i) or spm.is_unused(i))]
        self.id = {self.piece[i]: i for i in usual}
        self.score = {self.piece[i]: spm.get_score(i) for i in usual}
        self.byte_id = {int(self.piece[i][1:-1], 16): i for i in range(len(self.piece)) if spm.is_byte(i)}
        self.bytes_of = [b""] * len(self.piece)
        for p, i in self.id.items():
            self.bytes_of[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte_id.items():
            self.bytes_of[i] = bytes([b])
        if not self.byte_id or any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a model with byte pieces and no space inside a piece is expected")
        self.letters = {c for p in self.id for c in p}
        # A piece that shares its score with another leaves the order of merges to the places: these are merged plainly.
        seen: dict[float, int] = {}
        for s in self.score.values():
            seen[s] = seen.get(s, 0) + 1
        tied = [p for p, s in self.score.items() if seen[s] > 1 and len(p) > 1]
        self.tied = [p for p in tied if not any(q != p and q in p for q in tied)]
        self.finder = ahocorasick.Automaton()
        for p in self.id:
            if self.merged(p) == [p]:
                self.finder.add_word(p, len(p))
        self.finder.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.grown: dict[str, tuple] = {}
        alone = "".join(map(re.escape, "".join(c for c in "\n\t" if all(c not in p or p == c for p in self.id))))
        self.chunks = re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.known = ChunkIds(self)

    def merged(self, text: str, log: list[tuple[float, int, int, str]] | None = None) -> list[str]:
        """Plain merging: the best score first, the leftmost of equals. log takes each merge: the score's negative, where
        its left and its right part begin, and what comes of them."""
        parts: list[str] = list(text)
        if len(parts) < 2:
            return parts
        after, before, heap = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)], []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, len(parts[i]) + len(parts[j]), j))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            worth, i, size, j = heapq.heappop(heap)
            if not parts[i] or not parts[j] or after[i] != j or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i], parts[j] = parts[i] + parts[j], ""
            if log is not None:
                log.append((worth, i, j, parts[i]))
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p]

    def edges(self, piece: str) -> tuple[bool, list[tuple[str, float]], list[tuple[str, float]]]:
        """How a piece comes about when merged alone: whether its merges follow one another in order of their scores, and
        what stands at its end and at its begin in turn, each with the score's negative of the merge that takes it up."""
        if (known := self.grown.get(piece)) is None:
            log: list[tuple[float, int, int, str]] = []
            self.merged(piece, log)
            last, first, end, begin, at = piece[-1], piece[0], [], [], len(piece) - 1
            for worth, i, j, joined in log:
                if j == at:
                    end.append((last, worth))
                    last, at = joined, i
                if i == 0:
                    begin.append((first, worth))
                    first = joined
            in_order = all(a[0] <= b[0] for a, b in zip(log, log[1:]))
            known = self.grown[piece] = in_order, [*end, (last, inf)], [*begin, (first, inf)]
        return known

    def may_follow(self, left: str, right: str) -> bool:
        """Whether merging the joined text of two pieces gives just these two: no merge across their border comes before
        the merges that take up what stands at it. Of equal scores the leftmost merge is first."""
        key = (left, right)
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > REMEMBERED:
                self.fits.clear()
            known = self.fits[key] = self.remerged(left, right)
        return known

    def remerged(self, left: str, right: str) -> bool:
        plain, ends, _ = self.edges(left)
        plain_too, _, begins = self.edges(right)
        if not (plain and plain_too):  # merges out of order: the whole is merged
            return self.merged(left + right) == [left, right]
        i = j = 0
        while True:
            (a, taken), (b, taken_too) = ends[i], begins[j]
            score = self.score.get(a + b)
            if score is not None and -score < taken and -score <= taken_too:
                return False
            if taken <= taken_too:
                if taken == inf:
                    return True
                i += 1
            else:
                j += 1

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a text all of whose letters are pieces."""
        n = len(text)
        lengths: list[list[int]] = [[] for _ in range(n)]
        for end, size in self.finder.iter(text):
            lengths[end + 1 - size].append(size)  # shorter ones end first: each list is in ascending order
        failed, taken, at, choice = bytearray(n // 8 + 1), [], 0, len(lengths[0]) - 1
        while True:
            while choice >= 0:
                end = at + lengths[at][choice]
                if not failed[end >> 3] >> (end & 7) & 1 and (not taken or self.may_follow(text[taken[-1][0] : at], text[at:end])):
                    break
                choice -= 1
            if choice >= 0:
                taken.append((at, choice))
                at = end
                if at == n:
                    return [text[i : i + lengths[i][c]] for i, c in taken]
                choice = len(lengths[at]) - 1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at, choice = taken.pop()
                choice -= 1

    def chunk_ids(self, chunk: str) -> list[int]:
        if any(p in chunk for p in self.tied):
            pieces = self.merged(chunk)
        elif self.letters.issuperset(chunk):
            pieces = self.backtrack(chunk)
        else:  # letters without a piece end every merge
            pieces, run = [], ""
            for c in [*chunk, ""]:
                if c in self.letters:
                    run += c
                    continue
                pieces += self.backtrack(run) if run else []
                pieces += [c] if c else []
                run = ""
        ids: list[int] = []
        for p in pieces:
            ids += [self.id[p]] if p in self.id else [self.byte_id[b] for b in p.encode()]
        return ids

    def decode_bytes(self, ids) -> bytes:
        """What ids stand for, one after another; begin and end stand for nothing."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def packed(self, text: str) -> bytes:
        """A text's ids in little-endian 32 bits, without begin and end."""
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def split(self, text: str) -> list[str]:
        return self.chunks(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [self.bos, *array("I", self.packed(text)), self.eos]

    def decode(self, ids) -> bytes:
        """The decoded text in UTF-8; the space put before the text goes."""
        raw = self.decode_bytes(ids)
        return raw[1:] if raw[:1] == b" " else raw


def code(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs; keep adds ids, decoded or both.

    model: path of the model file, read by the driver and sent to the executors (its size is the vocabulary's). A
    null text counts as empty: begin and end only. Texts are coded whole, whatever their length, from ids to text as
    from text to ids. Repeated rows and null ids stay; an empty table gives no rows.
    """
    with open(model, "rb") as file:
        source = docs.sparkSession.sparkContext.broadcast(file.read())
    kinds = {"doc_id": "long", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | {k: {"ids": "array<int>", "decoded": "string"}[k] for k in keep}

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = worker_cache("piece_codecs")
        key = hash(source.value)
        codec = made.get(key) or made.setdefault(key, PieceCodec(source.value))
        begin, end = array("I", [codec.bos]).tobytes(), array("I", [codec.eos]).tobytes()

        def rows(doc_ids: pa.Array, ids: list[bytes], raw: list[bytes]) -> pa.RecordBatch:
            n = np.array([len(x) // 4 for x in ids])
            digest = lambda blobs: pa.array([hashlib.sha256(x).hexdigest() for x in blobs], pa.string())
            columns = {"doc_id": doc_ids, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": digest(ids), "decoded_sha256": digest(raw)}
            if "ids" in keep:
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                columns["ids"] = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), np.int32)))
            if "decoded" in keep:
                columns["decoded"] = pa.array([x.decode(errors="replace") for x in raw], pa.string())
            return pa.RecordBatch.from_arrays([columns[k] for k in kinds], list(kinds))

        for batch in batches:
            ids, raw, first, weight = [], [], 0, 0
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids.append(b"".join((begin, codec.packed(t or ""), end)))
                raw.append(codec.decode(array("I", ids[-1])))
                weight += len(ids[-1]) + len(raw[-1])
                if weight > GIVEN_BYTES:
                    yield rows(batch.column(0).slice(first, i + 1 - first), ids, raw)
                    ids, raw, first, weight = [], [], i + 1, 0
            if ids:
                yield rows(batch.column(0).slice(first), ids, raw)

    schema = ", ".join(f"{c} {k}" for c, k in kinds.items())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(coded, schema)
