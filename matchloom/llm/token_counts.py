"""Token counts by a whole-token shortcut: pre-tokens proven to be one token count directly, only the rest is merged."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_cache

#: White space as the tokenizer's pattern language has it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pre-token pattern of the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The steps before the merges that are reproduced here; of files with other steps nothing is known.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
    "padding": None,
}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
FLAGS = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}
#: Pre-tokens remembered by a worker; beyond this many the table starts anew.
REMEMBERED = 700_000


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordCounter:
    """Counts as the tokenizer file's library does, without begin, end or added special tokens."""

    def __init__(self, source: str, proven: tuple[dict[str, int], str] | None = None):
        """proven: what prove() and strange_letters() give, if it is known already."""
        from tokenizers import Tokenizer

        config = json.loads(source)
        told = {k: config[k] for k in STEPS} | {"model": {k: config["model"].get(k) for k in MODEL}}
        for name, want in (STEPS | {"model": MODEL}).items():
            if told[name] != want:
                raise ValueError(f"a tokenizer of another build: its {name} is {told[name]}, not {want}")
        for x in config["added_tokens"]:
            if {k: x[k] for k in FLAGS} != FLAGS:
                raise ValueError(f"a tokenizer of another build: added token {x}")
        tokenizer = Tokenizer.from_str(source)
        self.model, self.normalized, self.parted = tokenizer.model, tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.letters = byte_letters()
        specials = [x["content"] for x in config["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.pattern = regex.compile(PATTERN.replace(r"\s", SPACE))
        self.suffix = MODEL["end_of_word_suffix"]
        self.whole, self.strange = proven or (self.prove(config["model"]["vocab"]), self.strange_letters())
        self.is_plain = frozenset(self.strange).isdisjoint
        self.known: dict[str, int] = dict(self.whole)

    def merged(self, word: str) -> int:
        return len(self.model.tokenize("".join(map(self.letters.__getitem__, word.encode()))))

    def prove(self, vocab: dict[str, int]) -> dict[str, int]:
        """The vocabulary strings that, as pre-tokens, encode alone to their own single token: each is put to the proof."""
        back = {c: b for b, c in self.letters.items()}
        whole = {}
        for piece in vocab:
            if not piece.endswith(self.suffix):
                continue
            try:
                word = bytes(back[c] for c in piece[: len(piece) - len(self.suffix)]).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if word and self.merged(word) == 1:
                whole[word] = 1
        return whole

    def strange_letters(self) -> str:
        """The characters that the pattern takes for letters, numbers or white space where the library does not, or the
        other way round: their tables are of different versions of Unicode."""
        out: set[str] = set()
        for low in range(0x80, 0x110000, 1024):
            letters = [chr(c) for c in range(low, min(low + 1024, 0x110000)) if not 0xD800 <= c < 0xE000]
            for side in "!a":
                text = "".join([side, *letters, side])
                if len(self.parted(text)) == 1 and len(self.pattern.findall(text)) == 1:  # all signs or all letters, to both
                    letters = []
            text = " ".join(f"a{c}b !{c}!" for c in letters)
            theirs, ours = {span for _, span in self.parted(text)}, {m.span() for m in self.pattern.finditer(text)}
            out |= {letters[a // 8] for a, _ in theirs ^ ours}
        return "".join(sorted(out))

    def plain(self, text: str) -> int:
        # The library's own normalizer: its Unicode tables may be another version's. ASCII needs none of it.
        text = text.lower() if text.isascii() else self.normalized(text)
        if not text.isascii() and not self.is_plain(text):
            return sum(len(self.model.tokenize(piece)) for piece, _ in self.parted(text))
        found = self.pattern.findall(text)
        try:
            return sum(map(self.known.__getitem__, found))
        except KeyError:
            if len(self.known) > REMEMBERED:
                self.known = dict(self.whole)
            n, known = 0, self.known
            for word in found:
                k = known.get(word)
                if k is None:
                    k = self.merged(word)
                    if len(word) < 64:
                        known[word] = k
                n += k
            return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        return sum(map(self.plain, self.special.split(text))) + len(self.special.findall(text))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs; a null text counts as empty.

    tokenizer: path of a tokenizer file. The driver reads it and proves, once, which strings of the vocabulary are one
    token; both are sent to the executors (their size is the vocabulary's). A text of any length is counted in one pass.
    Rows are independent: repeated rows and null ids stay as they are, an empty table gives no rows.
    """
    with open(tokenizer, encoding="utf-8") as file:
        text_of = file.read()
    counter_ = WordCounter(text_of)
    given = docs.sparkSession.sparkContext.broadcast((text_of, (counter_.whole, counter_.strange)))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = worker_cache("word_counters")
        source, proven = given.value
        key = hash(source)
        counter = made.get(key) or made.setdefault(key, WordCounter(source, proven))
        for batch in batches:
            n = [counter.count(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    t = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(t).cast("long").alias("n_bytes"), t.alias("t"))
    return read.mapInArrow(counts, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
