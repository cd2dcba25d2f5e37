"""Exact byte-level BPE by backtracking, and decoding by an offset table.

A text is cut at added tokens, then into pieces by the usual pattern. Within a piece an
Aho-Corasick automaton over the vocabulary finds the longest token at every place. The
encoder goes left to right with longest tokens; a token may follow another only if the
merge rules would leave the two side by side (the pair-compatibility table), else a
shorter one is tried, and where none fits it steps back over the last token. Each place
is given up at most once, so the time is linear in the text. Decoding looks up start and
length of every token in one byte string.

Nothing depends on other rows. A null text is an empty one: no tokens, an empty decoded
text. Repeated rows are encoded one by one, other columns are not read, texts are encoded
whole. Frequent pieces are remembered in a table of bounded size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

# fixed value: the pre-tokenizing pattern of byte-level BPE
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 1 << 17
LONGEST_REMEMBERED = 64


def _visible() -> dict[str, int]:
    """The byte that each printable stand-in of a vocabulary file means."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec(dict):
    """Encoder of one vocabulary. As a mapping: piece -> its ids as bytes.

    Inside, tokens are numbered by merge order: bytes 0 to 255, then one per merge.
    """

    def __init__(self, file: bytes):
        super().__init__()
        self.older: dict[str, bytes] = {}
        spec = json.loads(file)
        model, byte_of = spec["model"], _visible()
        if model["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level BPE file without normalizer or prefix space is needed")
        raw = lambda token: bytes(byte_of[c] for c in token)
        outer = {raw(token): i for token, i in model["vocab"].items()}
        self.tokens = [bytes([b]) for b in range(256)]
        number = {t: i for i, t in enumerate(self.tokens)}
        self.left, self.right, self.merged = list(range(256)), list(range(256)), {}
        for merge in model["merges"]:
            a, b = (number[raw(x)] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            token = self.tokens[a] + self.tokens[b]
            if token not in number:
                number[token] = len(self.tokens)
                self.tokens.append(token)
                self.left.append(a)
                self.right.append(b)
            self.merged.setdefault((a, b), number[token])
        self.outer = [outer[t] for t in self.tokens]
        self.shorter = [next((number[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in number), -1) for t in self.tokens]
        self.fits: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self.automaton.make_automaton()
        self.pattern = regex.compile(PIECE)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added = {text: np.array([i], "<u4").tobytes() for text, i in added.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merge rules leave ``a`` and ``b`` side by side: no merge across the
        border comes before those that build the two tokens."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 4 * REMEMBERED:
                self.fits.clear()
            known = self.fits[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        before = len(self.tokens)  # merges across the border count if their number is below
        while True:
            if self.merged.get((a, b), before) < before:
                return False
            # take apart whichever of the two was built later
            for part in ("a", "b") if a > b else ("b", "a"):
                if part == "a" and a > 255:
                    before, a = a, self.right[a]
                    break
                if part == "b" and b > 255:
                    before, b = b + 1, self.left[b]
                    break
            else:
                return True

    def pieces_ids(self, piece: bytes) -> list[int]:
        """Token numbers of one piece."""
        n = len(piece)
        longest = [-1] * n
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = token
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + len(self.tokens[token])
            if open_[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:  # no token fits here: give the place up and shorten the one before
                open_[at] = 0
                token = out.pop()
                at -= len(self.tokens[token])

    def forget(self) -> None:
        """Give back the memory of remembered pieces and pairs."""
        self.clear()
        self.older = {}
        self.fits = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            outer = self.outer
            numbers = [outer[t] for t in self.pieces_ids(piece.encode("utf-8"))]
            ids = pack(f"<{len(numbers)}I", *numbers)
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:  # pieces not met again since the last turn are forgotten
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        if self.cut is None or not self.cut.search(text):
            return b"".join([self[p] for p in self.pattern.findall(text)])
        parts = self.cut.split(text)
        return b"".join([self.added[p] if i % 2 else b"".join([self[x] for x in self.pattern.findall(p)]) for i, p in enumerate(parts)])


class Table:
    """Decoder of one vocabulary: all tokens in one byte string, with offsets and lengths."""

    def __init__(self, file: bytes):
        spec, byte_of = json.loads(file), _visible()
        table = {i: bytes(byte_of[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        table |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        parts = [table.get(i, b"") for i in range(max(table) + 1)]
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.lengths = np.array([len(p) for p in parts])
        self.offsets = np.cumsum(self.lengths) - self.lengths

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters."""
        numbers = np.frombuffer(ids, "<u4")
        sizes = self.lengths[numbers]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.offsets[numbers] - (ends - sizes), sizes)
        return self.blob[np.arange(len(shift)) + shift].tobytes().decode("utf-8", "replace")


_MADE: dict[tuple[type, int], object] = {}


def _made(kind: type, file: bytes):
    """A ``Codec`` or ``Table`` of the vocabulary, built once per worker process."""
    key = kind, hash(file)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = kind(file)
    return _MADE[key]


def _vocabulary(spark: SparkSession, path: str):
    """The file's bytes for all tasks (a vocabulary of some 50,000 tokens: 2-4 MB)."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian 32-bit integers) of every row."""
    file = _vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _made(Codec, file.value)
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.slice(lo, 1000)
                ids = [codec.encode(text or "") for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
        codec.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the decoded ``text``."""
    file = _vocabulary(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _made(Table, file.value)
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.slice(lo, 1000)
                texts = [table.decode(ids) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, text string")
