"""Words of Arrow text columns as numpy arrays, and small shared helpers.

A word is a run of bytes other than space and 0x09-0x0D. Texts are UTF-8, so no
multi-byte character holds such a byte. Everything works on pieces of about a
megabyte, one whole text at least.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import files

PIECE_BYTES = 1 << 20

_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ORDER = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.ones(1, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        out = np.full(max(n, 256), _BASE, dtype=np.uint64)
        out[0] = 1
        _POWERS = np.multiply.accumulate(out)
    return _POWERS


class Words:
    """The words of consecutive documents: ``doc`` (row of each word), byte ``starts``
    and ``ends``, and ``first`` (index of each document's first word, with a final end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        inside = np.empty(len(data) + 1, dtype=bool)
        inside[:-1] = ~_GAP[data]
        inside[-1] = False
        begins = inside[:-1].copy()
        begins[1:] &= ~inside[:-2]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        begins[edges] = inside[edges]
        stops = inside[:-1] & ~inside[1:]
        stops[edges - 1] = inside[edges - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same wherever the word stands."""
        out = np.empty(len(self), dtype=np.uint64)
        lengths = self.ends - self.starts
        cuts = np.searchsorted(np.cumsum(lengths), np.arange(1 << 20, int(lengths.sum()) + 1, 1 << 20))
        cuts = np.unique(np.concatenate([[0], cuts + 1, [len(self)]]).clip(0, len(self)))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            size = lengths[lo:hi]
            at = np.concatenate([[0], np.cumsum(size)])
            inner = np.arange(at[-1]) - np.repeat(at[:-1], size)
            where = inner + np.repeat(self.starts[lo:hi], size)
            terms = (self.data[where].astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()))[inner]
            out[lo:hi] = np.add.reduceat(terms, at[:-1])
        return mix(out + lengths.astype(np.uint64))

    def text(self, keep: np.ndarray) -> bytes:
        """The words numbered by ``keep``, joined by one space."""
        raw = self._raw
        return b" ".join([raw[a:b] for a, b in zip(self.starts[keep].tolist(), self.ends[keep].tolist(), strict=True)])

    @cached_property
    def _raw(self) -> bytes:
        return self.data.tobytes()


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the run of ``size`` words that starts at each word (the last few missing)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        out *= _ORDER
        out += words[i : i + n]
    return mix(out)


def pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``lo:hi`` of a batch with their bytes and offsets, about a megabyte at a
    time (one text at least). A null text counts as an empty one."""
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32) if offsets else np.zeros(1, np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    lo, n = 0, len(texts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE_BYTES, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def carried(docs: DataFrame) -> Column:
    """All columns but ``text`` as one, ``row``, so that their names meet no others."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")


def restored(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, from ``row`` and ``text``."""
    return [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one is made for a local session only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex[:12]}")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost
    executor loses nothing. Zstandard frees its buffers with the file; those of Snappy lie outside
    the heap until a collection."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote, once its last reader is done."""
    for table in tables:
        files.delete(table.sparkSession, table._stored_at)
