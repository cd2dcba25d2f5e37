"""A Bloom filter of integer keys, made where the keys are and bounded in size.

A filter only spares work: what it lets through by mistake is sorted out by an exact step
that follows. Beyond ``MAX_BITS`` it lets more through, and stays correct.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.text import mix

SLICE_BITS = 1 << 19
MAX_BITS = 1 << 28
BITS_PER_KEY = 12
PROBES = 4


def _probe(keys: np.ndarray, slices: int) -> tuple[np.ndarray, list[np.ndarray]]:
    h = mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    where = (h >> np.uint64(32)) % np.uint64(slices)
    return where.astype(np.int64), [
        (mix(keys + np.uint64(i)) >> np.uint64(45)).astype(np.int64) for i in range(1, PROBES + 1)
    ]  # 19 bits each


class Filter:
    """A Bloom filter in slices of 64 KB; a key has all its bits in one slice."""

    def __init__(self, slices: int, bits: np.ndarray):
        self.slices, self.bits = slices, bits

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key], np.uint64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        if self.slices == 0:
            return np.zeros(len(keys), bool)
        where, places = _probe(keys, self.slices)
        out = np.ones(len(keys), bool)
        for place in places:
            at = where * SLICE_BITS + place
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def build_filter(keys: DataFrame, n: int) -> Filter:
    """Filter of the one long column of ``keys``, sized for ``n`` of them up to ``MAX_BITS``. Every slice is made
    where its keys are; the driver only puts the slices side by side."""
    if n == 0:
        return Filter(0, np.empty(0, np.uint8))
    slices = min(MAX_BITS // SLICE_BITS, max(1, math.ceil(n * BITS_PER_KEY / SLICE_BITS)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            where, _ = _probe(keys.astype(np.uint64), slices)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(where.astype(np.int32))], names=["key", "slice"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            where, places = _probe(keys, slices)
            for one in np.unique(where).tolist():
                bits = made.setdefault(one, np.zeros(SLICE_BITS, bool))
                for at in places:
                    bits[at[where == one]] = True
        for one, bits in made.items():
            packed = np.packbits(bits, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([one], pa.int32()), pa.array([packed], pa.binary())], names=["slice", "bits"])

    placed = keys.toDF("key").mapInArrow(place, "key long, slice int").repartition("slice")
    out = np.zeros(slices * SLICE_BITS // 8, np.uint8)
    for row in placed.mapInArrow(fill, "slice int, bits binary").toLocalIterator():
        at = row["slice"] * SLICE_BITS // 8
        out[at : at + SLICE_BITS // 8] |= np.frombuffer(row["bits"], np.uint8)
    return Filter(slices, out)
