"""Words of other character classes: runs of chosen bytes in Arrow text columns.

Bytes from 0x80 on always belong to a run, so no UTF-8 character is cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidemark.llm.text import _LOWER, Words


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Which bytes belong to a run: the ranges (both ends count) and 0x80-0xFF."""
    inside = np.zeros(256, bool)
    inside[0x80:] = True
    for first, last in ranges:
        inside[first : last + 1] = True
    return inside


class Runs(Words):
    """Like ``Words``, for runs of the bytes in ``kind``; A-Z are lower-cased first."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        self.data = _LOWER[data]
        self.offsets = offsets
        self.inside = kind[self.data]
        before = np.zeros(len(data), bool)
        before[1:] = self.inside[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = self.inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        before[edges] = False
        after[edges - 1] = False
        self.starts = np.flatnonzero(self.inside & ~before)
        self.ends = np.flatnonzero(self.inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def strings(self) -> pa.LargeStringArray:
        """The runs as Arrow strings, in order."""
        bounds = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int64)
        data = np.ascontiguousarray(self.data[self.inside])
        return pa.LargeStringArray.from_buffers(len(self), pa.py_buffer(bounds), pa.py_buffer(data))
