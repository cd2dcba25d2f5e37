"""Minimal acyclic transducers: sorted terms to their lexicographic ordinals and back.

Every state knows how many terms end below it; the arcs skipped on the way add up to the
ordinal of a term, so the automaton is a vocabulary and a perfect hash in one.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard


def build(terms: Iterable[bytes]) -> bytes:
    """The packed transducer of ``terms``, which are distinct and in byte order. States are
    made minimal while terms are added: what can no longer change is shared at once."""
    known: dict[tuple, int] = {}
    below: list[int] = []
    # the path of the last term: whether its states are final, and their arcs so far
    final, arcs, last = [False], [[]], b""

    def freeze(depth: int) -> None:
        while len(final) > depth + 1:
            key = (final.pop(), *arcs.pop())
            state = known.get(key)
            if state is None:
                state = known[key] = len(known)
                below.append(key[0] + sum(below[arc & 0xFFFFFFFF] for arc in key[1:]))
            arcs[-1].append(last[len(final) - 1] << 32 | state)

    for term in terms:
        depth, most = 0, min(len(last), len(term))
        while depth < most and last[depth] == term[depth]:
            depth += 1
        freeze(depth)
        for _ in range(len(term) - depth):
            final.append(False)
            arcs.append([])
        final[-1] = True
        last = term
    freeze(0)
    states = [*known, (final[0], *arcs[0])]  # the root is the last one
    below.append(states[-1][0] + sum(below[arc & 0xFFFFFFFF] for arc in states[-1][1:]))
    flat = np.fromiter((arc for state in states for arc in state[1:]), np.int64)
    head = np.array([len(states), len(flat)], "<i8")
    parts = (
        head, np.array([state[0] for state in states], "u1"), np.array([len(state) - 1 for state in states], "<i4"),
        np.array(below, "<i4"), (flat >> 32).astype("u1"), (flat & 0xFFFFFFFF).astype("<i4"),
    )
    return zstandard.compress(b"".join(p.tobytes() for p in parts), 3)


class Transducer:
    def __init__(self, packed: bytes):
        raw, at = zstandard.decompress(packed), 16
        states, n = np.frombuffer(raw, "<i8", 2).tolist()

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            values = np.frombuffer(raw, kind, count, at)
            at += values.nbytes
            return values

        self.final, sizes, self.below = take("u1", states).astype(bool), take("<i4", states), take("<i4", states)
        self.label, self.target = take("u1", n), take("<i4", n)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.root, self.size = states - 1, int(self.below[-1])
        # dense tables over the bytes in use: next state, and terms skipped by the step
        used, column = np.unique(self.label, return_inverse=True)
        self.column = np.full(256, len(used), np.int64)
        self.column[used] = np.arange(len(used))
        source = np.repeat(np.arange(states), sizes)
        counts = np.concatenate([[0], np.cumsum(self.below[self.target])])
        skipped = counts[:-1] - counts[self.first[source]] + self.final[source]
        self.next = np.full((states, len(used) + 1), -1, np.int32)
        self.skip = np.zeros((states, len(used) + 1), np.int32)
        self.next[source, column] = self.target
        self.skip[source, column] = skipped

    def ordinals(self, words: pa.Array) -> np.ndarray:
        """Ordinal of each word, -1 where it is not a term. All words step side by side."""
        words = words.cast(pa.large_binary())
        _, bounds, data = words.buffers()
        bounds = np.frombuffer(bounds, np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        out = np.full(len(words), -1, np.int64)
        row, at, end = np.arange(len(words)), bounds[:-1], bounds[1:]
        state, total = np.full(len(words), self.root), np.zeros(len(words), np.int64)
        while len(row):
            done = at == end
            hit = done & self.final[state]
            out[row[hit]] = total[hit]
            row, at, end, state, total = (x[~done] for x in (row, at, end, state, total))
            byte = self.column[data[at]]
            total = total + self.skip[state, byte]
            state = self.next[state, byte]
            alive = state >= 0
            row, at, end, state, total = (x[alive] for x in (row, at + 1, end, state, total))
        return out

    def terms(self) -> list[bytes]:
        """All terms in order."""
        out, stack = [], [(self.root, b"")]
        final, first, label, target = self.final.tolist(), self.first.tolist(), self.label.tolist(), self.target.tolist()
        while stack:
            state, prefix = stack.pop()
            if final[state]:
                out.append(prefix)
            for arc in range(first[state + 1] - 1, first[state] - 1, -1):
                stack.append((target[arc], prefix + bytes((label[arc],))))
        return out
