"""License scan: a generalised suffix automaton of license templates.

Words are runs of 0-9, a-z (A-Z are lower-cased) and bytes from 0x80 on. All templates go into
one suffix automaton over words; its states know the template places where their strings end.
Files stream through it: at each word the matching statistics give the longest run of words up
to there that stands in any template. Runs of ``LONG`` words or more that cannot be extended are
chained: matches in the order of a template, at most ``GAP`` words apart in the file, cover a
span of it. A span that covers at least ``COVER`` of a template's words gives its label.

The phrases of the base are templates too; each of their places is found by the same walk, as
the end of a phrase is a suffix of the match there. The automaton is made of constants (some
thousand words) and is built once per worker; nothing is shuffled.

Only words of two known neighbours enter the walk: any match of two words or more lies in such a
stretch. Words are compared by 64-bit hashes. Spans of one template do not overlap. A chain never
crosses documents, and its work grows with the matches times the logarithm of the template.

Rows: one per row of the input, repeated rows and ids included; a null or empty text, or one
without words, has no places, empty labels and score 0; other columns go no further; an empty
table gives no rows. Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.runs import Runs, byte_class
from tidemark.llm.text import pieces

WORD = byte_class((0x30, 0x39), (0x61, 0x7A))
LONG = 3
GAP = 12
COVER = 0.75

# fixed values: phrases of the base, and notices of public licenses with their labels
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software
        and associated documentation files the software to deal in the software without restriction including
        without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
        of the software and to permit persons to whom the software is furnished to do so subject to the following
        conditions the above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the software"""),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee
        is hereby granted provided that the above copyright notice and this permission notice appear in all copies"""),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted
        provided that the following conditions are met redistributions of source code must retain the above
        copyright notice this list of conditions and the following disclaimer redistributions in binary form must
        reproduce the above copyright notice this list of conditions and the following disclaimer in the
        documentation and or other materials provided with the distribution"""),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the
        authors be held liable for any damages arising from the use of this software permission is granted to
        anyone to use this software for any purpose including commercial applications and to alter it and
        redistribute it freely subject to the following restrictions"""),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", """licensed under the apache license version 2 0 the license you may not use this file except in
        compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0
        unless required by applicable law or agreed to in writing software distributed under the license is
        distributed on an as is basis without warranties or conditions of any kind either express or implied see
        the license for the specific language governing permissions and limitations under the license"""),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu
        general public license as published by the free software foundation either version 3 of the license or at
        your option any later version"""),
    ("lgpl", """this library is free software you can redistribute it and or modify it under the terms of the gnu
        lesser general public license as published by the free software foundation either version 2 1 of the
        license or at your option any later version"""),
    ("agpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu
        affero general public license as published by the free software foundation either version 3 of the license
        or at your option any later version"""),
    ("mpl", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the
        mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"""),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy
        modify publish use compile sell or distribute this software either in source code form or as a compiled
        binary for any purpose commercial or non commercial and by any means"""),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
)


class Places:
    """A generalised suffix automaton of token sequences. ``ends`` of a state are the (template,
    position) pairs where its strings end."""

    def __init__(self, sequences: list[list[int]]):
        self.moves: list[dict[int, int]] = [{}]
        self.up, self.size = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            state = 0
            for position, token in enumerate(sequence):
                state = self._append(state, token)
                self.ends[state].add((number, position))
        for state in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):
            self.ends[self.up[state]] |= self.ends[state]

    def _new(self, size: int, moves: dict[int, int], up: int) -> int:
        self.size.append(size)
        self.moves.append(moves)
        self.up.append(up)
        self.ends.append(set())
        return len(self.size) - 1

    def _append(self, state: int, token: int) -> int:
        grown = self.size[state] + 1
        there = self.moves[state].get(token)
        if there is not None and self.size[there] == grown:
            return there
        fresh = None if there is not None else self._new(grown, {}, 0)
        walk = state
        while walk >= 0 and token not in self.moves[walk]:
            self.moves[walk][token] = fresh
            walk = self.up[walk]
        if walk < 0:
            return fresh
        target = self.moves[walk][token]
        if self.size[target] != self.size[walk] + 1:
            half = self._new(self.size[walk] + 1, dict(self.moves[target]), self.up[target])
            self.up[target] = half
            while walk >= 0 and self.moves[walk].get(token) == target:
                self.moves[walk][token] = half
                walk = self.up[walk]
            target = half
        if fresh is None:
            return target
        self.up[fresh] = target
        return fresh

    def walk(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: state and length of the longest match that ends at each token."""
        state = length = 0
        for token in tokens:
            while state and token not in self.moves[state]:
                state = self.up[state]
                length = self.size[state]
            state = self.moves[state].get(token, 0)
            length = length + 1 if state else 0
            yield state, length


class Scanner:
    """The automaton of phrases and templates with its vocabulary, and the scan of one text."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        texts = [text for _, text in (*phrases, *templates)]
        self.labels = [label for label, _ in (*phrases, *templates)]
        self.phrases = len(phrases)
        raw = [" ".join(t.split()).encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        words = Runs(np.frombuffer(b"".join(raw), np.uint8), offsets, WORD)
        self.known, tokens = np.unique(words.hashes(), return_inverse=True)
        self.sequences = [tokens[a:b].tolist() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        self.places = Places(self.sequences)
        pairs = {a * len(self.known) + b for s in self.sequences for a, b in zip(s[:-1], s[1:], strict=True)}
        self.pairs = np.array(sorted(pairs))
        self.ending = self._phrases_ending()

    def _phrases_ending(self) -> list[tuple[tuple[int, int], ...]]:
        """For each state the phrases (number, words) that end where its strings end, if the match is long enough."""
        out: list[tuple[tuple[int, int], ...]] = [()] * len(self.places.size)
        for number in range(self.phrases):
            *_, (state, length) = self.places.walk(self.sequences[number])
            out[state] += ((number, length),)
        # the strings of a state end in those of the state above it
        for state in sorted(range(1, len(out)), key=lambda s: self.places.size[s]):
            out[state] += out[self.places.up[state]]
        return out

    def stretches(self, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens (-1: unknown), and first and last word of the runs of known neighbours of one document."""
        at = np.searchsorted(self.known, hashes).clip(max=len(self.known) - 1)
        token = np.where(self.known[at] == hashes, at, -1)
        pair = token[:-1] * len(self.known) + token[1:]
        near = self.pairs[np.searchsorted(self.pairs, pair).clip(max=len(self.pairs) - 1)] == pair
        near &= (token[:-1] >= 0) & (token[1:] >= 0) & (doc[:-1] == doc[1:])
        edge = np.diff(np.concatenate([[False], near, [False]]).astype(np.int8))
        return token, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def matches(self, tokens: list[int], start: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Phrase places (phrase, first word) of one stretch that begins at word ``start``, and
        its matches (first word, length, state) that cannot be extended."""
        phrases, found, last = [], [], (0, 0)
        for i, (state, length) in enumerate(self.places.walk(tokens)):
            for phrase, words in self.ending[state]:
                if words <= length:
                    phrases.append((phrase, start + i + 1 - words))
            if length <= last[1] and last[1] >= LONG:
                found.append((start + i - last[1], last[1], last[0]))
            last = (state, length)
        if last[1] >= LONG:
            found.append((start + len(tokens) - last[1], last[1], last[0]))
        return phrases, found

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Covered template spans (label, first word, last word, covered share) of one document's
        matches, which are in order."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for first, length, state in matches:
            for number, position in self.places.ends[state]:
                if number >= self.phrases:
                    by_template.setdefault(number, []).append((first, length, position + 1 - length))
        out = []
        for number, places in sorted(by_template.items()):
            places.sort()
            group: list[tuple[int, int, int]] = []
            reach = -1
            for place in [*places, None]:
                if group and (place is None or place[0] > reach + GAP):
                    out.append(self._chain(number, group))
                    group, reach = [], -1
                if place is not None:
                    group.append(place)
                    reach = max(reach, place[0] + place[1] - 1)
        return out

    def _chain(self, number: int, group: list[tuple[int, int, int]]) -> tuple[str, int, int, float]:
        """The chain of matches with most words, in the order of file and template: the best
        chain that ends before each template position is kept in a Fenwick tree of maxima."""
        size = len(self.sequences[number])
        tree: list[tuple[int, int, int]] = [(0, 0, 0)] * (size + 1)  # words, -first, last

        def upto(position: int) -> tuple[int, int, int]:
            best = (0, 0, 0)
            while position > 0:
                best = max(best, tree[position])
                position &= position - 1
            return best

        waiting: list[tuple[int, int, tuple[int, int, int]]] = []
        for first, length, position in group:
            # only chains that end before this match in the file may come before it
            still = []
            for end, place, chain in waiting:
                if end >= first:
                    still.append((end, place, chain))
                    continue
                while place <= size:
                    tree[place] = max(tree[place], chain)
                    place += place & -place
            waiting = still
            words, begin, _ = upto(position)
            chain = (words + length, begin if words else -first, first + length - 1)
            waiting.append((first + length - 1, position + length, chain))
        best = max([upto(size), *(chain for _, _, chain in waiting)])
        return self.labels[number], -best[1], best[2], min(1.0, best[0] / size)


@lru_cache(1)
def scanner() -> Scanner:
    return Scanner()


def scan(docs: DataFrame, cover: float = COVER) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``,
    ``score`` (largest covered share of a template; a phrase of the base is one) and ``spans``
    (label, first_word, last_word, covered) of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = scanner()
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch):
                words = Runs(data, offsets, WORD)
                doc = np.repeat(np.arange(hi - lo), words.counts)
                phrases: dict[int, list[tuple[int, int]]] = {}
                matches: dict[int, list[tuple[int, int, int]]] = {}
                if len(words) > 1:
                    token, begins, ends = book.stretches(words.hashes(), doc)
                    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
                        at = int(doc[a])
                        said, met = book.matches(token[a : b + 1].tolist(), a - int(words.first[at]))
                        if said:
                            phrases.setdefault(at, []).extend(said)
                        if met:
                            matches.setdefault(at, []).extend(met)
                rows = []
                for at, n in enumerate(words.counts.tolist()):
                    if at not in phrases and at not in matches:
                        rows.append((n, 0, None, None, "", "", 0.0, []))
                        continue
                    said = phrases.get(at, [])
                    spans = [s for s in book.spans(matches.get(at, [])) if s[3] >= cover]
                    base = {book.labels[p] for p, _ in said}
                    places = [place for _, place in said]
                    score = 1.0 if said else max((s[3] for s in spans), default=0.0)
                    rows.append((
                        n, len(said), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
                        ",".join(sorted(base | {s[0] for s in spans})), score,
                        [dict(zip(SPAN, s, strict=True)) for s in spans],
                    ))
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], names=["doc_id", *NAMES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label:string,first_word:bigint,last_word:bigint,covered:double>>",
    )


SPAN = ("label", "first_word", "last_word", "covered")
NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
TYPES = (
    *[pa.int64()] * 4, *[pa.string()] * 2, pa.float64(),
    pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.float64())])),
)
