"""Substring dedup with suffix automata over shards of the reference.

A window is ``WINDOW`` consecutive words of one document; every window whose words also
start in a document with a smaller doc_id is marked, and marked words are removed.

1. Each window has an anchor, the 5-gram with the smallest hash inside it; equal windows
   have equal anchors. Anchors are counted over all documents, those of two documents or more
   go into a Bloom filter (of bounded size) that all tasks get. A mistake of the filter
   costs work, never changes a result.
2. Consecutive windows with the same anchor make one stretch (at most 21 words). Stretches
   whose anchor passed are the reference: equal ones are merged with their smallest doc_id and
   dealt by anchor into shards of bounded size. A shard becomes one suffix automaton, whose
   states carry the smallest doc_id of their places. Every distinct stretch is streamed
   through it; the matching statistics give, for each of its windows, the first document
   that holds it. (Shipping every shard to every task, the plain form of the method, would stream
   the corpus once per shard; dealing by anchor keeps the sum linear.) Stretches of anchors
   that are very common are cut into single windows and dealt by the window instead.
3. Occurrences meet the answer for their stretch, marked windows are gathered per document.

Words are compared by 40-bit hashes (a false match needs 13 consecutive words to agree,
one of them by collision).

Rows: a null or empty text, or one below ``WINDOW`` words, loses nothing; a null doc_id counts
as the largest; rows that repeat a doc_id do not dedup each other; other columns pass through
``remove``; an empty table gives no rows. Texts are taken whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.filters import build_filter
from tidemark.llm.text import Words, carried, pieces, shingles, stored

WINDOW = 13
GRAM = 5
LAST = (1 << 63) - 1  # stands for a null doc_id
SYMBOL = 5  # bytes of a word in a stretch
SHARD = 4096  # stretches of one automaton, about
COMMON = 2000  # documents from which an anchor is cut into windows


class Stretches:
    """Runs of windows with one anchor in consecutive documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets)
        self.words, self.hashes = words, words.hashes()
        grams = shingles(self.hashes, GRAM)
        n = len(self.hashes) - WINDOW + 1
        empty = np.empty(0, np.int64)
        self.doc = self.start = self.size = empty
        self.anchor = np.empty(0, np.uint64)
        if n <= 0:
            return
        doc = np.repeat(np.arange(len(offsets) - 1), words.counts)
        whole = doc[:n] == doc[WINDOW - 1 :]
        span = WINDOW - GRAM + 1
        at = np.arange(n) + np.lib.stride_tricks.sliding_window_view(grams[: n + span - 1], span).argmin(axis=1)
        starts = np.flatnonzero(whole)
        if not len(starts):
            return
        place, owner = at[starts], doc[starts]
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
        head = np.flatnonzero(new)
        self.start, self.doc, self.anchor = starts[head], owner[head], grams[place[head]]
        self.size = np.diff(np.append(head, len(starts)))


def _doc_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def anchors(docs: DataFrame) -> DataFrame:
    """``anchor``, smallest and largest ``doc`` and number ``n``, of anchors in two documents or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch):
                found = Stretches(data, offsets)
                by = np.lexsort((found.anchor, found.doc))
                anchor, doc = found.anchor[by], found.doc[by]
                new = np.ones(len(by), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                ids = batch.column(0).slice(lo, hi - lo).take(pa.array(doc[new]))
                yield pa.RecordBatch.from_arrays([pa.array(anchor[new].astype(np.int64)), ids], names=["anchor", "doc"])

    rows = docs.select(_doc_key().alias("doc"), "text").mapInArrow(run, "anchor long, doc long")
    return rows.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n")).where("lo < hi")


def stretches(docs: DataFrame, shared, common) -> DataFrame:
    """``shard`` (anchor, or the window of a common anchor), ``content`` (words of the stretch),
    ``doc``, ``text_hash`` and ``start`` (word number), of stretches whose anchor is shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch):
                found = Stretches(data, offsets)
                keep = shared.value.has(found.anchor)
                anchor, start, size, doc = found.anchor[keep], found.start[keep], found.size[keep], found.doc[keep]
                if not len(start):
                    continue
                often = common.value.has(anchor)
                if often.any():
                    times = np.where(often, size, 1)
                    inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    start, doc, often = np.repeat(start, times) + inner, np.repeat(doc, times), np.repeat(often, times)
                    size, anchor = np.where(often, 1, np.repeat(size, times)), np.repeat(anchor, times)
                    anchor[often] = shingles(found.hashes, WINDOW)[start[often]]
                symbols = found.hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SYMBOL]
                long = size + WINDOW - 1
                ends = np.cumsum(long)
                index = np.arange(ends[-1]) + np.repeat(start - (ends - long), long)
                bounds = np.concatenate([[0], ends * SYMBOL]).astype(np.int32)
                content = pa.Array.from_buffers(
                    pa.binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(symbols[index]))]
                )
                ids, texts = (batch.column(c).slice(lo, hi - lo).take(pa.array(doc)) for c in (0, 2))
                inside = (start - found.words.first[doc]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.astype(np.int64)), content, ids, texts, pa.array(inside)],
                    names=["shard", "content", "doc", "text_hash", "start"],
                )

    return docs.select(_doc_key().alias("doc"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        run, "shard long, content binary, doc long, text_hash long, start long"
    )


class Automaton:
    """A suffix automaton of several sequences, with the smallest document of each state."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [LAST]

    def _state(self, moves: dict[int, int], link: int, length: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.first.append(LAST)
        return len(self.next) - 1

    def add(self, sequence: list[int], doc: int) -> None:
        at = 0
        for symbol in sequence:
            at = self._extend(at, symbol)
            if doc < self.first[at]:
                self.first[at] = doc

    def _extend(self, at: int, symbol: int) -> int:
        moves, link, length = self.next, self.link, self.length
        ready = moves[at].get(symbol)
        if ready is not None:  # the path is known from another sequence
            return ready if length[ready] == length[at] + 1 else self._split(at, symbol, ready)
        new = self._state({}, 0, length[at] + 1)
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = new
            at = link[at]
        if at >= 0:
            known = moves[at][symbol]
            link[new] = known if length[known] == length[at] + 1 else self._split(at, symbol, known)
        return new

    def _split(self, at: int, symbol: int, state: int) -> int:
        """Part the strings of ``state`` that are longer than ``at`` and the symbol."""
        moves, link = self.next, self.link
        short = self._state(dict(moves[state]), link[state], self.length[at] + 1)
        link[state] = short
        while at >= 0 and moves[at].get(symbol) == state:
            moves[at][symbol] = short
            at = link[at]
        return short

    def settle(self) -> None:
        """Hand the smallest document of every state down to its suffixes."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up = self.link[state]
            if self.first[state] < self.first[up]:
                self.first[up] = self.first[state]

    def first_documents(self, sequence: list[int], window: int) -> list[int]:
        """Matching statistics of a sequence: for each of its windows the smallest document
        that holds it (``LAST`` if none does)."""
        moves, link, length = self.next, self.link, self.length
        at, matched, out = 0, 0, []
        for i, symbol in enumerate(sequence):
            while at and symbol not in moves[at]:
                at = link[at]
                matched = length[at]
            if symbol in moves[at]:
                at = moves[at][symbol]
                matched += 1
            while at and length[link[at]] >= window:  # keep the last words of a window only
                at = link[at]
                matched = length[at]
            if i >= window - 1:
                out.append(self.first[at] if matched >= window else LAST)
        return out


def _symbols(content: bytes) -> list[int]:
    raw = np.frombuffer(content, np.uint8).reshape(-1, SYMBOL)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :SYMBOL] = raw
    return wide.view("<u8").ravel().tolist()


def _answer(table: pa.Table) -> pa.Table:
    """First documents of the windows of every stretch of one shard."""
    keys, docs, contents = table["shard"].to_numpy(), table["doc"].to_pylist(), table["content"].to_pylist()
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    several = (counts[inverse] > 1).tolist()
    automaton, sequences = Automaton(), {}
    for i, content in enumerate(contents):
        if several[i]:
            sequences[i] = _symbols(content)
            automaton.add(sequences[i], docs[i])
    automaton.settle()
    firsts = [
        # a stretch that is alone with its anchor can only be met by its own copies
        automaton.first_documents(sequences[i], WINDOW) if several[i] else [docs[i]] * (len(contents[i]) // SYMBOL - WINDOW + 1)
        for i in range(len(contents))
    ]
    return pa.table({"content_id": table["content_id"], "firsts": pa.array(firsts, pa.list_(pa.int64()))})


def marked(docs: DataFrame) -> DataFrame:
    """``doc``, ``text_hash`` and ``starts`` of the windows that also start in a document with a
    smaller doc_id."""
    spark = docs.sparkSession
    counted = stored(anchors(docs), "anchors")
    facts = counted.agg(
        F.count("*").alias("n"), F.sum("n").alias("places"), F.sum((F.col("n") > COMMON).cast("long")).alias("often")
    ).first()
    shared = spark.sparkContext.broadcast(build_filter(counted.select("anchor"), facts["n"]))
    common = spark.sparkContext.broadcast(build_filter(counted.where(F.col("n") > COMMON).select("anchor"), facts["often"] or 0))
    found = stretches(docs, shared, common).withColumn("content_id", F.xxhash64("shard", "content"))
    shards = max(1, math.ceil((facts["places"] or 0) / SHARD))
    distinct = found.groupBy("shard", "content", "content_id").agg(F.min("doc").alias("doc"))
    answers = (
        distinct.withColumn("bin", F.pmod(F.xxhash64("shard"), F.lit(shards)))
        .groupBy("bin")
        .applyInArrow(_answer, "content_id long, firsts array<bigint>")
    )
    places = found.select("content_id", "doc", "text_hash", "start")
    # a stretch whose windows all start first in this very document marks nothing
    hit = places.join(answers, "content_id").where(F.array_min("firsts") < F.col("doc"))
    starts = F.filter(
        F.transform("firsts", lambda f, i: F.when(f < F.col("doc"), F.col("start") + i)), lambda x: x.isNotNull()
    )
    return hit.select("doc", "text_hash", starts.alias("starts")).groupBy("doc", "text_hash").agg(
        # equal rows of one id give their windows once
        F.array_distinct(F.flatten(F.collect_set("starts"))).alias("starts")
    )


FACTS = ("n_words", "n_removed", "kept_sha256")


def remove(docs: DataFrame, texts: bool = True) -> DataFrame:
    """The columns of ``docs`` with ``text`` cut (or left out), and ``n_words``, ``n_removed`` and
    ``kept_sha256`` (of the kept words joined by one space); these take the place of columns of
    their names."""
    cut = removed(docs, texts)
    others = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("text", *FACTS)]
    return cut.select(*others, *(["text"] if texts else []), *FACTS)


def removed(docs: DataFrame, texts: bool = True) -> DataFrame:
    """``row`` (all columns of ``docs`` but ``text``, whatever their names), the cut ``text``, and ``FACTS``."""
    found = stored(marked(docs.select("doc_id", "text")), "marks")
    # texts that the filter does not know lose nothing and are spared the join
    key = F.xxhash64("doc", "text_hash")
    known = docs.sparkSession.sparkContext.broadcast(build_filter(found.select(key.alias("key")), found.count()))
    keyed = docs.select(carried(docs), "text", _doc_key().alias("doc"), F.xxhash64("text").alias("text_hash")).withColumn("key", key)

    def pick(meets: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                has = known.value.has(batch.column(4).to_numpy().astype(np.uint64))
                yield batch.filter(pa.array(has == meets, pa.bool_()))

        return keyed.mapInArrow(run, keyed.schema)

    met = pick(True).join(found, ["doc", "text_hash"], "left").select("row", "text", "starts")
    joined = met.unionByName(pick(False).select("row", "text", F.lit(None).cast("array<long>").alias("starts")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch):
                found = Stretches(data, offsets)
                words = found.words
                raw, olds = words._raw, batch.column(1).slice(lo, hi - lo)
                removed, digests, new = [], [], []
                for i, starts in enumerate(batch.column(2).slice(lo, hi - lo)):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    gone = np.zeros(b - a + 1, np.int32)
                    if starts.is_valid:
                        starts = starts.values.to_numpy()
                        gone[starts] += 1
                        gone[starts + WINDOW] -= 1
                    out = np.cumsum(gone)[:-1] > 0
                    kept = a + np.flatnonzero(~out)
                    removed.append(int(out.sum()))
                    digests.append(hashlib.sha256(words.text(kept)).hexdigest())
                    if texts:
                        if not removed[-1]:
                            new.append(olds[i].as_py())
                            continue
                        # keep each word with the white space before it
                        before = np.concatenate([[offsets[i]], words.ends[a : b - 1]])[~out]
                        parts = [raw[s:e] for s, e in zip(before.tolist(), words.ends[kept].tolist(), strict=True)]
                        new.append((b"".join(parts) + raw[words.ends[b - 1] : offsets[i + 1]]).decode("utf-8", "replace"))
                facts = [pa.array(words.counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
                text = [pa.array(new, pa.string())] if texts else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *text, *facts], names=names)

    names = ["row", *(["text"] if texts else []), *FACTS]
    fields = [joined.schema["row"], *[T.StructField("text", T.StringType())] * texts, *[T.StructField(f, T.LongType()) for f in FACTS[:2]]]
    return joined.mapInArrow(run, T.StructType([*fields, T.StructField(FACTS[2], T.StringType())]))
