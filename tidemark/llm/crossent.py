"""Documents scored by cross-entropy difference.

A target model and a background model are bigram models of the same order and smoothing over
one vocabulary, all words of all documents. The background is counted on all documents, and
its counts are scaled to the mass of the target's, so that smoothing weighs the same in both.
The score of a document is the mean, per token, of the target's loss minus the background's:
below 0 the text looks more like the target.

Both models hold every bigram of the corpus, so no task has them whole:

1. Tasks cut their documents into blocks of about ``BLOCK`` bytes of text and write each
   block as word codes, once.
2. Each block counts its words, how many of them end a document, and its bigrams. The counts
   are dealt into buckets by hash; the number of buckets follows the bytes of the corpus.
   A word is a context as often as it comes and does not end a document.
3. A bucket sums the counts of its hashes and sends each block the sums it asked for. A bigram
   comes at most once from a block, however common it is.
4. A block meets its sums and scores its documents.

Words are lower-cased (A-Z) and taken from whole texts. Entries of the models are told apart by
55-bit hashes. What travels is packed by ``pack``.

Rows: a null or empty text has 0 tokens and null losses; repeated rows count and are scored one
by one; a null doc_id is never in the target; without any target text the target model is
uniform; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import Words, mix, pieces, shingles, stored

PRIOR = 500.0  # words of the unigram model that each context is mixed with
BLOCK = 16 << 20
BUCKET = 4 << 20  # bytes of text whose counts meet in one bucket, about
SALTS = 4096  # parts of the rows without doc_id in the join with the target
START = np.uint64(0x2545F4914F6CDD1D)  # stands before a document's first word

_KIND = np.uint64(1)
FACTS = ("words", "mass", "target_mass", "documents", "target_documents")
WORD, BIGRAM = np.uint64(0), np.uint64(1)  # last bit of a key


def pack(values: np.ndarray) -> bytes:
    """Bytes of equal significance together, compressed."""
    flat = np.ascontiguousarray(values).ravel()
    return zstandard.compress(flat.view(np.uint8).reshape(-1, flat.itemsize).T.tobytes(), 1)


def unpack(packed: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed, "<u8"), dtype=np.uint64)


class Entries:
    """Model entries of one block: ``keys`` of its words, then of its bigrams, and which bigram
    (``token``) every token is."""

    def __init__(self, vocabulary: np.ndarray, codes: np.ndarray, bounds: np.ndarray):
        size = len(vocabulary)
        self.bounds, self.codes, self.words = bounds, codes, size
        before = np.concatenate([[size], codes[:-1]]) if len(codes) else codes
        before[bounds[:-1][bounds[:-1] < len(codes)]] = size
        pairs, self.token = np.unique(before * size + codes, return_inverse=True)
        self.context, self.word = np.divmod(pairs, max(size, 1))
        both = np.stack([np.append(vocabulary, START)[self.context], vocabulary[self.word]], axis=1).ravel()
        kinds = ((vocabulary, WORD), (shingles(both, 2)[::2], BIGRAM))
        self.keys = np.concatenate([mix(k) >> np.uint64(8) & ~_KIND | kind for k, kind in kinds])
        self.order = np.argsort(self.keys, kind="stable")

    def counts(self, inside: np.ndarray) -> np.ndarray:
        """Times of each key, in all documents and where ``inside`` holds, and then the same
        for words that end a document."""
        full = np.flatnonzero(np.diff(self.bounds))
        ends = self.codes[self.bounds[1:][full] - 1]
        times = np.zeros((4, len(self.keys)), "<i8")
        for row, docs in enumerate((np.ones(len(inside)), inside.astype(float))):
            weight = np.repeat(docs, np.diff(self.bounds))
            times[row, : self.words] = np.bincount(self.codes, weight, self.words)
            times[row, self.words :] = np.bincount(self.token, weight, len(self.word))
            times[row + 2, : self.words] = np.bincount(ends, docs[full], self.words)
        return times

    def losses(self, times: np.ndarray, ends: np.ndarray, mass: float, documents: float, words: int, scale: float) -> np.ndarray:
        """Loss of every token in nats: bigrams mixed with the smoothed unigrams."""
        word, bigram = times[: self.words] * scale, times[self.words :] * scale
        context = np.append(word - ends[: self.words] * scale, documents * scale)
        word = (word + 1) / (mass * scale + words)
        return -np.log((bigram + PRIOR * word[self.word]) / (context[self.context] + PRIOR))[self.token]


def flagged(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``in_target``; rows without doc_id are spread over the tasks.
    The target grows with the corpus, so it is never broadcast."""
    wanted = target.where("doc_id is not null").select(F.col("doc_id").alias("_id"), F.lit(0).cast("long").alias("_salt")).distinct()
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(SALTS)) + 1).otherwise(F.lit(0).cast("long"))
    joined = docs.withColumn("_own", salt).join(wanted.hint("merge"), (F.col("doc_id") == F.col("_id")) & (F.col("_own") == F.col("_salt")), "left")
    return joined.select("doc_id", "text", F.col("_id").isNotNull().alias("in_target"))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """One row per block of documents: ``doc_ids``, whether they are ``inside`` the target, their
    ``bounds`` in ``codes``, and the ``vocabulary`` that the codes number."""

    def block(number: int, ids: list[pa.Array], hashes: list[np.ndarray], sizes: list[np.ndarray], inside: list[np.ndarray]) -> pa.RecordBatch:
        vocabulary, codes = np.unique(np.concatenate(hashes), return_inverse=True)
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<u8")
        flat = pa.concat_arrays(ids)
        packed = (pack(np.concatenate(inside).astype("u1")), pack_sorted(bounds), pack_sorted(vocabulary), zstandard.compress(codes.astype("<i4").tobytes(), 3))
        columns = [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), *[pa.array([x], pa.binary()) for x in packed]]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, waiting = TaskContext.get().partitionId() << 32, ([], [], [], []), 0
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch):
                words = Words(data, offsets, lower=True)
                inside = batch.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                for values, new in zip(held, (batch.column(0).slice(lo, hi - lo), words.hashes(), words.counts, inside), strict=True):
                    values.append(new)
                waiting += len(data) + 64 * (hi - lo)
                if waiting >= size:
                    yield block(number, *held)
                    number, held, waiting = number + 1, ([], [], [], []), 0
        if held[0]:
            yield block(number, *held)

    names = ["block", "doc_ids", "inside", "bounds", "vocabulary", "codes"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "in_target").mapInArrow(
        run, f"block long, doc_ids array<{kind}>, inside binary, bounds binary, vocabulary binary, codes binary"
    )


def entries_of(row: dict[str, bytes]) -> Entries:
    codes = np.frombuffer(zstandard.decompress(row["codes"]), "<i4").astype(np.int64)
    return Entries(unpack_sorted(row["vocabulary"]), codes, unpack_sorted(row["bounds"]).astype(np.int64))


def dealt(cut: DataFrame, buckets: int) -> DataFrame:
    """``keys`` and ``counts`` of every block and ``bucket``, in the order of the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                entries = entries_of(row)
                counts = entries.counts(unpack(row["inside"], "u1"))[:, entries.order]
                keys = entries.keys[entries.order]
                # buckets by the first bits, so they follow the order of the keys
                at = ((keys >> np.uint64(24)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(at, prepend=-1))
                parts = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=False))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["block"]] * len(parts), pa.int64()),
                        pa.array(at[cuts]),
                        pa.array([pack_sorted(keys[a:b]) for a, b in parts], pa.binary()),
                        pa.array([pack(counts[:, a:b]) for a, b in parts], pa.binary()),
                    ],
                    names=["block", "bucket", "keys", "counts"],
                )

    rows = cut.select("block", "inside", "bounds", "vocabulary", "codes")
    return rows.mapInArrow(run, "block long, bucket long, keys binary, counts binary")


def _sum_bucket(table: pa.Table) -> pa.Table:
    """The sums of one bucket, for each block in the order of its keys. The first row also has
    the bucket's number of ``words``, and how often they come (``mass``) and end a document
    (``documents``), with the same for the target."""
    keys = [unpack_sorted(k) for k in table["keys"].to_pylist()]
    counts = np.concatenate([unpack(c, "<i8").reshape(4, -1) for c in table["counts"].to_pylist()], axis=1)
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros((4, len(every)), "<i8")
    for row, own in zip(sums, counts, strict=True):
        np.add.at(row, at, own)
    words = every & _KIND == WORD
    facts = [int(words.sum()), *sums[:, words].sum(axis=1).tolist()]
    ends = np.cumsum([len(k) for k in keys])
    totals = [pack(sums[:, at[a:b]]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    rest = [0] * (len(keys) - 1)
    return pa.table({
        "block": table["block"], "bucket": table["bucket"], "totals": pa.array(totals, pa.binary()),
        **{name: pa.array([fact, *rest], pa.int64()) for name, fact in zip(FACTS, facts, strict=True)},
    })


def score(docs: DataFrame, target: DataFrame, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``loss_target``, ``loss_background`` and ``score`` of every row
    of ``docs`` (doc_id, text); ``target`` names the doc_id s of the target texts. ``block`` and
    ``bucket`` are bytes of text."""
    docs = docs.select("doc_id", "text")
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cut = stored(blocks(flagged(docs, target), block), "blocks")
    kinds = ", ".join(f"{c} long" for c in FACTS)
    sums = dealt(cut, volume // bucket + 1).groupBy("bucket").applyInArrow(_sum_bucket, f"block long, bucket long, totals binary, {kinds}")
    sums = stored(sums, "sums")
    facts = sums.agg(*[F.sum(c).alias(c) for c in FACTS]).first()
    words, mass, wanted, documents, targets = (facts[c] or 0 for c in FACTS)
    scale = wanted / mass if wanted and mass else 1.0

    def run(coded: pa.Table, asked: pa.Table) -> pa.Table:
        entries = entries_of({c: coded[c][0].as_py() for c in ("bounds", "vocabulary", "codes")})
        bounds, parts = entries.bounds, asked.sort_by("bucket")["totals"].to_pylist()
        total = np.zeros((4, len(entries.keys)))
        if parts:
            total[:, entries.order] = np.concatenate([unpack(p, "<i8").reshape(4, -1) for p in parts], axis=1)
        n, means = np.diff(bounds), []
        for row, of, starts, by in ((1, wanted, targets, 1.0), (0, mass, documents, scale)):
            upto = np.concatenate([[0.0], np.cumsum(entries.losses(total[row], total[row + 2], of, starts, words, by))])
            means.append((upto[bounds[1:]] - upto[bounds[:-1]]) / np.maximum(n, 1))
        columns = [pa.array(np.round(c, 9), mask=n == 0) for c in (*means, means[0] - means[1])]
        return pa.table([coded["doc_ids"].combine_chunks().flatten(), pa.array(n), *columns], names=names)

    names = ["doc_id", "n_tokens", "loss_target", "loss_background", "score"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = cut.select("block", "doc_ids", "bounds", "vocabulary", "codes")
    return texts.groupBy("block").cogroup(sums.select("block", "bucket", "totals").groupBy("block")).applyInArrow(
        run, f"doc_id {kind}, n_tokens long, loss_target double, loss_background double, score double"
    )
