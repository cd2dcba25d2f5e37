"""Vector code compression: product codebooks, searched by Orchard's method.

Components become integers, floor(1024 * x). Vectors are cut into ``PARTS`` consecutive parts,
and each part is coded by an entry of its own codebook. Codebooks start as the parts of the
vectors with the smallest vec_ids; each of ``ROUNDS`` rounds assigns every part to its nearest
entry and moves the entries to the (floored) means of their parts.

Nearest entries are found by Orchard search: every entry has the list of all entries sorted by
distance from it. A search walks the list of its best entry so far, jumps to the list of any
entry that improves on it, marks entries it has visited, and ends where the list is beyond
twice the current distance, since nothing there can be nearer. Equal distances are within that
bound, so ties go to the smaller index exactly. A task advances many searches side by side.

Codebooks (``ENTRIES`` vectors at most) are all that reaches the driver and the tasks. Sums of a
round are made in the tasks and added by Spark; all arithmetic is on integers, so results do not
depend on how rows are dealt. The integer vectors are written to the shared folder once.

Rows: vectors that are null or hold a null, NaN or infinite component are left out; a null
vec_id sorts last; repeated vec_ids and rows all count, in the order of their components; fewer
vectors than entries make a shorter codebook; vectors of other lengths, or of lengths that are no
multiple of ``PARTS``, are filled up with zeros at the end; an empty table gives no rows; columns
other than the three named go no further. A component so large that squared distances would
leave 64 bits stops the job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
PIVOTS = 16  # entries looked at first, to start from a near one
SIDE_BY_SIDE = 4096
LABELS = 200_000  # totals of so many labels are broadcast, more are joined by merge


class Orchard:
    """Distance-sorted neighbour lists of the ``entries`` (n x width integers) of a codebook."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        away = np.array([((entries - e) ** 2).sum(axis=1) for e in entries]).reshape(len(entries), len(entries))
        self.near = np.argsort(away, axis=1, kind="stable")
        self.away = np.take_along_axis(away, self.near, axis=1)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to the nearest entry of each point."""
        found = [self._walk(points[i : i + SIDE_BY_SIDE]) for i in range(0, len(points), SIDE_BY_SIDE)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _walk(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, rows = len(self.entries), np.arange(len(points))
        pivots = np.arange(0, n, max(1, n // PIVOTS))
        first = np.stack([((points - self.entries[p]) ** 2).sum(axis=1) for p in pivots])
        at = pivots[first.argmin(axis=0)]  # the first of equals has the smallest index
        best = first.min(axis=0)
        seen = np.zeros((len(points), n), bool)
        seen[:, pivots] = True
        place = np.zeros(len(points), np.int64)
        while len(rows):
            rows = rows[place[rows] < n]
            rows = rows[self.away[at[rows], place[rows]] <= 4 * best[rows]]
            candidate = self.near[at[rows], place[rows]]
            place[rows] += 1
            new = ~seen[rows, candidate]
            ask, candidate = rows[new], candidate[new]
            seen[ask, candidate] = True
            distance = ((points[ask] - self.entries[candidate]) ** 2).sum(axis=1)
            better = (distance < best[ask]) | ((distance == best[ask]) & (candidate < at[ask]))
            jump = ask[better]
            at[jump], best[jump], place[jump] = candidate[better], distance[better], 0
        return at, best


def integers(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``label``, ``size`` and ``data`` (32-bit integers) of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            lists = lists.cast(pa.large_list(pa.float64()))
            bounds = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            keep = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[bounds[1:]] == bad[bounds[:-1]])
            size = np.diff(bounds)[keep]
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.floor(values * SCALE)
            taken = np.repeat(keep, np.diff(bounds))
            whole = whole[bounds[0] : bounds[-1]][taken]
            if len(whole) and np.abs(whole).max() > 2**30 / np.sqrt(max(1, size.max())):
                raise ValueError("a vector component is too large for exact distances in 64 bits")
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64) * 4
            data = pa.py_buffer(whole.astype("<i4").tobytes())
            binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), data])
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(mask), batch.column(1).filter(mask), pa.array(size.astype(np.int32)), binary.cast(pa.binary())],
                names=["vec_id", "label", "size", "data"],
            )

    kinds = vectors.select("vec_id", "label").schema
    schema = f"vec_id {kinds['vec_id'].dataType.simpleString()}, label {kinds['label'].dataType.simpleString()}, size int, data binary"
    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, schema)


def _points(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Rows x parts x width integers of the ``data`` of a batch."""
    data, size = batch.column("data"), batch.column("size").to_numpy()
    flat = np.frombuffer(b"".join(data.to_pylist()), "<i4")
    out = np.zeros((len(size), PARTS * width), np.int64)
    out[np.arange(PARTS * width) < size[:, None]] = flat
    return out.reshape(len(size), PARTS, width)


def train(kept: DataFrame, width: int, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks (parts x entries x width) of the rows of ``integers``."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "size", "data").limit(entries).select("size", "data").toArrow()
    books = np.concatenate([_points(b, width) for b in first.to_batches()] or [np.zeros((0, PARTS, width), np.int64)]).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _moved(kept, books) if books.shape[1] else books
    return books


def _moved(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    _, n, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Orchard(book) for book in books]
        sums, counts = np.zeros((PARTS, n, width), np.int64), np.zeros((PARTS, n), np.int64)
        for batch in batches:
            points = _points(batch, width)
            for part, search in enumerate(searches):
                at, _ = search.nearest(points[:, part]) if len(points) else (np.empty(0, np.int64), None)
                np.add.at(sums[part], at, points[:, part])
                counts[part] += np.bincount(at, minlength=n)
        used = np.flatnonzero(counts.ravel())
        totals = pa.array(list(np.column_stack([counts.ravel()[used], sums.reshape(-1, width)[used]])), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), totals], names=["entry", "totals"])

    made = kept.select("size", "data").mapInArrow(run, "entry int, totals array<long>")
    # at most one row per entry and component
    total = made.select("entry", F.posexplode("totals").alias("place", "total")).groupBy("entry", "place").agg(F.sum("total").alias("total")).toArrow()
    table = np.zeros((PARTS * n, width + 1), np.int64)
    table[total["entry"].to_numpy(), total["place"].to_numpy()] = total["total"].to_numpy()
    counts = table[:, :1]
    means = np.where(counts > 0, table[:, 1:] // np.maximum(counts, 1), books.reshape(-1, width))
    return means.reshape(books.shape)


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id``, ``label``, ``code`` (two hex digits a part) and ``error`` of every row of ``integers``."""
    width = books.shape[2]
    digits = np.array([f"{i:02x}" for i in range(max(ENTRIES, books.shape[1]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Orchard(book) for book in books]
        for batch in batches:
            if not len(batch):
                continue
            points = _points(batch, width)
            found = [search.nearest(points[:, part]) for part, search in enumerate(searches)]
            code = digits[found[0][0]]
            for at, _ in found[1:]:
                code = np.char.add(code, digits[at])
            error = sum(distance for _, distance in found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(code.tolist(), pa.string()), pa.array(error)],
                names=["vec_id", "label", "code", "error"],
            )

    kinds = kept.schema
    schema = f"vec_id {kinds['vec_id'].dataType.simpleString()}, label {kinds['label'].dataType.simpleString()}, code string, error long"
    return kept.mapInArrow(run, schema)


def reconstruct(code: str, books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for."""
    at = [int(code[i : i + 2], 16) for i in range(0, len(code), 2)]
    return (np.concatenate([book[i] for book, i in zip(books, at, strict=True)]) + 0.5) / SCALE


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of every vector of
    ``vectors`` (vec_id, embedding, label) that takes part."""
    kept = stored(integers(vectors), "integers")
    longest = kept.agg(F.max("size")).first()[0] or 0
    books = train(kept, -(-longest // PARTS), rounds)
    coded = stored(encode(kept, books), "codes")
    totals = stored(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    if totals.count() <= LABELS:
        totals = F.broadcast(totals)
    return coded.join(totals, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
