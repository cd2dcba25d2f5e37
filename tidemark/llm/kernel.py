"""Quality scores from random Fourier features of document statistics.

``statistics`` turns every whole text into a short vector. ``fit`` standardizes it, maps
it by random cosines (an approximate Gaussian kernel) and solves ridge regression from
normal equations that every partition sums for itself; a held-back fifth of the training
labels then fits a monotone (isotonic) map from raw score to probability. ``score``
applies the model row by row.

Feature values are rounded to integers before they are multiplied, so the sums are the
same in whatever order partitions arrive. The driver sees the sums (a few ten thousand
numbers, whatever the input) and the calibration bins, never documents. All labelled
rows outside the held-out fold are used.

Rows: a null or empty text has all statistics 0 and gets a score like any other;
repeated rows are scored one by one; a label joins by doc_id, null labels do not count and
of differing labels of one document the mean counts; without labels every score is 0.5.
Other columns, ids, language and source are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import Words, mix, pieces, shingles, stored

NAMES = (
    "log_words", "word_bytes", "word_spread", "upper", "symbols", "digits", "stops", "loud",
    "log_lines", "dup_lines", "fresh_words", "repeats", "wide",
)
FEATURES = 192
STEPS = 1 << 11  # feature values are multiples of 1 / STEPS
BINS = 512


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.float64)
    out[list(chars)] = 1
    return out


_UPPER, _DIGIT = _table(bytes(range(65, 91))), _table(bytes(range(48, 58)))
_SYMBOL, _STOP, _LOUD = _table(b"#*$%&|<>{}[]\\^~=_@"), _table(b".,;:"), _table(b"!?")
_WIDE = np.zeros(256)
_WIDE[128:] = 1


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; an empty run sums to 0."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _fresh(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct values of each consecutive run."""
    return np.array([len(np.unique(values[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)], dtype=float)


def describe(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Statistics of consecutive documents, one row each."""
    words = Words(data, offsets)
    n, size = words.counts.astype(float), np.maximum(np.diff(offsets), 1)
    length = (words.ends - words.starts).astype(float)
    safe = np.maximum(n, 1)
    mean = _sums(length, words.first) / safe
    spread = np.sqrt(np.maximum(_sums(length**2, words.first) / safe - mean**2, 0))
    share = [_sums(t[data], offsets) / size for t in (_UPPER, _SYMBOL, _DIGIT, _STOP, _LOUD, _WIDE)]
    # lines: words of a document hashed line by line
    hashes = words.hashes()
    newline = np.concatenate([[0], np.cumsum(data == 10)])
    line = newline[words.starts]
    doc = np.repeat(np.arange(len(n)), words.counts)
    head = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])])) if len(line) else np.empty(0, int)
    place = np.arange(len(line)) - np.repeat(head, np.diff(np.append(head, len(line))))
    whole = np.add.reduceat(mix(hashes + place.astype(np.uint64)), head) if len(head) else np.empty(0, np.uint64)
    per_doc = np.searchsorted(head, words.first)
    lines = np.diff(per_doc).astype(float)
    dup = 1 - _fresh(whole, per_doc) / np.maximum(lines, 1)
    triples = shingles(np.concatenate([hashes, np.zeros(2, np.uint64)]), 3)
    last = np.maximum(words.first[1:] - 2, words.first[:-1])
    windows = np.maximum(n - 2, 0)
    kinds = np.array([len(np.unique(triples[a:b])) for a, b in zip(words.first[:-1], last, strict=True)], dtype=float)
    repeats = np.where(windows > 0, 1 - kinds / np.maximum(windows, 1), 0)
    columns = [
        np.log1p(n), mean, spread, share[0], share[1], share[2], share[3], share[4],
        np.log1p(lines), np.where(lines > 0, dup, 0), _fresh(hashes, words.first) / safe, repeats, share[5],
    ]
    return np.round(np.stack(columns, axis=1), 9)


def statistics(docs: DataFrame, *also: str) -> DataFrame:
    """``doc_id``, the columns ``also``, and ``stats`` (array of doubles) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch):
                rows = describe(data, offsets)
                flat = pa.array(rows.ravel())
                stats = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), flat)
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, stats], names=[*keep, "stats"])

    keep = ["doc_id", *also]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, stats array<double>")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    levels: np.ndarray  # calibrated value of each raw bin
    seed: int

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        rng = np.random.default_rng(self.seed)
        turns = rng.normal(size=(stats.shape[1], FEATURES)) / np.sqrt(stats.shape[1] / 2)
        shift = rng.uniform(0, 2 * np.pi, FEATURES)
        waves = np.rint(np.cos(x @ turns + shift) * STEPS)
        return np.hstack([waves, np.full((len(x), 1), float(STEPS))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        """The ridge value, -0.25 to 1.25 mapped to 0 to 1."""
        return np.clip((self.features(stats) @ self.weights + 0.25) / 1.5, 0, 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not self.weights.any():
            return np.full(len(stats), self.levels[0])
        raw = self.raw(stats)
        centres = (np.arange(BINS) + 0.5) / BINS
        # a thousandth of the raw score keeps the order inside a level
        return 0.999 * np.interp(raw, centres, self.levels) + 0.001 * raw


def isotonic(total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Non-decreasing least-squares fit to bins (pool adjacent violators); bins without
    weight take the level to their left, those before the first that of the first."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(weight):
        blocks.append([total[i], weight[i], i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t, w, _ = blocks.pop()
            blocks[-1][0] += t
            blocks[-1][1] += w
    if not blocks:
        return np.full(len(total), 0.5)
    out = np.empty(len(total))
    starts = [0, *[int(b[2]) for b in blocks[1:]], len(total)]
    for (t, w, _), a, b in zip(blocks, starts[:-1], starts[1:], strict=True):
        out[a:b] = t / w
    return out


def _sum_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, int]:
    size = FEATURES + 1
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, n = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            stats = _matrix(batch.column(0))
            z, y = model.features(stats), np.rint(batch.column(1).to_numpy(zero_copy_only=False) * STEPS)
            left += z.T @ z
            right += z.T @ y
            n += len(y)
        if n:
            cells = np.concatenate([left[upper], right, [n]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "value"])

    sums = rows.select("stats", "label").mapInArrow(run, "cell long, value long").groupBy("cell").agg(F.sum("value").alias("v"))
    cells = np.zeros(len(upper[0]) + size + 1)
    for row in sums.collect():
        cells[row["cell"]] = row["v"]
    left = np.zeros((size, size))
    left[upper] = cells[: len(upper[0])]
    return left + np.triu(left, 1).T, cells[len(upper[0]) : -1], int(cells[-1])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, len(NAMES)))


def fit(rows: DataFrame, calibrate: Column, ridge: float = 1e-3, seed: int = 7) -> Model:
    """Fit on ``stats`` and ``label`` (0 to 1); rows where ``calibrate`` holds fit the
    calibration, the others the weights."""
    own, back = rows.where(~calibrate), rows.where(calibrate)
    sums = [f(F.col("stats")[i]).alias(f"{k}{i}") for i in range(len(NAMES)) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    first = own.agg(*sums).first()
    plain = lambda k: np.array([round(first[f"{k}{i}"] or 0.0, 6) for i in range(len(NAMES))])
    empty = Model(plain("m"), np.maximum(plain("s"), 1e-3), np.zeros(FEATURES + 1), np.full(BINS, 0.5), seed)
    left, right, n = _sum_equations(own, empty)
    if n == 0:
        return empty
    weights = np.linalg.solve(left + ridge * n * STEPS**2 * np.eye(len(left)), right) / STEPS
    model = Model(empty.mean, empty.scale, weights, empty.levels, seed)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            at = np.minimum((model.raw(_matrix(batch.column(0))) * BINS).astype(int), BINS - 1)
            total += np.bincount(at, np.rint(batch.column(1).to_numpy(zero_copy_only=False) * STEPS), BINS)
            weight += np.bincount(at, minlength=BINS)
        columns = [np.arange(BINS), total.astype(np.int64), weight.astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bin", "total", "weight"])

    counted = back.select("stats", "label").mapInArrow(bins, "bin long, total long, weight long")
    total, weight = np.zeros(BINS), np.zeros(BINS)
    for row in counted.groupBy("bin").agg(F.sum("total").alias("t"), F.sum("weight").alias("w")).collect():
        total[row["bin"]], weight[row["bin"]] = row["t"] / STEPS, row["w"]
    if not weight.any():
        centres = (np.arange(BINS) + 0.5) / BINS
        return Model(model.mean, model.scale, weights, np.clip(centres * 1.5 - 0.25, 0, 1), seed)
    return Model(model.mean, model.scale, weights, isotonic(total, weight), seed)


def apply(model: Model, rows: DataFrame) -> DataFrame:
    """``rows`` with ``stats`` replaced by ``score``."""
    keep = [c for c in rows.columns if c != "stats"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(model.score(_matrix(batch.column(len(keep)))))], names=[*keep, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.select(*keep, "stats").mapInArrow(run, f"{kinds}, score double")


def fold() -> Column:
    """crc32 of the doc_id as text, mod 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5


def learn(stats: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows of ``stats`` outside fold 0; fold 4 calibrates."""
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("label"))
    rows = stats.where(fold() != 0).join(known, "doc_id").select("doc_id", "stats", "label")
    return fit(stored(rows, "labelled"), fold() == 4)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row of ``docs``."""
    stats = stored(statistics(docs), "statistics")
    return apply(learn(stats, labels), stats).select(
        "doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` (all columns) whose score reaches ``threshold``."""
    from_all = stored(statistics(docs), "statistics")
    model = learn(from_all, labels)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch):
                good = pa.array(model.score(describe(data, offsets)) >= threshold)
                yield batch.slice(lo, hi - lo).filter(good)

    return docs.select(*columns).mapInArrow(run, docs.schema)
