"""Approximate nearest neighbours by shifted space-filling curves.

Every vector is projected on a few random directions, several times over; each
projection, shifted at random, gives a place on a Hilbert curve. Spark range-partitions and
sorts all places of all curves. A query searches the windows around its own place on
every curve; the windows' best are merged, ranked by exact inner products.

For the largest inner product, vectors get one more coordinate that makes all of them
equally long (0 for a query), so near in direction means large product. That coordinate
would drown all others if one vector were far longer than the rest; so the vectors are
parted by their length, a factor of two to a range, and every query searches each
range on the range's own curves.

A window is a share of a curve (``share``), because in data without structure the recall
depends on the share searched; in clustered data a far smaller share does. A curve is cut into
blocks of half a window (``BLOCK`` rows at least), so a query meets three blocks of each curve at
most, at any size of the table. A block streams past its queries, which keep their best so far:
a task holds ``QUERIES`` queries and one batch of vectors, and gives one list per query.

Rows: vectors that are null, zero, or hold null or non-finite components take no part, as a query
or a candidate. Vectors with another number of components are other spaces, each searched on its
own; spaces of less than ``BLOCK`` vectors are searched whole. Equal vectors are searched
once and stand for their k + 1 smallest ids, which is all that can be among k nearest; they are
numbered in the order of their smallest ids. A vec_id that repeats with the same vector counts
once, with another vector each counts. Ties go to the smaller id. Other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text import stored

CURVES = 16
DIRECTIONS = 6
BITS = 5
SHARE = 0.06
BLOCK = 1024
QUERIES = 4096  # that one task holds
PAIRS = 1 << 14  # multiplied at a time


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (one row each), by Skilling's transform."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(n):
            upper = (x[i] >> bit) & 1 == 1
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(upper, low, 0)
            x[0] ^= swap
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= turn
    place = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | (x[i] >> bit & 1)
    return place


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding) that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    full = vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0").select("vec_id", "embedding")
    return full.where(~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))


def _norm(embedding: str) -> Column:
    """Length of a vector; squares of its largest component neither overflow nor vanish."""
    size = lambda x: F.abs(x.cast("double"))
    top = F.array_max(F.transform(embedding, size))
    return top * F.sqrt(F.aggregate(embedding, F.lit(0.0), lambda s, x: s + F.pow(size(x) / top, 2)))


def _places(rows: DataFrame, dim: int, longest: list[float], curves: int, seed: int) -> DataFrame:
    """Each row (uid, embedding, query, level) once per curve of its range, with its place.
    The curves of one range after the other are numbered through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, most = np.random.default_rng(seed), np.array(longest)
        reach = 3.5 / np.sqrt(dim + 1)
        turns = [np.linalg.qr(rng.normal(size=(dim + 1, dim + 1)))[0][:, : min(DIRECTIONS, dim + 1)] for _ in range(curves)]
        shifts = [rng.uniform(0, 0.5, t.shape[1]) for t in turns]
        for batch in batches:
            x, query = _matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            level = batch.column(3).to_numpy()
            top = np.abs(x).max(axis=1, initial=0.0)
            x = x / top[:, None]
            norm = np.linalg.norm(x, axis=1)
            part = np.where(query, 1.0, np.minimum(1.0, top / most[level] * norm))  # of the longest
            x = x * (part / norm)[:, None]
            rest = np.where(query, 0.0, np.sqrt(np.maximum(0, 1 - part**2)))
            x = np.hstack([x, rest[:, None]])
            for curve, (turn, shift) in enumerate(zip(turns, shifts, strict=True)):
                unit = ((x @ turn) / reach + 1) / 2  # most lie in 0 to 1
                cells = np.clip((unit + shift) / 1.5 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                place = pa.array(hilbert(cells, BITS))
                yield pa.RecordBatch.from_arrays([pa.array((level * curves + curve).astype(np.int32)), place, *batch.columns[:3]], names=names)

    names = ["curve", "place", "uid", "embedding", "query"]
    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.select("uid", "embedding", "query", "level").mapInArrow(run, f"curve int, place long, uid long, embedding {kind}, query boolean")


class Lists:
    """The ``k`` best candidates so far of some queries (ids and vectors)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.sizes = np.linalg.norm(vectors, axis=1)
        self.who, self.found, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.floor = np.full(len(ids), -np.inf)

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Take candidates in. Those whose rounded product may reach a query's list are worked
        out exactly, by the same sum in the same order wherever a pair is met."""
        error = 4 * np.finfo(float).eps * vectors.shape[1] * np.outer(self.sizes, np.linalg.norm(vectors, axis=1))
        near = self.vectors @ vectors.T
        edge = self.floor
        if len(ids) > self.k:
            edge = np.maximum(edge, np.partition(near - error, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        who, at = np.nonzero(~(near + error < edge[:, None]))
        if not len(who):
            return
        cuts = range(0, len(who), PAIRS)
        exact = np.concatenate([(self.vectors[who[c : c + PAIRS]] * vectors[at[c : c + PAIRS]]).sum(axis=1) for c in cuts])
        who, found, scores = (np.concatenate(x) for x in ((self.who, who), (self.found, ids[at]), (self.scores, exact)))
        by = np.lexsort((found, -scores, who))
        who, found, scores = who[by], found[by], scores[by]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        last = place == self.k - 1
        self.floor[who[last]] = scores[last]
        keep = place < self.k
        self.who, self.found, self.scores = who[keep], found[keep], scores[keep]

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.who]), pa.array(self.found), pa.array(self.scores)], names=["q", "v", "score"])


FOUND = "q long, v long, score double"
_DEALT = ["block", "group", "uid", "embedding", "query"]


def _nearest(dealt: DataFrame, k: int) -> DataFrame:
    """Best candidates of each query in each block and group. Queries come first, then the
    block streams past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, ids, held, lists = None, [], [], None
        for batch in batches:
            block, group, uid = (batch.column(c).to_numpy() for c in range(3))
            query, vectors = batch.column(4).to_numpy(zero_copy_only=False), batch.column(3)
            change = np.flatnonzero((np.diff(block) != 0) | (np.diff(group) != 0) | (np.diff(query.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(batch)], strict=True):
                if lo == hi:
                    continue
                if (block[lo], group[lo]) != unit:
                    if lists is not None:
                        yield lists.rows()
                    unit, ids, held, lists = (block[lo], group[lo]), [], [], None
                if query[lo]:
                    ids.append(uid[lo:hi])
                    held.append(_matrix(vectors.slice(lo, hi - lo)))
                elif ids:
                    lists = lists or Lists(np.concatenate(ids), np.concatenate(held), k)
                    for i in range(lo, hi, 1000):
                        lists.offer(uid[i : min(i + 1000, hi)], _matrix(vectors.slice(i, min(1000, hi - i))))
        if lists is not None:
            yield lists.rows()

    placed = dealt.select(*_DEALT).repartition("block", "group")
    return placed.sortWithinPartitions("block", "group", F.col("query").desc()).mapInArrow(run, FOUND)


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, curves: int = CURVES, share: float = SHARE, seed: int = 3
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest found for the rows of
    ``vectors`` (vec_id, embedding) where ``is_query`` holds, the query's own row left out."""
    rows = usable(vectors).withColumn("query", is_query)
    # equal vectors: one row stands for all, with the smallest ids
    by = Window.partitionBy("embedding").orderBy("vec_id")
    few = (
        rows.select("vec_id", "embedding")
        .withColumn("place", F.dense_rank().over(by))
        .where(F.col("place") <= k + 1)
        .groupBy("embedding")
        .agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    )
    members = _numbered(few.select("ids", "embedding"), [F.element_at("ids", 1), F.col("embedding")], "members")
    members = members.select(F.col("number").alias("uid"), "ids", "embedding")
    asked = rows.where("query").select("vec_id", "embedding").distinct()
    asked = asked.join(members.select("uid", "embedding"), "embedding").select(
        F.col("vec_id").alias("query_id"), "uid", F.size("embedding").alias("dim")
    )
    asked = stored(asked, "asked")
    # one row per number of components
    spaces = members.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.max(_norm("embedding")).alias("longest")).collect()
    wide = [s for s in spaces if s["n"] >= BLOCK]
    here = ~F.size("embedding").isin(*[s["dim"] for s in wide])
    found = _whole(members.where(here), asked, k)
    for space in wide:
        own = F.size("embedding") == space["dim"]
        found = found.unionByName(_search(members.where(own), asked.where(F.col("dim") == space["dim"]), space, k, curves, share, seed))

    pairs = found.groupBy("q", "v").agg(F.max("score").alias("score"))
    best = pairs.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "v"))).where(
        F.col("place") <= k + 1
    )
    lists = (
        best.join(members.select(F.col("uid").alias("v"), "ids"), "v")
        .select("q", F.explode(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("id")))).alias("x"))
        .groupBy("q")
        .agg(F.slice(F.sort_array(F.collect_list("x")), 1, k + 1).alias("near"))
    )
    own = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    return (
        asked.join(lists, asked["uid"] == lists["q"])
        .select("query_id", F.posexplode(own).alias("rank", "x"))
        .select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))
    )


def _numbered(rows: DataFrame, order: list[Column], label: str) -> DataFrame:
    """``rows`` stored in one order, with their ``number`` in it."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("part", F.spark_partition_id()).withColumn("row", inside), label)
    # one row per partition
    counts = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for part in range(max(counts, default=0) + 1):
        starts.append(total)
        total += counts.get(part, 0)
    number = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("part") + 1) + F.col("row")
    return ranged.withColumn("number", number).drop("part", "row")


def _probes(members: DataFrame, asked: DataFrame) -> DataFrame:
    return members.join(asked.select("uid").distinct(), "uid", "left_semi").select("uid", "embedding", F.lit(True).alias("query"))


def _whole(members: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Spaces of few vectors: all of one space are one block."""
    block, group = F.size("embedding").cast("long").alias("block"), F.lit(0).alias("group")
    items = members.select("uid", "embedding", F.lit(False).alias("query"))
    return _nearest(_probes(members, asked).unionByName(items).select("*", block, group), k + 1)


def _search(members: DataFrame, asked: DataFrame, space, k: int, curves: int, share: float, seed: int) -> DataFrame:
    queries = _probes(members, asked)
    n_queries = asked.select("uid").distinct().count()
    # vectors as long as the longest but for rounding are all in range 0
    norm = _norm("embedding")
    octave = F.floor(F.log2(F.lit(space["longest"])) - F.log2(norm) + 1e-6).cast("int")
    items = members.select("uid", "embedding", F.lit(False).alias("query"), octave.alias("octave"), norm.alias("norm"))
    ranges = sorted(tuple(r) for r in items.groupBy("octave").agg(F.count("*"), F.max("norm")).collect())
    level = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(ranges) for x in (r[0], i)]), F.col("octave"))
    levels = F.sequence(F.lit(0), F.lit(len(ranges) - 1))
    placed = items.select("uid", "embedding", "query", level.alias("level")).unionByName(queries.withColumn("level", F.explode(levels)))
    placed = _places(placed, space["dim"], [r[2] for r in ranges], curves, seed)
    ranked = _numbered(placed, [F.col(c) for c in ("curve", "place", "uid", "query")], "curves")

    # rows of one curve of each range, and where the range's first curve starts
    sizes = [r[1] + n_queries for r in ranges]
    firsts = [curves * sum(sizes[:i]) for i in range(len(ranges))]
    reaches = [int(np.ceil(share * n / 2)) for n in sizes]
    lengths = [max(BLOCK, reach) for reach in reaches]
    of = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.floor(F.col("curve") / curves).cast("int") + 1)
    ranked = ranked.withColumns({"reach": of(reaches), "size": of(sizes), "length": of(lengths)})
    ranked = ranked.withColumn("at", F.col("number") - of(firsts) - F.col("curve") % curves * F.col("size"))
    # blocks are numbered by curve first
    block = lambda at: F.shiftleft(F.col("curve").cast("long"), 40) + F.floor(at / F.col("length"))
    several = max(1, max(-(-n_queries * (2 * r + n) // (s * QUERIES)) for r, n, s in zip(reaches, lengths, sizes, strict=True)))
    window = F.sequence(
        block(F.greatest(F.col("at") - F.col("reach"), F.lit(0))), block(F.least(F.col("at") + F.col("reach"), F.col("size") - 1))
    )
    groups = F.sequence(F.lit(0), F.lit(several - 1))
    probes = ranked.where("query").withColumn("group", F.pmod(F.xxhash64("uid"), F.lit(several)).cast("int")).withColumn("block", F.explode(window))
    blocks = ranked.where("not query").withColumn("block", block(F.col("at"))).withColumn("group", F.explode(groups))
    return _nearest(probes.select(*_DEALT).unionByName(blocks.select(*_DEALT)), k + 1)
