"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target in words; a document of it should appear target / size of the
source times. The whole part of that number is certain. The fractional parts are rounded
by pairs: from two documents, mass is moved at random from one to the other, so that
the words expected stay the same, until one of the two is integral. A chunk of
documents leaves one fractional rest; the rests of chunks are paired in the next level of
a tree, until one is left per source. So a source's taken words differ from its target by
less than one document, and every document keeps its expected number of copies.

The random numbers are hashes of the rows, so reruns agree. A chunk holds about ``CHUNK``
documents, whatever the size of a source.

Rows: a null text has size 0 and takes 0 words; null sources are one source, the last;
of n equal rows the whole part of n times the fraction get a copy for certain and only the
rest is rounded by pairs, as one document; an empty table gives no rows; other columns are
not read (``apply`` returns them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.text import Words, carried, mix, pieces, restored, stored

CHUNK = 2048
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0


def sized(docs: DataFrame, text: bool = False) -> DataFrame:
    """``docs`` with ``size``, the words of the whole text, and ``text_hash``; without the
    ``text`` unless it is asked for."""
    keep = [c for c in docs.columns if text or c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch):
                raw = data.tobytes()
                hashes = [xxhash.xxh64_intdigest(raw[a:b]) - (1 << 63) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                counts = pa.array(Words(data, offsets).counts.astype(np.int64))
                columns = [batch.column(c).slice(lo, hi - lo) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, counts, pa.array(hashes, pa.int64())], names=[*keep, "_size", "_text_hash"])

    added = [T.StructField(name, T.LongType()) for name in ("_size", "_text_hash")]
    return docs.mapInArrow(run, T.StructType([*docs.select(*keep).schema, *added]))


def targets(units: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Per ``source``: ``source_size``, ``target`` and ``documents``. The targets share the
    sum of all sizes by weight; none goes over ``most`` times its source's size, and what
    is over is shared again among the others."""
    spark = units.sparkSession
    totals = units.groupBy("source").agg(F.sum("mass").alias("source_size"), F.count("*").alias("documents"))
    ranked = totals.sort(F.asc_nulls_last("source")).rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    table = stored(spark.createDataFrame(ranked, "source string, source_size long, documents long, place long"), "sources")
    share = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1)
    table = table.withColumn("weight", share).withColumn("top", F.col("source_size") * most)
    # the level at which weight * level fills the sum; a source above its top stays at its top
    level, whole = 0.0, table.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    while True:
        over = F.col("weight") * level > F.col("top")
        row = table.agg(
            F.sum(F.when(over, F.col("top")).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        nearer = (whole - (row["fixed"] or 0.0)) / row["open"] if row["open"] else level
        if nearer <= level * (1 + 1e-12):
            break
        level = nearer
    target = F.least(F.col("top"), F.col("weight") * level)
    return table.select("source", "source_size", "documents", target.alias("target"))


def _round(table: pa.Table, last: bool) -> pa.Table:
    """Pair the fractions of one chunk. One row may stay fractional, unless ``last``."""
    # long documents first, so that what is left open in the end is short
    order = np.lexsort((table["key"].to_numpy(), -table["mass"].to_numpy()))
    table = table.take(pa.array(order))
    size = table["mass"].to_numpy().astype(float)
    fraction = table["fraction"].to_numpy().copy()
    key = table["key"].to_numpy().astype(np.uint64)
    held = -1
    for i in range(len(fraction)):
        if not 0.0 < fraction[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        up = min(size[a] * (1 - fraction[a]), size[b] * fraction[b])  # words that a can gain from b
        down = min(size[a] * fraction[a], size[b] * (1 - fraction[b]))
        if _chance(key[a], key[b]) * (up + down) < down:
            move, fills = up, size[a] * (1 - fraction[a]) <= size[b] * fraction[b]
            gains, loses = a, b
        else:
            move, fills = down, size[b] * (1 - fraction[b]) <= size[a] * fraction[a]
            gains, loses = b, a
        fraction[gains] += move / size[gains]
        fraction[loses] -= move / size[loses]
        done, other = (gains, loses) if fills else (loses, gains)
        fraction[done] = 1.0 if fills else 0.0
        if not 1e-12 < fraction[other] < 1 - 1e-12:
            fraction[other] = round(fraction[other])
            held = -1
        else:
            held = other
    if last and held >= 0:
        fraction[held] = 1.0 if _chance(key[held], np.uint64(0x5851F42D4C957F2D)) < fraction[held] else 0.0
    return table.set_column(table.schema.get_field_index("fraction"), "fraction", pa.array(fraction))


def _round_open(table: pa.Table) -> pa.Table:
    return _round(table, last=False)


def _round_last(table: pa.Table) -> pa.Table:
    return _round(table, last=True)


def _chance(a: np.uint64, b: np.uint64) -> float:
    mixed = mix(np.array([int(a) ^ (int(b) << 1 & (1 << 64) - 1)], dtype=np.uint64))[0]
    return float(mixed >> np.uint64(11)) / (1 << 53)


def rounded(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: int = 1
) -> DataFrame:
    """Per distinct row of ``docs`` (doc_id, source, text): ``doc_id``, ``source``, ``text_hash``,
    number ``n`` of equal rows, ``size``, ``source_size``, ``target``, ``sure`` copies of each, number
    ``more`` of the equal rows that get one copy more, and a ``key`` of the distinct row."""
    facts = sized(docs.select("doc_id", "source", "text")).withColumnsRenamed({"_size": "size", "_text_hash": "text_hash"})
    units = facts.groupBy("doc_id", "source", "size", "text_hash").agg(F.count("*").alias("n"))
    units = stored(units.withColumn("mass", F.col("n") * F.col("size")), "sizes")
    goals = stored(targets(units, weights, most), "targets")
    named = goals.withColumnRenamed("source", "name")
    times = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(times + 1e-12)
    columns = ("doc_id", "source", "text_hash", "n", "size", "mass", "source_size", "target", "sure", "whole", "fraction", "key", "chunk")
    rows = (
        units.join(named, F.col("source").eqNullSafe(F.col("name")))
        .withColumn("sure", whole.cast("long"))
        .withColumn("fraction", F.greatest(F.lit(0.0), times - whole) * F.col("n"))
        .withColumn("whole", F.floor(F.col("fraction") + 1e-12).cast("long"))
        .withColumn("fraction", F.greatest(F.lit(0.0), F.col("fraction") - F.col("whole")))
        .withColumn("mass", F.col("size"))  # one document is open
        .withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "source", "text_hash"))
        .withColumn("chunk", F.pmod("key", F.ceil(F.col("documents") / CHUNK)))
        .select(*columns)
    )
    most_rows = goals.agg(F.max("documents").alias("n")).first()["n"] or 0
    chunks, done = math.ceil(most_rows / CHUNK), []
    while chunks > 1:
        level = stored(rows.groupBy("source", "chunk").applyInArrow(_round_open, rows.schema), "rounded")
        fractional = (F.col("fraction") > 0) & (F.col("fraction") < 1)
        done.append(level.where(~fractional))
        rows = level.where(fractional).withColumn("chunk", F.floor(F.col("chunk") / CHUNK))
        chunks = math.ceil(chunks / CHUNK)
    out = rows.groupBy("source", "chunk").applyInArrow(_round_last, rows.schema)
    for level in done:
        out = out.unionByName(level)
    more = (F.col("whole") + F.round("fraction")).cast("long")
    return out.select("doc_id", "source", "text_hash", "n", "size", "source_size", "target", "sure", more.alias("more"), "key")


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: int = 1
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``
    and ``taken`` words."""
    each = rounded(docs, weights, most, seed).withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    each = each.withColumn("copies", F.col("sure") + (F.col("_row") <= F.col("more")).cast("long"))
    return each.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def apply(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: int = 1) -> DataFrame:
    """The rows of ``docs`` (all columns), each as often as the mix takes it."""
    takes = rounded(docs, weights, most, seed).where("sure > 0 or more > 0")
    takes = stored(takes.select(*[F.col(c).alias(f"_{c}_") for c in ("doc_id", "source", "text_hash", "n", "sure", "more", "key")]), "takes")
    same = (
        F.col("doc_id").eqNullSafe(F.col("_doc_id_"))
        & F.col("source").eqNullSafe(F.col("_source_"))
        & (F.col("_text_hash") == F.col("_text_hash_"))
    )

    def repeat(rows: DataFrame, copies: Column) -> DataFrame:
        rows = rows.withColumn("_copies", copies.cast("int")).where("_copies > 0")
        times = F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_time")
        return rows.select("row", "text", times).select(*restored(docs))

    facts = sized(docs.select(carried(docs), "doc_id", "source", "text"), text=True)
    alike = (F.col("_more_") == 0) | (F.col("_more_") == F.col("_n_"))
    out = repeat(facts.join(takes.where(alike), same), F.col("_sure_") + (F.col("_more_") > 0).cast("long"))
    # some of several equal rows get one copy more: number them, by part first
    mixed = takes.where(~alike)
    if mixed.isEmpty():
        return out
    part = stored(facts.join(mixed, same).withColumn("_part", F.spark_partition_id()), "repeated")
    inside = F.row_number().over(Window.partitionBy("_key_", "_part").orderBy(F.lit(1)))
    before = F.sum("_rows").over(Window.partitionBy("_key_").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    earlier = part.groupBy("_key_", "_part").agg(F.count("*").alias("_rows")).withColumn("_before", F.coalesce(before, F.lit(0)))
    numbered = part.withColumn("_place", inside).join(earlier, ["_key_", "_part"])
    place = F.col("_place") + F.col("_before")
    return out.unionByName(repeat(numbered, F.col("_sure_") + (place <= F.col("_more_")).cast("long")))
