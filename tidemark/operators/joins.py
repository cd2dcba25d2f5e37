"""Lookups, as-of joins, anti joins that keep the total, peer joins."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import flag, stamp, valid_at


@dataclass(frozen=True)
class Lookup:
    """A registry, read by key. How it is joined is left to Spark's byte statistics and
    run-time planning."""

    frame: DataFrame
    key: str


def lookup_join(
    df: DataFrame,
    lookup: Lookup,
    on: Column | str,
    attrs: dict[str, tuple[str, object]],
    found: str,
) -> DataFrame:
    """Left join to a registry; an unknown key keeps its row.

    ``attrs`` maps an output column to (registry column, default). A default of
    ``None`` leaves unknown keys null. ``found`` says whether the key is known.
    """
    on = F.col(on) if isinstance(on, str) else on
    side = lookup.frame.select(
        F.col(lookup.key).alias("_lk"),
        F.lit(1).alias("_hit"),
        *[F.col(src).alias(f"_lk_{out}") for out, (src, _) in attrs.items()],
    )
    joined = df.withColumn("_on", on).join(side, F.col("_on") == F.col("_lk"), "left")

    def value(out: str, src: str, default: object) -> Column:
        col = F.col(f"_lk_{out}")
        if default is None:
            return col.alias(out)
        dtype = lookup.frame.schema[src].dataType
        return F.coalesce(col, F.lit(default).cast(dtype)).alias(out)

    return joined.select(
        *df.columns,
        flag(F.col("_hit") == 1).alias(found),
        *[value(out, src, default) for out, (src, default) in attrs.items()],
    )


def _slot(ts: Column, start: datetime, width_s: float, buckets: int) -> Column:
    """Time slice of ``ts``: 0 … buckets-1, and -1 for anything before ``start``."""
    seconds = F.timestamp_diff("SECOND", stamp(start), ts)
    slot = F.least(F.floor(seconds / F.lit(width_s)), F.lit(buckets - 1)).cast("int")
    return F.when(ts.isNull() | (ts < stamp(start)), F.lit(-1)).otherwise(slot)


def asof_left(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    cols: Sequence[str],
    tie: Sequence[str] = (),
    span: tuple[datetime, datetime] | None = None,
    buckets: int = 16,
    salts: int | None = None,
) -> DataFrame:
    """For every left row the right row of the same keys with the greatest
    ``right_ts <= left_ts``; left rows without one keep nulls.

    One hot key must not end in one task, so a key is cut into time slices of
    ``span`` and the left rows of a slice into ``salts`` parts:

    * the newest right row before each slice is worked out from the right side
      alone (at most ``buckets`` rows per key) and joined by (keys, slice);
    * right rows inside a slice are merged with the left rows by one window per
      (keys, slice, salt); only these rows are repeated per salt.

    A row inside the slice is always newer than the carried one. ``tie`` orders
    right rows of equal time; the greatest wins. Left rows outside ``span`` are
    matched as well, only without the cut.
    """
    keys = list(keys)
    spark = left.sparkSession
    if span is None:
        start, width, buckets = datetime(1970, 1, 1), 1.0, 1
    else:
        start = span[0]
        width = max((span[1] - span[0]).total_seconds() / buckets, 1.0)
    if salts is None:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        salts = max(1, min(32, math.ceil(parts / (2 * buckets))))

    usable = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*keys, right_ts]])
    changes = right.where(usable).select(
        *keys,
        _slot(F.col(right_ts), start, width, buckets).alias("_slot"),
        F.col(right_ts).alias("_at"),
        *[F.col(t).alias(f"_tie{i}") for i, t in enumerate(tie)],
        F.struct(*cols).alias("_value"),
    )
    ties = [f"_tie{i}" for i in range(len(tie))]

    by_slot = Window.partitionBy(*keys).orderBy("_slot")
    carried = (
        changes.groupBy(*keys, "_slot")
        .agg(F.max_by("_value", F.struct("_at", *ties)).alias("_carry"))
        .withColumn(
            "_until", F.coalesce(F.lead("_slot").over(by_slot), F.lit(buckets - 1))
        )
        .where(F.col("_slot") < F.col("_until"))
        .select(
            *keys,
            F.explode(F.sequence(F.col("_slot") + 1, F.col("_until"))).alias("_slot"),
            "_carry",
        )
    )

    # Each left column goes along once and by itself: keys and time are there already (unless the union
    # below would widen them), and what nobody asks for afterwards is not shuffled.
    pairs = [*((k, k, k) for k in keys), (left_ts, right_ts, "_at")]
    there = {l: name for l, r, name in pairs if left.select(l).schema[0].dataType == right.select(r).schema[0].dataType}
    carrier = {c: there.get(c, f"_left{i}") for i, c in enumerate(left.columns)}

    # a content hash, so a re-run task puts every row where it was before
    part = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    placed = left.select(
        *keys,
        _slot(F.col(left_ts), start, width, buckets).alias("_slot"),
        F.col(left_ts).alias("_at"),
        *[F.col(c).alias(n) for c, n in carrier.items() if c not in there],
        part.alias("_salt"),
    ).withColumn("_salt", F.when(F.col("_slot") >= 0, F.col("_salt")).otherwise(0))
    # one row per key and slice, of which Spark's byte statistics know nothing (they take the sequence
    # for one row): left to them it would be broadcast, and pass through the driver
    with_carry = placed.join(carried.hint("merge"), [*keys, "_slot"], "left").withColumn("_side", F.lit(1))
    repeated = changes.withColumn(
        "_salt",
        F.explode(
            F.when(F.col("_slot") >= 0, F.array(*[F.lit(i) for i in range(salts)])).otherwise(
                F.array(F.lit(0))
            )
        ),
    ).withColumn("_side", F.lit(0))

    within = (
        Window.partitionBy(*keys, "_slot", "_salt")
        .orderBy("_at", "_side", *ties)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    merged = repeated.unionByName(with_carry, allowMissingColumns=True)
    filled = merged.withColumn("_seen", F.last("_value", ignorenulls=True).over(within)).where(
        F.col("_side") == 1
    )
    return filled.select(
        *[F.col(n).alias(c) for c, n in carrier.items()],
        F.coalesce(F.col("_seen"), F.col("_carry")).alias("_match"),
    ).select(*left.columns, *[F.col(f"_match.{c}").alias(c) for c in cols])


def price_at(prices: DataFrame, as_of: datetime) -> DataFrame:
    """One price per item: the newest validity begun and not ended at ``as_of``."""
    cols = ("price_list_id", "currency", "list_price", "cost_price")
    newest = F.max_by(F.struct(*cols, "valid_from"), F.struct("valid_from", "price_list_id"))
    return (
        prices.where(valid_at("valid_from", "valid_to", as_of))
        .groupBy("item_id")
        .agg(newest.alias("p"))
        .select("item_id", *[f"p.{c}" for c in cols], F.col("p.valid_from").alias("price_valid_from"))
    )


NULL_SALTS = 4096


def with_null_salt(df: DataFrame, key: Sequence[str], by: Sequence[str] | None = None) -> DataFrame:
    """``_salt``: 0 where the key is whole, otherwise a number from 1 on by the columns ``by`` (all,
    if none are named: then all of them have to be read and carried up to here)."""
    part = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
    spread = F.pmod(F.xxhash64(*(by or df.columns)), F.lit(NULL_SALTS)) + 1
    return df.withColumn("_salt", F.when(part, spread).otherwise(F.lit(0).cast("bigint")))


def mark_missing(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    mark: str = "is_orphan",
    by: Sequence[str] | None = None,
    spread: bool = True,
) -> DataFrame:
    """Anti join that keeps the denominator: every left row stays, ``mark`` is 1
    where no right row matches. The right side is made unique first. Left rows with a null in
    their key match nothing, so they are spread by a salt (of the columns ``by``) and never meet in
    one task. Without ``spread`` there is no salt, and left rows that are partitioned by the key
    already are not shuffled again."""
    names = [f"_r{i}" for i in range(len(on))]
    side = (
        right.select(*[F.col(r).alias(n) for (_, r), n in zip(on, names)])
        .distinct()
        .withColumns({"_hit": F.lit(1), "_side": F.lit(0).cast("bigint")})
    )
    same = [F.col(l) == F.col(n) for (l, _), n in zip(on, names)]
    rows = left
    if spread:
        rows = with_null_salt(left, [l for l, _ in on], by)
        same.append(F.col("_salt") == F.col("_side"))
    return rows.join(side, reduce(lambda a, b: a & b, same), "left").select(
        *left.columns, flag(F.col("_hit").isNull()).alias(mark)
    )


def anti_with_total(
    left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]
) -> DataFrame:
    """One row: how many left rows there are and how many have no partner."""
    return mark_missing(left, right, on).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.coalesce(F.sum("is_orphan"), F.lit(0)).alias("orphan_rows"),
    )


def full_peer_join(a: DataFrame, b: DataFrame, on: str, has_a: str, has_b: str) -> DataFrame:
    """Full outer join of equals: neither side is the parent of the other."""
    left = a.withColumn(has_a, F.lit(1))
    right = b.withColumn(has_b, F.lit(1))
    joined = left.join(right, on, "full")
    return joined.withColumns(
        {
            has_a: F.coalesce(F.col(has_a), F.lit(0)),
            has_b: F.coalesce(F.col(has_b), F.lit(0)),
        }
    )


def touched_keys(frames: Sequence[DataFrame], key: str, cut: datetime) -> DataFrame:
    """Distinct keys with ``updated_at >= cut`` in any of the frames."""
    recent = [f.where(F.col("updated_at") >= stamp(cut)).select(key) for f in frames]
    return reduce(DataFrame.unionByName, recent).distinct()


# Bits of a sieve: 16 per key, up to 16 MB. Its memory does not grow with the keys, only its errors do.
SIEVE_BITS = 1 << 15, 1 << 27
_WORD, _ROW = 6, 12  # a word has 2**6 bits; words are gathered by 2**12 bits first


@dataclass(frozen=True)
class Sieve:
    """``words``, one row: a bitmap of the hashes of keys, of ``bits`` bits."""

    words: DataFrame
    bits: int


def sieve(keys: DataFrame) -> Sieve:
    """To drop rows before a shuffle that a join with many keys would drop after it. It passes all keys
    and a few others (one of twelve, for 11 million keys), so the join is still needed. ``keys`` are
    counted, and read once more for it: they should be stored."""
    least, most = SIEVE_BITS
    bits = min(most, max(least, 1 << (16 * keys.count()).bit_length()))
    bit = F.pmod(F.xxhash64(*keys.columns), F.lit(bits))
    words = (
        keys.select(bit.alias("_bit"))
        .groupBy(F.shiftright("_bit", _WORD).alias("_word"))
        .agg(F.expr(f"bit_or(shiftleft(1L, cast(_bit & {(1 << _WORD) - 1} as int)))").alias("_bits"))
    )
    width = 1 << (_ROW - _WORD)
    zero = F.lit(0).cast("bigint")
    empty = keys.sparkSession.range(bits >> _ROW).select((F.col("id") * width).alias("_word"), zero.alias("_bits"))
    entry = F.map_from_entries(F.collect_list(F.struct((F.col("_word") % width).cast("int"), "_bits")))
    places = F.sequence(F.lit(0), F.lit(width - 1))
    rows = (
        words.unionAll(empty)
        .groupBy("_word")
        .agg(F.bit_or("_bits").alias("_bits"))
        .groupBy(F.shiftright("_word", _ROW - _WORD).alias("_row"))
        .agg(entry.alias("_set"))  # at most ``width`` entries
        .select("_row", F.transform(places, lambda i: F.coalesce(F.col("_set")[i], zero)).alias("_words"))
    )
    in_order = F.array_sort(F.collect_list(F.struct("_row", "_words")))  # as many as ``bits`` have, no more
    return Sieve(rows.agg(F.flatten(F.transform(in_order, lambda r: r["_words"])).alias("_sieve")), bits)


def can_sieve(df: DataFrame, keys: DataFrame) -> bool:
    """Whether equal values of the columns of ``keys`` have equal hashes in ``df``."""
    plain = {"string", "int", "bigint", "date"}
    kinds = [(df.schema[c].dataType, keys.schema[c].dataType) for c in keys.columns]
    return all(a == b and a.simpleString() in plain for a, b in kinds)


def passes(on: Sequence[str], through: Sieve) -> Column:
    """Whether the ``on`` columns of a row pass a sieve. As a filter, and not a join, it goes down to
    where the rows are read."""
    bit = F.pmod(F.xxhash64(*on), F.lit(through.bits))
    word = F.get(through.words.scalar(), F.shiftright(bit, _WORD).cast("int"))
    return F.getbit(word, (bit % (1 << _WORD)).cast("int")) == 1


def fanout_guard(mart: DataFrame, detail: DataFrame, key: str, count_col: str) -> DataFrame:
    """Keys whose count in the mart differs from the number of detail rows."""
    counted = detail.groupBy(key).agg(F.count(F.lit(1)).alias("actual_count"))
    return (
        mart.select(key, count_col)
        .join(counted, key, "left")
        .withColumn("actual_count", F.coalesce(F.col("actual_count"), F.lit(0)))
        .where(F.col(count_col) != F.col("actual_count"))
    )
