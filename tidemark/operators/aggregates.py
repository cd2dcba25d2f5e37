"""Aggregations that need more than one built-in call."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.cdc import with_scalars

SKETCH = 10_000  # accuracy of approximate quantiles


def quantiles(
    df: DataFrame, group: Sequence[str], col: str, qs: dict[str, float], exact: bool = True
) -> DataFrame:
    """Quantiles of ``col`` per group, one output column per entry of ``qs``.

    Exact: values are first counted (combined on the map side), so only distinct
    values travel; see ``counted_quantiles``. ``exact=False`` uses a bounded sketch.
    """
    values = df.where(F.col(col).isNotNull())
    if exact:
        counted = values.groupBy(*group, col).agg(F.count(F.lit(1)).alias("_n"))
        return counted_quantiles(counted, group, col, "_n", qs)
    picked = values.groupBy(*group).agg(
        F.percentile_approx(F.col(col), list(qs.values()), SKETCH).alias("_q")
    )
    return picked.select(
        *group, *[F.col("_q")[i].cast("double").alias(name) for i, name in enumerate(qs)]
    )


def counted_quantiles(
    counted: DataFrame, group: Sequence[str], col: str, weight: str, qs: dict[str, float], slices: int = 256
) -> DataFrame:
    """Exact interpolated quantiles per group of distinct values with their ``weight``.

    No task holds the values of a group: a sketch of bounded size cuts every group into slices
    of about as many values, the weights of slices say in which of them the wanted ranks lie, and
    only those slices are put in order.
    """
    group = list(group)
    probs = [i / slices for i in range(1, slices)]
    facts = counted.groupBy(*group).agg(
        F.percentile_approx(F.col(col), probs, SKETCH).alias("_cuts"), F.sum(weight).alias("_total")
    )
    below = F.size(F.filter("_cuts", lambda c: c < F.col(col)))
    sliced = _same(counted, facts, group).withColumn("_slice", below).drop("_cuts")

    sizes = sliced.groupBy(*group, "_slice").agg(F.sum(weight).alias("_in"), F.first("_total").alias("_total"))
    upto = Window.partitionBy(*group).orderBy("_slice")
    places = [F.col("_total") * 1.0 * q - q for q in qs.values()]
    ranks = [(F.floor(p), F.ceil(p)) for p in places]
    wanted = sizes.withColumn("_before", F.sum("_in").over(upto) - F.col("_in"))
    inside = reduce(
        lambda a, b: a | b,
        [(r >= F.col("_before")) & (r < F.col("_before") + F.col("_in")) for pair in ranks for r in pair],
    )
    wanted = wanted.where(inside).select(*group, "_slice", "_before")

    in_slice = Window.partitionBy(*group, "_slice").orderBy(col)
    ordered = _same(sliced, wanted, [*group, "_slice"]).withColumn("_end", F.col("_before") + F.sum(weight).over(in_slice))

    def at(rank):
        return F.max(F.when((rank < F.col("_end")) & (rank >= F.col("_end") - F.col(weight)), F.col(col))).cast("double")

    picked = ordered.groupBy(*group).agg(
        F.first("_total").alias("_total"),
        *[at(r).alias(f"_{name}_{side}") for name, pair in zip(qs, ranks) for side, r in zip(("lo", "hi"), pair)],
    )
    part = [p - F.floor(p) for p in places]
    return picked.select(
        *group,
        *[((1 - f) * F.col(f"_{name}_lo") + f * F.col(f"_{name}_hi")).alias(name) for name, f in zip(qs, part)],
    )


def _same(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on equal columns, null equal to null. Without columns ``right`` has one row."""
    if not on:
        return with_scalars(left, right)
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(renamed, condition).drop(*[f"_r_{c}" for c in on])


def preferred_value(df: DataFrame, key: str, col: str, out: str, weight: str | None = None) -> DataFrame:
    """Most frequent value per key; ties go to the smaller value."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = df.where(F.col(col).isNotNull()).groupBy(key, col).agg(n.alias("_n"))
    best = F.min_by(F.col(col), F.struct(-F.col("_n"), F.col(col)))
    return counted.groupBy(key).agg(best.alias(out))


def allocation_share(weight: str, group: Sequence[str], scale: int = 6):
    """Share of a row in its group by ``weight``; equal shares when all weigh zero.

    Rows without a weight take no share. Meant for rows that are already aggregated
    (a few per group)."""
    rows = Window.partitionBy(*group)
    w = F.greatest(F.col(weight), F.lit(0)).cast("decimal(18,4)")
    total = F.sum(F.greatest(F.col(weight), F.lit(0))).over(rows).cast("decimal(18,4)")
    count = F.count(weight).over(rows).cast("decimal(18,4)")
    one = F.lit(1).cast("decimal(18,4)")
    zero = F.lit(0).cast("decimal(18,4)")
    by_weight = (w / F.nullif(total, zero)).cast(f"decimal(38,{scale})")
    equal = (one / F.nullif(count, zero)).cast(f"decimal(38,{scale})")
    return F.when(total > 0, by_weight).otherwise(equal)


def allocate(df: DataFrame, group: Sequence[str], amount: str, weight: str, out: str) -> DataFrame:
    """Split the group's ``amount`` over its rows in proportion to ``weight``."""
    share = allocation_share(weight, group)
    return df.withColumn("_share", share).withColumn(
        out, (F.col(amount).cast("decimal(18,4)") * F.col("_share")).cast("decimal(18,4)")
    ).drop("_share")


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return (
        df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    )
