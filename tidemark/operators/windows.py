"""Global ranks, capped samples and newest-version reads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.cdc import newest, with_scalars

SLICES = 256  # parts of about equal size that a global order is cut into
_SAMPLED = 64  # rows looked at per slice to choose its bounds
_BLOCK = 16  # bounds between two heads, so that a row is compared with few of them


def _cuts(df: DataFrame, orders: Mapping[str, Sequence[str]], slices: int) -> DataFrame:
    """One row with the sorted slice bounds of every order.

    Of each of a fixed number of hash classes the row with the smallest hash is kept, so the
    sample depends on the rows alone: a task that runs again finds the same bounds."""
    cols = list(dict.fromkeys(c for order in orders.values() for c in order))
    classes = slices * _SAMPLED
    picked = (
        df.select(*cols)
        .withColumn("_h", F.xxhash64(*cols))
        .groupBy(F.pmod("_h", F.lit(classes)).alias("_class"))
        .agg(F.min(F.struct("_h", *cols)).alias("_row"))
    )

    keys = picked.agg(
        *[
            F.sort_array(F.collect_list(F.struct(*[F.col(f"_row.{c}").alias(c) for c in order]))).alias(name)
            for name, order in orders.items()
        ]
    )

    def bounds(name: str) -> Column:
        places = F.sequence(F.lit(1), F.lit(slices - 1))
        return F.transform(places, lambda i: F.col(name)[F.floor(i * F.size(name) / slices).cast("int")])

    # in a step of its own, so that the sorted list is made once and not per bound
    return keys.select(*[F.when(F.size(name) > 0, bounds(name)).alias(f"_cuts_{name}") for name in orders])


def _slice(cuts: str, order: Sequence[str]) -> Column:
    """How many bounds lie below a row: first by every ``_BLOCK``-th of them, then in one block."""
    key = F.struct(*order)
    heads = F.filter(cuts, lambda cut, at: ((at + 1) % _BLOCK == 0) & (cut < key))
    block = F.slice(cuts, F.size(heads) * _BLOCK + 1, F.lit(_BLOCK))
    return F.size(heads) * _BLOCK + F.size(F.filter(block, lambda cut: cut < key))


def global_ranks(
    df: DataFrame, orders: Mapping[str, Sequence[str]], total: str, slices: int = SLICES
) -> DataFrame:
    """0-based rank of every row in each of several global orders (``name -> columns``), and the
    number of rows, without sending all rows through one task.

    Bounds from a small sample cut each order into slices; one pass counts the slices of all
    orders, and prefix sums over these counts (one number per slice) say how many rows come
    before a slice. Only inside a slice are rows put in order. Equal values are told apart by the
    further columns of the order, in the bounds too, so a value that a third of all rows share
    fills many slices. The plan is lazy; bounds and counts are scalar subqueries.
    """
    sliced = with_scalars(df, _cuts(df, orders, slices)).select(
        *df.columns, *[_slice(f"_cuts_{name}", order).alias(f"_slice_{name}") for name, order in orders.items()]
    )
    places = [F.struct(F.lit(name).alias("o"), F.col(f"_slice_{name}").alias("s")) for name in orders]
    sizes = sliced.select(F.explode(F.array(*places)).alias("p")).groupBy("p.o", "p.s").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("o").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))

    def start_of(name: str) -> Column:
        here = F.when(F.col("o") == name, F.struct("s", "before"))
        return F.map_from_entries(F.collect_list(here)).alias(f"_start_{name}")

    first = next(iter(orders))
    rows = F.coalesce(F.sum(F.when(F.col("o") == first, F.col("n"))), F.lit(0)).alias(total)
    ranked = with_scalars(sliced, starts.agg(rows, *[start_of(name) for name in orders]))
    for name, order in orders.items():
        inside = Window.partitionBy(f"_slice_{name}").orderBy(*order)
        before = F.col(f"_start_{name}")[F.col(f"_slice_{name}")]
        ranked = ranked.withColumn(f"_before_{name}", before).drop(f"_start_{name}")
        ranked = ranked.withColumn(name, F.col(f"_before_{name}") + F.row_number().over(inside) - 1)
    return ranked.select(*df.columns, *orders, total)


def tile(rank: Column, total: Column, n: int) -> Column:
    """Tile number 1..n of a 0-based rank; the first tiles take the remainder."""
    size, extra = F.floor(total / n), total % n
    head = extra * (size + 1)
    return (
        F.when(rank < head, F.floor(rank / (size + 1)) + 1)
        .otherwise(extra + F.floor((rank - head) / F.greatest(size, F.lit(1))) + 1)
        .cast("int")
    )


def ntiles_global(
    df: DataFrame, orders: Mapping[str, Sequence[str]], n: int, slices: int = SLICES
) -> DataFrame:
    """``ntile(n)`` over each global order, as columns named by ``orders``. Every order must end
    in a unique column."""
    ranked = global_ranks(df, orders, "_total", slices)
    tiles = {name: tile(F.col(name), F.col("_total"), n) for name in orders}
    return ranked.withColumns(tiles).drop("_total")


def ntile_global(df: DataFrame, order: Sequence[str], n: int, name: str) -> DataFrame:
    """``ntile(n)`` over one global order; ``order`` must end in a unique column."""
    return ntiles_global(df, {name: order}, n)


def sample_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, salts: int = 64
) -> DataFrame:
    """The first ``n`` rows of every group in ``order``.

    A first cut inside hash parts of the group leaves at most ``salts * n`` rows
    for the final cut, so a huge group is never sorted in one task.
    """
    part = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    inner = Window.partitionBy(*group, "_part").orderBy(*order)
    outer = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_part", part)
        .withColumn("_rank", F.row_number().over(inner))
        .where(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(outer))
        .where(F.col("_rank") <= n)
        .drop("_part", "_rank")
    )


def latest_by(df: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """Newest row per key of an append-mode table."""
    return newest(df, key, (version,))
