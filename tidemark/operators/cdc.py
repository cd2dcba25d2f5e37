"""The core layer: row projection, current state, profile."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.contracts import MONTH, VERSION_ORDER, Contract
from tidemark.functions import flag, stamp
from tidemark.operators.joins import Sieve, can_sieve, passes

CORE_TECHNICAL = ("_cdc_seq", "_kafka_ts", "_partition", "_offset", "_is_deleted", "_ingested_at")


def to_core(landing: DataFrame, contract: Contract) -> DataFrame:
    """Landing row to core row. One row in, one row out, no join; works on a
    stream as on a batch. The source coordinates stay as the tie-break."""
    return landing.select(
        *contract.columns,
        "_cdc_seq",
        "_kafka_ts",
        "_partition",
        "_offset",
        flag(F.col("_op").isin(*contract.soft_delete_operations)).alias("_is_deleted"),
        "_ingested_at",
    )


def newest(df: DataFrame, key: Sequence[str], order: Sequence[str] = VERSION_ORDER) -> DataFrame:
    """The newest row of every key, deleted or not.

    ``row_number = 1`` lets Spark prune to one row per key inside every map task
    before the shuffle, so a key with very many versions does not pile up.
    """
    by_version = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return (
        df.withColumn("_rank", F.row_number().over(by_version))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )


def current_state(
    core: DataFrame,
    contract: Contract,
    since: datetime | None = None,
    on: str | None = None,
    coordinates: bool = False,
) -> DataFrame:
    """One live row per key: highest version, deleted keys gone.

    ``since`` keeps rows with ``on >= since``. It is applied before the versions
    are compared (so partitions and row groups are skipped) only where the
    contract declares ``on`` immutable; otherwise after. ``coordinates`` adds the
    source partition and offset of the winning version.
    """
    recent = None if since is None else F.col(on) >= stamp(since)
    if recent is not None and on in contract.immutable:
        core = core.where(recent)
        if MONTH in core.columns and on == contract.partition_on:
            core = core.where(F.col(MONTH) >= int(since.strftime("%Y%m")))
    live = newest(core, contract.key).where(F.col("_is_deleted") == 0)
    if recent is not None and on not in contract.immutable:
        live = live.where(recent)
    extra = ("_partition", "_offset") if coordinates else ()
    return live.select(*contract.columns, "_ingested_at", *extra)


def current_of(
    core: DataFrame, contract: Contract, keys: DataFrame, through: Sieve | None = None
) -> DataFrame:
    """Current rows whose ``keys`` columns are among ``keys``; ``through`` is their sieve, if
    there is one.

    Columns that cannot differ between the versions of a key are restricted before
    the versions are compared. Otherwise a key may have moved (a payment to another
    order): all versions of every key that was ever there are compared, and the
    rows that are there now are kept.
    """
    on = keys.columns
    likely = core if through is None or not can_sieve(core, keys) else core.where(passes(on, through))
    hit = likely.join(keys, on, "left_semi")
    if set(on) <= {*contract.key, *contract.immutable}:
        return current_state(hit, contract)
    ever = hit.select(*contract.key).distinct()
    resolved = current_state(core.join(ever, list(contract.key), "left_semi"), contract)
    return resolved.join(keys, on, "left_semi")


def current_under(core: DataFrame, contract: Contract, head: DataFrame, on: str) -> DataFrame:
    """Current rows of a child entity together with columns of its parent.

    ``head`` has one row per ``on``, which is part of the child's key or constant
    per key, so the join may come before the versions are compared: only versions
    of wanted parents are shuffled, and the join's partitioning serves the window. The
    parents may be all there are, so they are merged and never broadcast.
    """
    joined = core.join(head.hint("merge"), on)
    extra = [c for c in head.columns if c != on]
    live = newest(joined, contract.key).where(F.col("_is_deleted") == 0)
    return live.select(*contract.columns, *extra)


def current_by_max(core: DataFrame, contract: Contract, columns: Sequence[str]) -> DataFrame:
    """The same state by one aggregation over a few columns (wide scans)."""
    version = F.struct(*VERSION_ORDER)
    picked = F.max_by(F.struct(*columns, "_is_deleted"), version).alias("row")
    return (
        core.groupBy(*contract.key)
        .agg(picked)
        .where(F.col("row._is_deleted") == 0)
        .select(*contract.key, *[F.col(f"row.{c}").alias(c) for c in columns])
    )


# operation letter -> name of its counter
OPERATION_COUNTS = {
    "c": "ops_create",
    "u": "ops_update",
    "d": "ops_delete",
    "r": "ops_snapshot",
}


def fold_keys(landing: DataFrame, key: Sequence[str], chunk: int = 1_000_000) -> DataFrame:
    """One row per key of a landing table: records, operations, last message, and
    ``regressions`` - how often ``_cdc_seq`` falls in arrival order (partition,
    offset).

    A key may hold a large part of all records, so neighbours are compared within
    chunks of an offset range (at most ``chunk`` offsets each); the first and last
    sequence of every chunk then settle the seams between chunks. Records that
    share a coordinate are taken in sequence order.
    """
    key = list(key)
    arrivals = landing.select(
        *key,
        "_partition",
        "_offset",
        "_cdc_seq",
        "_op",
        "_kafka_ts",
        F.floor(F.col("_offset") / chunk).alias("_chunk"),
    )
    inside = Window.partitionBy(*key, "_partition", "_chunk").orderBy("_offset", "_cdc_seq")
    place = F.struct("_offset", "_cdc_seq")
    chunks = (
        arrivals.withColumn("_falls", flag(F.lag("_cdc_seq").over(inside) > F.col("_cdc_seq")))
        .groupBy(*key, "_partition", "_chunk")
        .agg(
            F.sum("_falls").alias("_falls"),
            F.min_by("_cdc_seq", place).alias("_first"),
            F.max_by("_cdc_seq", place).alias("_last"),
            F.count(F.lit(1)).alias("records"),
            F.max("_kafka_ts").alias("last_kafka_ts"),
            *[F.count_if(F.col("_op") == op).alias(n) for op, n in OPERATION_COUNTS.items()],
        )
    )
    across = Window.partitionBy(*key).orderBy("_partition", "_chunk")
    return (
        chunks.withColumn("_seam", flag(F.lag("_last").over(across) > F.col("_first")))
        .groupBy(*key)
        .agg(
            F.sum(F.col("_falls") + F.col("_seam")).alias("regressions"),
            F.max("last_kafka_ts").alias("last_kafka_ts"),
            *[F.sum(c).alias(c) for c in ("records", *OPERATION_COUNTS.values())],
        )
    )


def seq_regressions(landing: DataFrame, key: Sequence[str], chunk: int = 1_000_000) -> DataFrame:
    """Keys whose sequence falls in arrival order, and how often."""
    found = fold_keys(landing, key, chunk).where(F.col("regressions") > 0)
    return found.select(*key, "regressions")


def landing_profile(landing: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row, from one pass: volume, distinct keys, operations, last message,
    keys that arrived out of order."""

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    return fold_keys(landing, key).agg(
        F.max("last_kafka_ts").alias("last_kafka_ts"),
        total("records").alias("landing_rows"),
        F.count(F.lit(1)).alias("landing_distinct_keys"),
        *[total(n).alias(n) for n in OPERATION_COUNTS.values()],
        F.count_if(F.col("regressions") > 0).alias("cdc_seq_non_monotonic"),
    )


def core_profile(state: DataFrame, contract: Contract) -> DataFrame:
    """One row: live keys, deleted keys, and keys that are live twice. ``state`` is what readers
    get before deleted keys are dropped; it should hold one row per key, which is counted here
    and not assumed."""
    live = flag(F.col("_is_deleted") == 0)
    per_key = state.groupBy(*contract.key).agg(F.sum(live).alias("live"))
    return per_key.agg(
        F.count_if(F.col("live") > 0).alias("core_rows"),
        F.count_if(F.col("live") == 0).alias("core_deleted_keys"),
        F.count_if(F.col("live") > 1).alias("keys_with_dup_in_core"),
    )


def with_scalars(df: DataFrame, *one_row: DataFrame) -> DataFrame:
    """Append the columns of one-row frames, each as a scalar subquery."""
    for n, frame in enumerate(one_row):
        df = df.withColumn(f"_s{n}", frame.select(F.struct("*")).scalar()).select(
            *df.columns, f"_s{n}.*"
        )
    return df


def cdc_profile(landing: DataFrame, state: DataFrame, contract: Contract) -> DataFrame:
    """One row per entity: operations, keys, duplicates, out-of-order keys."""
    both = with_scalars(landing_profile(landing, contract.key), core_profile(state, contract))
    return both.select(
        F.lit(contract.context).alias("context"), F.lit(contract.entity).alias("entity"), "*"
    )


def immutable_changes(core: DataFrame, contract: Contract) -> DataFrame:
    """Keys with versions that differ in a column declared immutable, and in which (``changed``).

    Deletes count as versions: readers restrict such a column before versions are compared, so a
    delete with another value would be passed over and its key come back. Null beside a value
    is a difference, null in all versions is none."""

    def differs(name: str) -> Column:
        nulls = F.count_if(F.col(name).isNull())
        return (F.min(name) != F.max(name)) | ((nulls > 0) & (F.count(name) > 0))

    named = [F.when(differs(name), F.lit(name)) for name in contract.immutable]
    per_key = core.groupBy(*contract.key).agg(F.array_compact(F.array(*named)).alias("changed"))
    return per_key.where(F.size("changed") > 0)


class Lake:
    """Access to the layers by entity name: landing, core and current state. ``stored`` gives
    the rows of the stored state table of an entity, where there is one."""

    def __init__(
        self,
        landing: dict,
        contracts: dict[str, Contract],
        core: dict | None = None,
        stored: Callable[[str], DataFrame] | None = None,
    ):
        self._landing, self.contracts, self._core, self._stored = landing, contracts, core or {}, stored

    def landing(self, entity: str) -> DataFrame:
        return self._landing[entity]

    def core(self, entity: str) -> DataFrame:
        if entity not in self._core:
            self._core[entity] = to_core(self.landing(entity), self.contracts[entity])
        return self._core[entity]

    def state(self, entity: str) -> DataFrame:
        """The row of every key, deleted or not, as stored; worked out where nothing is."""
        if self._stored is not None:
            return self._stored(entity)
        return newest(self.core(entity), self.contracts[entity].key)

    def parents(self, child: str, on: str, parent: str, since: datetime, narrow: bool) -> DataFrame:
        """Current parents of child rows created from ``since`` on. For a narrow
        window only the parents named by any of its child versions are resolved,
        instead of all history. A wide window names all parents, so they are merged."""
        if not narrow:
            return self.current(parent)
        recent = self.core(child).where(F.col("created_at") >= stamp(since))
        return current_of(self.core(parent), self.contracts[parent], recent.select(on).distinct().hint("merge"))

    def current(
        self,
        entity: str,
        since: datetime | None = None,
        on: str = "created_at",
        coordinates: bool = False,
    ) -> DataFrame:
        return current_state(self.core(entity), self.contracts[entity], since, on, coordinates)
