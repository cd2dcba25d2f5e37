"""Materialization of marts: by window, in full, by touched keys; refresh log.

A refresh first writes its result, by period, to a staging folder beside the mart and then moves
the folders of its periods from there. A lost executor only repeats tasks. After a lost driver the next refresh,
or ``recover``, finishes the replacement from a complete staging folder and drops an
incomplete one. Nothing is read and overwritten in one plan. One writer per mart.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Collection, Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.contracts import BATCH, MONTH
from tidemark.functions import flag, midnight, seconds_between, stamp
from tidemark.operators.joins import Sieve, can_sieve, passes, sieve
from tidemark.operators.windows import latest_by
from tidemark.session import scratch, shuffles_freed
from tidemark.sources import files
from tidemark.sources.landing import apply_retention

PERIOD = "_period"
_FORMATS = {"day": "yyyy-MM-dd", "month": "yyyyMM"}


def period_start(moment: datetime, grain: str) -> datetime:
    day = midnight(moment)
    return day.replace(day=1) if grain == "month" else day


def aligned_days(as_of: datetime, days: int, grain: str) -> int:
    """``days`` stretched back to the start of its first partition, so that every
    partition touched by the window is recomputed as a whole."""
    start = period_start(midnight(as_of, days), grain)
    return (midnight(as_of) - start).days


@contextmanager
def staged(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """``df`` written to a fresh folder of the shared store and read back. The
    folder is removed when the block has succeeded; after a failure it stays."""
    spark = df.sparkSession
    path = scratch(spark, label)
    with shuffles_freed(spark):
        df.write.parquet(path)
    yield spark.read.schema(df.schema).parquet(path)
    files.delete(spark, path)


def _write_periods(rows: DataFrame, folder: str) -> None:
    with shuffles_freed(rows.sparkSession):
        rows.write.option("compression", "zstd").partitionBy(PERIOD).parquet(folder)


def _stage(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` written beside the mart at ``path`` by period, as the first step of a refresh, and
    read back. They are gathered by period here, once; afterwards only their files are moved."""
    spark, stage = rows.sparkSession, f"{path}-staging"
    files.delete(spark, stage)
    _write_periods(rows.hint("rebalance", PERIOD), f"{stage}/rows")
    return spark.read.schema(rows.schema).parquet(f"{stage}/rows")


def _publish(
    spark: SparkSession, path: str, drop: Callable[[str], bool], fresh: DataFrame, kept: DataFrame | None = None
) -> int:
    """Replace the periods of the staged rows, ``fresh``, in the mart at ``path``, together with the
    rows ``kept`` of it; of the periods absent from both, remove those ``drop`` names (their groups
    have vanished). Returns the number of rows.

    What is kept is staged beside the rows, then the periods to remove. From then on the
    refresh is decided, and ``recover`` can finish it whatever happens to the driver."""
    stage = f"{path}-staging"
    staged_rows = fresh.select(PERIOD)
    if kept is not None:
        _write_periods(kept, f"{stage}/kept")
        staged_rows = staged_rows.unionAll(spark.read.schema(kept.schema).parquet(f"{stage}/kept").select(PERIOD))
    # a handful of period labels, not data
    present = dict(staged_rows.groupBy(PERIOD).count().collect())
    gone = [(label,) for label in files.partitions(spark, path, PERIOD) if label not in present and drop(label)]
    spark.createDataFrame(gone, "label string").coalesce(1).write.parquet(f"{stage}/gone")
    _finish(spark, path)
    return sum(present.values())


def _finish(spark: SparkSession, path: str) -> None:
    """Put the staged folder of every period in place of that of the mart. Done again after it was
    cut off anywhere, it goes on where it was: a period is staged until its folder has been moved."""
    stage = f"{path}-staging"
    files.make(spark, path)
    for label, kept in files.partitions(spark, f"{stage}/kept", PERIOD).items():
        rows = f"{stage}/rows/{PERIOD}={label}"
        if not files.exists(spark, rows):
            files.move(spark, kept, rows)
            continue
        for name in files.names(spark, kept):
            files.move(spark, f"{kept}/{name}", f"{rows}/{name}")
        files.delete(spark, kept)  # before its rows are moved on, or it would be taken for all of the period
    for label, rows in files.partitions(spark, f"{stage}/rows", PERIOD).items():
        target = f"{path}/{PERIOD}={label}"
        files.delete(spark, target)
        files.move(spark, rows, target)
    folders = files.partitions(spark, path, PERIOD)
    for (label,) in spark.read.schema("label string").parquet(f"{stage}/gone").collect():
        if label in folders:
            files.delete(spark, folders[label])
    files.delete(spark, f"{stage}/gone")  # before the rows: what is left is then no decided refresh
    files.delete(spark, stage)


def recover(spark: SparkSession, path: str) -> bool:
    """Finish a refresh of the mart at ``path`` that was cut off after its result had been staged
    whole, and throw away one that was cut off before. Every refresh begins with it, so a crash
    can leave a mart half replaced only until the next one. Whether there was one to finish."""
    stage = f"{path}-staging"
    decided = files.exists(spark, f"{stage}/gone/_SUCCESS")
    if decided:
        _finish(spark, path)
    files.delete(spark, stage)
    return decided


def read_mart(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(PERIOD)


def refresh_window(
    job: Callable[[datetime, int], DataFrame],
    path: str,
    as_of: datetime,
    days: int,
    date_col: str,
    grain: str = "month",
) -> int:
    """Recompute ``job(as_of, days)`` and replace the partitions of the window,
    including those left without any row. Returns the number of rows written.
    Another ``days`` on the same table is a directed refresh."""
    span = aligned_days(as_of, days, grain)
    period = F.date_format(date_col, _FORMATS[grain])
    fmt = {"day": "%Y-%m-%d", "month": "%Y%m"}[grain]
    first = period_start(midnight(as_of, days), grain).strftime(fmt)
    rows = job(as_of, span).withColumn(PERIOD, period)
    recover(rows.sparkSession, path)
    return _publish(rows.sparkSession, path, drop=lambda label: label >= first, fresh=_stage(rows, path))


MANY_FILES = 8  # of a period, where they are smaller than
FILE_BYTES = 16 << 20


def _crumbled(spark: SparkSession, folders: Collection[str]) -> bool:
    """Whether the files of periods, to which every refresh adds, are many and small."""
    count = sum(len(files.names(spark, f)) for f in folders)
    return count > MANY_FILES * len(folders) and sum(files.size(spark, f) for f in folders) < count * FILE_BYTES


def _without(old: DataFrame, keys: DataFrame, through: Sieve | None, gather: bool) -> DataFrame:
    """The rows of a mart that are not of ``keys``, gathered by period or left in theirs. Most rows
    are told by a sieve where they are read, and are not shuffled; the others are joined."""
    on = keys.columns
    if through is None:
        return old.join(keys, on, "left_anti").hint("rebalance", PERIOD)
    likely = passes(on, through)
    clear = old.where(~likely)
    left = old.where(likely).join(keys, on, "left_anti").select(*old.columns)
    if gather:
        return clear.unionByName(left).hint("rebalance", PERIOD)
    return clear.unionByName(left.hint("rebalance", PERIOD))


def refresh_keys(
    job: Callable[[DataFrame], DataFrame],
    keys: DataFrame,
    path: str,
    key: str,
    date_col: str,
    grain: str = "month",
) -> int:
    """Recompute the rows of ``keys`` and put them in place of the old ones.
    Only the periods that hold an old or a new row of these keys are rewritten; a
    key the job no longer returns disappears."""
    spark = keys.sparkSession
    period = F.date_format(date_col, _FORMATS[grain])
    recover(spark, path)
    with staged(keys.select(key).distinct(), "keys") as wanted:
        fresh = _stage(job(wanted).withColumn(PERIOD, period), path)
        if not files.exists(spark, path):
            return _publish(spark, path, drop=lambda label: False, fresh=fresh)
        rows = fresh.count()
        old = spark.read.parquet(path).withColumn(PERIOD, F.col(PERIOD).cast("string"))
        through = sieve(wanted) if can_sieve(old, wanted) else None
        likely = old if through is None else old.where(passes([key], through))
        hit = likely.join(wanted, key, "left_semi").select(PERIOD).union(fresh.select(PERIOD))
        touched = {r[0] for r in hit.distinct().collect()}  # period labels, not data
        folders = [f for label, f in files.partitions(spark, path, PERIOD).items() if label in touched]
        kept = _without(old.where(F.col(PERIOD).isin(*touched)), wanted, through, _crumbled(spark, folders))
        kept = fresh.limit(0).unionByName(kept)  # in the columns of the mart
        _publish(spark, path, drop=lambda label: label in touched, fresh=fresh, kept=kept)
        return rows


def refresh_full(df: DataFrame, root: str, version: str) -> int:
    """Write a new version folder, then name it current by one appended record. A
    failed job leaves the old version; an empty result is a legal version."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/version={version}")
    rows = spark.read.parquet(f"{root}/version={version}").count()
    switched = spark.createDataFrame(
        [(version, time.time_ns(), rows)], "version string, switched_at bigint, rows bigint"
    )
    switched.coalesce(1).write.mode("append").parquet(f"{root}/_current")
    return rows


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The version named last."""
    named = spark.read.parquet(f"{root}/_current")
    version = named.agg(F.max_by("version", "switched_at")).head()[0]
    return spark.read.parquet(f"{root}/version={version}")


def write_second_order(df: DataFrame, path: str, cols: Sequence[str]) -> None:
    """A second copy sorted for another access path: ranges of ``cols`` per file,
    so that file and row-group statistics prune a lookup."""
    df.repartitionByRange(*cols).sortWithinPartitions(*cols).write.mode("overwrite").parquet(path)


_PARTS = "_parts"  # how many parts a keyed copy has stands in its folder name
_PART = "_part"


def write_keyed(df: DataFrame, path: str, key: str, parts: int) -> None:
    """A copy for reading single keys: dealt to ``parts`` folders by a checksum of the text
    ``key``, sorted by it, with a Bloom filter of it in every row group. Rows without a key are
    kept in part 0. Writing it again, also with other ``parts``, replaces it."""
    spark = df.sparkSession
    part = F.coalesce(F.crc32(F.col(key)) % parts, F.lit(0)).cast("int")
    (
        df.withColumn(_PART, part)
        .repartition(parts, _PART)
        .sortWithinPartitions(_PART, key)
        .write.mode("overwrite")
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
        .option("parquet.block.size", str(16 << 20))
        .partitionBy(_PART)
        .parquet(f"{path}/{_PARTS}={parts}")
    )
    for found, folder in files.partitions(spark, path, _PARTS).items():
        if found != str(parts):
            files.delete(spark, folder)


def read_keyed(spark: SparkSession, path: str, schema: StructType, key: str, *values: str) -> DataFrame:
    """Rows of a keyed copy whose ``key`` is one of ``values``. Only the folders of their parts
    are listed, and row groups without the keys are passed over."""
    found = files.partitions(spark, path, _PARTS)
    if not found:
        raise FileNotFoundError(f"no keyed copy in {path}")
    parts, root = max(found.items(), key=lambda entry: int(entry[0]))
    named = sorted({f"{root}/{_PART}={zlib.crc32(value.encode()) % int(parts)}" for value in values})
    folders = [folder for folder in named if files.exists(spark, folder)]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders).where(F.col(key).isin(*values))


def write_bucketed(df: DataFrame, table: str, key: Sequence[str], buckets: int) -> None:
    """A catalog table bucketed and sorted by its join key: later joins,
    aggregations and current-state windows on that key need no shuffle."""
    (
        df.write.mode("overwrite")
        .bucketBy(buckets, *key)
        .sortBy(*key)
        .format("parquet")
        .saveAsTable(table)
    )


# --- refresh log ----------------------------------------------------------

# Refresh interval per mart, in minutes.
INTERVAL_MINUTES = {
    "order_360": 1,
    "revenue_by_bu_day": 15,
    "payment_funnel_day": 5,
    "discount_effectiveness": 15,
    "discount_baseline_day": 15,
    "item_margin_daily": 15,
    "stock_coverage": 15,
    "stockout_candidates": 15,
    "customer_metrics": 30,
    "customer_cohort": 30,
    "dq_overview": 5,
    "orphan_summary": 5,
    "orphan_records": 5,
    "idle_catalog": 60,
}
LOG_SCHEMA = (
    "mart string, run_at timestamp_ntz, status string, rows bigint, "
    "duration_ms bigint, exception string"
)


def log_refresh(
    spark: SparkSession, path: str, mart: str, run_at: datetime, status: str, rows: int | None,
    duration_ms: int, exception: str = "",
) -> None:
    row = [(mart, run_at, status, rows, duration_ms, exception)]
    spark.createDataFrame(row, LOG_SCHEMA).write.mode("append").parquet(path)


def run_logged(
    spark: SparkSession, log_path: str, mart: str, as_of: datetime, work: Callable[[], int],
    clock: Callable[[], float] = time.monotonic,
) -> int | None:
    """Run a refresh and append its outcome to the log; a failure is logged and
    raised again. ``clock`` gives seconds, read before and after the work."""
    begun = clock()

    def elapsed() -> int:
        return int((clock() - begun) * 1000)

    try:
        rows = work()
    except Exception as error:
        log_refresh(spark, log_path, mart, as_of, "Failed", None, elapsed(), str(error))
        raise
    log_refresh(spark, log_path, mart, as_of, "Finished", rows, elapsed())
    return rows


def refresh_state(log: DataFrame, as_of: datetime) -> DataFrame:
    """Last run per mart with its age, whether it is healthy (finished, and not
    older than two intervals) and whether it took under half its interval."""
    minutes = F.create_map(
        *[F.lit(v) for pair in INTERVAL_MINUTES.items() for v in pair]
    )
    interval = F.coalesce(minutes[F.col("mart")], F.lit(15))
    age = seconds_between("run_at", stamp(as_of))
    return latest_by(log, ["mart"], "run_at").select(
        "mart",
        "run_at",
        "status",
        "rows",
        "duration_ms",
        age.alias("age_seconds"),
        flag((F.col("status") == "Finished") & (age <= interval * 120)).alias("healthy"),
        flag(F.col("duration_ms") < interval * 30_000).alias("duration_ok"),
    )


def retain(path: str, spark: SparkSession, as_of: datetime, days: int, ts_col: str) -> None:
    """Apply retention to a month-partitioned landing table, by the clock ``ts_col`` and
    whatever month a row was filed under. A month without an expired row is left
    alone, one without any other row is removed as a folder, the rest are rewritten."""
    folders = files.partitions(spark, path, MONTH)
    if not folders:
        return
    kept_rows = apply_retention(spark.read.parquet(path), as_of, days, ts_col)
    by = [c for c in (MONTH, BATCH) if c in kept_rows.columns]  # a table without replays is cut by batch too
    count = lambda df: {r[0]: r[1] for r in df.groupBy(MONTH).count().collect()}
    before, after = count(spark.read.parquet(path)), count(kept_rows)
    mixed = [m for m, n in before.items() if 0 < after.get(m, 0) < n]
    if mixed:
        with staged(kept_rows.where(F.col(MONTH).isin(mixed)), "retain") as kept:
            (
                kept.write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy(*by)
                .parquet(path)
            )
    for month in before:
        if not after.get(month):
            files.delete(spark, folders[str(month)])
