"""Which source offsets have landed, as intervals.

Offsets of a (topic, partition) are cut into chunks of ``CHUNK``; a batch adds the intervals it
landed, in a folder of its own. Whether a record is new is found out against the intervals of the
chunks that the batch touches, never against the landed records. Topics are nearly contiguous, so
an index holds a few rows per chunk and batch; ``fold`` joins those of many batches.

Everything about one batch carries its label, and a batch does not see its own intervals: a repeat
after a crash finds the same records new, and overwrites what the first try left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.contracts import BATCH, OFFSET_KEY
from tidemark.sources import files

CHUNK = 1_000_000
FOLD_AFTER = 64  # batches
_PLACE = ["_topic", "_partition", "_chunk"]
SCHEMA = f"_topic string, _partition int, _chunk bigint, first bigint, last bigint, {BATCH} string"
FOLDED = "folded"


def _chunk():
    return F.expr(f"_offset div {CHUNK}")


def read(spark: SparkSession, path: str) -> DataFrame:
    if not files.exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def unseen(records: DataFrame, index: DataFrame) -> DataFrame:
    """Records whose offsets no interval of ``index`` holds, one per offset. Intervals and offsets
    of a chunk are merged in order, so a task holds one chunk's records at most."""
    records = records.dropDuplicates(list(OFFSET_KEY)).withColumn("_chunk", _chunk())
    known = index.join(records.select(*_PLACE).distinct(), _PLACE, "left_semi")
    both = records.withColumns({"_at": F.col("_offset"), "_until": F.lit(None).cast("bigint")}).unionByName(
        known.select(*_PLACE, F.col("first").alias("_at"), F.col("last").alias("_until")), allowMissingColumns=True
    )
    # at one offset the interval comes first
    before = Window.partitionBy(*_PLACE).orderBy("_at", F.col("_until").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max("_until").over(before)
    return (
        both.withColumn("_reach", reach)
        .where(F.col("_until").isNull() & (F.col("_reach").isNull() | (F.col("_reach") < F.col("_offset"))))
        .drop("_chunk", "_at", "_until", "_reach")
    )


def intervals(records: DataFrame) -> DataFrame:
    """Runs of consecutive offsets per chunk; every offset stands once."""
    place = Window.partitionBy(*_PLACE).orderBy("_offset")
    runs = records.select(*OFFSET_KEY, _chunk().alias("_chunk")).withColumn("_run", F.col("_offset") - F.row_number().over(place))
    return runs.groupBy(*_PLACE, "_run").agg(F.min("_offset").alias("first"), F.max("_offset").alias("last")).drop("_run")


def joined(index: DataFrame) -> DataFrame:
    """Intervals of one chunk that touch or overlap, as one."""
    place = Window.partitionBy(*_PLACE).orderBy("first", "last")
    before = F.max("last").over(place.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(before.isNull() | (F.col("first") > before + 1), 1).otherwise(0)
    island = F.sum("_begins").over(place.rowsBetween(Window.unboundedPreceding, 0))
    return (
        index.withColumn("_begins", begins)
        .withColumn("_island", island)
        .groupBy(*_PLACE, "_island")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .drop("_island")
    )


def add(records: DataFrame, path: str, label: str) -> None:
    """Note the offsets of ``records`` under ``label``, in place of an earlier try."""
    # no coalesce: one task would then put all chunks in order
    intervals(records).write.mode("overwrite").parquet(f"{path}/{BATCH}={label}")


def fold(spark: SparkSession, path: str, label: str, after: int = FOLD_AFTER) -> bool:
    """Join the intervals of all batches but ``label``, once there are many. A crash in between
    leaves intervals twice, which is harmless."""
    name = f"{FOLDED}-{label}"
    old = {b: f for b, f in files.partitions(spark, path, BATCH).items() if b not in (label, name)}
    if len(old) <= after:
        return False
    target = f"{path}/{BATCH}={name}"
    if not files.exists(spark, f"{target}/_SUCCESS"):
        whole = joined(read(spark, path).where(F.col(BATCH).isin(*old)).drop(BATCH))
        whole.write.mode("overwrite").parquet(target)
    for folder in old.values():
        files.delete(spark, folder)
    return True
