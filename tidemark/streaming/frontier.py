"""What new records touch: the frontier between a stream and the marts refreshed from it.

Every batch notes the distinct keys of its records in a folder under its own label, so a batch
that runs again replaces its note. A mart that is due by its refresh interval recomputes the keys
of all notes it has not taken in yet, and only then records them as taken. A crash in between
leaves them open, and the same keys are recomputed once more, which changes nothing: a refresh by
keys replaces rows. What a refresh reads grows with what arrived, not with the mart.

One writer per mart and frontier. Driver-side are only labels of batches. Null keys belong to no
row of a mart and are not noted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.contracts import BATCH
from tidemark.plans.refresh import INTERVAL_MINUTES
from tidemark.sources import files

TAKEN_SCHEMA = "label string, taken_at timestamp_ntz"


def note(batch: DataFrame, path: str, cols: Sequence[str], label: str) -> None:
    """Note what a batch touches: its distinct ``cols``, none of them null."""
    touched = batch.select(*cols).dropna().distinct()
    touched.write.mode("overwrite").parquet(f"{path}/{BATCH}={label}")


def _taken(spark: SparkSession, path: str, mart: str) -> DataFrame:
    folder = f"{path}-taken/{mart}"
    if not files.exists(spark, folder):
        return spark.createDataFrame([], TAKEN_SCHEMA)
    return spark.read.schema(TAKEN_SCHEMA).parquet(folder)


def open_notes(spark: SparkSession, path: str, mart: str) -> list[str]:
    """Labels of the batches that ``mart`` has not taken in."""
    done = {r[0] for r in _taken(spark, path, mart).select("label").collect()}
    return sorted(set(files.partitions(spark, path, BATCH)) - done)


def due(spark: SparkSession, path: str, mart: str, now: datetime) -> bool:
    """Whether the refresh interval of ``mart`` has passed since it last took notes."""
    last = _taken(spark, path, mart).agg(F.max("taken_at")).first()[0]
    return last is None or now - last >= timedelta(minutes=INTERVAL_MINUTES[mart])


def take(
    spark: SparkSession, path: str, mart: str, now: datetime, work: Callable[[DataFrame], int]
) -> int | None:
    """Refresh ``mart`` by ``work`` (touched keys -> rows written) if it is due and anything is
    open. Returns what ``work`` returns, or ``None`` if there was nothing to do."""
    if not due(spark, path, mart, now):
        return None
    labels = open_notes(spark, path, mart)
    if not labels:
        return None
    rows = work(spark.read.parquet(*[f"{path}/{BATCH}={label}" for label in labels]).distinct())
    taken = spark.createDataFrame([(label, now) for label in labels], TAKEN_SCHEMA)
    taken.coalesce(1).write.mode("append").parquet(f"{path}-taken/{mart}")
    return rows


def clear(spark: SparkSession, path: str, marts: Sequence[str]) -> int:
    """Remove the notes that every one of ``marts`` has taken in; how many they were."""
    folders = files.partitions(spark, path, BATCH)
    still = {label for mart in marts for label in open_notes(spark, path, mart)}
    spent = [folder for label, folder in folders.items() if label not in still]
    for folder in spent:
        files.delete(spark, folder)
    return len(spent)
