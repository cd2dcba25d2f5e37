"""Structured Streaming jobs: landing, core, upsert, windowed totals, refresh."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.contracts import BATCH, MONTH, Contract
from tidemark.operators.cdc import to_core
from tidemark.operators.store import Store
from tidemark.operators.windows import latest_by
from tidemark.sources.landing import by_month, coerce, parse_lines, split_malformed
from tidemark.streaming import frontier, offsets


def _start(writer, trigger: dict) -> StreamingQuery:
    return writer.trigger(**trigger).start()


NOW = {"availableNow": True}
Parse = Callable[[DataFrame, Contract], DataFrame]


def landing_stream(spark: SparkSession, path: str, contract: Contract, glob: str | None = None) -> DataFrame:
    """A landing table (or any folder of files in its schema) as a stream."""
    reader = spark.readStream.schema(contract.landing_schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def stream_landing(
    lines: DataFrame, contract: Contract, path: str, quarantine: str, checkpoint: str,
    trigger: dict = NOW, skip_replays: bool = False, parse: Parse = parse_lines,
) -> list[StreamingQuery]:
    """Messages (JSON lines, or what ``parse`` reads) to the landing table, and what cannot be
    read to quarantine.

    Two file sinks, each with its own checkpoint: every line ends in exactly one
    of the two tables exactly once. With ``skip_replays`` a record that the producer
    sends again, however late, lands once by its source coordinates.
    """
    if skip_replays:
        return [_start(_landing_once(lines, contract, path, quarantine, checkpoint, parse), trigger)]
    good, bad = split_malformed(coerce(parse(lines, contract), contract), contract)
    landed = (
        by_month(good)
        .writeStream.format("parquet")
        .outputMode("append")
        .partitionBy(MONTH)
        .option("path", path)
        .option("checkpointLocation", f"{checkpoint}/landing")
    )
    rejected = (
        bad.writeStream.format("parquet")
        .outputMode("append")
        .option("path", quarantine)
        .option("checkpointLocation", f"{checkpoint}/quarantine")
    )
    return [_start(landed, trigger), _start(rejected, trigger)]


def _run_id(spark: SparkSession, checkpoint: str) -> str:
    """The identity of a query: Spark writes a new one into every new checkpoint."""
    return spark.read.json(f"{checkpoint}/metadata").first()["id"]


def _landing_once(lines: DataFrame, contract: Contract, path: str, quarantine: str, checkpoint: str, parse: Parse):
    """One pass per batch for both tables. New records are those whose offsets are in no interval
    of the index beside the table, so what a batch reads does not grow with what has landed, and
    no record is too late. Everything is written under the run and the batch: a repeated
    batch replaces what it wrote before, in the landing table, the index and quarantine."""

    def land(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        label = f"{_run_id(spark, checkpoint)}-{batch_id}"
        typed = coerce(parse(batch, contract), contract).persist()
        good, bad = split_malformed(typed, contract)
        index = f"{path}-offsets"
        offsets.fold(spark, index, label)
        others = offsets.read(spark, index).where(F.col(BATCH) != label)
        fresh = by_month(offsets.unseen(good, others)).persist()
        # quarantine first: one pass fills the cache, which two sides of the join would each do at once
        for rows, folder, by in ((bad, quarantine, [BATCH]), (fresh, path, [MONTH, BATCH])):
            (
                rows.withColumn(BATCH, F.lit(label))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy(*by)
                .parquet(folder)
            )
        offsets.add(fresh, index, label)
        fresh.unpersist()
        typed.unpersist()

    return lines.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)


def read_landed(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """The landing table that ``stream_landing`` fills; empty before its first record."""
    names = [f.name for f in contract.landing_schema.fields]
    return spark.read.schema(contract.landing_schema).parquet(path).select(*names)


def stream_core(
    landing: DataFrame, contract: Contract, path: str, checkpoint: str, trigger: dict = NOW
) -> StreamingQuery:
    """Landing to core, row by row. State is resolved on read, so the order of
    arrival cannot matter."""
    writer = (
        to_core(landing, contract)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return _start(writer, trigger)


def merge_batch(batch: DataFrame, store: Store, writer: str, batch_id: int) -> bool:
    """Add a batch of landing rows to a stored core table: the batch writes its own rows, and
    folds the buckets that have become due. A repeated batch adds nothing."""
    added = store.append(to_core(batch, store.contract), writer, batch_id, one_per_key=True)
    store.fold(store.due())
    return added


def stream_upsert(
    landing: DataFrame,
    contract: Contract,
    path: str,
    checkpoint: str,
    buckets: int = 64,
    trigger: dict = NOW,
) -> StreamingQuery:
    """Landing stream to a stored core table (``Store``) that gives the newest row per key."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            spark = batch.sparkSession
            merge_batch(batch, Store(spark, path, contract, buckets), _run_id(spark, checkpoint), batch_id)

    writer = landing.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return _start(writer, trigger)


def windowed_totals(
    fact: DataFrame, ts: str, value: str, by: Sequence[str], size: str, watermark: str
) -> DataFrame:
    """Count and sum per tumbling window. Only for facts that never change: a
    mutable entity would be counted once per version. Watermarks need an instant,
    so the wall-clock time is read in the session's zone and turned back after."""
    return (
        fact.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, watermark)
        .groupBy(F.window(ts, size).alias("w"), *by)
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.sum(F.col(value).cast("decimal(18,4)")).cast("decimal(38,4)").alias("total"),
        )
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"), *by, "events", "total"
        )
    )


def stream_windowed(
    fact: DataFrame,
    path: str,
    checkpoint: str,
    ts: str = "ts",
    value: str = "value",
    by: Sequence[str] = ("event_type",),
    size: str = "1 minute",
    watermark: str = "72 hours",
    trigger: dict = NOW,
) -> StreamingQuery:
    """Changed windows of every batch, one folder per batch (a repeated batch
    replaces its own folder)."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    writer = (
        windowed_totals(fact, ts, value, by, size, watermark)
        .writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
    )
    return _start(writer, trigger)


def read_windowed(spark: SparkSession, path: str, by: Sequence[str] = ("event_type",)) -> DataFrame:
    """The last total of every window."""
    return latest_by(spark.read.parquet(path), ["window_start", *by], BATCH).drop(BATCH)


def stream_refresh(
    source: DataFrame, refresh: Callable[[int], None], checkpoint: str, trigger: dict = NOW
) -> StreamingQuery:
    """Run a mart refresh for every batch of new records. The refresh reads the
    core tables itself and is safe to repeat, so a repeated batch does no harm."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            refresh(batch_id)

    writer = source.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return _start(writer, trigger)


def stream_marts(
    source: DataFrame, key: str, path: str, refresh: Callable[[], None], checkpoint: str, trigger: dict = NOW
) -> StreamingQuery:
    """Note the keys of every batch of new records in the frontier ``path``, then let ``refresh``
    bring up to date the marts that are due (``frontier.take``). A batch that fails on the way
    is repeated with its own note."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        frontier.note(batch, path, [key], f"{_run_id(spark, checkpoint)}-{batch_id}")
        refresh()

    writer = source.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return _start(writer, trigger)
