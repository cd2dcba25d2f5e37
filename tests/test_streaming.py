"""Streams give the same tables as batches, over several micro-batches and replays."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.support import AS_OF, SMALL, ago, records
from tidemark.contracts import BATCH, CONTRACTS
from tidemark.operators import cdc
from tidemark.operators.store import Store
from tidemark.plans import refresh
from tidemark.plans.catalog import framed_json, framed_orders, workspace
from tidemark.session import scratch
from tidemark.sources import files, landing
from tidemark.streaming import frontier, jobs, offsets

ORDER = CONTRACTS["order"]


def finish(*running):
    for one in running:
        one.awaitTermination()


def test_landing_and_core_streams_equal_the_batch(spark):
    base = scratch(spark, "stream")
    rows = workspace(spark, SMALL).lake.landing("order")
    landing.to_lines(rows).repartition(5).write.text(f"{base}/topic")
    spark.createDataFrame([("{ not json",)], "value string").write.mode("append").text(f"{base}/topic")

    def run():
        lines = spark.readStream.option("maxFilesPerTrigger", 2).text(f"{base}/topic")
        finish(*jobs.stream_landing(lines, ORDER, f"{base}/l0", f"{base}/dlq", f"{base}/cp0"))
        l0 = jobs.landing_stream(spark, f"{base}/l0", ORDER)
        finish(jobs.stream_core(l0, ORDER, f"{base}/l1", f"{base}/cp1"))

    run()
    run()  # a restart from the checkpoint adds nothing
    landed = spark.read.parquet(f"{base}/l0").select(*rows.columns)
    assert sorted(landed.collect()) == sorted(rows.collect())
    assert [r.reason for r in spark.read.parquet(f"{base}/dlq").collect()] == ["unparseable"]
    state = cdc.current_state(spark.read.parquet(f"{base}/l1"), ORDER)
    assert sorted(state.collect()) == sorted(workspace(spark, SMALL).lake.current("order").collect())


def test_upsert_equals_current_state_over_shuffled_batches(spark):
    base = scratch(spark, "stream")
    rows = workspace(spark, SMALL).lake.landing("order")
    rows.repartition(4, F.xxhash64("_offset")).write.parquet(f"{base}/l0")
    stream = jobs.landing_stream(spark, f"{base}/l0", ORDER)
    source = spark.readStream.schema(ORDER.landing_schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/l0")
    assert stream.schema == source.schema
    finish(jobs.stream_upsert(source, ORDER, f"{base}/table", f"{base}/cp", buckets=6))
    store = Store(spark, f"{base}/table", ORDER)
    assert store.buckets == 6
    assert store.table().count() == rows.select("order_id").distinct().count()
    expect = workspace(spark, SMALL).lake.current("order").select(*ORDER.columns)
    assert sorted(store.current().select(*ORDER.columns).collect()) == sorted(expect.collect())


def test_a_repeated_batch_and_an_old_version_change_nothing(spark):
    base = scratch(spark, "stream")

    def fold(batch_id, rows):
        jobs.merge_batch(records(spark, "order", rows), Store(spark, base, ORDER, 4), "w", batch_id)
        state = Store(spark, base, ORDER).table().collect()
        return sorted((r.order_id, r.order_status, r._is_deleted) for r in state)

    first = [{"order_id": "A", "_cdc_seq": 5}, {"order_id": "B", "_cdc_seq": 5}]
    assert fold(0, first) == [("A", "paid", 0), ("B", "paid", 0)]
    second = [{"order_id": "A", "_op": "d", "_cdc_seq": 9}]
    done = fold(1, second)
    assert done == [("A", "paid", 1), ("B", "paid", 0)]
    assert fold(1, second) == done
    # after the repeat an older version arrives: the tombstone holds
    assert fold(2, [{"order_id": "A", "order_status": "shipped", "_cdc_seq": 7}]) == done
    assert fold(3, [{"order_id": "A", "order_status": "delivered", "_cdc_seq": 12}]) == [
        ("A", "delivered", 0), ("B", "paid", 0)]


def test_windowed_totals_accept_late_facts(spark):
    base = scratch(spark, "stream")
    t0 = datetime(2024, 1, 1, 10)
    schema = "ts timestamp_ntz, event_type string, value double"
    batches = [
        [(t0, "view", 1.0), (t0 + timedelta(seconds=59), "view", 2.0), (t0 + timedelta(minutes=9), "click", 5.0)],
        [(t0 + timedelta(seconds=30), "view", 4.0)],  # late, inside the watermark
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/fact")
        fact = spark.readStream.schema(schema).parquet(f"{base}/fact")
        finish(jobs.stream_windowed(fact, f"{base}/out", f"{base}/cp"))
    got = {(r.window_start, r.event_type): (r.events, float(r.total)) for r in jobs.read_windowed(spark, f"{base}/out").collect()}
    assert got == {(t0, "view"): (3, 7.0), (t0 + timedelta(minutes=9), "click"): (1, 5.0)}


def test_a_stream_drives_refreshes(spark):
    base, ran = scratch(spark, "stream"), []
    records(spark, "order", [{"order_id": "A"}]).write.parquet(f"{base}/l0")

    def run():
        finish(jobs.stream_refresh(jobs.landing_stream(spark, f"{base}/l0", ORDER), ran.append, f"{base}/cp"))

    run()
    run()
    assert ran == [0]


def test_a_producer_that_sends_twice_lands_once(spark):
    base = scratch(spark, "stream")
    rows = records(spark, "order", [{"order_id": str(n)} for n in range(20)])
    for _ in range(2):
        landing.to_lines(rows).write.mode("append").text(f"{base}/topic")
        lines = spark.readStream.text(f"{base}/topic")
        finish(*jobs.stream_landing(
            lines, ORDER, f"{base}/l0", f"{base}/dlq", f"{base}/cp", skip_replays=True))
    landed = spark.read.parquet(f"{base}/l0").select(*rows.columns)
    assert sorted(landed.collect()) == sorted(rows.collect())


def test_a_very_late_record_still_lands(spark):
    base = scratch(spark, "stream")
    newest = records(spark, "order", [{"order_id": "new", "created_at": ago(0), "_offset": 1}])
    late = records(spark, "order", [{"order_id": "late", "created_at": ago(10), "_offset": 2}])
    for rows in (newest, late, late):
        landing.to_lines(rows).write.mode("append").text(f"{base}/topic")
        spark.createDataFrame([("no json",)], "value string").write.mode("append").text(f"{base}/topic")
        lines = spark.readStream.text(f"{base}/topic")
        finish(*jobs.stream_landing(lines, ORDER, f"{base}/l0", f"{base}/dlq", f"{base}/cp", skip_replays=True))
    assert sorted(r.order_id for r in spark.read.parquet(f"{base}/l0").collect()) == ["late", "new"]
    assert spark.read.parquet(f"{base}/dlq").count() == 3


def test_a_reset_checkpoint_is_another_writer(spark):
    base = scratch(spark, "stream")
    for run, key in enumerate("AB"):
        records(spark, "order", [{"order_id": key}]).write.mode("append").parquet(f"{base}/l0-{key}")
        source = jobs.landing_stream(spark, f"{base}/l0-{key}", ORDER)
        if run:
            files.delete(spark, f"{base}/cp")
        finish(jobs.stream_upsert(source, ORDER, f"{base}/table", f"{base}/cp", buckets=2))
    assert sorted(r.order_id for r in Store(spark, f"{base}/table", ORDER).table().collect()) == ["A", "B"]


def land(spark, base, **more):
    lines = spark.readStream.text(f"{base}/topic")
    finish(*jobs.stream_landing(lines, ORDER, f"{base}/l0", f"{base}/dlq", f"{base}/cp", skip_replays=True, **more))


def send(spark, base, *rows, bad=0):
    for part in rows:
        landing.to_lines(part).coalesce(1).write.mode("append").text(f"{base}/topic")
    if bad:
        spark.createDataFrame([(f"bad {n}",) for n in range(bad)], "value string").coalesce(1).write.mode("append").text(f"{base}/topic")


def test_a_first_batch_of_bad_lines_does_not_stop_the_stream(spark):
    base = scratch(spark, "stream")
    rows = records(spark, "order", [{"order_id": str(n)} for n in range(6)])
    for parts, bad in (((), 2), ((rows, rows), 1), ((), 1), ((rows,), 0)):
        send(spark, base, *parts, bad=bad)
        land(spark, base)
    assert sorted(jobs.read_landed(spark, f"{base}/l0", ORDER).collect()) == sorted(rows.collect())
    assert spark.read.parquet(f"{base}/dlq").count() == 4


def test_a_batch_reads_no_landed_record_and_few_intervals(spark):
    base = scratch(spark, "stream")
    for n in range(4):
        send(spark, base, records(spark, "order", [{"order_id": f"{n}-{i}", "_offset": n * 50 + i} for i in range(50)]))
        land(spark, base)
    index = offsets.read(spark, f"{base}/l0-offsets")
    assert sorted((r.first, r.last) for r in index.collect()) == [(0, 49), (50, 99), (100, 149), (150, 199)]
    plan = offsets.unseen(records(spark, "order", [{"order_id": "x"}]), index)
    assert all("l0-offsets" in f for f in plan.inputFiles())
    assert offsets.fold(spark, f"{base}/l0-offsets", "next", after=3)
    assert [(r.first, r.last) for r in offsets.read(spark, f"{base}/l0-offsets").collect()] == [(0, 199)]
    send(spark, base, records(spark, "order", [{"order_id": "again", "_offset": 77}, {"order_id": "new", "_offset": 200}]))
    land(spark, base)
    landed = jobs.read_landed(spark, f"{base}/l0", ORDER)
    assert landed.count() == 201
    assert landed.where("order_id = 'new'").count() == 1


def test_a_batch_repeated_after_a_crash_lands_what_it_landed_before(spark):
    base = scratch(spark, "stream")
    rows = records(spark, "order", [{"order_id": str(n), "created_at": ago(40 * (n % 3))} for n in range(9)])
    send(spark, base, rows)
    land(spark, base)
    # the checkpoint forgets that the batch was done: it runs again with the same number
    files.delete(spark, f"{base}/cp/commits/0")
    files.delete(spark, f"{base}/cp/commits/.0.crc")
    month = next(iter(files.partitions(spark, f"{base}/l0", "_month").values()))
    files.delete(spark, month)  # and one month was not written when it crashed
    land(spark, base)
    assert sorted(jobs.read_landed(spark, f"{base}/l0", ORDER).collect()) == sorted(rows.collect())


def test_unseen_offsets_equal_brute_force(spark):
    rng = random.Random(3)
    landed = sorted(rng.sample(range(0, 3_000_000, 7), 400))
    asked = [rng.choice((rng.choice(landed), rng.randrange(0, 3_000_000))) for _ in range(300)]
    old = records(spark, "order", [{"order_id": "o", "_offset": o} for o in landed])
    index = offsets.intervals(old).withColumn("_batch", F.lit("b"))
    again = offsets.joined(index.unionByName(index).drop("_batch"))
    assert sorted((r.first, r.last) for r in again.collect()) == sorted((r.first, r.last) for r in index.collect())
    got = offsets.unseen(records(spark, "order", [{"order_id": "n", "_offset": o} for o in asked]), index)
    assert sorted(r._offset for r in got.collect()) == sorted(set(asked) - set(landed))


def test_retention_of_a_table_without_replays(spark):
    base = scratch(spark, "stream")
    send(spark, base, records(spark, "order", [{"order_id": "old", "created_at": ago(3)}, {"order_id": "new", "created_at": ago(1)}]))
    land(spark, base)
    refresh.retain(f"{base}/l0", spark, AS_OF, 2, "_kafka_ts")
    send(spark, base, records(spark, "order", [{"order_id": "next", "created_at": ago(0), "_offset": 3}]))
    land(spark, base)
    assert sorted(r.order_id for r in jobs.read_landed(spark, f"{base}/l0", ORDER).collect()) == ["new", "next"]


def test_framed_messages_land_and_are_quarantined(spark):
    base = scratch(spark, "stream")
    orders = workspace(spark, SMALL).lake.landing("order").where("order_id < 1000")
    framed_orders(orders).write.parquet(f"{base}/topic")
    parse = framed_json(ORDER, ("discount_code",))
    messages = spark.readStream.schema(framed_orders(orders).schema).parquet(f"{base}/topic")
    finish(*jobs.stream_landing(messages, ORDER, f"{base}/l0", f"{base}/dlq", f"{base}/cp", skip_replays=True, parse=parse))
    good, bad = jobs.read_landed(spark, f"{base}/l0", ORDER), spark.read.parquet(f"{base}/dlq")
    assert good.count() + bad.count() == orders.count()
    assert {r.reason for r in bad.collect()} == {"frame:short", "frame:magic", "frame:schema", "frame:payload"}
    assert {r._schema_id for r in good.collect()} == {1, 2}


def test_a_mart_takes_open_notes_when_it_is_due_and_again_after_a_failure(spark):
    path, seen = scratch(spark, "touched"), []
    keys = lambda *ids: spark.createDataFrame([(i,) for i in ids], "order_id string")
    take = lambda now, work: frontier.take(spark, path, "order_360", now, work)

    def work(touched):
        seen.append(sorted(r[0] for r in touched.collect()))
        return len(seen[-1])

    def lost(touched):
        work(touched)
        raise RuntimeError

    assert take(ago(0), work) is None  # nothing noted
    frontier.note(keys("A", "A", None), path, ["order_id"], "q-0")
    frontier.note(keys("A", "B"), path, ["order_id"], "q-1")
    frontier.note(keys("B", "C"), path, ["order_id"], "q-1")  # the batch again
    with pytest.raises(RuntimeError):
        take(ago(0), lost)
    assert take(ago(0), work) == 3
    frontier.note(keys("D"), path, ["order_id"], "q-2")
    assert take(ago(0) + timedelta(seconds=59), work) is None  # not due
    assert frontier.open_notes(spark, path, "order_360") == ["q-2"]
    assert frontier.clear(spark, path, ["order_360"]) == 2
    assert take(ago(0) + timedelta(seconds=60), work) == 1
    frontier.note(keys(None), path, ["order_id"], "q-3")  # a note without keys
    assert take(ago(0) + timedelta(seconds=120), work) == 0
    assert seen == [["A", "B", "C"], ["A", "B", "C"], ["D"], []]


def test_intervals_of_many_chunks_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(64).selectExpr("'t' _topic", "cast(id % 8 as int) _partition", f"id * {offsets.CHUNK} _offset")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        offsets.add(rows, str(tmp_path), "one")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / f"{BATCH}=one").glob("part-*"))) > 1
    assert offsets.read(spark, str(tmp_path)).count() == 64
