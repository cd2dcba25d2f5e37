"""Landing: parsing, coercion, quarantine, partitions, retention, framing."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.support import AS_OF, ago, records
from tidemark.contracts import CONTRACTS, MONTH
from tidemark.plans import refresh
from tidemark.session import scratch
from tidemark.sources import landing

ORDER = CONTRACTS["order"]


def good_lines(spark, n):
    rows = records(spark, "order", [{"order_id": str(i), "total_amount": "12.5"} for i in range(n)])
    return [r.value for r in landing.to_lines(rows).collect()]


def split(spark, lines):
    frame = spark.createDataFrame([(line,) for line in lines], "value string")
    coerced = landing.coerce(landing.parse_lines(frame, ORDER), ORDER)
    return landing.split_malformed(coerced, ORDER)


def test_good_lines_land_and_bad_ones_are_kept_with_their_reason(spark):
    lines = good_lines(spark, 100)
    broken = [json.loads(line) for line in lines[:4]]
    broken[0]["total_amount"] = "abc"
    del broken[1]["customer_id"]
    broken[2]["order_status"], broken[2]["_op"] = "lost", "z"
    broken[3]["_cdc_seq"] = "not a number"
    bad_lines = [json.dumps(b) for b in broken] + ["{ not json"]
    good, bad = split(spark, lines + bad_lines)
    assert good.count() == 100
    assert [(f.name, f.dataType) for f in good.schema] == [
        (f.name, f.dataType) for f in ORDER.landing_schema
    ]
    reasons = {r.line: r.reason for r in bad.collect()}
    assert sorted(reasons) == sorted(bad_lines)
    assert [reasons[line] for line in bad_lines] == [
        "type:total_amount", "missing:customer_id", "domain:order_status,domain:_op",
        "type:_cdc_seq", "unparseable",
    ]


def test_optional_fields_may_be_absent_and_arrival_time_is_filled_in(spark):
    line = json.loads(good_lines(spark, 1)[0])
    line.pop("discount_code", None)
    line.pop("_ingested_at")
    good, bad = split(spark, [json.dumps(line)])
    row = good.first()
    assert bad.count() == 0 and row.discount_code is None
    assert abs((datetime.now() - row._ingested_at).total_seconds()) < 86400


def test_numbers_and_unknown_fields_in_json(spark):
    line = json.loads(good_lines(spark, 1)[0])
    line["_offset"], line["unknown"] = 77, {"a": 1}
    good, _ = split(spark, [json.dumps(line)])
    assert good.first()._offset == 77


def test_message_attributes_win_over_the_payload(spark):
    line = good_lines(spark, 1)[0]
    frame = spark.createDataFrame(
        [(line, "t9", 4, 123, ago(2))], "value string, topic string, partition int, offset bigint, timestamp timestamp_ntz"
    )
    good, _ = landing.split_malformed(landing.coerce(landing.parse_lines(frame, ORDER), ORDER), ORDER)
    row = good.first()
    assert (row._topic, row._partition, row._offset, row._kafka_ts) == ("t9", 4, 123, ago(2))


def test_a_replay_adds_nothing(spark):
    rows = records(spark, "order", [{"order_id": str(n)} for n in range(5)])
    twice = rows.unionByName(rows)
    assert landing.duplicate_offsets(twice).count() == 5
    assert sorted(landing.dedup_offsets(twice).collect()) == sorted(rows.collect())


def test_month_partitions_prune_and_retention_removes_them(spark):
    path = scratch(spark, "landing")
    days = [1, 2, 20, 45, 80, 200]
    rows = records(spark, "order", [{"order_id": str(d), "created_at": ago(d)} for d in days])
    landing.write_partitioned(rows, path)
    read = spark.read.parquet(path)
    assert sorted(r.order_id for r in read.collect()) == sorted(map(str, days))
    plan = read.where(F.col(MONTH) == 202609)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_month" in plan
    refresh.retain(path, spark, AS_OF, 60, "_ingested_at")
    assert sorted(r.order_id for r in spark.read.parquet(path).collect()) == ["1", "2", "20", "45"]
    expect = landing.apply_retention(rows, AS_OF, 60)
    assert expect.count() == 4


def test_retention_drops_a_boundary_month_that_becomes_empty(spark):
    path = scratch(spark, "landing")
    rows = records(spark, "order", [{"order_id": "edge", "created_at": ago(73)}, {"order_id": "new"}])
    landing.write_partitioned(rows, path)
    refresh.retain(path, spark, AS_OF, 50, "_ingested_at")
    assert [r.order_id for r in spark.read.parquet(path).collect()] == ["new"]


def test_frame_header(spark):
    frame = bytes([0, 0, 1, 2, 3]) + b"payload"
    df = spark.createDataFrame([(bytearray(frame),), (bytearray(b"\x07abcdx"),)], "value binary")
    first, other = landing.split_frame(df, "value").collect()
    assert (first._magic, first._schema_id, bytes(first._payload)) == (0, 0x010203, b"payload")
    assert other._magic == 7


def framed(schemas):
    return landing.Framed(schemas, lambda col, schema: F.from_json(F.decode(col, "UTF-8"), schema))


def test_framed_records_are_decoded_by_their_own_schema(spark):
    row = records(spark, "order", [{"order_id": "A", "discount_code": "X"}])
    body = landing.to_lines(row.drop("_schema_id")).first().value.encode()
    names = [f.name for f in ORDER.landing_schema.fields if f.name != "_schema_id"]
    known = {i: ", ".join(f"{n} string" for n in names if n not in without) for i, without in {1: ("discount_code",), 258: ()}.items()}
    frames = [bytes([0]) + i.to_bytes(4, "big") + b for i, b in [(1, body), (258, body), (3, body), (1, b"")]]
    frames += [b"\x01" + frames[0][1:], b"\x00\x00", b""]
    messages = spark.createDataFrame([(bytearray(f), 4, n) for n, f in enumerate(frames)] + [(None, 4, 9)], "value binary, partition int, offset long")
    good, bad = landing.split_malformed(landing.coerce(framed(known)(messages, ORDER), ORDER), ORDER)
    got = sorted((r._schema_id, r.discount_code, r._partition, r._offset, r.order_id, r.total_amount) for r in good.collect())
    total = row.first().total_amount
    assert got == [(1, None, 4, 0, "A", total), (258, "X", 4, 1, "A", total)]
    why = {(r.line, r.reason) for r in bad.collect()}
    reasons = ["frame:schema", "frame:payload", "frame:magic", "frame:short", "frame:short"]
    told = {(f.hex().upper(), r) for f, r in zip(frames[2:], reasons)}
    assert why == told | {(None, "frame:short")}


def test_framed_messages_without_any_known_schema_are_all_quarantined(spark):
    messages = spark.createDataFrame([(bytearray(b"\x00\x00\x00\x00\x01x"),)], "value binary")
    good, bad = landing.split_malformed(landing.coerce(framed({})(messages, ORDER), ORDER), ORDER)
    assert good.count() == 0
    assert [r.reason for r in bad.collect()] == ["frame:schema"]


def test_avro_decoding_needs_its_package(spark):
    df = spark.createDataFrame([(bytearray(b"\x00\x00\x00\x00\x01\x02a"),)], "value binary")
    schema = '{"type": "record", "name": "r", "fields": [{"name": "order_id", "type": "string"}]}'
    try:
        out = landing.Framed({1: schema})(df, ORDER)
    except Exception as error:
        assert "avro" in str(error).lower()
        pytest.skip("spark-avro is not on the class path")
    assert [r.order_id for r in out.collect()] == ["a"]


def test_conformance_counts_findings(spark):
    rows = records(spark, "order", [{"order_id": "A"}, {"order_id": "B", "order_status": "lost"}])
    rows = rows.withColumn("customer_id", F.when(F.col("order_id") == "B", F.col("customer_id")))
    row = landing.conformance(rows.withColumn("total_amount", F.col("total_amount").cast("double")), ORDER).first()
    assert (row.required_nulls, row.outside_domain, row.type_mismatches) == (1, 1, 1)


def test_windows_are_cut_at_midnight():
    from tidemark.functions import midnight

    assert midnight(AS_OF, 3) == datetime(2026, 9, 10)
    assert midnight(datetime(2026, 3, 1, 5), 1) == datetime(2026, 2, 28)
    assert AS_OF - timedelta(days=3) != midnight(AS_OF, 3)


def test_retention_goes_by_its_clock_and_not_by_the_folder(spark):
    path = scratch(spark, "landing")
    rows = records(spark, "order", [
        {"order_id": "backfilled", "created_at": ago(200), "_ingested_at": ago(1)},
        {"order_id": "old", "created_at": ago(200)}, {"order_id": "new"}])
    landing.write_partitioned(rows, path)
    refresh.retain(path, spark, AS_OF, 60, "_ingested_at")
    assert sorted(r.order_id for r in spark.read.parquet(path).collect()) == ["backfilled", "new"]


def test_excess_decimals_are_a_finding(spark):
    line = landing.to_lines(records(spark, "order_item", [{"order_id": "A", "unit_price": 10}])).first().value
    lines = spark.createDataFrame([(line.replace("10.0000", "10.123456"),)], "value string")
    good, bad = landing.split_malformed(landing.coerce(landing.parse_lines(lines, CONTRACTS["order_item"]), CONTRACTS["order_item"]), CONTRACTS["order_item"])
    assert good.count() == 0 and "scale:unit_price" in bad.first().reason
