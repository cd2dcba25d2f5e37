"""Core-layer semantics: order, deletes, resurrection, compaction, rebuild."""

import random
from datetime import timedelta

from pyspark.sql import functions as F

from tests.support import SMALL, ago, lake, records
from tidemark.contracts import CONTRACTS
from tidemark.operators import cdc
from tidemark.plans.catalog import workspace

ORDER = CONTRACTS["order"]


def statuses(a_lake):
    return {r.order_id: r.order_status for r in a_lake.current("order").collect()}


def test_higher_sequence_wins_whatever_arrives_first(spark):
    got = statuses(lake(spark, order=[
        {"order_id": "ORD-OOO-1", "order_status": "canceled", "_cdc_seq": 2, "_op": "u"},
        {"order_id": "ORD-OOO-1", "order_status": "paid", "_cdc_seq": 1},
    ]))
    assert got == {"ORD-OOO-1": "canceled"}


def test_delete_hides_the_key_but_landing_keeps_it(spark):
    a_lake = lake(spark, order=[
        {"order_id": "ORD-DEL-1"}, {"order_id": "ORD-DEL-1", "_op": "d"},
    ])
    assert statuses(a_lake) == {}
    assert a_lake.landing("order").count() == 2


def test_resurrection_by_a_higher_sequence(spark):
    got = statuses(lake(spark, order=[
        {"order_id": "ORD-RES-1"}, {"order_id": "ORD-RES-1", "_op": "d"},
        {"order_id": "ORD-RES-1", "order_status": "delivered"},
    ]))
    assert got == {"ORD-RES-1": "delivered"}


def test_equal_sequence_is_settled_by_source_coordinates(spark):
    at = ago(1)
    got = statuses(lake(spark, order=[
        {"order_id": "A", "order_status": "paid", "_cdc_seq": 7, "_kafka_ts": at, "_partition": 1, "_offset": 9},
        {"order_id": "A", "order_status": "shipped", "_cdc_seq": 7, "_kafka_ts": at, "_partition": 2, "_offset": 1},
        {"order_id": "B", "order_status": "shipped", "_cdc_seq": 7, "_kafka_ts": at + timedelta(seconds=1), "_offset": 1},
        {"order_id": "B", "order_status": "paid", "_cdc_seq": 7, "_kafka_ts": at, "_offset": 99},
    ]))
    assert got == {"A": "shipped", "B": "shipped"}


def test_input_order_and_duplicates_do_not_matter(spark):
    rows = workspace(spark, SMALL).lake.landing("order_item").collect()
    contract = CONTRACTS["order_item"]
    shuffled = random.Random(3).sample(rows, len(rows)) + rows[:500]
    again = spark.createDataFrame(shuffled, contract.landing_schema)
    expect = cdc.current_state(workspace(spark, SMALL).lake.core("order_item"), contract)
    got = cdc.current_state(cdc.to_core(again, contract), contract)
    assert sorted(got.collect()) == sorted(expect.collect())


def test_aggregation_form_gives_the_same_state(spark):
    core, contract = workspace(spark, SMALL).lake.core("order_item"), CONTRACTS["order_item"]
    a = cdc.current_state(core, contract).select("order_id", "item_seq", "item_id", "quantity")
    b = cdc.current_by_max(core, contract, ["item_id", "quantity"])
    assert sorted(a.collect()) == sorted(b.collect())


def test_window_on_an_immutable_column_equals_filtering_afterwards(spark):
    core, contract = workspace(spark, SMALL).lake.core("order_item"), CONTRACTS["order_item"]
    since = workspace(spark, SMALL).as_of - timedelta(days=700)
    early = cdc.current_state(core, contract, since, "created_at")
    late = cdc.current_state(core, contract).where(F.col("created_at") >= F.lit(str(since)).cast("timestamp_ntz"))
    assert 0 < early.count() < core.count()
    assert sorted(early.collect()) == sorted(late.collect())


def test_a_column_that_may_change_is_filtered_after_the_versions(spark):
    """The newest version left the window: the older one must not come back."""
    core = cdc.to_core(records(spark, "order", [
        {"order_id": "A", "updated_at": ago(1), "_cdc_seq": 1},
        {"order_id": "A", "updated_at": ago(30), "_cdc_seq": 2},
    ]), ORDER)
    assert cdc.current_state(core, ORDER, ago(5), "updated_at").count() == 0


def test_child_rows_under_their_parent(spark):
    a_lake = workspace(spark, SMALL).lake
    head = a_lake.current("order").select("order_id", F.col("currency").alias("cur"))
    contract = CONTRACTS["order_item"]
    got = cdc.current_under(a_lake.core("order_item"), contract, head, "order_id")
    expect = a_lake.current("order_item").drop("_ingested_at").join(head, "order_id")
    columns = [*contract.columns, "cur"]
    assert sorted(got.select(columns).collect()) == sorted(expect.select(columns).collect())


def test_regressions_over_chunk_seams_equal_brute_force(spark):
    rng = random.Random(11)
    rows = [
        {"order_id": f"K{rng.randrange(4)}", "_partition": rng.randrange(3), "_offset": i,
         "_cdc_seq": rng.randrange(50)}
        for i in range(300)
    ]
    expect: dict[str, int] = {}
    by_key: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["_partition"], r["_offset"])):
        by_key.setdefault(r["order_id"], []).append(r["_cdc_seq"])
    for key, seqs in by_key.items():
        expect[key] = sum(a > b for a, b in zip(seqs, seqs[1:]))
    landing = records(spark, "order", rows)
    for chunk in (7, 50, 1_000_000):
        got = cdc.seq_regressions(landing, ["order_id"], chunk).collect()
        assert {r.order_id: r.regressions for r in got} == expect


def test_profile_counts_operations_and_deleted_keys(spark):
    a_lake = lake(spark, order=[
        {"order_id": "A", "_cdc_seq": 2, "_op": "u"}, {"order_id": "A", "_cdc_seq": 1},
        {"order_id": "B"}, {"order_id": "B", "_op": "d"},
    ])
    row = cdc.cdc_profile(a_lake.landing("order"), a_lake.state("order"), ORDER).first()
    assert (row.landing_rows, row.landing_distinct_keys) == (4, 2)
    assert (row.core_rows, row.core_deleted_keys, row.keys_with_dup_in_core) == (1, 1, 0)
    assert (row.ops_create, row.ops_update, row.ops_delete) == (2, 1, 1)
    assert row.cdc_seq_non_monotonic == 1


def test_a_payment_that_moved_is_found_only_where_it_is_now(spark):
    contract = CONTRACTS["order_payment"]
    core = cdc.to_core(records(spark, "order_payment", [
        {"payment_id": "P", "order_id": "A"}, {"payment_id": "P", "order_id": "B"},
        {"payment_id": "Q", "order_id": "A"},
    ]), contract)

    def of(order):
        keys = spark.createDataFrame([(order,)], "order_id string")
        return sorted(r.payment_id for r in cdc.current_of(core, contract, keys).collect())

    assert (of("A"), of("B")) == (["Q"], ["P"])


def test_parents_of_a_narrow_window_equal_all_parents(spark):
    a_lake, since = workspace(spark, SMALL).lake, workspace(spark, SMALL).as_of - timedelta(days=20)
    items = a_lake.current("order_item", since)
    wide = items.join(a_lake.parents("order_item", "order_id", "order", since, False), "order_id")
    narrow = items.join(a_lake.parents("order_item", "order_id", "order", since, True), "order_id")
    assert 0 < narrow.count() < a_lake.current("order_item").count()
    assert sorted(map(str, narrow.collect())) == sorted(map(str, wide.collect()))


def test_a_changed_immutable_column_is_found_with_deletes_and_nulls(spark):
    order = {"created_at": ago(3)}
    rows = [
        {**order, "order_id": "same"}, {**order, "order_id": "same", "_op": "d"},
        {**order, "order_id": "moved"}, {**order, "order_id": "moved", "created_at": ago(40)},
        {**order, "order_id": "gone"}, {**order, "order_id": "gone", "created_at": ago(40), "_op": "d"},
    ]
    contract = CONTRACTS["order"]
    core = cdc.to_core(records(spark, "order", rows), contract)
    half = core.where(F.col("order_id") == "same").withColumn(
        "created_at", F.when(F.col("_is_deleted") == 0, F.col("created_at")))
    none = half.withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    both = core.unionByName(half.withColumn("order_id", F.lit("half"))).unionByName(none.withColumn("order_id", F.lit("none")))
    got = {r.order_id: r.changed for r in cdc.immutable_changes(both, contract).collect()}
    assert got == {"moved": ["created_at"], "gone": ["created_at"], "half": ["created_at"]}
