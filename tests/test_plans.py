"""What the optimizer makes of the jobs: pruning, map-side combine, no cross joins."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.support import SMALL, records
from tidemark.contracts import CONTRACTS, VERSION_ORDER
from tidemark.functions import midnight
from tidemark.operators import cdc
from tidemark.operators.store import Store
from tidemark.plans import catalog, quality, refresh
from tidemark.plans.catalog import QUERIES, workspace
from tidemark.plans.marts import customers, health, margin, stock
from tidemark.plans.workspace import Workspace
from tidemark.sources import landing, retail
from tidemark.session import RECOMMENDED, scratch, shared_dir


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_versions_are_pruned_before_the_shuffle(spark):
    plan = physical(workspace(spark, SMALL).lake.current("order_item"))
    below = plan.split("Exchange hashpartitioning(order_id", 1)[1]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_the_refresh_window_reaches_the_scan(spark):
    w = workspace(spark, SMALL)
    plan = physical(w.lake.current("order", midnight(w.as_of, 3)))
    assert "GreaterThanOrEqual(o_orderdate,2001-07-30T00:00)" in plan


def test_a_stored_core_opens_only_the_months_of_the_window(spark):
    w, contract, path = workspace(spark, SMALL), CONTRACTS["order"], scratch(spark, "core")
    landing.write_core(w.lake.core("order"), path, contract)
    since = midnight(w.as_of, 40)
    recent = cdc.current_state(spark.read.parquet(path), contract, since, "created_at")
    assert "(_month#" in physical(recent).split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert sorted(recent.collect()) == sorted(w.lake.current("order", since).collect())


def test_only_needed_columns_are_read(spark):
    w = workspace(spark, SMALL)
    plan = physical(w.lake.current("order_item").groupBy("order_id").agg(F.sum("quantity")))
    assert "l_extendedprice" not in plan and "l_tax" not in plan


WRITERS = ("refresh", "landing_json", "landing_partitioned", "landing_stream", "late_arrival", "second",
           "core_stream", "core_stored", "core_upsert", "events_per_window", "stream_refresh", "order_point_read")


def test_no_query_multiplies_rows_by_a_cross_join(spark):
    for name, build in QUERIES.items():
        if name.startswith(WRITERS):
            continue
        plan = physical(build(spark, SMALL))
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_a_bucketed_core_needs_no_shuffle_for_state_and_item_totals(spark):
    """Items bucketed by their order: current state, totals per order and the
    join to the order all run where the rows are."""
    w = workspace(spark, SMALL)
    for entity in ("order", "order_item"):
        contract = CONTRACTS[entity]
        refresh.write_bucketed(w.lake.core(entity), f"core_{entity}", contract.bucket_by, 4)
    # the test tables are so small that a broadcast would hide the point
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items = cdc.current_state(spark.table("core_order_item"), CONTRACTS["order_item"])
        orders = cdc.current_state(spark.table("core_order"), CONTRACTS["order"])
        totals = items.groupBy("order_id").agg(F.sum("quantity").alias("q"))
        joined = orders.join(totals, "order_id", "left").select("order_id", "q")
        assert "Exchange" not in physical(joined)
        assert joined.count() == w.lake.current("order").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_working_folders_lie_in_the_named_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    first, second = scratch(spark, "x"), scratch(spark, "x")
    assert first != second and first.startswith(shared_dir(spark))


@pytest.mark.parametrize("key", sorted(RECOMMENDED))
def test_session_defaults(spark, key):
    assert spark.conf.get(key) == RECOMMENDED[key]


def test_parents_of_a_window_are_filtered_by_its_keys_below_their_versions(spark):
    w = workspace(spark, SMALL)
    contract = CONTRACTS["order_item"]
    (relation,) = (r for r in contract.relations if r.to == "order")
    plan = physical(health._parents(w.lake, contract, relation, midnight(w.as_of, 7)))
    windowed = plan.split("Window [row_number()", 1)[1]
    assert "LeftSemi" in windowed and "LeftSemi" not in plan.split("Window [row_number()", 1)[0]
    rows = health._parents(w.lake, contract, relation, midnight(w.as_of, 7))
    assert 0 < rows.count() < w.lake.current("order").count() / 10


def test_the_join_of_items_serves_their_current_state(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(workspace(spark, SMALL).lake.current("order_item"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2  # the two sides of the join


def test_orphan_totals_read_no_column_that_is_not_looked_up(spark):
    plan = physical(workspace(spark, SMALL).mart("orphan_summary"))
    assert "l_partkey" in plan and "l_extendedprice" not in plan


def test_stored_rows_are_compared_without_their_columns(spark):
    contract = CONTRACTS["order"]
    space, store = workspace(spark, SMALL), Store(spark, scratch(spark, "store"), CONTRACTS["order"], 8)
    store.append(space.lake.core("order"), "load", 0)
    narrow = store.table(store.marked)
    assert narrow.columns == [*contract.key, *VERSION_ORDER, "_is_deleted", "_mark"]
    whole = {r.order_id: r[-1] for r in store.marked(store.table()).collect()}
    assert {r.order_id: r._mark for r in narrow.collect()} == whole


@pytest.fixture
def no_broadcast(spark):
    """As on large tables, whose sides are too large to be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_items_meet_their_orders_without_a_second_shuffle(spark, no_broadcast):
    """The key is part of the item's own, by which its versions were compared."""
    w = workspace(spark, SMALL)
    plan = physical(health._references(w.lake, CONTRACTS["order_item"], w.as_of, None))
    assert "hashpartitioning(_l0_0" not in plan


def test_the_salt_of_references_carries_no_key(spark, no_broadcast):
    w = workspace(spark, SMALL)
    references = health._references(w.lake, CONTRACTS["order_item"], w.as_of, None).select("relation_id", "is_orphan", "age_seconds")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = references._jdf.queryExecution().explainString(mode)
    shuffled = [b for b in plan.split("\n\n") if ") Exchange" in b and "_salt" in b]
    assert shuffled and not any("item_seq" in b for b in shuffled)


def test_items_are_shuffled_to_their_orders_without_floating_point(spark, no_broadcast):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = workspace(spark, SMALL).tables.landing("order_item")._jdf.queryExecution().explainString(mode)
    shuffled = [b for b in plan.split("\n\n") if ") Exchange" in b]
    assert shuffled and not any(c in b for b in shuffled for c in ("l_extendedprice", "l_quantity", "l_returnflag"))


def few_sales(spark):
    """Five orders of one item each, all of it of a size that Spark knows to be small."""
    orders = spark.range(1, 6).selectExpr(
        "id o_orderkey", "id o_custkey", "'O' o_orderstatus", "100D o_totalprice",
        "timestamp'2001-07-20 00:00:00' o_orderdate", "'1-URGENT' o_orderpriority",
    )
    lines = spark.range(1, 6).selectExpr(
        "id l_orderkey", "id l_partkey", "id l_suppkey", "1 l_linenumber", "2D l_quantity", "200D l_extendedprice",
        "0D l_discount", "0D l_tax", "'N' l_returnflag", "'O' l_linestatus", "timestamp'2001-07-21 00:00:00' l_shipdate",
    )
    parts = spark.range(1, 6).selectExpr("id p_partkey", "10 p_size", "50D p_retailprice")
    people = spark.range(1, 6).selectExpr("id c_custkey", "'n' c_name", "1 c_nationkey", "'S' c_mktsegment")
    made = {
        "order": retail.order_records(orders),
        "order_item": retail.order_item_records(lines, orders),
        "prices": retail.price_records(parts),
        "stock_position": retail.stock_records(parts),
        "customer": retail.customer_records(people),
    }
    return cdc.Lake({e: made[e] if e in made else records(spark, e, []) for e in CONTRACTS}, CONTRACTS)


def test_items_meet_orders_without_a_broadcast(spark):
    """Orders grow with the data: at a small size too they do not pass through the driver."""
    a_lake = few_sales(spark)
    for mart in (
        stock.stockout_candidates(a_lake, retail.SALES_AS_OF),
        margin.item_margin_daily(a_lake, retail.SALES_AS_OF, 28),
        customers.customer_metrics(a_lake, retail.SALES_AS_OF),
    ):
        plan = physical(mart)
        assert "BroadcastHashJoin [order_id" not in plan and "SortMergeJoin [order_id" in plan
    priced = margin.item_margin_daily(a_lake, retail.SALES_AS_OF, 28)
    assert priced.agg(F.sum("units_sold")).first()[0] == 8  # one order of five is canceled


def test_parity_of_the_margin_broadcasts_neither_prices_nor_orders(spark):
    found = quality.parity_margin(Workspace(few_sales(spark)))
    assert "BroadcastHashJoin" not in physical(found)
    row = found.first()
    assert row["mart_value"] == row["direct_value"] != 0


def test_the_cohort_does_not_broadcast_customers(spark):
    found = customers.customer_cohort(few_sales(spark), retail.SALES_AS_OF)
    assert "BroadcastHashJoin [customer_id" not in physical(found)
    assert found.agg(F.sum("orders")).first()[0] == 4  # one of five is canceled


PRICED = (
    "dq_price_below_cost", "dq_price_coverage", "dq_price_staleness", "item_margin_daily",
    "item_margin_daily_window", "items_without_price", "sold_below_cost", "top_margin_items",
)


@pytest.mark.parametrize("name", [*PRICED, "stockout_candidates", "stockout_candidates_vetoed"])
def test_prices_and_orders_never_pass_through_the_driver(spark, monkeypatch, name):
    """Spark knows these tables to be small, so whatever is left to it is broadcast."""
    space = Workspace(few_sales(spark), datetime(2001, 7, 22))  # two days after the orders
    monkeypatch.setitem(catalog._spaces, (spark.sparkContext.applicationId, "few"), space)
    plan = physical(QUERIES[name](spark, "few"))
    assert "BroadcastExchange" not in plan and "SortMergeJoin [order_id" in plan
    assert name not in PRICED or "SortMergeJoin [item_id" in plan


def test_keys_and_time_of_a_sale_are_shuffled_once_to_its_prices(spark):
    priced = margin.priced_items(few_sales(spark), retail.SALES_AS_OF, 28)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    asked = priced.select("item_id", "currency", "created_at", "price_valid_from")
    plan = asked._jdf.queryExecution().explainString(mode)
    inputs = [b.split("]: [")[1].split("]")[0] for b in plan.split("\n\n") if ") Exchange" in b and "_side#" in b]
    (names,) = ({c.split("#")[0].strip() for c in b.split(",")} for b in inputs)
    assert names - {"_side", "_value", "_tie0", "_carry"} == {"item_id", "currency", "_slot", "_at", "_salt"}
