"""Named queries over a data folder: ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.contracts import CONTRACTS, MONTH
from tidemark.functions import flag, in_window, is_blank, midnight, money_sum, seconds_between
from tidemark.operators import cdc, joins, windows
from tidemark.operators.aggregates import duplicate_keys, preferred_value, quantiles
from tidemark.operators.store import Store
from tidemark.plans import quality, refresh, reports
from tidemark.plans.marts import discounts, health, margin, payments, sales, stock
from tidemark.plans.workspace import Workspace
from tidemark.session import scratch
from tidemark.sources import landing
from tidemark.streaming import frontier, jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_spaces: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, folder: str) -> Workspace:
    """One workspace per session and folder, so lookups are sized once."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _spaces:
        _spaces[key] = Workspace.of_folder(spark, folder)
    return _spaces[key]


def query(name: str):
    def register(fn: Callable[[Workspace], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(workspace(spark, folder))
        return fn

    return register


def _flat(order_360: DataFrame) -> DataFrame:
    """Payment methods as one text, for comparison as a plain value."""
    return order_360.withColumn("payment_methods", F.array_join("payment_methods", ","))


# --- marts, over all data -------------------------------------------------

for _name in (
    "revenue_by_bu_day",
    "payment_funnel_day",
    "discount_effectiveness",
    "discount_baseline_day",
    "item_margin_daily",
    "stock_coverage",
    "stockout_candidates",
    "customer_metrics",
    "customer_cohort",
    "dq_overview",
    "orphan_summary",
    "orphan_records",
    "idle_catalog",
):
    query(_name)(lambda w, _name=_name: w.mart(_name))

query("order_360")(lambda w: _flat(w.mart("order_360")))

# --- marts, in their own refresh windows ----------------------------------

query("order_360_window")(lambda w: _flat(sales.order_360(w.lake, w.lookups, w.as_of, 3)))
query("revenue_by_bu_day_window")(
    lambda w: sales.revenue_by_bu_day(w.lake, w.lookups, w.as_of, 3)
)
query("payment_funnel_day_window")(
    lambda w: payments.payment_funnel_day(w.lake, w.lookups, w.payments_as_of, 15)
)
query("discount_effectiveness_window")(
    lambda w: discounts.discount_effectiveness(w.lake, w.lookups, w.as_of, 90)
)
query("discount_baseline_day_window")(
    lambda w: discounts.discount_baseline_day(w.lake, w.as_of, 90)
)
query("item_margin_daily_window")(lambda w: margin.item_margin_daily(w.lake, w.as_of, 7))
query("stock_coverage_window")(lambda w: stock.stock_coverage(w.lake, w.as_of, 28))
query("stockout_candidates_wide")(lambda w: stock.stockout_candidates(w.lake, w.as_of, w.days))


@query("stockout_candidates_vetoed")
def _vetoed(w: Workspace) -> DataFrame:
    """The stock topic is two hours behind: no absence is conclusive."""
    late = F.col("_kafka_ts") - F.expr("INTERVAL 2 HOURS")
    behind = w.lake.landing("stock_position").withColumn("_kafka_ts", late)
    return stock.stockout_candidates(_lake_with(w, stock_position=behind), w.as_of)


query("orphan_summary_window")(lambda w: health.orphan_summary(w.lake, w.as_of, 7))

# --- landing --------------------------------------------------------------


def broken_lines(orders: DataFrame) -> DataFrame:
    """The order records as JSON text, some of them damaged in four ways: cut
    short, a text for an amount, a missing customer, an unknown status."""
    key = F.col("order_id").cast("bigint")
    cut, text = key % 97 == 0, key % 89 == 0
    missing, unknown = key % 83 == 0, key % 79 == 0
    fields = [F.col(c).cast("string").alias(c) for c in orders.columns]
    damaged = orders.select(*fields).withColumns(
        {
            "total_amount": F.when(~cut & text, "abc").otherwise(F.col("total_amount")),
            "customer_id": F.when(cut | text | ~missing, F.col("customer_id")),
            "order_status": F.when(~cut & ~text & ~missing & unknown, "lost").otherwise(
                F.col("order_status")
            ),
        }
    )
    line = F.to_json(F.struct(*orders.columns))
    return damaged.select(F.when(cut, F.substring(line, 1, 20)).otherwise(line).alias("value"))


def _split(w: Workspace) -> tuple[DataFrame, DataFrame]:
    contract = CONTRACTS["order"]
    lines = broken_lines(w.lake.landing("order"))
    return landing.split_malformed(
        landing.coerce(landing.parse_lines(lines, contract), contract), contract
    )


@query("coerce")
def _coerce(w: Workspace) -> DataFrame:
    return _split(w)[0]


@query("dlq_split")
def _dlq_split(w: Workspace) -> DataFrame:
    good, bad = _split(w)
    counted = bad.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))
    return counted.unionByName(
        good.agg(F.count(F.lit(1)).alias("lines")).withColumn("reason", F.lit("landed"))
    )


def framed_orders(orders: DataFrame) -> DataFrame:
    """The order records as framed messages of two schemas: the first, for odd orders, does not
    know coupons yet. Some are damaged: a cut payload, an unknown schema, another magic byte, less
    than a header. The payload is JSON here; a topic has Avro."""
    key = F.col("order_id").cast("bigint")
    texts = [F.col(c).cast("string").alias(c) for c in orders.columns if c not in landing.MESSAGE]
    first = F.to_json(F.struct(*[t for t, c in zip(texts, [c for c in orders.columns if c not in landing.MESSAGE]) if c != "discount_code"]))
    payload = F.when(key % 2 == 1, first).otherwise(F.to_json(F.struct(*texts)))
    payload = F.when(key % 97 == 0, F.substring(payload, 1, 20)).otherwise(payload)
    schema = F.when(key % 89 == 0, 9).otherwise(F.when(key % 2 == 1, 1).otherwise(2))
    head = F.concat(F.when(key % 83 == 0, "01").otherwise("00"), F.lpad(F.hex(schema.cast("bigint")), 8, "0"))
    frame = F.concat(F.unhex(head), F.encode(payload, "UTF-8"))
    return orders.select(
        F.when(key % 79 == 0, F.substring(frame, 1, 3)).otherwise(frame).alias("value"),
        *[F.col(name).alias(source) for name, source in landing.MESSAGE.items()],
    )


def framed_json(contract, without: tuple[str, ...]) -> landing.Framed:
    """Reader of ``framed_orders``: JSON payloads, the first schema without some fields."""
    names = [f.name for f in contract.landing_schema.fields if f.name not in landing.MESSAGE and f.name != "_schema_id"]
    schemas = {1: [n for n in names if n not in without], 2: names}

    def decode(payload, schema):
        record = F.from_json(F.decode(payload, "UTF-8"), schema, {"mode": "PERMISSIVE"})
        return F.when(F.col("_payload").isNotNull() & record["order_id"].isNotNull(), record)

    return landing.Framed({i: ", ".join(f"{n} string" for n in ns) for i, ns in schemas.items()}, decode)


def _framed_split(w: Workspace) -> tuple[DataFrame, DataFrame]:
    contract = CONTRACTS["order"]
    parse = framed_json(contract, ("discount_code",))
    messages = framed_orders(w.lake.landing("order"))
    return landing.split_malformed(landing.coerce(parse(messages, contract), contract), contract)


@query("framed_landing")
def _framed_landing(w: Workspace) -> DataFrame:
    return _framed_split(w)[0]


@query("framed_dlq")
def _framed_dlq(w: Workspace) -> DataFrame:
    """Why messages were quarantined, and how many bytes they have."""
    bad = _framed_split(w)[1]
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.length("line") < 10).alias("short"))


@query("landing_json")
def _landing_json(w: Workspace) -> DataFrame:
    path = scratch(w.spark, "json")
    landing.to_lines(w.lake.landing("order")).write.text(path)
    good, _ = landing.read_landing_json(w.spark, path, CONTRACTS["order"])
    return good


@query("landing_partitioned")
def _landing_partitioned(w: Workspace) -> DataFrame:
    """Month partitions of the payment landing table, written and read back."""
    path = scratch(w.spark, "landing")
    landing.write_partitioned(w.lake.landing("order_payment"), path)
    return (
        w.spark.read.parquet(path)
        .groupBy(F.col(MONTH).cast("string").alias("month"))
        .agg(F.count(F.lit(1)).alias("rows"), F.max("_offset").alias("last_offset"))
    )


query("offset_dups")(lambda w: landing.duplicate_offsets(w.lake.landing("order_item")))


@query("offset_replay")
def _offset_replay(w: Workspace) -> DataFrame:
    """A full replay of the order records adds no row."""
    records = w.lake.landing("order")
    return landing.dedup_offsets(records.unionByName(records))


query("retention")(
    lambda w: landing.apply_retention(
        w.lake.landing("order"), w.as_of, CONTRACTS["order"].retention_days
    )
)
query("schema_conformance")(
    lambda w: health.union_by_contract(
        CONTRACTS.values(), lambda c: landing.conformance(w.lake.landing(c.entity), c)
    )
)
query("window_filter")(
    lambda w: w.lake.current("order")
    .where(in_window("created_at", w.as_of, 90))
    .select("order_id", "created_at", "total_amount")
)


@query("blank_dc")
def _blank_dc(w: Workspace) -> DataFrame:
    blank = flag(is_blank("dc_id")).alias("blank")
    return w.lake.current("order_item").groupBy(blank).agg(
        F.count(F.lit(1)).alias("items"), F.sum("quantity").alias("units")
    )


# --- core -----------------------------------------------------------------

query("core_projection")(lambda w: w.lake.core("order_item"))
query("current_order")(lambda w: w.lake.current("order"))
query("current_order_item")(lambda w: w.lake.current("order_item"))
query("current_argmax")(
    lambda w: cdc.current_by_max(
        w.lake.core("order_item"), CONTRACTS["order_item"], ["item_id", "quantity", "total_amount"]
    )
)


@query("cdc_delete_resurrect")
def _delete_resurrect(w: Workspace) -> DataFrame:
    """Every order that was ever deleted: is it alive again, and in what status."""
    deleted = w.lake.landing("order").where(F.col("_op") == "d").select("order_id").distinct()
    alive = w.lake.current("order").select("order_id", "order_status")
    return deleted.join(alive, "order_id", "left").select(
        "order_id", flag(F.col("order_status").isNotNull()).alias("alive"), "order_status"
    )


def _stored_items(w: Workspace, writes: int = 3) -> Store:
    """All versions of the items in a stored core table, in several runs."""
    contract = CONTRACTS["order_item"]
    store = Store(w.spark, scratch(w.spark, "core"), contract, 8)
    core = w.lake.core("order_item")
    for n in range(writes):
        store.append(core.where(F.pmod(F.xxhash64("_offset", "_partition"), F.lit(writes)) == n), "load", n)
    return store


@query("compaction_invariant")
def _compaction(w: Workspace) -> DataFrame:
    """Stored versions, compacted: the current items are the same, and files have become smaller."""
    store = _stored_items(w)
    before = sum(p.bytes for p in store.parts)
    hit = store.compact()
    if hit and sum(p.bytes for p in store.parts) >= before:
        raise ValueError("compaction has saved nothing")
    return store.current()


@query("compaction_report")
def _compaction_report(w: Workspace) -> DataFrame:
    """What compaction drops, by whether the key is live."""
    store = _stored_items(w)
    superseded = sum(store.superseded().values())
    before = store.versions().agg(F.count(F.lit(1)).alias("rows_before"))
    store.compact()
    after = store.versions().agg(
        F.count(F.lit(1)).alias("rows_after"), F.count_if(F.col("_is_deleted") == 1).alias("tombstones")
    )
    return cdc.with_scalars(before, after).withColumn("superseded", F.lit(superseded).cast("bigint"))


@query("rebuild_parity")
def _rebuild(w: Workspace) -> DataFrame:
    """A stored core table that lost one bucket and holds other amounts in a second: the two are
    found by their fingerprints and derived from landing again."""
    contract, raw = CONTRACTS["order_item"], w.lake.landing("order_item")
    store = Store(w.spark, scratch(w.spark, "core"), contract, 8)
    spoilt = F.when(store.bucket() == 5, F.col("total_amount") + 1).otherwise(F.col("total_amount"))
    core = cdc.to_core(raw, contract).where(store.bucket() != 2)
    store.append(core.withColumn("total_amount", spoilt.cast("decimal(18,4)")), "load", 0)
    store.rebuild(raw, store.differing(raw))
    return store.versions().agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("_is_deleted").alias("deleted_rows"),
        money_sum("total_amount").alias("total_amount"),
    )


@query("core_differences")
def _core_differences(w: Workspace) -> DataFrame:
    """Live keys that a stored table without every 50th order does not have."""
    contract, raw = CONTRACTS["order"], w.lake.landing("order")
    store = Store(w.spark, scratch(w.spark, "core"), contract, 8)
    kept = w.lake.core("order").where(F.col("order_id").cast("bigint") % 50 != 0)
    store.append(kept, "load", 0, one_per_key=True)
    found = store.differences(raw, store.differing(raw))
    return found.select("order_id", "stored_rows", "landed_rows")


query("cdc_profile")(
    lambda w: health.union_by_contract(
        CONTRACTS.values(),
        lambda c: cdc.cdc_profile(w.lake.landing(c.entity), w.lake.state(c.entity), c),
    )
)
query("seq_regressions")(
    lambda w: cdc.seq_regressions(w.lake.landing("order_item"), CONTRACTS["order_item"].key)
)


@query("raw_vs_current")
def _raw_vs_current(w: Workspace) -> DataFrame:
    def block(contract) -> DataFrame:
        count = F.count(F.lit(1))
        raw = w.lake.core(contract.entity).agg(count.alias("raw_rows"))
        now = w.lake.current(contract.entity).agg(count.alias("current_rows"))
        return cdc.with_scalars(raw, now).withColumn("entity", F.lit(contract.entity))

    return health.union_by_contract(CONTRACTS.values(), block)


query("key_uniqueness")(
    lambda w: duplicate_keys(w.lake.landing("order_item"), CONTRACTS["order_item"].key)
)

query("topic_lag")(
    lambda w: health.union_by_contract(
        CONTRACTS.values(),
        lambda c: stock.topic_lag(w.lake.landing(c.entity), w.payments_as_of).withColumn(
            "topic", F.lit(c.topic)
        ),
    )
)


@query("core_stored")
def _core_stored(w: Workspace) -> DataFrame:
    """Core items stored by month; the current items of the last 90 days."""
    path, contract = scratch(w.spark, "core"), CONTRACTS["order_item"]
    landing.write_core(w.lake.core("order_item"), path, contract)
    since = midnight(w.as_of, 90)
    return cdc.current_state(w.spark.read.parquet(path), contract, since, "created_at")


# --- joins and aggregates -------------------------------------------------

query("lookup_join")(
    lambda w: joins.lookup_join(
        w.lake.current("order").select("order_id", "business_unit_code"),
        w.lookups["business_unit"],
        "business_unit_code",
        {"bu_name": ("bu_name", "(sem cadastro)"), "bu_country": ("country", None)},
        "bu_found",
    )
)
query("asof_price")(
    lambda w: margin.priced_items(w.lake, w.as_of, w.days).select(
        "order_id",
        "item_seq",
        "item_id",
        "created_at",
        "price_list_id",
        "list_price",
        "cost_price",
        "price_valid_from",
    )
)
query("current_price")(lambda w: joins.price_at(w.lake.current("prices"), w.as_of))


@query("anti_null")
def _anti_null(w: Workspace) -> DataFrame:
    """Items at a centre without a position; an item without a centre stays."""
    stock = w.lake.current("stock_position").select("item_id", "dc_id")
    items = w.lake.current("order_item").select("order_id", "item_seq", "item_id", "dc_id")
    return items.join(stock, ["item_id", "dc_id"], "left_anti")


query("anti_with_total")(
    lambda w: joins.anti_with_total(
        w.lake.current("order_payment"), w.lake.current("order"), [("order_id", "order_id")]
    )
)
query("touched_orders")(
    lambda w: joins.touched_keys(
        [w.lake.current(e) for e in ("order", "order_item", "order_payment")],
        "order_id",
        w.as_of - timedelta(days=3),
    )
)
query("fanout_guard")(
    lambda w: joins.fanout_guard(
        w.mart("order_360"), w.lake.current("order_item"), "order_id", "items_count"
    )
)
query("unassigned_total")(lambda w: reports.unassigned_total(w.mart("stock_coverage")))
query("preferred_channel")(
    lambda w: preferred_value(w.lake.current("order"), "customer_id", "channel", "channel")
)


@query("latency_quantiles")
def _latency_quantiles(w: Workspace) -> DataFrame:
    attempts = w.lake.current("order_payment").select(
        "acquirer", seconds_between("created_at", "authorized_at").alias("latency")
    )
    return quantiles(attempts, ["acquirer"], "latency", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


# --- reports --------------------------------------------------------------

query("order_lookup")(lambda w: _flat(reports.order_lookup(w.mart("order_360"), w.as_of, "42")))
query("customer_orders")(lambda w: reports.customer_orders(w.mart("order_360")))
query("customer_orders_of")(lambda w: reports.customer_orders(w.mart("order_360"), "42", 50))
query("revenue_last_30d")(
    lambda w: reports.revenue_last_days(w.mart("revenue_by_bu_day"), w.as_of)
)
query("cancel_rate_by_bu")(
    lambda w: reports.cancel_rate_by_bu(w.mart("revenue_by_bu_day"), w.as_of, w.days)
)
query("approval_by_acquirer")(
    lambda w: reports.approval_by_acquirer(w.mart("payment_funnel_day"), w.payments_as_of, w.days)
)
query("unknown_coupons")(
    lambda w: reports.unknown_coupons(w.mart("discount_effectiveness"), w.as_of)
)
query("coupons_over_limit")(lambda w: reports.coupons_over_limit(w.mart("discount_effectiveness")))
query("campaign_vs_baseline")(
    lambda w: reports.campaign_vs_baseline(
        w.mart("discount_effectiveness"), w.mart("discount_baseline_day"), w.as_of, w.days
    )
)
query("items_without_price")(lambda w: reports.items_without_price(w.mart("item_margin_daily")))
query("sold_below_cost")(
    lambda w: reports.sold_below_cost(w.mart("item_margin_daily"), w.as_of, w.days)
)
query("top_margin_items")(
    lambda w: reports.top_margin_items(w.mart("item_margin_daily"), w.as_of, w.days)
)
query("coverage_alerts")(lambda w: reports.coverage_alerts(w.mart("stock_coverage")))
query("coverage_by_dc")(lambda w: reports.coverage_by_dc(w.mart("stock_coverage"), "3"))
query("stockout_queue")(lambda w: reports.stockout_queue(w.mart("stockout_candidates")))
query("stockout_summary")(lambda w: reports.stockout_summary(w.mart("stockout_candidates")))
query("rfm_scores")(lambda w: reports.rfm_scores(w.mart("customer_metrics")))
query("retention_curve")(
    lambda w: reports.retention_curve(w.mart("customer_cohort"), date(1995, 1, 1))
)
query("dq_alerts")(
    lambda w: reports.dq_alerts(w.mart("dq_overview"), w.mart("orphan_summary"))
)
query("entity_state")(lambda w: reports.entity_state(w.mart("dq_overview")))
query("orphan_verdict")(lambda w: reports.orphan_verdict(w.mart("orphan_summary")))
query("data_health")(
    lambda w: reports.data_health(
        reports.dq_alerts(w.mart("dq_overview"), w.mart("orphan_summary"))
    )
)
query("capital_by_dc")(lambda w: reports.capital_by_dc(w.mart("idle_catalog")))
query("catalog_gaps")(lambda w: reports.catalog_gaps(w.mart("idle_catalog")))
query("idle_ranking")(lambda w: reports.idle_ranking(w.mart("idle_catalog")))
query("top_idle")(lambda w: reports.top_idle(w.mart("idle_catalog")))

# --- refresh --------------------------------------------------------------


@query("refresh_window_parity")
def _refresh_window(w: Workspace) -> DataFrame:
    """A wide refresh, then the cited window on top: equal to the mart at once."""
    path = scratch(w.spark, "mart")

    def job(at, days):
        return sales.revenue_by_bu_day(w.lake, w.lookups, at, days)

    refresh.refresh_window(job, path, w.as_of, w.days, "order_date")
    refresh.refresh_window(job, path, w.as_of, 3, "order_date")
    return refresh.read_mart(w.spark, path)


@query("refresh_full_parity")
def _refresh_full(w: Workspace) -> DataFrame:
    root = scratch(w.spark, "mart")
    refresh.refresh_full(w.mart("stock_coverage").limit(0), root, "empty")
    refresh.refresh_full(w.mart("stock_coverage"), root, "whole")
    return refresh.read_current(w.spark, root)


@query("refresh_keys_parity")
def _refresh_keys(w: Workspace) -> DataFrame:
    """Built before cancellations and deletes are known, then only the touched
    orders are recomputed: equal to the mart built at once."""
    path = scratch(w.spark, "mart")
    raw = w.lake.landing("order")
    early = _lake_with(w, order=raw.where(F.col("_cdc_seq") == 1))

    def build(lake):
        return lambda keys: sales.order_360(lake, w.lookups, w.as_of, None, keys)

    everyone = raw.select("order_id")
    refresh.refresh_keys(build(early), everyone, path, "order_id", "order_created_at")
    changed = raw.where(F.col("_cdc_seq") > 1).select("order_id")
    refresh.refresh_keys(build(w.lake), changed, path, "order_id", "order_created_at")
    return _flat(refresh.read_mart(w.spark, path))


def _lake_with(w: Workspace, **replaced: DataFrame) -> cdc.Lake:
    return cdc.Lake(
        {e: replaced.get(e, w.lake.landing(e)) for e in CONTRACTS}, CONTRACTS
    )


@query("late_arrival")
def _late_arrival(w: Workspace) -> DataFrame:
    """First refresh: a third of the orders and half of the items have not landed.
    Second refresh, nothing else done: the mart is complete."""
    path = scratch(w.spark, "mart")
    number = F.col("order_id").cast("bigint")
    early = _lake_with(
        w,
        order=w.lake.landing("order").where(number % 3 != 0),
        order_item=w.lake.landing("order_item").where(number % 2 == 0),
    )
    for lake in (early, w.lake):
        refresh.refresh_window(
            lambda at, days, lake=lake: sales.revenue_by_bu_day(lake, w.lookups, at, days),
            path,
            w.as_of,
            w.days,
            "order_date",
        )
    return refresh.read_mart(w.spark, path)


@query("latest_by")
def _latest_by(w: Workspace) -> DataFrame:
    """Append mode: two refreshes of the baseline, the newer one is read."""
    first = discounts.discount_baseline_day(w.lake, w.as_of - timedelta(days=1), w.days)
    both = first.unionByName(w.mart("discount_baseline_day"))
    return windows.latest_by(both, ["order_date", "business_unit_code"], "_refreshed_at")


TOOK = {"stock_coverage": 8, "idle_catalog": 29}  # minutes; their intervals are 15 and 60


def _logged(w: Workspace, minutes: dict[str, int]) -> DataFrame:
    """Refreshes with their log, by a clock on which each takes its ``minutes``."""
    log, root = scratch(w.spark, "log"), scratch(w.spark, "mart")
    for name, took in minutes.items():
        refresh.run_logged(
            w.spark,
            log,
            name,
            w.as_of,
            lambda name=name: refresh.refresh_full(w.mart(name), f"{root}/{name}", "1"),
            clock=iter((0, took * 60)).__next__,
        )
    return w.spark.read.parquet(log)


@query("refresh_log")
def _refresh_log(w: Workspace) -> DataFrame:
    state = refresh.refresh_state(_logged(w, TOOK), w.as_of)
    return state.select("mart", "run_at", "status", "rows", "age_seconds", "healthy")


@query("second_access_path")
def _second_access_path(w: Workspace) -> DataFrame:
    """The order mart once more, sorted by customer for the lookup by customer."""
    path = scratch(w.spark, "by-customer")
    refresh.write_second_order(w.mart("order_360"), path, ["customer_id", "order_created_at"])
    return reports.customer_orders(w.spark.read.parquet(path))


@query("order_point_read")
def _order_point_read(w: Workspace) -> DataFrame:
    """One order out of a stored copy of the order mart: one file is opened."""
    path, mart = scratch(w.spark, "by-order"), w.mart("order_360")
    refresh.write_keyed(mart, path, "order_id", 16)
    row = refresh.read_keyed(w.spark, path, mart.schema, "order_id", "42")
    return _flat(reports.order_lookup(row, w.as_of, "42"))


# --- streams --------------------------------------------------------------


def _finish(*running) -> None:
    for one in running:
        one.awaitTermination()


@query("landing_stream")
def _landing_stream(w: Workspace) -> DataFrame:
    base = scratch(w.spark, "stream")
    landing.to_lines(w.lake.landing("order")).write.text(f"{base}/topic")
    lines = w.spark.readStream.text(f"{base}/topic")
    _finish(
        *jobs.stream_landing(
            lines, CONTRACTS["order"], f"{base}/landing", f"{base}/quarantine", f"{base}/checkpoint"
        )
    )
    return w.spark.read.parquet(f"{base}/landing").drop(MONTH)


def _order_stream(w: Workspace, base: str) -> DataFrame:
    w.lake.landing("order").write.parquet(f"{base}/landing")
    return jobs.landing_stream(w.spark, f"{base}/landing", CONTRACTS["order"])


@query("core_stream")
def _core_stream(w: Workspace) -> DataFrame:
    base, contract = scratch(w.spark, "stream"), CONTRACTS["order"]
    stream = _order_stream(w, base)
    _finish(jobs.stream_core(stream, contract, f"{base}/core", f"{base}/checkpoint"))
    return cdc.current_state(w.spark.read.parquet(f"{base}/core"), contract)


@query("core_upsert")
def _core_upsert(w: Workspace) -> DataFrame:
    """A filled table, then four batches of changes, one of them a second time."""
    base, contract = scratch(w.spark, "stream"), CONTRACTS["order"]
    raw = w.lake.landing("order")
    store = Store(w.spark, f"{base}/core", contract, 8)
    store.append(cdc.to_core(raw.where(F.col("_cdc_seq") == 1), contract), "load", 0, one_per_key=True)
    changes = raw.where(F.col("_cdc_seq") > 1)
    for part in (0, 1, 2, 1):
        changes.where(F.pmod(F.xxhash64("_offset"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(f"{base}/landing")
    source = w.spark.readStream.schema(contract.landing_schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/landing")
    _finish(jobs.stream_upsert(source, contract, f"{base}/core", f"{base}/checkpoint", 8))
    return Store(w.spark, f"{base}/core", contract).current()


@query("landing_stream_replay")
def _landing_stream_replay(w: Workspace) -> DataFrame:
    """Batches of the order topic: unreadable lines only, the later half, everything (so half of it
    again, and the other half late), unreadable lines, everything again."""
    base, contract = scratch(w.spark, "stream"), CONTRACTS["order"]
    rows = w.lake.landing("order")
    bad = w.spark.createDataFrame([("{ cut",)], "value string")
    later = F.col("_kafka_ts") >= F.lit("1998-06-01").cast("timestamp_ntz")
    whole = landing.to_lines(rows)
    for lines in (bad, landing.to_lines(rows.where(later)), whole, bad, whole):
        # many files, as packed ones are not split
        lines.write.mode("append").options(compression="gzip", maxRecordsPerFile=100_000).text(f"{base}/topic")
        stream = w.spark.readStream.text(f"{base}/topic")
        _finish(*jobs.stream_landing(
            stream, contract, f"{base}/landing", f"{base}/quarantine", f"{base}/checkpoint", skip_replays=True
        ))
    return jobs.read_landed(w.spark, f"{base}/landing", contract)


@query("stream_refresh")
def _stream_refresh(w: Workspace) -> DataFrame:
    """Orders land in three parts, the last one late for the interval of the mart. The run dies in
    the second part, when the mart has been written and not yet recorded, and is started again."""
    base, contract, died = scratch(w.spark, "stream"), CONTRACTS["order"], []
    rows, glance = w.lake.landing("order"), timedelta(seconds=20)

    def run(now) -> None:
        def work(keys: DataFrame) -> int:
            lake = _lake_with(w, order=w.spark.read.parquet(f"{base}/landing"))
            written = refresh.refresh_keys(
                lambda keys: sales.order_360(lake, w.lookups, w.as_of, None, keys),
                keys, f"{base}/mart", "order_id", "order_created_at",
            )
            if now == w.as_of + 3 * glance and not died:
                died.append(now)
                raise RuntimeError("lost in the middle")
            return written

        stream = jobs.landing_stream(w.spark, f"{base}/landing", contract)
        step = lambda: frontier.take(w.spark, f"{base}/touched", "order_360", now, work)
        _finish(jobs.stream_marts(stream, "order_id", f"{base}/touched", step, f"{base}/checkpoint"))

    for part, late in enumerate((0, 3, 4)):
        rows.where(F.pmod(F.xxhash64("_offset"), F.lit(3)) == part).write.mode("append").parquet(f"{base}/landing")
        now = w.as_of + late * glance
        try:
            run(now)
        except StreamingQueryException:
            if died != [now]:
                raise
            run(now)
    # a third of a minute after the second refresh the third part was not due; now it is
    lake = _lake_with(w, order=w.spark.read.parquet(f"{base}/landing"))
    frontier.take(
        w.spark, f"{base}/touched", "order_360", w.as_of + 6 * glance,
        lambda keys: refresh.refresh_keys(
            lambda keys: sales.order_360(lake, w.lookups, w.as_of, None, keys),
            keys, f"{base}/mart", "order_id", "order_created_at",
        ),
    )
    return _flat(refresh.read_mart(w.spark, f"{base}/mart"))


@query("events_per_window")
def _events_per_window(w: Workspace) -> DataFrame:
    base = scratch(w.spark, "stream")
    events = (
        w.spark.readStream.schema(w.tables.table("events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(w.tables.folder)
    )
    _finish(jobs.stream_windowed(events, f"{base}/totals", f"{base}/checkpoint"))
    return jobs.read_windowed(w.spark, f"{base}/totals")


# --- quality --------------------------------------------------------------

for _name, _fn in quality.PARITIES.items():
    query(f"parity_{_name}")(_fn)
query("parity_revenue_by_currency")(quality.parity_revenue_by_currency)

for _id, _check in quality.CHECKS.items():
    query("dq_" + _id.replace(".", "_"))(
        lambda w, _check=_check: quality.run_check(_check, w, w.as_of)
    )


@query("dq_landing_dlq_depth")
def _dlq_depth(w: Workspace) -> DataFrame:
    item = quality.Check(
        "landing.dlq_depth", "error", "lte", 0, lambda w: quality.rows(_split(w)[1])
    )
    return quality.run_check(item, w, w.as_of)


query("dq_marts_refresh")(lambda w: quality.refresh_checks(_logged(w, TOOK), w.as_of))

KEPT_CHECKS = (
    "marts.order_360.grain", "marts.order_360.amount_mismatch_rate", "marts.order_360.bu_orphan_rate",
    "customer.signup_after_first_order", "stock.negative_available",
)


@query("dq_history")
def _dq_history(w: Workspace) -> DataFrame:
    """Three daily runs of checks over stored marts and what the history says. For the second run
    the order mart holds every row twice; the third one is recorded twice."""
    root, path = scratch(w.spark, "marts"), scratch(w.spark, "checks")
    space = Workspace(w.lake, w.as_of, w.payments_as_of, w.days)
    space.store(root, "order_360", "customer_metrics")
    twice = Workspace(w.lake, w.as_of, w.payments_as_of, w.days)
    twice._marts = {**space._marts, "order_360": space.mart("order_360").unionAll(space.mart("order_360"))}
    for days, state in ((2, space), (1, twice), (0, space), (0, space)):
        run_at = w.as_of - timedelta(days=days)
        quality.record(quality.run_checks(state, run_at, KEPT_CHECKS), path, run_at)
    return quality.standing(quality.history(w.spark, path))
