"""Order 360 and revenue by business unit and day."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.contracts import CANCELED
from tidemark.functions import (
    AMOUNT,
    average_money,
    flag,
    midnight,
    money,
    money_if,
    normalize_code,
    stamp,
    sum_if,
)
from tidemark.operators.cdc import Lake, current_of
from tidemark.operators.joins import Lookup, Sieve, lookup_join, sieve, touched_keys

# What payments count as authorized and as captured.
AUTHORIZED = ("authorized", "captured", "refunded")
CAPTURED = ("captured", "refunded")

BU_360 = {
    "bu_name": ("bu_name", ""),
    "bu_channel": ("channel", ""),
    "bu_region": ("region", ""),
    "bu_active": ("active", False),
}
COUPON_360 = {
    "discount_campaign_name": ("campaign_name", ""),
    "discount_type": ("discount_type", ""),
    "discount_value": ("discount_value", 0),
}


def _of(lake: Lake, entity: str, keys: DataFrame | None, through: Sieve | None) -> DataFrame:
    """Current rows of an entity, of the orders in ``keys`` if given."""
    if keys is None:
        return lake.current(entity)
    return current_of(lake.core(entity), lake.contracts[entity], keys, through)


def items_by_order(items: DataFrame) -> DataFrame:
    return items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("items_count"),
        F.count_distinct("item_id").alias("items_distinct_item_ids"),
        F.sum("quantity").alias("items_quantity"),
        money(F.sum("gross_amount"), total=False).alias("items_gross_amount"),
        money(F.sum("discount_amount"), total=False).alias("items_discount_amount"),
        money(F.sum("total_amount"), total=False).alias("items_total_amount"),
        # centres are a small closed domain: a set of them stays small, and one
        # distinct count less keeps the rows from being expanded
        F.size(F.collect_set("dc_id")).cast("bigint").alias("items_dc_count"),
        F.min_by("item_id", "item_seq").alias("items_first_item_id"),
        F.max("updated_at").alias("_items_touched"),
    )


def payments_by_order(payments: DataFrame) -> DataFrame:
    status = F.col("payment_status")

    def amount(states) -> F.Column:
        return money(sum_if(status.isin(*states), "amount"), total=False)

    return payments.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("payments_count"),
        F.count_if(status.isin(*CAPTURED)).alias("payments_captured_count"),
        F.count_if(status == "denied").alias("payments_denied_count"),
        F.count_if(status == "pending").alias("payments_pending_count"),
        # the method is a small closed domain, so the set stays small
        F.array_sort(F.collect_set("payment_method")).alias("payment_methods"),
        amount(AUTHORIZED).alias("authorized_amount"),
        amount(CAPTURED).alias("captured_amount"),
        amount(("refunded",)).alias("refunded_amount"),
        F.min("authorized_at").alias("first_authorized_at"),
        F.max("captured_at").alias("last_captured_at"),
        F.max("updated_at").alias("_payments_touched"),
    )


def order_360(
    lake: Lake,
    lookups: dict[str, Lookup],
    as_of: datetime,
    window_days: int | None = 3,
    keys: DataFrame | None = None,
) -> DataFrame:
    """One row per order with its items, payments, customer, unit and coupon.

    ``window_days`` keeps orders of which the order itself, an item or a payment
    was updated in the window; ``None`` builds all orders. The key set is first
    taken from any recent version (a plain filtered scan) and made exact at the
    end, on the current rows. ``keys`` names the orders instead; they may be many, and
    are read several times, so they should be stored.
    """
    through = None if keys is None else sieve(keys)
    cut = None if window_days is None else as_of - timedelta(days=window_days)
    if keys is None and cut is not None:
        sources = [lake.core(e) for e in ("order", "order_item", "order_payment")]
        keys = touched_keys(sources, "order_id", cut)

    orders = _of(lake, "order", keys, through).drop("_ingested_at")
    items = items_by_order(_of(lake, "order_item", keys, through))
    payments = payments_by_order(_of(lake, "order_payment", keys, through))
    customers = lake.current("customer").select(
        "customer_id",
        F.col("first_name").alias("customer_first_name"),
        F.col("segment").alias("customer_segment"),
        F.col("loyalty_tier").alias("customer_loyalty_tier"),
        F.col("city").alias("customer_city"),
        F.col("state").alias("customer_state"),
        F.col("customer_since").alias("customer_since"),
        F.lit(1).alias("customer_found"),
    )
    zero = F.lit(0).cast(AMOUNT)
    joined = (
        orders.withColumn("discount_code", F.coalesce(normalize_code("discount_code"), F.lit("")))
        .join(items, "order_id", "left")
        .join(payments, "order_id", "left")
        .join(customers, "customer_id", "left")
    )
    if cut is not None:
        last = F.greatest("updated_at", "_items_touched", "_payments_touched")
        joined = joined.where(last >= stamp(cut))
    counts = [c for c in joined.columns if c.endswith(("_count", "_ids")) or c == "items_quantity"]
    amounts = [
        "items_gross_amount",
        "items_discount_amount",
        "items_total_amount",
        "authorized_amount",
        "captured_amount",
        "refunded_amount",
    ]
    texts = [
        "items_first_item_id",
        "customer_first_name",
        "customer_segment",
        "customer_loyalty_tier",
        "customer_city",
        "customer_state",
    ]
    filled = joined.withColumns(
        {
            **{c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in counts},
            **{c: F.coalesce(F.col(c), zero) for c in amounts},
            **{c: F.coalesce(F.col(c), F.lit("")) for c in texts},
            "customer_found": F.coalesce(F.col("customer_found"), F.lit(0)),
            "payment_methods": F.coalesce(
                F.col("payment_methods"), F.array().cast("array<string>")
            ),
        }
    )
    known = lookup_join(filled, lookups["business_unit"], "business_unit_code", BU_360, "bu_found")
    known = lookup_join(
        known, lookups["discount_codes"], "discount_code", COUPON_360, "discount_code_found"
    )
    paid = F.col("captured_amount") - F.col("refunded_amount")
    return known.select(
        "order_id",
        "customer_id",
        "business_unit_code",
        "order_status",
        "channel",
        "currency",
        "discount_code",
        "gross_amount",
        "discount_amount",
        "freight_amount",
        "total_amount",
        F.col("created_at").alias("order_created_at"),
        F.col("updated_at").alias("order_updated_at"),
        "items_count",
        "items_distinct_item_ids",
        "items_quantity",
        "items_gross_amount",
        "items_discount_amount",
        "items_total_amount",
        "items_dc_count",
        "items_first_item_id",
        flag(F.col("items_count") > 0).alias("has_items"),
        "payments_count",
        "payments_captured_count",
        "payments_denied_count",
        "payments_pending_count",
        "payment_methods",
        "authorized_amount",
        "captured_amount",
        "refunded_amount",
        "first_authorized_at",
        "last_captured_at",
        flag(paid >= F.col("total_amount")).alias("is_fully_paid"),
        money(F.col("total_amount") - paid, total=False).alias("payment_gap_amount"),
        "customer_found",
        "customer_first_name",
        "customer_segment",
        "customer_loyalty_tier",
        "customer_city",
        "customer_state",
        "customer_since",
        "bu_found",
        "bu_name",
        "bu_channel",
        "bu_region",
        flag(F.col("bu_active")).alias("bu_active"),
        "discount_code_found",
        "discount_campaign_name",
        "discount_type",
        "discount_value",
        money(
            F.col("total_amount") - (F.col("items_total_amount") + F.col("freight_amount")),
            total=False,
        ).alias("amount_mismatch_amount"),
        flag((F.col("bu_found") == 1) & (F.col("channel") != F.col("bu_channel"))).alias(
            "channel_mismatch"
        ),
        F.lit(int((as_of - datetime(1970, 1, 1)).total_seconds() * 1000)).cast("bigint").alias(
            "_mart_version"
        ),
        stamp(as_of).alias("_refreshed_at"),
    )


def revenue_by_bu_day(
    lake: Lake, lookups: dict[str, Lookup], as_of: datetime, window_days: int = 3
) -> DataFrame:
    """Day x business unit x channel x currency. Canceled orders are counted but
    earn nothing; a unit without registration keeps its rows."""
    since = midnight(as_of, window_days)
    items = (
        lake.current("order_item", since)
        .groupBy("order_id")
        .agg(F.sum("quantity").alias("units"), F.count(F.lit(1)).alias("items"))
    )
    orders = lake.current("order", since)
    valid = F.col("order_status") != CANCELED
    grain = ("order_date", "business_unit_code", "order_channel", "currency")
    # an order is one row here, so plain counts are distinct counts
    totals = (
        orders.join(items, "order_id", "left")
        .select(
            F.to_date("created_at").alias("order_date"),
            "business_unit_code",
            F.col("channel").alias("order_channel"),
            "currency",
            "customer_id",
            "order_status",
            "gross_amount",
            "discount_amount",
            "freight_amount",
            "total_amount",
            F.coalesce("units", F.lit(0)).alias("units"),
            F.coalesce("items", F.lit(0)).alias("items"),
        )
        .groupBy(*grain)
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.count_if(~valid).alias("orders_canceled"),
            F.sum("units").alias("units_sold"),
            F.sum("items").alias("items_count"),
            F.count_distinct("customer_id").alias("distinct_customers"),
            money_if(valid, "gross_amount").alias("gross_revenue"),
            money_if(valid, "discount_amount").alias("discount_total"),
            money_if(valid, "freight_amount").alias("freight_total"),
            money_if(valid, "total_amount").alias("net_revenue"),
        )
    )
    # the registry is joined to the few aggregated rows, not to every order
    named = lookup_join(
        totals,
        lookups["business_unit"],
        "business_unit_code",
        {
            "bu_name": ("bu_name", "(sem cadastro)"),
            "bu_channel": ("channel", "unknown"),
            "bu_region": ("region", "unknown"),
        },
        "_bu_found",
    )
    return named.select(
        "order_date",
        "business_unit_code",
        "bu_name",
        "bu_channel",
        "bu_region",
        "order_channel",
        "currency",
        "orders",
        "orders_canceled",
        "units_sold",
        "items_count",
        "distinct_customers",
        "gross_revenue",
        "discount_total",
        "freight_total",
        "net_revenue",
        average_money("net_revenue", F.col("orders") - F.col("orders_canceled")).alias("avg_ticket"),
        "_bu_found",
        stamp(as_of).alias("_refreshed_at"),
    )
