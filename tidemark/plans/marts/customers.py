"""Customer metrics and monthly cohorts, over all history."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.contracts import CANCELED
from tidemark.functions import (
    TOTAL,
    average_money,
    days_between,
    flag,
    is_blank,
    money_if,
    month_of,
    months_between_calendar,
    ratio,
    stamp,
)
from tidemark.operators.cdc import Lake, current_under


def _orders_by_customer(orders: DataFrame) -> DataFrame:
    """Orders are first folded by (customer, channel, unit): a few rows even for a
    customer with very many orders. Distinct counts and the preferred channel are
    then taken from the folded rows."""
    valid = F.col("order_status") != CANCELED
    folded = orders.groupBy("customer_id", "channel", "business_unit_code").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~valid).alias("n_canceled"),
        F.count_if(valid).alias("n_valid"),
        F.count_if(~is_blank("discount_code")).alias("n_coupon"),
        money_if(valid, "gross_amount").alias("gross"),
        money_if(valid, "discount_amount").alias("discount"),
        money_if(valid, "total_amount").alias("net"),
        F.max(F.when(valid, F.col("total_amount"))).alias("top"),
        F.min(F.when(valid, F.col("created_at"))).alias("first"),
        F.max(F.when(valid, F.col("created_at"))).alias("last"),
    )
    in_channel = Window.partitionBy("customer_id", "channel")
    return (
        folded.withColumn("n_channel", F.sum("n").over(in_channel))
        .groupBy("customer_id")
        .agg(
            F.sum("n").alias("total_orders"),
            F.sum("n_canceled").alias("orders_canceled"),
            F.sum("n_valid").alias("orders_valid"),
            F.sum("n_coupon").alias("orders_with_coupon"),
            F.sum("gross").cast(TOTAL).alias("lifetime_gross"),
            F.sum("discount").cast(TOTAL).alias("lifetime_discount"),
            F.sum("net").cast(TOTAL).alias("lifetime_net"),
            F.max("top").cast(TOTAL).alias("max_ticket"),
            F.min("first").alias("first_order_at"),
            F.max("last").alias("last_order_at"),
            F.count_distinct("business_unit_code").alias("distinct_business_units"),
            F.count_distinct("channel").alias("distinct_channels"),
            F.min_by("channel", F.struct(-F.col("n_channel"), F.col("channel"))).alias(
                "preferred_channel"
            ),
        )
    )


def customer_metrics(lake: Lake, as_of: datetime) -> DataFrame:
    """One row per registered customer, buyers or not. ``distinct_items`` is the
    true distinct count; the sum of per-order counts is ``items_lines_distinct``."""
    orders = lake.current("order")
    bought = current_under(
        lake.core("order_item"),
        lake.contracts["order_item"],
        orders.select("order_id", "customer_id"),
        "order_id",
    )
    # folded step by step, so that both distinct counts are plain counts of rows
    per_order = bought.groupBy("customer_id", "item_id", "order_id").agg(
        F.sum("quantity").alias("units")
    )
    per_item = per_order.groupBy("customer_id", "item_id").agg(
        F.sum("units").alias("units"), F.count(F.lit(1)).alias("orders")
    )
    items = per_item.groupBy("customer_id").agg(
        F.sum("units").alias("total_units"),
        F.count(F.lit(1)).alias("distinct_items"),
        F.sum("orders").alias("items_lines_distinct"),
    )
    customers = lake.current("customer").select(
        "customer_id", "segment", "loyalty_tier", "state", "city", "customer_since"
    )
    counts = (
        "total_orders",
        "orders_canceled",
        "orders_valid",
        "orders_with_coupon",
        "total_units",
        "distinct_items",
        "items_lines_distinct",
        "distinct_business_units",
        "distinct_channels",
    )
    amounts = ("lifetime_gross", "lifetime_discount", "lifetime_net", "max_ticket")
    base = (
        customers.join(_orders_by_customer(orders), "customer_id", "left")
        .join(items, "customer_id", "left")
        .withColumns(
            {
                **{c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in counts},
                **{c: F.coalesce(F.col(c), F.lit(0).cast(TOTAL)) for c in amounts},
                "preferred_channel": F.coalesce("preferred_channel", F.lit("")),
            }
        )
    )
    n = F.col("orders_valid")
    gap = days_between("first_order_at", "last_order_at").cast("double")
    return base.select(
        "customer_id",
        "segment",
        "loyalty_tier",
        "state",
        "city",
        "customer_since",
        month_of("customer_since").alias("cohort_month"),
        "total_orders",
        "orders_canceled",
        "total_units",
        "distinct_items",
        "items_lines_distinct",
        "lifetime_gross",
        "lifetime_discount",
        "lifetime_net",
        average_money("lifetime_net", n).alias("avg_ticket"),
        "max_ticket",
        "first_order_at",
        "last_order_at",
        days_between("last_order_at", stamp(as_of)).alias("recency_days"),
        days_between("customer_since", "first_order_at").alias("days_to_first_order"),
        F.when(n >= 2, gap / F.nullif(n - 1, F.lit(0)).cast("double")).alias(
            "avg_days_between_orders"
        ),
        "distinct_business_units",
        "distinct_channels",
        "orders_with_coupon",
        "preferred_channel",
        flag(F.col("last_order_at") >= stamp(as_of - timedelta(days=90))).alias("is_active_90d"),
        flag(n == 1).alias("is_one_time_buyer"),
        flag(n == 0).alias("never_purchased"),
        stamp(as_of).alias("_refreshed_at"),
    )


def customer_cohort(lake: Lake, as_of: datetime) -> DataFrame:
    """Sign-up month x month of activity x segment; retention on the whole cohort."""
    customers = lake.current("customer").select(
        "customer_id", "segment", month_of("customer_since").alias("cohort_month")
    )
    sizes = customers.groupBy("cohort_month", "segment").agg(
        F.count(F.lit(1)).alias("cohort_size")
    )
    orders = (
        lake.current("order")
        .where(F.col("order_status") != CANCELED)
        .select("customer_id", month_of("created_at").alias("activity_month"), "total_amount")
        .groupBy("customer_id", "activity_month")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("total_amount").alias("net"))
    )
    # one row per customer and month, so active customers are a plain count
    activity = (
        orders.join(customers.hint("merge"), "customer_id")  # all customers: too many to broadcast
        .groupBy("cohort_month", "segment", "activity_month")
        .agg(
            F.count(F.lit(1)).alias("active_customers"),
            F.sum("n").alias("orders"),
            F.sum("net").cast(TOTAL).alias("net_revenue"),
        )
    )
    return activity.join(sizes, ["cohort_month", "segment"]).select(
        "cohort_month",
        "activity_month",
        months_between_calendar("cohort_month", "activity_month").alias("months_since_signup"),
        "segment",
        "cohort_size",
        "active_customers",
        ratio("active_customers", "cohort_size").alias("retention_rate"),
        "orders",
        "net_revenue",
        average_money("net_revenue", "active_customers").alias("revenue_per_customer"),
        stamp(as_of).alias("_refreshed_at"),
    )
