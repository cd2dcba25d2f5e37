"""Coupon effectiveness and the baseline without coupons."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.contracts import CANCELED
from tidemark.functions import (
    average_money,
    is_blank,
    midnight,
    money_if,
    normalize_code,
    ratio,
    stamp,
)
from tidemark.operators.cdc import Lake
from tidemark.operators.joins import Lookup, lookup_join

REGISTRY = {
    "campaign_name": ("campaign_name", "(sem cadastro)"),
    "discount_type": ("discount_type", "unknown"),
    "discount_value": ("discount_value", 0),
    "valid_from": ("valid_from", None),
    "valid_to": ("valid_to", None),
    "max_uses": ("max_uses", 0),
    "bu_scope": ("business_unit_scope", ""),
}


def discount_effectiveness(
    lake: Lake, lookups: dict[str, Lookup], as_of: datetime, window_days: int = 90
) -> DataFrame:
    """Coupon x day x business unit: registration, misuse, sales, realized rate."""
    since = midnight(as_of, window_days)
    units = (
        lake.current("order_item", since)
        .groupBy("order_id")
        .agg(F.sum("quantity").alias("units"))
    )
    coded = (
        lake.current("order", since)
        .where(~is_blank("discount_code"))
        .select(
            "order_id",
            "created_at",
            F.to_date("created_at").alias("order_date"),
            "business_unit_code",
            "order_status",
            "gross_amount",
            "discount_amount",
            "total_amount",
            F.col("discount_code").alias("discount_code_raw"),
            normalize_code("discount_code").alias("discount_code_norm"),
        )
    )
    # what is judged per order needs three attributes of the code ...
    judged = lookup_join(
        coded,
        lookups["discount_codes"],
        "discount_code_norm",
        {
            "begins": ("valid_from", None),
            "ends": ("valid_to", None),
            "scope": ("business_unit_scope", ""),
        },
        "known",
    )
    found = F.col("known") == 1
    outside_validity = found & (
        (F.col("created_at") < F.col("begins")) | (F.col("created_at") > F.col("ends"))
    )
    # an empty scope means every unit
    outside_scope = (
        found & (F.col("scope") != "") & (F.col("scope") != F.col("business_unit_code"))
    )
    valid = F.col("order_status") != CANCELED
    grain = ("order_date", "discount_code_norm", "business_unit_code")
    sums = (
        judged.join(units, "order_id", "left")
        .groupBy(*grain)
        .agg(
            F.min("discount_code_raw").alias("discount_code_raw"),
            F.count_if(outside_validity).alias("used_outside_validity"),
            F.count_if(outside_scope).alias("used_outside_bu_scope"),
            F.count(F.lit(1)).alias("orders"),
            F.count_if(~valid).alias("orders_canceled"),
            F.coalesce(F.sum("units"), F.lit(0)).alias("units_sold"),
            money_if(valid, "gross_amount").alias("gross_amount"),
            money_if(valid, "discount_amount").alias("discount_amount"),
            money_if(valid, "total_amount").alias("net_amount"),
        )
    )
    # ... the descriptive ones are added to the few aggregated rows
    totals = lookup_join(
        sums, lookups["discount_codes"], "discount_code_norm", REGISTRY, "code_found"
    )
    return totals.select(
        "order_date",
        "discount_code_norm",
        "discount_code_raw",
        "business_unit_code",
        "code_found",
        *REGISTRY,
        "used_outside_validity",
        "used_outside_bu_scope",
        "orders",
        "orders_canceled",
        "units_sold",
        "gross_amount",
        "discount_amount",
        "net_amount",
        average_money("net_amount", F.col("orders") - F.col("orders_canceled")).alias("avg_ticket"),
        ratio("discount_amount", "gross_amount").alias("discount_pct_effective"),
        stamp(as_of).alias("_refreshed_at"),
    )


def discount_baseline_day(lake: Lake, as_of: datetime, window_days: int = 90) -> DataFrame:
    """Day x business unit: valid orders and ticket with and without a coupon."""
    orders = lake.current("order", midnight(as_of, window_days))
    valid = F.col("order_status") != CANCELED
    coupon = ~is_blank("discount_code")
    totals = orders.groupBy(
        F.to_date("created_at").alias("order_date"), "business_unit_code"
    ).agg(
        F.count_if(valid & ~coupon).alias("orders_no_coupon"),
        money_if(valid & ~coupon, "total_amount").alias("net_no_coupon"),
        F.count_if(valid & coupon).alias("orders_with_coupon"),
        money_if(valid & coupon, "total_amount").alias("net_with_coupon"),
    )
    return totals.select(
        "order_date",
        "business_unit_code",
        "orders_no_coupon",
        "net_no_coupon",
        average_money("net_no_coupon", "orders_no_coupon").alias("avg_ticket_no_coupon"),
        "orders_with_coupon",
        "net_with_coupon",
        average_money("net_with_coupon", "orders_with_coupon").alias("avg_ticket_with_coupon"),
        stamp(as_of).alias("_refreshed_at"),
    )
