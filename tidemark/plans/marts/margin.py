"""Real margin per item and day against the price list valid at the sale."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.contracts import CANCELED
from tidemark.functions import (
    TOTAL,
    days_between,
    midnight,
    money_if,
    stamp,
    sum_if,
)
from tidemark.operators.cdc import Lake
from tidemark.operators.joins import asof_left

NO_PRICE = "(sem preco)"


def sold_items(lake: Lake, as_of: datetime, window_days: int) -> DataFrame:
    """Current items of the window with unit, currency and status of their order."""
    since = midnight(as_of, window_days)
    items = lake.current("order_item", since)
    head = lake.parents("order_item", "order_id", "order", since, True).select(
        "order_id", "business_unit_code", "currency", "order_status"
    )
    return items.select(
        "order_id", "item_seq", "item_id", "quantity", "unit_price", "total_amount", "created_at"
    ).join(head.hint("merge"), "order_id")  # as many orders as the window has, never broadcast


def priced_items(lake: Lake, as_of: datetime, window_days: int) -> DataFrame:
    """Every sold item with the price version valid at its sale, if there is one."""
    return asof_left(
        sold_items(lake, as_of, window_days),
        lake.current("prices"),
        keys=("item_id", "currency"),
        left_ts="created_at",
        right_ts="valid_from",
        cols=("price_list_id", "list_price", "cost_price", "valid_from"),
        tie=("price_list_id",),
        span=(midnight(as_of, window_days), as_of),
    ).withColumnRenamed("valid_from", "price_valid_from")


def item_margin_daily(lake: Lake, as_of: datetime, window_days: int = 7) -> DataFrame:
    """Day x item x unit x price list x currency. Items without a price count as
    revenue and as units without price, never as margin."""
    priced = priced_items(lake, as_of, window_days)
    has_price = F.col("price_valid_from").isNotNull()
    valid = F.col("order_status") != CANCELED
    counted = valid & has_price
    quantity = F.col("quantity").cast("decimal(10,0)")
    totals = (
        priced.groupBy(
            F.to_date("created_at").alias("order_date"),
            "item_id",
            "business_unit_code",
            F.coalesce("price_list_id", F.lit(NO_PRICE)).alias("price_list_id"),
            "currency",
        )
        .agg(
            F.count_distinct("order_id").alias("orders"),
            sum_if(valid, "quantity").alias("units_sold"),
            money_if(valid, "total_amount").alias("revenue_practiced"),
            money_if(counted, "total_amount").alias("_revenue_priced"),
            money_if(counted, quantity * F.col("list_price")).alias("revenue_at_list"),
            money_if(counted, quantity * F.col("cost_price")).alias("cost_total"),
            sum_if(valid & ~has_price, "quantity").alias("units_without_price"),
            sum_if(counted & (F.col("unit_price") < F.col("cost_price")), "quantity").alias(
                "units_below_cost"
            ),
            sum_if(counted & (F.col("unit_price") > F.col("list_price")), "quantity").alias(
                "units_above_list"
            ),
            F.min("price_valid_from").alias("price_valid_from_min"),
            F.max("price_valid_from").alias("price_valid_from_max"),
            F.max(days_between("price_valid_from", "created_at")).alias("price_staleness_max_d"),
        )
    )

    def one_minus(num: str, den: str):
        share = F.col(num).cast("double") / F.col(den).cast("double")
        return F.when(F.col(den) == 0, F.lit(0.0)).otherwise(F.lit(1.0) - share)

    return totals.select(
        "order_date",
        "item_id",
        "business_unit_code",
        "price_list_id",
        "currency",
        "orders",
        "units_sold",
        "revenue_practiced",
        "revenue_at_list",
        "cost_total",
        (F.col("revenue_at_list") - F.col("_revenue_priced")).cast(TOTAL).alias("discount_vs_list"),
        one_minus("_revenue_priced", "revenue_at_list").alias("discount_vs_list_pct"),
        (F.col("_revenue_priced") - F.col("cost_total")).cast(TOTAL).alias("margin_amount"),
        one_minus("cost_total", "_revenue_priced").alias("margin_pct"),
        "units_without_price",
        "units_below_cost",
        "units_above_list",
        "price_valid_from_min",
        "price_valid_from_max",
        "price_staleness_max_d",
        stamp(as_of).alias("_refreshed_at"),
    )
