"""Stock coverage, stock-out candidates and the idle catalogue."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.contracts import BILLABLE, CANCELED
from tidemark.functions import (
    AMOUNT,
    TOTAL,
    age_seconds,
    days_between,
    flag,
    is_blank,
    money,
    quotient,
    stamp,
    sum_if,
)
from tidemark.operators.aggregates import allocation_share
from tidemark.operators.cdc import Lake, current_under
from tidemark.operators.joins import full_peer_join, price_at

# Late-arrival grace and how far behind the stock topic may be.
GRACE_SECONDS = 72 * 3600
TOPIC_LAG_TOLERANCE_SECONDS = 3600
NO_STOCK, NO_PRICE = "(sem estoque)", "(sem preco)"


def sales(lake: Lake, wanted: Column, since: datetime | None = None) -> DataFrame:
    """Current items of the orders that satisfy ``wanted`` (and are created from
    ``since`` on), with the order's creation time. A blank centre becomes ''."""
    orders = lake.current("order", since).where(wanted)
    head = orders.select("order_id", F.col("created_at").alias("sold_at"))
    items = current_under(lake.core("order_item"), lake.contracts["order_item"], head, "order_id")
    return items.select(
        "order_id",
        "item_id",
        F.when(is_blank("dc_id"), "").otherwise(F.col("dc_id")).alias("dc_id"),
        "quantity",
        "total_amount",
        "created_at",
        "sold_at",
    )


def billable_sales(lake: Lake, as_of: datetime, days: int) -> DataFrame:
    return sales(lake, F.col("order_status").isin(*BILLABLE), as_of - timedelta(days=days))


def stock_coverage(lake: Lake, as_of: datetime, window_days: int = 28) -> DataFrame:
    """One row per stock position with demand, share of the demand without a
    centre, days of coverage and a class."""
    start, start_7d = as_of - timedelta(days=window_days), as_of - timedelta(days=7)
    demand = (
        billable_sales(lake, as_of, window_days)
        .groupBy("item_id", "dc_id")
        .agg(
            F.sum("quantity").alias("q"),
            sum_if(F.col("sold_at") >= stamp(start_7d), "quantity").alias("q7"),
        )
    )
    # Stock and demand meet on (item, centre), the key both are already partitioned
    # by. What concerns the whole item is then a window over its few centres.
    nowhere = F.col("dc_id") == ""
    of_item = Window.partitionBy("item_id")

    def of_item_sum(col: Column) -> Column:
        return F.coalesce(F.sum(col).over(of_item), F.lit(0))

    base = (
        lake.current("stock_position")
        .withColumn("stocked", F.lit(1))
        .join(demand, ["item_id", "dc_id"], "full")
        .withColumns(
            {
                "share": allocation_share("available", ["item_id"]),
                "dc_count_for_item": F.count("stocked").over(of_item),
                "demand_qty_unassigned_28d": of_item_sum(F.when(nowhere, F.col("q"))),
                "attributed": of_item_sum(F.when(~nowhere, F.col("q"))),
                "demand_qty_28d": F.coalesce("q", F.lit(0)),
                "demand_qty_7d": F.coalesce("q7", F.lit(0)),
            }
        )
        .where(F.col("stocked") == 1)
    )
    q, lost = F.col("demand_qty_28d"), F.col("demand_qty_unassigned_28d")
    item_total = F.col("attributed") + lost
    allocated = (q.cast(AMOUNT) + lost.cast(AMOUNT) * F.col("share")).cast(AMOUNT)
    step1 = base.withColumns(
        {
            "demand_qty_allocated_28d": allocated,
            "unassigned_ratio": F.when(item_total > 0, quotient(lost, item_total, 4))
            .otherwise(0)
            .cast(AMOUNT),
            "avg_daily_demand_28d": quotient(q, F.lit(window_days), 4).cast(AMOUNT),
        }
    ).withColumn(
        "avg_daily_demand_alloc_28d",
        quotient("demand_qty_allocated_28d", F.lit(window_days), 4).cast(AMOUNT),
    )
    daily, daily_alloc = F.col("avg_daily_demand_28d"), F.col("avg_daily_demand_alloc_28d")
    usable = F.greatest(F.col("available"), F.lit(0))
    step2 = step1.withColumns(
        {
            "coverage_days": F.when(daily > 0, quotient(usable, daily, 2)).cast(AMOUNT),
            "coverage_days_allocated": F.when(
                daily_alloc > 0, quotient(usable, daily_alloc, 2)
            ).cast(AMOUNT),
            "days_to_safety_stock": F.when(
                daily_alloc > 0,
                quotient(F.col("available") - F.col("safety_stock"), daily_alloc, 2),
            ).cast(AMOUNT),
        }
    )
    days = F.col("coverage_days_allocated")
    coverage_class = (
        F.when(F.col("available") <= 0, "stockout")
        .when(daily_alloc == 0, "no_demand")
        .when(days < 7, "critical")
        .when(days < 21, "low")
        .when(days < 90, "healthy")
        .otherwise("excess")
    )
    return step2.select(
        "dc_id",
        "item_id",
        "dc_name",
        "on_hand",
        "reserved",
        "available",
        "safety_stock",
        "position_at",
        F.greatest(age_seconds("position_at", as_of), F.lit(0)).alias("position_age_seconds"),
        "demand_qty_28d",
        "demand_qty_7d",
        "demand_qty_unassigned_28d",
        "dc_count_for_item",
        "demand_qty_allocated_28d",
        "unassigned_ratio",
        "avg_daily_demand_28d",
        "avg_daily_demand_alloc_28d",
        "coverage_days",
        "coverage_days_allocated",
        "days_to_safety_stock",
        flag(F.col("available") < F.col("safety_stock")).alias("below_safety_stock"),
        coverage_class.alias("coverage_class"),
        stamp(start).alias("demand_basis_from"),
        stamp(as_of).alias("demand_basis_to"),
        stamp(as_of).alias("refreshed_at"),
    )


def topic_lag(landing: DataFrame, as_of: datetime) -> DataFrame:
    """One row: seconds since the last message of a topic, never negative."""
    return landing.agg(
        F.greatest(age_seconds(F.max("_kafka_ts"), as_of), F.lit(0)).alias("lag_seconds")
    )


def stockout_candidates(lake: Lake, as_of: datetime, window_days: int = 28) -> DataFrame:
    """Items sold without usable stock, in three exclusive classes.

    Absence (no record at all, no record at that centre) counts only after the
    grace time and not while the stock topic itself is behind; a record that says
    zero counts at once.
    """
    start_7d = stamp(as_of - timedelta(days=7))
    per_order = (
        billable_sales(lake, as_of, window_days)
        .groupBy("item_id", "dc_id", "order_id")
        .agg(
            F.min("sold_at").alias("first"),
            F.max("sold_at").alias("last"),
            sum_if(F.col("sold_at") >= start_7d, "quantity").alias("q7"),
            F.sum("quantity").alias("q"),
            F.sum("total_amount").alias("revenue"),
        )
    )
    # an order counts once per item, at whichever centre it comes first
    once = Window.partitionBy("item_id", "order_id").orderBy("dc_id")
    sold = (
        per_order.withColumn("new", flag(F.row_number().over(once) == 1))
        .groupBy("item_id", "dc_id")
        .agg(
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            F.count(F.lit(1)).alias("orders"),
            F.sum("new").alias("item_orders"),
            F.sum("q7").alias("q7"),
            F.sum("q").alias("q"),
            F.sum("revenue").cast(TOTAL).alias("revenue"),
        )
    )
    stock = (
        lake.current("stock_position")
        .select("item_id", "dc_id", "available", "safety_stock", "position_at")
        .withColumn("stocked", F.lit(1))
    )
    # Sales and stock meet on (item, centre), the key both are already partitioned
    # by; an item's other centres are then seen by a window over its few rows.
    of_item = Window.partitionBy("item_id")
    whole = {
        "first": F.min("first").over(of_item),
        "last": F.max("last").over(of_item),
        "orders": F.sum("item_orders").over(of_item),
        "q7": F.sum("q7").over(of_item),
        "q": F.sum("q").over(of_item),
        "revenue": F.sum("revenue").over(of_item).cast(TOTAL),
    }
    base = sold.join(stock, ["item_id", "dc_id"], "full").withColumns(
        {
            **{f"item_{c}": value for c, value in whole.items()},
            "centres": F.count("stocked").over(of_item),
            "one_centre": F.min("dc_id").over(of_item),
        }
    )
    here = F.col("stocked") == 1
    stockout_class = (
        F.when(
            (F.col("centres") == 0) & (F.col("dc_id") == F.col("one_centre")),
            "missing_stock_record",
        )
        .when(
            here & (F.col("available") <= 0) & (F.col("item_last") >= start_7d), "zero_available"
        )
        .when(
            (F.col("centres") > 0) & F.col("stocked").isNull() & (F.col("dc_id") != ""),
            "missing_dc_position",
        )
    )
    found = base.withColumn("stockout_class", stockout_class).where(
        F.col("stockout_class").isNotNull()
    )
    is_zero = F.col("stockout_class") == "zero_available"
    at_centre = F.col("stockout_class") == "missing_dc_position"
    no_record = F.col("stockout_class") == "missing_stock_record"

    def measure(name: str) -> Column:
        return F.when(at_centre, F.col(name)).otherwise(F.col(f"item_{name}"))

    measured = found.withColumns(
        {
            "dc_id": F.when(no_record, "").otherwise(F.col("dc_id")),
            "dc_known": flag(~no_record),
            "first_sale_at": measure("first"),
            "last_sale_at": measure("last"),
            "orders_affected": measure("orders"),
            "units_sold_7d": measure("q7"),
            "units_sold_28d": measure("q"),
            "revenue": measure("revenue"),
        }
    )
    # at zero stock: a week of sales at the mean price paid; else what was sold
    price = quotient("revenue", F.greatest(F.col("units_sold_28d"), F.lit(1)), 4)
    prospective = F.when(F.col("units_sold_7d") <= 0, F.lit(0).cast(AMOUNT)).otherwise(
        price.cast(AMOUNT) * F.col("units_sold_7d").cast("decimal(18,0)")
    )
    lag = topic_lag(lake.landing("stock_position"), as_of).scalar()
    aged = measured.withColumns(
        {
            "revenue_at_risk": F.when(is_zero, prospective.cast(AMOUNT)).otherwise(
                money("revenue", total=False)
            ),
            "grace_window_seconds": F.when(is_zero, 0).otherwise(GRACE_SECONDS),
            "evidence_age_seconds": F.greatest(age_seconds("first_sale_at", as_of), F.lit(0)),
            "last_sale_age_seconds": F.greatest(age_seconds("last_sale_at", as_of), F.lit(0)),
            "inventory_lag_seconds": lag,
        }
    ).withColumn(
        "evidence_status",
        F.when(is_zero, "confirmed")
        .when(F.col("inventory_lag_seconds") > TOPIC_LAG_TOLERANCE_SECONDS, "suppressed_topic_lag")
        .when(F.col("evidence_age_seconds") < GRACE_SECONDS, "pending_grace")
        .otherwise("confirmed"),
    )
    recent = F.col("units_sold_7d") > 0
    severity = (
        F.when(F.col("evidence_status") != "confirmed", "low")
        .when(at_centre, F.when(recent, "medium").otherwise("low"))
        .when(recent, "high")
        .otherwise("medium")
    )
    return aged.select(
        "stockout_class",
        "item_id",
        "dc_id",
        "dc_known",
        "first_sale_at",
        "last_sale_at",
        "evidence_age_seconds",
        "last_sale_age_seconds",
        "orders_affected",
        "units_sold_7d",
        "units_sold_28d",
        "revenue_at_risk",
        "available",
        "safety_stock",
        "position_at",
        "inventory_lag_seconds",
        "grace_window_seconds",
        "evidence_status",
        severity.alias("severity"),
        stamp(as_of).alias("refreshed_at"),
    )


def idle_catalog(lake: Lake, as_of: datetime, window_days: int = 90) -> DataFrame:
    """Item x centre: price, stock and sales, and why the item stands still.

    Units are those of the window; the last sale is looked for in all history.
    """
    start = stamp(as_of - timedelta(days=window_days))
    in_window = F.col("created_at") >= start
    demand = (
        sales(lake, F.col("order_status") != CANCELED)
        .groupBy("item_id")
        .agg(
            sum_if(in_window, "quantity").alias("units_sold_90d"),
            F.count_distinct(F.when(in_window, F.col("order_id"))).alias("orders_90d"),
            F.max("created_at").alias("last_sale_at"),
        )
    )
    stock = lake.current("stock_position").select(
        "item_id", "dc_id", "on_hand", "reserved", "available", "safety_stock", "position_at"
    )
    catalog = full_peer_join(
        stock, price_at(lake.current("prices"), as_of), "item_id", "has_stock_record", "has_price"
    )
    base = catalog.join(demand, "item_id", "left").withColumns(
        {
            "dc_id": F.coalesce("dc_id", F.lit(NO_STOCK)),
            "price_list_id": F.coalesce("price_list_id", F.lit(NO_PRICE)),
            "currency": F.coalesce("currency", F.lit("")),
            **{
                c: F.coalesce(F.col(c), F.lit(0).cast(AMOUNT)) for c in ("list_price", "cost_price")
            },
            **{
                c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
                for c in (
                    "on_hand",
                    "reserved",
                    "available",
                    "safety_stock",
                    "units_sold_90d",
                    "orders_90d",
                )
            },
        }
    )
    priced, stocked = F.col("has_price") == 1, F.col("has_stock_record") == 1
    some = F.col("available") > 0
    idle_class = (
        F.when(F.col("units_sold_90d") > 0, "ativo")
        .when(priced & stocked & some, "parado_com_estoque")
        .when(priced & stocked, "parado_sem_estoque")
        .when(priced, "preco_sem_posicao")
        .when(stocked & some, "estoque_sem_preco")
        .otherwise("indefinido")
    )

    def capital(price: str) -> Column:
        value = F.col("available").cast("decimal(18,0)") * F.col(price)
        return F.when(priced & stocked, value).otherwise(0).cast(TOTAL)

    return base.select(
        "item_id",
        "dc_id",
        "has_price",
        "price_list_id",
        "currency",
        "list_price",
        "cost_price",
        "price_valid_from",
        "has_stock_record",
        "on_hand",
        "reserved",
        "available",
        "safety_stock",
        "position_at",
        "units_sold_90d",
        "orders_90d",
        "last_sale_at",
        days_between("last_sale_at", stamp(as_of)).alias("days_since_last_sale"),
        idle_class.alias("idle_class"),
        capital("cost_price").alias("immobilized_capital"),
        capital("list_price").alias("potential_revenue"),
        stamp(as_of).alias("_refreshed_at"),
    )
