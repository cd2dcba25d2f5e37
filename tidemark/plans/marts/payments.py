"""Payment funnel by day."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import midnight, money_sum, ratio, seconds_between, stamp
from tidemark.operators.cdc import Lake
from tidemark.operators.joins import Lookup, lookup_join

GRAIN = (
    "attempt_date",
    "business_unit_code",
    "order_channel",
    "payment_method",
    "acquirer",
    "installment_bucket",
    "currency",
)
# Final states of an attempt.
STATES = ("pending", "authorized", "captured", "denied", "refunded")


def installment_bucket(col: str = "installments"):
    n = F.col(col)
    return F.when(n <= 1, "1").when(n <= 6, "2-6").when(n <= 12, "7-12").otherwise("13+")


def payment_funnel_day(
    lake: Lake, lookups: dict[str, Lookup], as_of: datetime, window_days: int = 3
) -> DataFrame:
    """One row per day, unit, channel, method, acquirer, installments, currency.

    Attempts are first folded by (order, grain, latency in whole seconds). That
    is combined before the shuffle and leaves few rows even for an order with very
    many attempts, so retries and distinct orders can be marked with windows on
    the folded rows and everything else is one sum per grain.
    """
    since = midnight(as_of, window_days)
    payments = lake.current("order_payment", since)
    orders = lake.parents("order_payment", "order_id", "order", since, True).select(
        "order_id", "business_unit_code", F.col("channel").alias("order_channel"), "currency"
    )
    attempts = payments.join(orders, "order_id").select(
        "order_id",
        F.to_date("created_at").alias("attempt_date"),
        "business_unit_code",
        "order_channel",
        "payment_method",
        "acquirer",
        installment_bucket().alias("installment_bucket"),
        "currency",
        "payment_status",
        "amount",
        seconds_between("created_at", "authorized_at").alias("latency"),
    )
    status = F.col("payment_status")
    folded = attempts.groupBy("order_id", *GRAIN, "latency").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(status == s).alias(f"n_{s}") for s in STATES],
        money_sum("amount").alias("amount_all"),
        money_sum(F.when(status == "captured", F.col("amount"))).alias("amount_cap"),
        money_sum(F.when(status == "refunded", F.col("amount"))).alias("amount_ref"),
    )
    by_order = Window.partitionBy("order_id")
    in_grain = Window.partitionBy("order_id", *GRAIN)
    marked = folded.withColumns(
        {
            "order_attempts": F.sum("n").over(by_order),
            "first": F.row_number().over(in_grain.orderBy("latency")) == 1,
            "captured_here": F.sum("n_captured").over(in_grain) > 0,
        }
    )
    first = F.col("first")
    totals = marked.groupBy(*GRAIN).agg(
        F.sum("n").alias("attempts"),
        *[F.sum(f"n_{s}").alias(f"attempts_{s}") for s in STATES],
        F.count_if(first).alias("orders_with_attempt"),
        F.count_if(first & F.col("captured_here")).alias("orders_captured"),
        money_sum("amount_all").alias("amount_attempted"),
        money_sum("amount_cap").alias("amount_captured"),
        money_sum("amount_ref").alias("amount_refunded"),
        F.percentile("latency", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.col("n")).alias(
            "q"
        ),
        F.max("latency").cast("double").alias("auth_latency_max_s"),
        F.max("order_attempts").alias("max_attempts_per_order"),
        F.count_if(first & (F.col("order_attempts") > 1)).alias("orders_with_retry"),
    )
    named = lookup_join(
        totals,
        lookups["business_unit"],
        "business_unit_code",
        {"bu_name": ("bu_name", "(sem cadastro)")},
        "_bu_found",
    )
    approved = F.col("attempts_authorized") + F.col("attempts_captured")
    return named.select(
        "attempt_date",
        "business_unit_code",
        "bu_name",
        "order_channel",
        "payment_method",
        "acquirer",
        "installment_bucket",
        "currency",
        "attempts",
        *[f"attempts_{s}" for s in STATES],
        "orders_with_attempt",
        "orders_captured",
        "amount_attempted",
        "amount_captured",
        "amount_refunded",
        ratio(approved, "attempts").alias("approval_rate"),
        ratio("attempts_captured", approved).alias("capture_rate"),
        ratio("attempts_denied", "attempts").alias("denial_rate"),
        F.col("q")[0].alias("auth_latency_p50_s"),
        F.col("q")[1].alias("auth_latency_p95_s"),
        F.col("q")[2].alias("auth_latency_p99_s"),
        "auth_latency_max_s",
        "max_attempts_per_order",
        "orders_with_retry",
        stamp(as_of).alias("_refreshed_at"),
    )
