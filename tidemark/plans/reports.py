"""Report views and consumption queries over the marts.

Rates are always ratios of sums, never means of the ratios in a mart.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import average_money, flag, money_sum, ratio, seconds_between, stamp
from tidemark.operators.windows import ntiles_global


def _since(as_of: datetime, days: int):
    return F.lit((as_of.date() - timedelta(days=days)).isoformat()).cast("date")


# --- orders ---------------------------------------------------------------


def order_lookup(order_360: DataFrame, as_of: datetime, order_id: str) -> DataFrame:
    """One order with the age of the answer."""
    return (
        order_360.where(F.col("order_id") == order_id)
        .withColumn("freshness_seconds", seconds_between("_refreshed_at", stamp(as_of)))
    )


def customer_orders(
    order_360: DataFrame, customer_id: str | None = None, limit: int | None = None
) -> DataFrame:
    """Newest version of every order with its customer; for one customer newest
    orders first, at most ``limit``."""
    cols = ("order_status", "total_amount", "currency", "order_created_at", "is_fully_paid")
    rows = order_360
    if customer_id is not None:
        rows = rows.where(F.col("customer_id") == customer_id)
    newest = rows.groupBy("customer_id", "order_id").agg(
        F.max_by(F.struct(*cols), "_mart_version").alias("v")
    )
    out = newest.select("customer_id", "order_id", *[f"v.{c}" for c in cols])
    if limit is not None:
        out = out.orderBy(F.col("order_created_at").desc(), "order_id").limit(limit)
    return out


# --- revenue --------------------------------------------------------------


def revenue_last_days(revenue: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    return revenue.where(F.col("order_date") >= _since(as_of, days)).select(
        "business_unit_code",
        "bu_name",
        "bu_channel",
        "order_date",
        "orders",
        "units_sold",
        "gross_revenue",
        "discount_total",
        "net_revenue",
        "avg_ticket",
    )


def cancel_rate_by_bu(revenue: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    totals = (
        revenue.where(F.col("order_date") >= _since(as_of, days))
        .groupBy("bu_name")
        .agg(
            F.sum("orders").alias("orders"),
            F.sum("orders_canceled").alias("canceled"),
            money_sum("net_revenue").alias("net_revenue"),
        )
    )
    return totals.select(
        "bu_name",
        "orders",
        ratio("canceled", "orders").alias("cancel_rate"),
        "net_revenue",
        average_money("net_revenue", F.col("orders") - F.col("canceled")).alias("avg_ticket"),
    )


# --- payments -------------------------------------------------------------


def approval_by_acquirer(funnel: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    totals = (
        funnel.where(F.col("attempt_date") >= _since(as_of, days))
        .groupBy("acquirer", "installment_bucket")
        .agg(
            F.sum("attempts").alias("attempts"),
            F.sum(F.col("attempts_authorized") + F.col("attempts_captured")).alias("approved"),
            F.max("auth_latency_p95_s").alias("worst_p95_s"),
        )
    )
    return totals.select(
        "acquirer",
        "installment_bucket",
        "attempts",
        ratio("approved", "attempts").alias("approval_rate"),
        "worst_p95_s",
    )


# --- coupons --------------------------------------------------------------


def unknown_coupons(effectiveness: DataFrame, as_of: datetime) -> DataFrame:
    """Codes without registration. A code seen within the last 15 minutes is left
    out: its registration may be on the way."""
    totals = (
        effectiveness.where(F.col("code_found") == 0)
        .groupBy("discount_code_norm")
        .agg(
            F.min("discount_code_raw").alias("example_raw"),
            F.min("order_date").alias("first_seen"),
            F.max("order_date").alias("last_seen"),
            F.sum("orders").alias("orders"),
            money_sum("discount_amount").alias("discount_given"),
        )
    )
    quiet = F.col("last_seen").cast("timestamp_ntz") < stamp(as_of - timedelta(minutes=15))
    return totals.where(quiet)


def coupons_over_limit(effectiveness: DataFrame) -> DataFrame:
    return (
        effectiveness.where((F.col("code_found") == 1) & (F.col("max_uses") > 0))
        .groupBy("discount_code_norm", "campaign_name", "max_uses")
        .agg(F.sum("orders").alias("total_uses"))
        .where(F.col("total_uses") > F.col("max_uses"))
        .withColumn("over_by", F.col("total_uses") - F.col("max_uses"))
    )


def campaign_vs_baseline(
    effectiveness: DataFrame, baseline: DataFrame, as_of: datetime, days: int = 30
) -> DataFrame:
    """Side by side, not cause and effect."""
    used = effectiveness.where(
        (F.col("order_date") >= _since(as_of, days)) & (F.col("code_found") == 1)
    )
    plain = baseline.select(
        "order_date", "business_unit_code", "net_no_coupon", "orders_no_coupon"
    )
    totals = (
        used.join(plain, ["order_date", "business_unit_code"])
        .groupBy("campaign_name")
        .agg(
            F.sum("orders").alias("orders"),
            money_sum("discount_amount").alias("discount_given"),
            money_sum("gross_amount").alias("gross"),
            money_sum("net_amount").alias("net"),
            money_sum("net_no_coupon").alias("base_net"),
            F.sum("orders_no_coupon").alias("base_orders"),
        )
    )
    return totals.select(
        "campaign_name",
        "orders",
        "discount_given",
        ratio("discount_given", "gross").alias("pct_effective"),
        average_money("net", "orders").alias("avg_ticket_coupon"),
        average_money("base_net", "base_orders").alias("avg_ticket_baseline"),
    )


# --- margin ---------------------------------------------------------------


def items_without_price(margin: DataFrame) -> DataFrame:
    return (
        margin.where(F.col("units_without_price") > 0)
        .groupBy("item_id")
        .agg(
            F.min("order_date").alias("first_seen"),
            F.max("order_date").alias("last_seen"),
            F.sum("units_without_price").alias("units"),
            money_sum("revenue_practiced").alias("revenue_unaudited"),
        )
    )


def sold_below_cost(margin: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    return margin.where(
        (F.col("units_below_cost") > 0) & (F.col("order_date") >= _since(as_of, days))
    ).select(
        "order_date",
        "item_id",
        "business_unit_code",
        "units_below_cost",
        "margin_amount",
        "margin_pct",
    )


def top_margin_items(margin: DataFrame, as_of: datetime, days: int = 30, n: int = 50) -> DataFrame:
    totals = (
        margin.where(
            (F.col("order_date") >= _since(as_of, days))
            & (F.col("price_list_id") != "(sem preco)")
        )
        .groupBy("item_id")
        .agg(
            F.sum("units_sold").alias("units"),
            money_sum("revenue_practiced").alias("revenue"),
            money_sum("revenue_at_list").alias("revenue_at_list"),
            money_sum("cost_total").alias("cost"),
            F.sum("units_without_price").alias("units_unaudited"),
        )
    )

    def one_minus(num: str, den: str):
        return F.when(F.col(den) == 0, F.lit(0.0)).otherwise(F.lit(1.0) - ratio(num, den))

    return (
        totals.select(
            "item_id",
            "units",
            "revenue",
            "revenue_at_list",
            one_minus("revenue", "revenue_at_list").alias("discount_pct"),
            one_minus("cost", "revenue").alias("margin_pct"),
            "units_unaudited",
        )
        .orderBy(F.col("revenue").desc(), "item_id")
        .limit(n)
    )


# --- stock ----------------------------------------------------------------


def coverage_alerts(coverage: DataFrame) -> DataFrame:
    risky = F.col("coverage_class").isin("stockout", "critical", "low")
    return coverage.where(risky | (F.col("below_safety_stock") == 1)).select(
        "dc_id",
        "dc_name",
        "item_id",
        "available",
        "safety_stock",
        "avg_daily_demand_alloc_28d",
        "coverage_days_allocated",
        "days_to_safety_stock",
        "coverage_class",
        "unassigned_ratio",
        "position_age_seconds",
        "refreshed_at",
    )


def coverage_by_dc(coverage: DataFrame, dc_id: str) -> DataFrame:
    return coverage.where(F.col("dc_id") == dc_id).orderBy(
        F.col("coverage_days_allocated").asc_nulls_last()
    )


def unassigned_total(coverage: DataFrame) -> DataFrame:
    """Demand without a centre. It is repeated on every centre of an item, so it
    is taken once per item before it is summed."""
    return (
        coverage.groupBy("item_id")
        .agg(F.min("demand_qty_unassigned_28d").alias("q"))
        .agg(F.sum("q").alias("unassigned_units"), F.count(F.lit(1)).alias("items"))
    )


def severity_rank(col: str = "severity"):
    return F.when(F.col(col) == "high", 3).when(F.col(col) == "medium", 2).otherwise(1)


def stockout_queue(candidates: DataFrame) -> DataFrame:
    """Confirmed findings, high severity first."""
    return (
        candidates.where(F.col("evidence_status") == "confirmed")
        .select(
            "stockout_class",
            "item_id",
            "dc_id",
            "severity",
            severity_rank().alias("severity_rank"),
            "units_sold_7d",
            "revenue_at_risk",
            "available",
            "last_sale_at",
            "evidence_age_seconds",
            "refreshed_at",
        )
        .orderBy(F.col("severity_rank").desc(), F.col("revenue_at_risk").desc())
    )


def stockout_summary(candidates: DataFrame) -> DataFrame:
    """Always by class: the classes measure risk in different ways."""
    return candidates.groupBy("stockout_class", "evidence_status").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_distinct("item_id").alias("items"),
        F.count_distinct("dc_id").alias("dcs"),
        F.sum("units_sold_7d").alias("units_sold_7d"),
        money_sum("revenue_at_risk").alias("revenue_at_risk"),
        F.max("evidence_age_seconds").alias("max_evidence_age_seconds"),
        F.min("refreshed_at").alias("refreshed_at"),
    )


# --- customers ------------------------------------------------------------


def rfm_scores(metrics: DataFrame) -> DataFrame:
    """Recency, frequency and value in fifths of all buyers; ties by customer."""
    base = metrics.where(F.col("never_purchased") == 0).select(
        "customer_id", "segment", "recency_days", "total_orders", "lifetime_net"
    )
    by = {"_r": "recency_days", "f_score": "total_orders", "m_score": "lifetime_net"}
    scored = ntiles_global(base, {name: [col, "customer_id"] for name, col in by.items()}, 5)
    return scored.select(
        "customer_id", "segment", (6 - F.col("_r")).alias("r_score"), "f_score", "m_score"
    )


def retention_curve(cohort: DataFrame, since: date, segment: str | None = None) -> DataFrame:
    rows = cohort.where(F.col("cohort_month") >= F.lit(since.isoformat()).cast("date"))
    if segment is not None:
        rows = rows.where(F.col("segment") == segment)
    totals = rows.groupBy("segment", "cohort_month", "months_since_signup").agg(
        F.min("cohort_size").alias("size"), F.sum("active_customers").alias("active")
    )
    return totals.withColumn("retention", ratio("active", "size"))


# --- quality --------------------------------------------------------------


def _raised(df: DataFrame, context: str, entity: str, alerts: dict) -> DataFrame:
    """One row per alert that applies, from one pass over ``df``. ``alerts`` maps a
    kind to (condition, detail)."""
    candidates = F.array(
        *[
            F.when(bad, F.struct(F.lit(kind).alias("kind"), detail.alias("detail")))
            for kind, (bad, detail) in alerts.items()
        ]
    )
    return df.select(
        F.col(context).alias("context"),
        F.col(entity).alias("entity"),
        F.inline(F.array_compact(candidates)),
    ).select("kind", "context", "entity", "detail")


def dq_alerts(overview: DataFrame, orphans: DataFrame) -> DataFrame:
    """Empty means healthy; every row asks for action."""

    def text(col: str):
        return F.col(col).cast("string")

    of_entities = _raised(
        overview,
        "context",
        "entity",
        {
            "freshness": (F.col("freshness_ok") == 0, text("freshness_seconds")),
            "reconcile": (F.col("reconcile_ok") == 0, text("reconcile_diff")),
            "core_dup": (F.col("keys_with_dup_in_core") != 0, text("keys_with_dup_in_core")),
        },
    )
    pct = F.round("orphan_rate_pct", 3).cast("decimal(12,3)").cast("string")
    p99 = F.round("orphan_age_p99_s").cast("bigint").cast("string")
    of_relations = _raised(
        orphans,
        "from_context",
        "from_entity",
        {
            "orphan_rate": (
                F.col("rate_ok") == 0,
                F.concat("relation_id", F.lit(" = "), pct, F.lit("%")),
            ),
            "orphan_age": (
                F.col("age_ok") == 0,
                F.concat("relation_id", F.lit(" p99 = "), p99, F.lit("s")),
            ),
        },
    )
    return of_entities.unionByName(of_relations)


def entity_state(overview: DataFrame) -> DataFrame:
    return overview.select(
        "context",
        "entity",
        "freshness_ok",
        "freshness_seconds",
        "freshness_sla_seconds",
        "landing_distinct_keys",
        "core_rows",
        "reconcile_diff",
    ).orderBy("freshness_ok", "context", "entity")


# Verdict words of the orphan report.
ORPHANS_BOTH, ORPHANS_LATE, ORPHANS_MANY, ORPHANS_NORMAL = "INCIDENTE", "ATRASO ACIMA DA JANELA", "TAXA ALTA", "normal"


def orphan_verdict(orphans: DataFrame) -> DataFrame:
    bad_rate, bad_age = F.col("rate_ok") == 0, F.col("age_ok") == 0
    verdict = (
        F.when(bad_rate & bad_age, ORPHANS_BOTH)
        .when(bad_age, ORPHANS_LATE)
        .when(bad_rate, ORPHANS_MANY)
        .otherwise(ORPHANS_NORMAL)
    )
    return orphans.select(
        "relation_id",
        "relation_kind",
        "orphan_rows",
        F.round("orphan_rate_pct", 3).alias("rate_pct"),
        "threshold_pct",
        "orphan_age_p99_s",
        "refresh_window_s",
        verdict.alias("veredito"),
    )


def data_health(alerts: DataFrame) -> DataFrame:
    """One row for a gate: healthy only without any alert."""
    return alerts.agg(F.count(F.lit(1)).alias("n_alerts")).select(
        flag(F.col("n_alerts") == 0).alias("healthy"), "n_alerts"
    )


# --- catalogue ------------------------------------------------------------


def _capital(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count_distinct("item_id").alias("items"),
        F.sum("available").alias("units"),
        money_sum("immobilized_capital").alias("capital"),
        money_sum("potential_revenue").alias("potential_revenue"),
    )


def capital_by_dc(idle: DataFrame) -> DataFrame:
    return _capital(idle.where(F.col("idle_class") == "parado_com_estoque"), "dc_id")


def catalog_gaps(idle: DataFrame) -> DataFrame:
    gaps = idle.where(F.col("idle_class").isin("estoque_sem_preco", "preco_sem_posicao"))
    return _capital(gaps, "idle_class").drop("potential_revenue")


def idle_ranking(idle: DataFrame, currency: str = "BRL", n: int = 50) -> DataFrame:
    """Capital standing still, per centre and class, in one currency."""
    rows = idle.where((F.col("idle_class") != "ativo") & (F.col("currency") == currency))
    ranked = _capital(rows, "dc_id", "idle_class")
    return ranked.orderBy(F.col("capital").desc(), "dc_id", "idle_class").limit(n)


def top_idle(idle: DataFrame, n: int = 100) -> DataFrame:
    return (
        idle.where(F.col("idle_class") == "parado_com_estoque")
        .select(
            "item_id",
            "dc_id",
            "available",
            "cost_price",
            "immobilized_capital",
            "days_since_last_sale",
        )
        .orderBy(F.col("immobilized_capital").desc(), "item_id", "dc_id")
        .limit(n)
    )
