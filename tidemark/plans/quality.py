"""Quality checks: each is one row (value against a threshold)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.contracts import BILLABLE, CANCELED, VERSION_ORDER
from tidemark.functions import flag, midnight, money_sum, out_of_range, stamp
from tidemark.operators.aggregates import duplicate_keys, quantiles
from tidemark.operators.cdc import immutable_changes, with_scalars
from tidemark.operators.joins import fanout_guard, price_at
from tidemark.plans.refresh import refresh_state
from tidemark.plans.reports import coupons_over_limit
from tidemark.plans.workspace import Workspace

COMPARATORS: dict[str, Callable[[Column, float], Column]] = {
    "lte": lambda v, t: v <= t,
    "gte": lambda v, t: v >= t,
    "eq": lambda v, t: v == t,
    "neq": lambda v, t: v != t,
}


@dataclass(frozen=True)
class Check:
    check_id: str
    severity: str  # error | warn | info
    comparator: str
    threshold: float
    value: Callable[[Workspace], DataFrame]  # one row, column "value"


CHECKS: dict[str, Check] = {}


def check(check_id: str, severity: str = "error", comparator: str = "lte", threshold: float = 0.0):
    def register(fn: Callable[[Workspace], DataFrame]):
        CHECKS[check_id] = Check(check_id, severity, comparator, threshold, fn)
        return fn

    return register


def run_check(item: Check, space: Workspace, run_at: datetime, details: bool = False) -> DataFrame:
    """One row; with ``details`` also what was found, in words: the check's own column ``details``
    if it has one, else the verdict against the threshold."""
    value = F.col("value").cast("double")
    verdict = COMPARATORS[item.comparator](value, item.threshold)
    measured = item.value(space)
    rule = f"{item.comparator} {float(item.threshold)!r}"
    words = F.when(value.isNull(), "nothing to measure").when(verdict, f"holds: {rule}").otherwise(f"violated: {rule}")
    found = F.coalesce("details", words) if "details" in measured.columns else words
    return measured.select(
        F.lit(item.check_id).alias("check_id"),
        stamp(run_at).alias("run_at"),
        F.lit(item.severity).alias("severity"),
        value.alias("value"),
        F.lit(float(item.threshold)).alias("threshold"),
        F.lit(item.comparator).alias("comparator"),
        # nothing to measure is not a violation
        flag(value.isNull() | verdict).alias("passed"),
        *([found.alias("details")] if details else []),
    )


def run_checks(
    space: Workspace, run_at: datetime, ids: Iterable[str] | None = None
) -> DataFrame:
    """All (or the named) checks, one row each with details; ``record`` adds it to the history.
    Store the marts first (``Workspace.store``), or each check builds its own again."""
    wanted = [CHECKS[i] for i in ids] if ids is not None else list(CHECKS.values())
    return reduce(DataFrame.unionByName, [run_check(c, space, run_at, details=True) for c in wanted])


# --- history of results -------------------------------------------------------

RUN = "_run"
HISTORY_SCHEMA = (
    "check_id string, run_at timestamp_ntz, severity string, value double, threshold double, "
    f"comparator string, passed int, details string, {RUN} string"
)


def record(results: DataFrame, path: str, run_at: datetime) -> None:
    """Add the results of one run to the stored history. Every run is a partition of its own, so a
    run repeated after a crash replaces what it wrote."""
    (
        results.repartition(1)  # one row per check; the checks themselves run before this shuffle
        .withColumn(RUN, F.lit(f"{run_at:%Y%m%dT%H%M%S.%f}"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(RUN)
        .parquet(path)
    )


def history(spark: SparkSession, path: str) -> DataFrame:
    """All recorded results, one row per check and run."""
    return spark.read.schema(HISTORY_SCHEMA).parquet(path).drop(RUN)


def standing(results: DataFrame) -> DataFrame:
    """Per check of a history: its runs, how many failed, how often the verdict turned, the last
    result, and since when it fails without a break (null while it passes)."""
    by_check = Window.partitionBy("check_id")
    marked = results.select(
        "*",
        F.max(F.when(F.col("passed") == 1, F.col("run_at"))).over(by_check).alias("_last_pass"),
        F.lag("passed").over(by_check.orderBy("run_at")).alias("_before"),
    )
    failed = F.col("passed") == 0
    unbroken = failed & (F.col("_last_pass").isNull() | (F.col("run_at") > F.col("_last_pass")))
    last = F.max_by(F.struct("severity", "value", "passed", "details"), "run_at")
    return marked.groupBy("check_id").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(failed).alias("failed_runs"),
        F.count_if(F.col("_before") != F.col("passed")).alias("turns"),
        F.min(F.when(unbroken, F.col("run_at"))).alias("failing_since"),
        F.max("run_at").alias("last_run_at"),
        last.alias("_last"),
    ).select("*", "_last.*").drop("_last")


def share(condition: Column) -> Column:
    """Part of the rows that satisfy a condition; null over nothing."""
    n = F.nullif(F.count(F.lit(1)), F.lit(0))
    return (F.count_if(condition).cast("double") / n.cast("double")).alias("value")


def rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("value"))


def money_columns(df: DataFrame) -> list[T.StructField]:
    """The numeric columns that hold money, by their names."""
    words = ("amount", "price", "revenue", "ticket", "capital", "net_", "gross_", "lifetime_", "cost")
    rates = ("_pct", "_rate", "_ratio")
    return [
        f
        for f in df.schema.fields
        if isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType))
        and any(w in f.name for w in words)
        and not f.name.endswith(rates)
    ]


def float_money_columns(df: DataFrame) -> list[str]:
    """Money must never be floating point; empty means the schema is right."""
    return [f.name for f in money_columns(df) if not isinstance(f.dataType, T.DecimalType)]


def float_money(marts: dict[str, DataFrame]) -> DataFrame:
    """One row: ``value``, the rows of marts that hold money in floating point, and the columns in
    question in ``details``."""
    blocks = []
    for name, mart in marts.items():
        wrong = float_money_columns(mart)
        held = F.count(F.lit(1) if wrong else F.lit(None))
        named = F.lit(", ".join(f"{name}.{c}" for c in wrong) or None).cast("string")
        blocks.append(mart.agg(held.alias("n")).select("n", named.alias("wrong")))
    return reduce(DataFrame.unionByName, blocks).agg(
        F.sum("n").alias("value"), F.nullif(F.array_join(F.array_sort(F.collect_list("wrong")), "; "), F.lit("")).alias("details")
    )


# --- parity: the mart against an independent computation --------------------


def _parity(mart: DataFrame, direct: DataFrame) -> DataFrame:
    """One row: value in the mart, value worked out directly, difference."""
    return with_scalars(
        mart.select(F.col(mart.columns[0]).alias("mart_value")),
        direct.select(F.col(direct.columns[0]).alias("direct_value")),
    ).withColumn("diff", F.col("mart_value") - F.col("direct_value"))


def _valid_orders(w: Workspace) -> DataFrame:
    recent = w.lake.current("order", midnight(w.as_of, w.days))
    return recent.where(F.col("order_status") != CANCELED)


def parity_revenue(w: Workspace) -> DataFrame:
    return _parity(
        w.mart("revenue_by_bu_day").agg(money_sum("net_revenue")),
        _valid_orders(w).agg(money_sum("total_amount")),
    )


def parity_revenue_by_currency(w: Workspace) -> DataFrame:
    mart = w.mart("revenue_by_bu_day").groupBy("currency").agg(
        money_sum("net_revenue").alias("mart_value")
    )
    direct = _valid_orders(w).groupBy("currency").agg(
        money_sum("total_amount").alias("direct_value")
    )
    return mart.join(direct, "currency", "full").withColumn(
        "diff", F.col("mart_value") - F.col("direct_value")
    )


def parity_order_360(w: Workspace) -> DataFrame:
    return _parity(
        w.mart("order_360").agg(money_sum("total_amount")),
        w.lake.current("order").agg(money_sum("total_amount")),
    )


def parity_order_items(w: Workspace) -> DataFrame:
    orders = w.lake.current("order").select("order_id")
    direct = w.lake.current("order_item").join(orders, "order_id", "left_semi")
    return _parity(
        w.mart("order_360").agg(money_sum("items_total_amount")),
        direct.agg(money_sum("total_amount")),
    )


def parity_payments(w: Workspace) -> DataFrame:
    orders = w.lake.current("order").select("order_id")
    direct = w.lake.current("order_payment", midnight(w.payments_as_of, w.days))
    return _parity(
        w.mart("payment_funnel_day").agg(F.sum("attempts")),
        rows(direct.join(orders, "order_id", "left_semi")),
    )


def parity_baseline(w: Workspace) -> DataFrame:
    both = F.col("orders_no_coupon") + F.col("orders_with_coupon")
    return _parity(w.mart("discount_baseline_day").agg(F.sum(both)), rows(_valid_orders(w)))


def parity_margin(w: Workspace) -> DataFrame:
    """Directly: every price is an interval up to the next one of its item.

    Prices and orders grow with the data, and their keys as text are larger than Spark's byte statistics
    say: they are merged, or they would be broadcast and pass through the driver."""
    by_item = Window.partitionBy("item_id", "currency").orderBy("valid_from")
    intervals = (
        w.lake.current("prices")
        .groupBy("item_id", "currency", "valid_from")
        .agg(F.max_by("cost_price", "price_list_id").alias("cost_price"))
        .withColumn("until", F.lead("valid_from").over(by_item))
    )
    heads = w.lake.current("order").where(F.col("order_status") != CANCELED)
    sold = w.lake.current("order_item", midnight(w.as_of, w.days)).join(
        heads.select("order_id", "currency").hint("merge"), "order_id"
    )
    priced = sold.join(intervals.hint("merge"), ["item_id", "currency"]).where(
        (F.col("created_at") >= F.col("valid_from"))
        & (F.col("until").isNull() | (F.col("created_at") < F.col("until")))
    )
    cost = F.col("quantity").cast("decimal(10,0)") * F.col("cost_price")
    return _parity(
        w.mart("item_margin_daily").agg(money_sum("margin_amount")),
        priced.agg(money_sum(F.col("total_amount") - cost)),
    )


def parity_customers(w: Workspace) -> DataFrame:
    registered = w.lake.current("customer").select("customer_id")
    orders = w.lake.current("order").where(F.col("order_status") != CANCELED)
    return _parity(
        w.mart("customer_metrics").agg(money_sum("lifetime_net")),
        orders.join(registered, "customer_id", "left_semi").agg(money_sum("total_amount")),
    )


def _billable_items(w: Workspace, days: int) -> DataFrame:
    heads = w.lake.current("order").where(
        (F.col("created_at") >= stamp(w.as_of - timedelta(days=days)))
        & F.col("order_status").isin(*BILLABLE)
    )
    return w.lake.current("order_item").join(heads.select("order_id"), "order_id", "left_semi")


def parity_stock_demand(w: Workspace) -> DataFrame:
    pairs = w.lake.current("stock_position").select("item_id", "dc_id")
    direct = _billable_items(w, w.days).join(pairs, ["item_id", "dc_id"], "left_semi")
    return _parity(
        w.mart("stock_coverage").agg(F.sum("demand_qty_28d")), direct.agg(F.sum("quantity"))
    )


def parity_stockout(w: Workspace) -> DataFrame:
    """Items without any record, and positions at zero with a recent sale."""
    stock = w.lake.current("stock_position")
    none = (
        _billable_items(w, 28).select("item_id").distinct().join(stock, "item_id", "left_anti")
    )
    zero = stock.where(F.col("available") <= 0).join(
        _billable_items(w, 7).select("item_id"), "item_id", "left_semi"
    )
    found = F.col("stockout_class").isin("missing_stock_record", "zero_available")
    return _parity(
        rows(w.mart("stockout_candidates").where(found)),
        none.select("item_id").unionByName(zero.select("item_id")).agg(F.count(F.lit(1))),
    )


PARITIES: dict[str, Callable[[Workspace], DataFrame]] = {
    "revenue": parity_revenue,
    "order_360": parity_order_360,
    "order_items": parity_order_items,
    "payments": parity_payments,
    "baseline": parity_baseline,
    "margin": parity_margin,
    "customers": parity_customers,
    "stock_demand": parity_stock_demand,
    "stockout": parity_stockout,
}

for _name, _fn in PARITIES.items():
    check(f"marts.sum_parity.{_name}", "error", "eq", 0)(
        lambda w, _fn=_fn: _fn(w).select(F.col("diff").alias("value"))
    )


# --- landing and core -------------------------------------------------------


def _bad_entities(column: str, bad: Callable[[Column], Column]):
    return lambda w: w.mart("dq_overview").agg(F.count_if(bad(F.col(column))).alias("value"))


check("landing.freshness")(_bad_entities("freshness_ok", lambda c: c == 0))
check("core.dup_key")(_bad_entities("keys_with_dup_in_core", lambda c: c != 0))
check("core.reconcile_count")(_bad_entities("reconcile_ok", lambda c: c == 0))


@check("core.cdc_monotonic", "warn")
def _cdc_monotonic(w: Workspace) -> DataFrame:
    return w.mart("dq_overview").agg(F.sum("cdc_seq_non_monotonic").alias("value"))


@check("core.immutable_columns")
def _immutable_columns(w: Workspace) -> DataFrame:
    """Keys whose versions differ in a column that readers prune on before comparing versions."""
    found = [
        immutable_changes(w.lake.core(c.entity), c).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c.entity).alias("entity"), "n")
        for c in w.lake.contracts.values()
        if c.immutable
    ]
    words = F.when(F.col("n") > 0, F.concat_ws(": ", "entity", F.col("n").cast("string")))
    return reduce(DataFrame.unionAll, found).agg(
        F.sum("n").alias("value"),
        F.nullif(F.array_join(F.array_sort(F.collect_list(words)), ", "), F.lit("")).alias("details"),
    )


@check("core.deleted_leak")
def _deleted_leak(w: Workspace) -> DataFrame:
    """Live keys whose newest version, found by another route, is a delete."""

    def block(contract) -> DataFrame:
        newest = w.lake.core(contract.entity).groupBy(*contract.key).agg(
            F.max_by("_is_deleted", F.struct(*VERSION_ORDER)).alias("gone")
        )
        dead = newest.where(F.col("gone") == 1)
        return rows(
            w.lake.current(contract.entity).join(dead, list(contract.key), "left_semi")
        )

    blocks = [block(c) for c in w.lake.contracts.values()]
    return reduce(DataFrame.unionByName, blocks).agg(F.sum("value").alias("value"))


# --- relations --------------------------------------------------------------


def _bad_relations(bad: Column, kind: str | None = None):
    def value(w: Workspace) -> DataFrame:
        found = w.mart("orphan_summary")
        if kind:
            found = found.where(F.col("relation_kind") == kind)
        return found.agg(F.count_if(bad).alias("value"))

    return value


check("rel.orphan_rate")(lambda w: _bad_relations(F.col("rate_ok") == 0)(w))
check("rel.orphan_age_p99")(lambda w: _bad_relations(F.col("age_ok") == 0)(w))
check("rel.fk_violation", "warn")(
    lambda w: _bad_relations(F.col("orphan_rows") > 0, "foreign_key")(w)
)


# --- marts ------------------------------------------------------------------


@check("marts.row_parity", "error", "eq", 0)
def _row_parity(w: Workspace) -> DataFrame:
    both = _parity(rows(w.mart("customer_metrics")), rows(w.lake.current("customer")))
    return both.select(F.col("diff").alias("value"))


@check("marts.rate_bounds")
def _rate_bounds(w: Workspace) -> DataFrame:
    bad = out_of_range("approval_rate", 0, 1) | out_of_range("capture_rate", 0, 1)
    return w.mart("payment_funnel_day").agg(F.count_if(bad).alias("value"))


@check("marts.header_item_parity", "warn", "lte", 0.005)
def _header_item_parity(w: Workspace) -> DataFrame:
    with_items = w.mart("order_360").where(F.col("has_items") == 1)
    return with_items.agg(share(F.abs("amount_mismatch_amount") > 0.01))


@check("money.no_negative_amount", "warn", "lte", 0.0001)
def _no_negative_amount(w: Workspace) -> DataFrame:
    return w.lake.current("order_payment").agg(share(F.col("amount") < 0))


@check("marts.order_360.grain")
def _order_grain(w: Workspace) -> DataFrame:
    return rows(duplicate_keys(w.mart("order_360"), ["order_id"]))


@check("marts.order_360.coverage")
def _order_coverage(w: Workspace) -> DataFrame:
    return rows(w.lake.current("order").join(w.mart("order_360"), "order_id", "left_anti"))


@check("marts.order_360.item_fanout")
def _order_fanout(w: Workspace) -> DataFrame:
    detail = w.lake.current("order_item")
    return rows(fanout_guard(w.mart("order_360"), detail, "order_id", "items_count"))


@check("marts.order_360.amount_mismatch_rate", "warn", "lte", 0.01)
def _order_mismatch(w: Workspace) -> DataFrame:
    return w.mart("order_360").agg(share(F.abs("amount_mismatch_amount") > 0.01))


@check("marts.order_360.bu_orphan_rate", "error", "lte", 0.0)
def _order_bu(w: Workspace) -> DataFrame:
    return w.mart("order_360").agg(share(F.col("bu_found") == 0))


@check("marts.order_360.customer_orphan_rate", "error", "lte", 0.005)
def _order_customer(w: Workspace) -> DataFrame:
    return w.mart("order_360").agg(share(F.col("customer_found") == 0))


@check("discount.over_limit", "warn")
def _over_limit(w: Workspace) -> DataFrame:
    return rows(coupons_over_limit(w.mart("discount_effectiveness")))


def _part(df: DataFrame, part: str, whole: str) -> DataFrame:
    """Ratio of two sums over a mart; null over nothing."""
    return df.agg(
        (F.sum(part).cast("double") / F.nullif(F.sum(whole), F.lit(0)).cast("double")).alias("value")
    )


@check("discount.outside_validity", "warn", "lte", 0.001)
def _outside_validity(w: Workspace) -> DataFrame:
    return _part(w.mart("discount_effectiveness"), "used_outside_validity", "orders")


@check("price.coverage", "error", "lte", 0.01)
def _price_coverage(w: Workspace) -> DataFrame:
    return _part(w.mart("item_margin_daily"), "units_without_price", "units_sold")


@check("price.staleness", "warn", "lte", 365)
def _price_staleness(w: Workspace) -> DataFrame:
    return w.mart("item_margin_daily").agg(F.max("price_staleness_max_d").alias("value"))


@check("price.below_cost", "warn", "lte", 0.005)
def _below_cost(w: Workspace) -> DataFrame:
    return _part(w.mart("item_margin_daily"), "units_below_cost", "units_sold")


@check("marts.stock_coverage.grain_unique")
def _coverage_grain(w: Workspace) -> DataFrame:
    return rows(duplicate_keys(w.mart("stock_coverage"), ["dc_id", "item_id"]))


@check("marts.stock_coverage.position_age_p99", "warn", "lte", 3600)
def _position_age(w: Workspace) -> DataFrame:
    return quantiles(w.mart("stock_coverage"), [], "position_age_seconds", {"value": 0.99})


@check("rel.unassigned_dc_ratio", "warn", "lte", 0.05)
def _unassigned_ratio(w: Workspace) -> DataFrame:
    """Mean over items with demand; the ratio is the same on every centre."""
    wanted = F.col("demand_qty_28d") + F.col("demand_qty_unassigned_28d") > 0
    per_item = (
        w.mart("stock_coverage")
        .where(wanted)
        .groupBy("item_id")
        .agg(F.min("unassigned_ratio").alias("r"))
    )
    return per_item.agg(
        (F.sum("r").cast("double") / F.nullif(F.count(F.lit(1)), F.lit(0)).cast("double")).alias(
            "value"
        )
    )


@check("marts.stockout.class_exclusive")
def _class_exclusive(w: Workspace) -> DataFrame:
    classes = (
        w.mart("stockout_candidates")
        .groupBy("item_id", "dc_id")
        .agg(F.count_distinct("stockout_class").alias("n"))
    )
    return rows(classes.where(F.col("n") > 1))


@check("marts.stockout.complement_006")
def _complement(w: Workspace) -> DataFrame:
    absent = w.mart("stockout_candidates").where(F.col("stockout_class") != "zero_available")
    return rows(absent.join(w.mart("stock_coverage"), ["item_id", "dc_id"], "left_semi"))


@check("rel.stockout_missing_record_rate", "error", "lte", 0.02)
def _missing_record(w: Workspace) -> DataFrame:
    confirmed = rows(
        w.mart("stockout_candidates").where(
            (F.col("stockout_class") == "missing_stock_record")
            & (F.col("evidence_status") == "confirmed")
        )
    )
    sold = _billable_items(w, 28).agg(F.count_distinct("item_id"))
    both = _parity(confirmed, sold)
    return both.select(
        (
            F.col("mart_value").cast("double")
            / F.nullif(F.col("direct_value"), F.lit(0)).cast("double")
        ).alias("value")
    )


@check("rel.stockout_evidence_age_p99", "error", "lte", 72 * 3600)
def _evidence_age(w: Workspace) -> DataFrame:
    waiting = w.mart("stockout_candidates").where(F.col("evidence_status") == "pending_grace")
    return quantiles(waiting, [], "evidence_age_seconds", {"value": 0.99})


@check("customer.cohort_bounds")
def _cohort_bounds(w: Workspace) -> DataFrame:
    cohort = w.mart("customer_cohort")
    outside = cohort.where(out_of_range("retention_rate", 0, 1)).select("cohort_month")
    unstable = (
        cohort.groupBy("cohort_month", "segment")
        .agg(F.count_distinct("cohort_size").alias("n"))
        .where(F.col("n") > 1)
        .select("cohort_month")
    )
    return rows(outside.unionByName(unstable))


@check("customer.signup_after_first_order", "warn", "lte", 0.005)
def _signup_late(w: Workspace) -> DataFrame:
    return w.mart("customer_metrics").agg(share(F.col("days_to_first_order") < 0))


@check("catalog.coverage", "warn", "gte", 0.9)
def _catalog_coverage(w: Workspace) -> DataFrame:
    per_item = w.mart("idle_catalog").groupBy("item_id").agg(
        F.min(F.least("has_price", "has_stock_record")).alias("both")
    )
    return per_item.agg(share(F.col("both") == 1))


@check("catalog.items_complete", "error", "eq", 0)
def _catalog_items(w: Workspace) -> DataFrame:
    """The mart holds exactly the items that have a valid price or a position."""
    priced = price_at(w.lake.current("prices"), w.as_of).select("item_id")
    stocked = w.lake.current("stock_position").select("item_id")
    either = priced.unionByName(stocked).distinct()
    both = _parity(
        w.mart("idle_catalog").agg(F.count_distinct("item_id")), either.agg(F.count(F.lit(1)))
    )
    return both.select(F.col("diff").alias("value"))


@check("catalog.stock_without_price", "error", "lte", 0.01)
def _stock_without_price(w: Workspace) -> DataFrame:
    return w.mart("idle_catalog").agg(share(F.col("idle_class") == "estoque_sem_preco"))


@check("catalog.class_exhaustive")
def _class_exhaustive(w: Workspace) -> DataFrame:
    return rows(w.mart("idle_catalog").where(F.col("idle_class") == "indefinido"))


@check("stock.negative_available", "warn", "lte", 0.001)
def _negative_available(w: Workspace) -> DataFrame:
    return w.lake.current("stock_position").agg(share(F.col("available") < 0))


@check("dict.loaded")
def _dict_loaded(w: Workspace) -> DataFrame:
    """Lookups that are empty or hold a key twice."""

    def block(name: str) -> DataFrame:
        lookup = w.lookups[name]
        sizes = lookup.frame.groupBy(lookup.key).agg(F.count(F.lit(1)).alias("n"))
        return sizes.agg(
            flag((F.count(F.lit(1)) == 0) | (F.coalesce(F.max("n"), F.lit(0)) > 1)).alias("value")
        )

    blocks = [block(n) for n in ("business_unit", "discount_codes")]
    return reduce(DataFrame.unionByName, blocks).agg(F.sum("value").alias("value"))


# marts with columns of money
MONEY_MARTS = (
    "order_360", "revenue_by_bu_day", "payment_funnel_day", "discount_effectiveness", "discount_baseline_day",
    "item_margin_daily", "stockout_candidates", "customer_metrics", "customer_cohort", "idle_catalog",
)


@check("money.no_float")
def _money_no_float(w: Workspace) -> DataFrame:
    return float_money({name: w.mart(name) for name in MONEY_MARTS})


# --- refresh log --------------------------------------------------------------


def refresh_checks(log: DataFrame, run_at: datetime) -> DataFrame:
    """Marts whose last refresh failed or is too old, and marts that take half of
    their interval or more: two rows in the form of the other checks."""
    state = refresh_state(log, run_at)
    items = (
        ("marts.refresh_health", "error", "healthy"),
        ("marts.refresh_duration", "warn", "duration_ok"),
    )
    blocks = [
        run_check(
            Check(
                check_id, severity, "lte", 0,
                lambda _, ok=ok: state.agg(F.count_if(F.col(ok) == 0).alias("value")),
            ),
            None,
            run_at,
        )
        for check_id, severity, ok in items
    ]
    return reduce(DataFrame.unionByName, blocks)
