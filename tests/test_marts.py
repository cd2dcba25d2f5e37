"""Named adverse cases of the marts with their exact results."""

from datetime import timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.support import AS_OF, ago, lake, lookups, only, space
from tidemark.plans import quality, reports
from tidemark.plans.marts import customers, discounts, health, margin, payments, sales, stock
from tidemark.session import scratch


def revenue(spark, orders, items=(), days=400):
    a_lake = lake(spark, order=orders, order_item=list(items))
    return sales.revenue_by_bu_day(a_lake, lookups(a_lake), AS_OF, days)


# --- revenue -----------------------------------------------------------------


def test_an_update_replaces_revenue_and_a_cancellation_removes_it(spark):
    versions = [
        {"order_id": "A", "business_unit_code": "BU-TEST", "total_amount": 100},
        {"order_id": "A", "business_unit_code": "BU-TEST", "total_amount": 150},
    ]
    row = only(revenue(spark, versions))
    assert (row.net_revenue, row.orders, row.bu_name) == (Decimal("150.0000"), 1, "Unit T")
    row = only(revenue(spark, [*versions, {**versions[1], "order_status": "canceled"}]))
    assert (row.net_revenue, row.avg_ticket, row.orders, row.orders_canceled) == (0, 0, 1, 1)


def test_items_do_not_multiply_the_header_and_missing_items_count_zero(spark):
    items = [{"order_id": "A", "item_seq": n, "quantity": 2} for n in (1, 2, 3)]
    rows = revenue(spark, [
        {"order_id": "A", "total_amount": 10}, {"order_id": "B", "total_amount": 10, "currency": "USD"},
    ], items).collect()
    got = {r.currency: (r.net_revenue, r.units_sold, r.items_count) for r in rows}
    assert got == {"BRL": (Decimal("10.0000"), 6, 3), "USD": (Decimal("10.0000"), 0, 0)}


def test_unknown_unit_keeps_its_rows(spark):
    row = only(revenue(spark, [{"order_id": "A", "business_unit_code": "BU-X", "total_amount": 5}]))
    assert (row.bu_name, row.bu_channel, row._bu_found, row.net_revenue) == (
        "(sem cadastro)", "unknown", 0, Decimal("5.0000"))


def test_orders_before_the_window_are_left_out(spark):
    rows = [{"order_id": "A", "created_at": ago(3)}, {"order_id": "B", "created_at": ago(4)}]
    assert revenue(spark, rows, days=3).agg(F.sum("orders")).first()[0] == 1


# --- order 360 ---------------------------------------------------------------


def order_360(spark, days=None, **entities):
    a_lake = lake(spark, **entities)
    return sales.order_360(a_lake, lookups(a_lake), AS_OF, days)


def test_order_with_items_and_payments_has_no_fan_out(spark):
    row = only(order_360(
        spark,
        order=[{"order_id": "A", "total_amount": 100, "freight_amount": 10, "discount_code": " promo10 ", "channel": "app"}],
        order_item=[{"order_id": "A", "item_seq": n, "item_id": f"S{n % 2}", "total_amount": 30, "quantity": n,
                     "dc_id": None if n == 3 else "DC-01"} for n in (3, 2, 1)],
        order_payment=[
            {"payment_id": "1", "order_id": "A", "amount": 60, "payment_status": "captured", "payment_method": "pix"},
            {"payment_id": "2", "order_id": "A", "amount": 50, "payment_status": "refunded", "payment_method": "boleto"},
            {"payment_id": "3", "order_id": "A", "amount": 70, "payment_status": "denied", "payment_method": "pix"},
        ],
    ))
    assert (row.items_count, row.items_distinct_item_ids, row.items_quantity, row.items_dc_count) == (3, 2, 6, 1)
    assert (row.items_total_amount, row.items_first_item_id, row.has_items) == (90, "S1", 1)
    assert (row.payments_count, row.payments_captured_count, row.payments_denied_count) == (3, 2, 1)
    assert row.payment_methods == ["boleto", "pix"]
    assert (row.authorized_amount, row.captured_amount, row.refunded_amount) == (110, 110, 50)
    assert (row.is_fully_paid, row.payment_gap_amount) == (0, 40)
    assert (row.discount_code, row.discount_code_found, row.discount_value) == ("PROMO10", 1, 10)
    assert (row.amount_mismatch_amount, row.channel_mismatch, row.bu_found) == (0, 1, 1)
    assert (row.customer_found, row.customer_since, row.customer_segment) == (0, None, "")


def test_order_without_items_payments_or_coupon_is_there(spark):
    row = only(order_360(spark, order=[{"order_id": "A", "total_amount": 5, "order_status": "canceled"}]))
    assert (row.has_items, row.items_count, row.payments_count, row.payment_methods) == (0, 0, 0, [])
    assert (row.discount_code, row.discount_code_found, row.order_status) == ("", 0, "canceled")
    assert row.payment_gap_amount == 5


def test_a_recent_item_or_payment_brings_an_old_order_into_the_window(spark):
    old, new = ago(30), ago(1)
    got = order_360(
        spark, 3,
        order=[{"order_id": o, "created_at": old} for o in "ABCDE"],
        order_item=[{"order_id": "A", "created_at": old, "updated_at": new}],
        order_payment=[
            {"payment_id": "1", "order_id": "B", "created_at": old, "updated_at": new},
            # only the superseded version of this payment is recent
            {"payment_id": "2", "order_id": "D", "created_at": old, "updated_at": new},
            {"payment_id": "2", "order_id": "D", "created_at": old, "updated_at": old},
        ],
    ).collect()
    assert sorted(r.order_id for r in got) == ["A", "B"]


# --- payments ----------------------------------------------------------------


def funnel(spark, pays, orders):
    a_lake = lake(spark, order=orders, order_payment=pays)
    return payments.payment_funnel_day(a_lake, lookups(a_lake), AS_OF, 400)


def test_three_states_of_one_attempt_count_once(spark):
    pays = [{"payment_id": "P", "order_id": "A", "acquirer": "ACQ-TEST", "payment_status": s}
            for s in ("pending", "authorized", "captured")]
    row = only(funnel(spark, pays, [{"order_id": "A"}]))
    assert (row.attempts, row.attempts_captured, row.approval_rate, row.capture_rate) == (1, 1, 1.0, 1.0)


def test_latency_ignores_what_was_never_authorized(spark):
    at = ago(1)
    pays = [{"payment_id": str(n), "order_id": f"O{n}", "created_at": at, "payment_status": "authorized",
             "authorized_at": at + timedelta(seconds=10)} for n in range(9)]
    pays.append({"payment_id": "x", "order_id": "O0", "created_at": at, "payment_status": "pending"})
    row = only(funnel(spark, pays, [{"order_id": f"O{n}"} for n in range(9)]))
    assert (row.auth_latency_p50_s, row.auth_latency_max_s, row.attempts) == (10.0, 10.0, 10)


def test_retries_of_one_order(spark):
    pays = [{"payment_id": str(n), "order_id": "A", "payment_status": s}
            for n, s in enumerate(("denied", "denied", "captured"))]
    row = only(funnel(spark, pays, [{"order_id": "A"}]))
    assert (row.attempts, row.orders_with_attempt, row.orders_captured) == (3, 1, 1)
    assert (row.max_attempts_per_order, row.orders_with_retry, row.denial_rate) == (3, 1, 2 / 3)


def test_channel_stays_in_the_grain_and_orphans_stay_out(spark):
    pays = [{"payment_id": "1", "order_id": "A"}, {"payment_id": "2", "order_id": "B"},
            {"payment_id": "3", "order_id": "GHOST"}]
    rows = funnel(spark, pays, [{"order_id": "A", "channel": "web"}, {"order_id": "B", "channel": "app"}]).collect()
    assert sorted((r.order_channel, r.attempts) for r in rows) == [("app", 1), ("web", 1)]


@pytest.mark.parametrize("n,bucket", [(0, "1"), (1, "1"), (2, "2-6"), (6, "2-6"), (7, "7-12"), (12, "7-12"), (13, "13+")])
def test_installment_buckets(spark, n, bucket):
    df = spark.createDataFrame([(n,)], "installments int")
    assert df.select(payments.installment_bucket()).first()[0] == bucket


# --- coupons -----------------------------------------------------------------


def coupons(spark, orders, codes=None):
    extra = {} if codes is None else {"discount_codes": codes}
    a_lake = lake(spark, order=orders, **extra)
    return discounts.discount_effectiveness(a_lake, lookups(a_lake), AS_OF, 90)


def test_three_spellings_are_one_code(spark):
    row = only(coupons(spark, [
        {"order_id": str(n), "discount_code": c} for n, c in enumerate(("PROMO10", "promo10", " PROMO10 "))
    ]))
    assert (row.discount_code_norm, row.orders, row.code_found) == ("PROMO10", 3, 1)


def test_unregistered_code_is_kept(spark):
    mart = coupons(spark, [{"order_id": "A", "discount_code": "CUPOM-INEXISTENTE", "created_at": ago(2)}])
    row = only(mart)
    assert (row.code_found, row.campaign_name, row.max_uses, row.valid_from) == (0, "(sem cadastro)", 0, None)
    assert (row.used_outside_validity, row.used_outside_bu_scope) == (0, 0)
    assert only(reports.unknown_coupons(mart, AS_OF)).discount_code_norm == "CUPOM-INEXISTENTE"


def test_a_swapped_coupon_counts_once(spark):
    row = only(coupons(spark, [
        {"order_id": "A", "discount_code": "PROMO10", "_cdc_seq": 10},
        {"order_id": "A", "discount_code": "PROMO20", "_cdc_seq": 20},
    ]))
    assert (row.discount_code_norm, row.orders) == ("PROMO20", 1)


def test_validity_scope_and_limit(spark):
    codes = [
        {"discount_code": "CUPOM-EXPIRADO", "valid_from": ago(100), "valid_to": ago(5)},
        {"discount_code": "CUPOM-BU", "valid_from": ago(100), "valid_to": ago(-5), "business_unit_scope": "BU-01"},
        {"discount_code": "CUPOM-LIVRE", "valid_from": ago(100), "valid_to": ago(-5), "business_unit_scope": ""},
        {"discount_code": "CUPOM-LIMITE", "valid_from": ago(100), "valid_to": ago(-5), "max_uses": 2},
    ]
    orders = [
        {"order_id": "1", "discount_code": "CUPOM-EXPIRADO"},
        {"order_id": "2", "discount_code": "CUPOM-BU", "business_unit_code": "BU-02"},
        {"order_id": "3", "discount_code": "CUPOM-LIVRE", "business_unit_code": "BU-02"},
        *[{"order_id": f"L{n}", "discount_code": "CUPOM-LIMITE", "order_status": s}
          for n, s in enumerate(("paid", "paid", "canceled"))],
    ]
    mart = coupons(spark, orders, codes)
    got = {r.discount_code_norm: (r.used_outside_validity, r.used_outside_bu_scope) for r in mart.collect()}
    assert got == {"CUPOM-EXPIRADO": (1, 0), "CUPOM-BU": (0, 1), "CUPOM-LIVRE": (0, 0), "CUPOM-LIMITE": (0, 0)}
    assert only(reports.coupons_over_limit(mart)).over_by == 1


def test_baseline_splits_valid_orders_by_coupon(spark):
    a_lake = lake(spark, order=[
        {"order_id": "1", "discount_code": "X", "total_amount": 10}, {"order_id": "2", "discount_code": "  ", "total_amount": 20},
        {"order_id": "3", "total_amount": 40}, {"order_id": "4", "discount_code": "X", "order_status": "canceled"},
    ])
    row = only(discounts.discount_baseline_day(a_lake, AS_OF, 90))
    assert (row.orders_no_coupon, row.avg_ticket_no_coupon) == (2, 30)
    assert (row.orders_with_coupon, row.avg_ticket_with_coupon) == (1, 10)


# --- margin ------------------------------------------------------------------


def one_item_margin(spark, item, prices, sold=3, **order):
    a_lake = lake(
        spark,
        order=[{"order_id": "A", "created_at": ago(sold), **order}],
        order_item=[{"order_id": "A", "item_id": item, "quantity": 2, "unit_price": 70, "total_amount": 140,
                     "created_at": ago(sold)}],
        prices=[{"item_id": item, **p} for p in prices],
    )
    return only(margin.item_margin_daily(a_lake, AS_OF, 7))


def test_price_of_the_day_of_sale(spark):
    row = one_item_margin(spark, "SKU-ASOF", [
        {"valid_from": ago(10), "list_price": 100}, {"valid_from": ago(5), "list_price": 90},
        {"valid_from": ago(1), "list_price": 80},
    ])
    assert row.revenue_at_list / row.units_sold == 90
    assert (row.price_valid_from_max, row.price_staleness_max_d) == (ago(5), 2)


@pytest.mark.parametrize("prices", [[], [{"valid_from": ago(10), "list_price": 9, "currency": "USD"}],
                                    [{"valid_from": ago(1), "list_price": 9}]])
def test_no_usable_price_is_no_margin(spark, prices):
    row = one_item_margin(spark, "SKU-FX", prices)
    assert (row.price_list_id, row.units_without_price, row.revenue_practiced) == ("(sem preco)", 2, 140)
    assert (row.revenue_at_list, row.margin_amount, row.margin_pct, row.discount_vs_list) == (0, 0, 0.0, 0)


def test_versions_of_one_validity_do_not_triple_units(spark):
    row = one_item_margin(spark, "SKU-DUP", [
        {"valid_from": ago(10), "list_price": p, "_cdc_seq": n} for n, p in enumerate((91, 93, 95))
    ])
    assert (row.units_sold, row.revenue_at_list / row.units_sold) == (2, 95)


def test_below_cost_above_list_and_canceled(spark):
    price = [{"valid_from": ago(10), "list_price": 60, "cost_price": 80}]
    row = one_item_margin(spark, "SKU-PREJUIZO", price)
    assert (row.units_below_cost, row.units_above_list, row.margin_amount) == (2, 2, -20)
    row = one_item_margin(spark, "SKU-PREJUIZO", price, order_status="canceled")
    assert (row.orders, row.units_sold, row.revenue_practiced, row.margin_pct) == (1, 0, 0, 0.0)


# --- stock -------------------------------------------------------------------


def test_unassigned_demand_is_shared_by_available_stock(spark):
    a_lake = lake(
        spark,
        order=[{"order_id": "A"}, {"order_id": "B", "order_status": "created"}],
        order_item=[
            {"order_id": "A", "item_seq": 1, "quantity": 28, "dc_id": "DC-01"},
            {"order_id": "A", "item_seq": 2, "quantity": 56, "dc_id": None},
            {"order_id": "B", "item_seq": 1, "quantity": 99},
        ],
        stock_position=[
            {"dc_id": "DC-01", "available": 30, "safety_stock": 10, "position_at": ago(0, hours=1)},
            {"dc_id": "DC-02", "available": 10, "safety_stock": 100, "position_at": ago(0, hours=1)},
            {"dc_id": "DC-03", "available": -4, "position_at": ago(0, hours=1)},
            {"item_id": "SKU-9", "dc_id": "DC-01", "available": 7, "position_at": ago(0, hours=1)},
        ],
    )
    rows = {(r.item_id, r.dc_id): r for r in stock.stock_coverage(a_lake, AS_OF).collect()}
    first, second = rows["SKU-000001", "DC-01"], rows["SKU-000001", "DC-02"]
    assert (first.demand_qty_28d, first.demand_qty_allocated_28d, first.unassigned_ratio) == (28, 70, Decimal("0.6667"))
    assert (first.coverage_days, first.coverage_days_allocated, first.days_to_safety_stock) == (30, 12, 8)
    assert (first.coverage_class, first.dc_count_for_item, first.position_age_seconds) == ("low", 3, 3600)
    assert (second.demand_qty_28d, second.demand_qty_allocated_28d, second.below_safety_stock) == (0, 14, 1)
    assert (second.coverage_days, second.days_to_safety_stock) == (None, -180)
    assert rows["SKU-000001", "DC-03"].coverage_class == "stockout"
    idle = rows["SKU-9", "DC-01"]
    assert (idle.coverage_class, idle.coverage_days_allocated) == ("no_demand", None)
    total = only(reports.unassigned_total(stock.stock_coverage(a_lake, AS_OF)))
    assert total.unassigned_units == 56


def stockouts(spark, positions, sold=1, lag_hours=0, **item):
    a_lake = lake(
        spark,
        order=[{"order_id": "A", "created_at": ago(sold)}],
        order_item=[{"order_id": "A", "created_at": ago(sold), "total_amount": 50, "quantity": 5, **item}],
        # one unrelated position keeps the topic alive
        stock_position=[{"item_id": "OTHER", "dc_id": "DC-09", "available": 5, "_kafka_ts": ago(0, hours=lag_hours)}, *positions],
    )
    return stock.stockout_candidates(a_lake, AS_OF)


def test_absence_waits_for_the_grace_time(spark):
    row = only(stockouts(spark, [], item_id="ITM-LATE-1"))
    assert (row.stockout_class, row.evidence_status, row.severity, row.dc_id) == (
        "missing_stock_record", "pending_grace", "low", "")
    row = only(stockouts(spark, [], sold=4, item_id="ITM-LATE-1"))
    assert (row.evidence_status, row.severity, row.revenue_at_risk) == ("confirmed", "high", 50)
    arrived = [{"item_id": "ITM-LATE-1", "dc_id": "DC-01", "available": 3, "_kafka_ts": ago(1)}]
    assert stockouts(spark, arrived, item_id="ITM-LATE-1").count() == 0


def test_a_deleted_position_is_a_missing_record(spark):
    gone = [{"item_id": "ITM-DISC-1", "dc_id": "DC-01", "available": 3, "_kafka_ts": ago(1)},
            {"item_id": "ITM-DISC-1", "dc_id": "DC-01", "_op": "d", "_kafka_ts": ago(1)}]
    assert only(stockouts(spark, gone, item_id="ITM-DISC-1")).stockout_class == "missing_stock_record"


def test_a_late_topic_suppresses_absence_but_not_presence(spark):
    assert only(stockouts(spark, [], sold=9, lag_hours=2, item_id="X")).evidence_status == "suppressed_topic_lag"
    zero = [{"item_id": "X", "dc_id": "DC-01", "available": 0, "_kafka_ts": ago(1)}]
    row = only(stockouts(spark, zero, lag_hours=2, item_id="X"))
    assert (row.stockout_class, row.evidence_status, row.grace_window_seconds) == ("zero_available", "confirmed", 0)
    # 7 days of sales at the mean price paid: 50 / 5 * 5
    assert (row.severity, row.revenue_at_risk) == ("high", 50)


def test_missing_centre_and_no_centre(spark):
    elsewhere = [{"item_id": "X", "dc_id": "DC-02", "available": 5, "_kafka_ts": ago(0)}]
    row = only(stockouts(spark, elsewhere, sold=5, item_id="X", dc_id="DC-01"))
    assert (row.stockout_class, row.dc_id, row.severity) == ("missing_dc_position", "DC-01", "medium")
    assert stockouts(spark, elsewhere, sold=5, item_id="X", dc_id=None).count() == 0


def test_queue_puts_high_severity_first(spark):
    w = space(
        spark,
        order=[{"order_id": "A", "created_at": ago(5)}, {"order_id": "B", "created_at": ago(20)}],
        order_item=[{"order_id": "A", "item_id": "HIGH", "total_amount": 1}, {"order_id": "B", "item_id": "MID", "total_amount": 99}],
        stock_position=[{"item_id": "OTHER", "_kafka_ts": AS_OF}],
    )
    queue = reports.stockout_queue(w.mart("stockout_candidates")).collect()
    assert [r.severity for r in queue] == ["high", "medium"]


def test_idle_classes(spark):
    item = lambda i, **kw: {"item_id": i, **kw}
    a_lake = lake(
        spark,
        order=[{"order_id": "NEW", "created_at": ago(0)}, {"order_id": "OLD", "created_at": ago(120)},
               {"order_id": "CAN", "order_status": "canceled", "created_at": ago(1)}],
        order_item=[
            {"order_id": "NEW", "item_id": "SKU-ATIVO", "created_at": ago(0)},
            {"order_id": "OLD", "item_id": "SKU-VENDA-ANTIGA", "created_at": ago(120)},
            {"order_id": "CAN", "item_id": "SKU-VENDA-CANCELADA", "created_at": ago(1)},
            {"order_id": "NEW", "item_seq": 2, "item_id": "SKU-ATIVO-SEM-PRECO", "created_at": ago(0)},
        ],
        prices=[item(i, valid_from=ago(30), list_price=10, cost_price=6) for i in (
            "SKU-ATIVO", "SKU-PARADO", "SKU-ZERO", "SKU-PRECO-SEM-POSICAO", "SKU-VENDA-ANTIGA", "SKU-VENDA-CANCELADA", "SKU-NEG")]
        + [item("SKU-EXPIRADO", valid_from=ago(30), valid_to=ago(2), list_price=10)]
        + [item("SKU-VIGENCIA", valid_from=ago(d), list_price=p) for d, p in ((30, 100), (5, 80), (-5, 60))],
        stock_position=[item(i, available=a, on_hand=a) for i, a in (
            ("SKU-ATIVO", 5), ("SKU-PARADO", 5), ("SKU-ZERO", 0), ("SKU-VENDA-ANTIGA", 5), ("SKU-VENDA-CANCELADA", 5),
            ("SKU-NEG", -2), ("SKU-EXPIRADO", 5), ("SKU-VIGENCIA", 1), ("SKU-NADA", 0), ("SKU-ATIVO-SEM-PRECO", 5))],
    )
    rows = {r.item_id: r for r in stock.idle_catalog(a_lake, AS_OF).collect()}
    assert {i: r.idle_class for i, r in rows.items()} == {
        "SKU-ATIVO": "ativo", "SKU-PARADO": "parado_com_estoque", "SKU-ZERO": "parado_sem_estoque",
        "SKU-PRECO-SEM-POSICAO": "preco_sem_posicao", "SKU-VENDA-ANTIGA": "parado_com_estoque",
        "SKU-VENDA-CANCELADA": "parado_com_estoque", "SKU-NEG": "parado_sem_estoque",
        "SKU-EXPIRADO": "estoque_sem_preco", "SKU-VIGENCIA": "parado_com_estoque",
        "SKU-NADA": "indefinido", "SKU-ATIVO-SEM-PRECO": "ativo",
    }
    assert (rows["SKU-VENDA-ANTIGA"].units_sold_90d, rows["SKU-VENDA-ANTIGA"].days_since_last_sale) == (0, 120)
    assert rows["SKU-PARADO"].days_since_last_sale is None
    assert rows["SKU-ATIVO"].days_since_last_sale == 0
    assert rows["SKU-VIGENCIA"].list_price == 80
    assert (rows["SKU-NEG"].immobilized_capital, rows["SKU-EXPIRADO"].immobilized_capital) == (-12, 0)
    missing = rows["SKU-PRECO-SEM-POSICAO"]
    assert (missing.dc_id, missing.has_stock_record, missing.position_at) == ("(sem estoque)", 0, None)


# --- customers ---------------------------------------------------------------


def test_customer_metrics(spark):
    a_lake = lake(
        spark,
        customer=[{"customer_id": c} for c in ("NONE", "ONE", "OLD", "GONE")] + [{"customer_id": "GONE", "_op": "d"}],
        order=[
            *[{"order_id": "S", "customer_id": "ONE", "order_status": s, "total_amount": 30, "created_at": ago(10)}
              for s in ("created", "paid", "invoiced", "shipped", "delivered")],
            {"order_id": "X", "customer_id": "OLD", "total_amount": 200, "created_at": ago(200)},
            {"order_id": "X", "customer_id": "OLD", "total_amount": 200, "created_at": ago(200), "order_status": "canceled"},
            {"order_id": "Y", "customer_id": "OLD", "total_amount": 50, "created_at": ago(100), "channel": "app"},
            {"order_id": "Z", "customer_id": "OLD", "total_amount": 70, "created_at": ago(95), "channel": "store"},
        ],
        order_item=[{"order_id": o, "item_id": "SAME", "quantity": 2} for o in ("Y", "Z")],
    )
    rows = {r.customer_id: r for r in customers.customer_metrics(a_lake, AS_OF).collect()}
    assert set(rows) == {"NONE", "ONE", "OLD"}
    none, one, old = rows["NONE"], rows["ONE"], rows["OLD"]
    assert (none.total_orders, none.never_purchased, none.recency_days, none.preferred_channel) == (0, 1, None, "")
    assert (one.total_orders, one.is_one_time_buyer, one.avg_days_between_orders, one.is_active_90d) == (1, 1, None, 1)
    assert (old.lifetime_net, old.orders_canceled, old.total_orders, old.avg_ticket) == (120, 1, 3, 60)
    assert (old.avg_days_between_orders, old.is_active_90d, old.recency_days) == (5.0, 0, 95)
    assert (old.distinct_items, old.items_lines_distinct, old.preferred_channel) == (1, 2, "app")


def test_cohort_counts_the_whole_cohort(spark):
    a_lake = lake(
        spark,
        customer=[{"customer_id": c} for c in "ABCD"],
        order=[{"order_id": str(n), "customer_id": c, "total_amount": 10} for n, c in enumerate("AAB")],
    )
    row = only(customers.customer_cohort(a_lake, AS_OF))
    assert (row.cohort_size, row.active_customers, row.orders, row.retention_rate) == (4, 2, 3, 0.5)
    assert (row.months_since_signup, row.revenue_per_customer) == (20, 15)


# --- quality -----------------------------------------------------------------


def orphans(spark, days=7, **entities):
    a_lake = lake(spark, **entities)
    found = health.orphan_summary(a_lake, AS_OF, days).collect()
    return {r.relation_id: r for r in found}


def test_a_young_orphan_is_normal_and_an_old_one_alarms(spark):
    item = {"order_id": "ORD-ORPHAN", "item_id": "SKU-000001"}
    row = orphans(spark, order_item=[item])["sales.order_item -> sales.order"]
    assert (row.total_rows, row.orphan_rows, row.age_ok, row.rate_ok) == (1, 1, 1, 0)
    row = orphans(spark, order_item=[{**item, "created_at": ago(4)}])["sales.order_item -> sales.order"]
    assert (row.age_ok, row.orphan_age_p99_s) == (0, 4 * 86400)
    row = orphans(spark, order_item=[item], order=[{"order_id": "ORD-ORPHAN"}])["sales.order_item -> sales.order"]
    assert (row.orphan_rows, row.age_ok, row.orphan_age_p99_s) == (0, 1, None)


def test_every_checked_relation_has_one_row_and_loose_ones_none(spark):
    found = orphans(spark)
    assert len(found) == 8
    assert not any("prices -> inventory" in r or "stock_position -> pricing" in r for r in found)


def test_coupon_relation_uses_the_clean_code_and_skips_orders_without(spark):
    row = orphans(spark, order=[
        {"order_id": "1", "discount_code": " promo10 "}, {"order_id": "2"}, {"order_id": "3", "discount_code": "NOPE"},
    ])["sales.order -> pricing.discount_codes"]
    assert (row.total_rows, row.orphan_rows) == (2, 1)


def test_a_blank_order_takes_no_part_even_where_an_order_without_a_name_exists(spark):
    items = [{"order_id": o, "item_seq": n} for n, o in enumerate(("", " ", None, "A", "GONE"))]
    row = orphans(spark, order_item=items, order=[{"order_id": ""}, {"order_id": "A"}])["sales.order_item -> sales.order"]
    assert (row.total_rows, row.orphan_rows) == (2, 1)


def test_orphan_records_carry_coordinates_and_obey_the_cap(spark):
    a_lake = lake(spark, order_item=[
        {"order_id": f"G{n}", "created_at": ago(0, hours=n), "_partition": 3, "_offset": 70 + n} for n in range(5)])
    got = health.orphan_records(a_lake, AS_OF, 7, limit=2)
    rows = got.where(F.col("relation_id") == "sales.order_item -> sales.order").orderBy("first_seen_at").collect()
    assert [(r.orphan_key, r.missing_key, r.sample_offset) for r in rows] == [("G4|1", "G4", 74), ("G3|1", "G3", 73)]


def test_panel_has_every_entity_and_no_message_is_not_fresh(spark):
    a_lake = lake(spark, order=[{"order_id": "A", "_kafka_ts": ago(0, minutes=20)}])
    rows = {r.entity: r for r in health.data_quality_overview(a_lake, AS_OF).collect()}
    assert len(rows) == 8
    assert (rows["order"].freshness_seconds, rows["order"].freshness_ok) == (1200, 0)
    assert (rows["prices"].freshness_seconds, rows["prices"].freshness_ok) == (None, 0)
    assert rows["order"].reconcile_ok == 1


def test_lost_core_rows_show_up_as_a_difference(spark):
    a_lake = lake(spark, order=[{"order_id": str(n)} for n in range(12)])
    a_lake._core["order"] = a_lake.core("order").where(F.col("order_id").cast("int") < 2)
    rows = {r.entity: r for r in health.data_quality_overview(a_lake, AS_OF).collect()}
    assert (rows["order"].reconcile_diff, rows["order"].reconcile_ok) == (10, 0)


def test_alerts_and_gate(spark):
    w = space(spark, order=[{"order_id": "A"}])
    alerts = reports.dq_alerts(w.mart("dq_overview"), w.mart("orphan_summary"))
    kinds = {(r.kind, r.entity) for r in alerts.collect()}
    assert ("freshness", "order") in kinds and ("orphan_rate", "order") in kinds
    gate = only(reports.data_health(alerts))
    assert gate.healthy == 0 and gate.n_alerts >= 2
    assert only(reports.data_health(alerts.limit(0))).healthy == 1


def test_money_is_never_floating_point(spark):
    w = space(spark)
    for name in w._builders:
        assert quality.float_money_columns(w.mart(name)) == [], name
    bad = spark.createDataFrame([(1.0, 0.5)], "net_amount double, discount_pct double")
    assert quality.float_money_columns(bad) == ["net_amount"]
    good = w.mart("revenue_by_bu_day")
    assert set(quality.MONEY_MARTS) == {n for n in w._builders if quality.money_columns(w.mart(n))}
    got = only(quality.float_money({"good": good, "bad": bad.union(bad)}))
    assert (got.value, got.details) == (2, "bad.net_amount")
    got = only(quality.float_money({"good": good}))
    assert (got.value, got.details) == (0, None)


def test_history_of_checks_keeps_one_row_per_run_and_tells_since_when(spark):
    w = space(spark, order=[{"order_id": "A", "total_amount": 10}, {"order_id": "B", "total_amount": 5}])
    root, path = scratch(spark, "marts"), scratch(spark, "checks")
    w.store(root, "order_360")
    good = w.mart("order_360")
    assert good.inputFiles() and good.count() == 2
    ids = ["marts.order_360.grain", "customer.signup_after_first_order"]
    instants = [AS_OF + timedelta(minutes=5 * n) for n in range(5)]
    for at, damaged in zip(instants, (True, False, True, True, True)):
        w._marts["order_360"] = good.unionAll(good) if damaged else good
        for _ in range(2):  # a run that is repeated replaces itself
            quality.record(quality.run_checks(w, at, ids), path, at)
    kept = quality.history(spark, path)
    assert kept.count() == 10
    got = {r.check_id: r for r in quality.standing(kept).collect()}
    grain = got[ids[0]]
    assert (grain.runs, grain.failed_runs, grain.turns, grain.failing_since, grain.last_run_at) == (5, 4, 2, instants[2], instants[4])
    assert (grain.severity, grain.value, grain.passed, grain.details) == ("error", 2.0, 0, "violated: lte 0.0")
    empty = got[ids[1]]
    assert (empty.failed_runs, empty.turns, empty.failing_since, empty.value, empty.details) == (0, 0, None, None, "nothing to measure")
    w._marts["order_360"] = good
    last = instants[4] + timedelta(minutes=5)
    quality.record(quality.run_checks(w, last, ids), path, last)
    assert {r.check_id: r.failing_since for r in quality.standing(quality.history(spark, path)).collect()} == dict.fromkeys(ids)


def test_checks_fail_when_a_mart_is_damaged(spark):
    w = space(spark, order=[{"order_id": "A", "total_amount": 10, "customer_id": "C"}],
              customer=[{"customer_id": "C"}])
    ids = ["marts.sum_parity.revenue", "marts.order_360.grain", "marts.row_parity"]
    good = {r.check_id: r.passed for r in quality.run_checks(w, AS_OF, ids).collect()}
    assert good == dict.fromkeys(ids, 1)
    for mart in ("revenue_by_bu_day", "order_360", "customer_metrics"):
        w._marts[mart] = w.mart(mart).unionAll(w.mart(mart))
    bad = {r.check_id: r.passed for r in quality.run_checks(w, AS_OF, ids).collect()}
    assert bad == dict.fromkeys(ids, 0)


@pytest.mark.parametrize("comparator,value,passed", [
    ("lte", 1, 1), ("lte", 2, 0), ("gte", 1, 1), ("gte", 0, 0), ("eq", 1, 1), ("eq", 2, 0), ("neq", 2, 1), ("neq", 1, 0)])
def test_comparators(spark, comparator, value, passed):
    frame = spark.createDataFrame([(value,)], "value int")
    item = quality.Check("x", "warn", comparator, 1, lambda w: frame)
    assert only(quality.run_check(item, None, AS_OF)).passed == passed
