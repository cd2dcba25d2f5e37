"""The marts as SQL over the entity expressions."""

from oracle.compose import define, exact, money, per_unit, rate
from oracle.entities import COLUMNS, CONTEXT, KEYS, SLA

SALES = "TIMESTAMP '2001-08-02 00:00:00'"
PAYMENTS = "TIMESTAMP '2024-01-31 00:00:00'"
WIDE = 3650


def day(as_of: str, days: int) -> str:
    return f"(CAST(CAST({as_of} AS DATE) - {days} AS TIMESTAMP))"


def ago(as_of: str, days: int) -> str:
    return f"({as_of} - INTERVAL {days} DAY)"


def secs(a: str, b: str) -> str:
    return f"date_diff('second', {a}, {b})"


def order_360(days: int | None) -> str:
    cut = ago(SALES, days) if days is not None else None
    touched = (
        f"""WHERE o.updated_at >= {cut} OR i.touched >= {cut} OR p.touched >= {cut}"""
        if cut
        else ""
    )
    paid = "(COALESCE(p.captured_amount, 0) - COALESCE(p.refunded_amount, 0))"
    code = "upper(trim(COALESCE(o.discount_code, '')))"
    d = "DECIMAL(18,4)"
    return f"""
SELECT o.order_id, o.customer_id, o.business_unit_code, o.order_status, o.channel, o.currency,
  {code} AS discount_code, o.gross_amount, o.discount_amount, o.freight_amount, o.total_amount,
  o.created_at AS order_created_at, o.updated_at AS order_updated_at,
  COALESCE(i.items_count, 0) AS items_count, COALESCE(i.items_distinct_item_ids, 0) AS items_distinct_item_ids,
  CAST(COALESCE(i.items_quantity, 0) AS BIGINT) AS items_quantity,
  CAST(COALESCE(i.gross, 0) AS {d}) AS items_gross_amount, CAST(COALESCE(i.disc, 0) AS {d}) AS items_discount_amount,
  CAST(COALESCE(i.total, 0) AS {d}) AS items_total_amount, COALESCE(i.items_dc_count, 0) AS items_dc_count,
  COALESCE(i.items_first_item_id, '') AS items_first_item_id,
  CAST(CASE WHEN i.items_count > 0 THEN 1 ELSE 0 END AS INTEGER) AS has_items,
  COALESCE(p.n, 0) AS payments_count, COALESCE(p.n_captured, 0) AS payments_captured_count,
  COALESCE(p.n_denied, 0) AS payments_denied_count, COALESCE(p.n_pending, 0) AS payments_pending_count,
  COALESCE(p.methods, '') AS payment_methods,
  CAST(COALESCE(p.authorized_amount, 0) AS {d}) AS authorized_amount,
  CAST(COALESCE(p.captured_amount, 0) AS {d}) AS captured_amount,
  CAST(COALESCE(p.refunded_amount, 0) AS {d}) AS refunded_amount,
  p.first_authorized_at, p.last_captured_at,
  CAST(CASE WHEN {paid} >= o.total_amount THEN 1 ELSE 0 END AS INTEGER) AS is_fully_paid,
  CAST(o.total_amount - {paid} AS {d}) AS payment_gap_amount,
  CAST(CASE WHEN c.customer_id IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS customer_found,
  COALESCE(c.first_name, '') AS customer_first_name, COALESCE(c.segment, '') AS customer_segment,
  COALESCE(c.loyalty_tier, '') AS customer_loyalty_tier, COALESCE(c.city, '') AS customer_city,
  COALESCE(c.state, '') AS customer_state, c.customer_since,
  CAST(CASE WHEN b.bu_code IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS bu_found,
  COALESCE(b.bu_name, '') AS bu_name, COALESCE(b.channel, '') AS bu_channel, COALESCE(b.region, '') AS bu_region,
  CAST(CASE WHEN b.active THEN 1 ELSE 0 END AS INTEGER) AS bu_active,
  CAST(CASE WHEN k.discount_code IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS discount_code_found,
  COALESCE(k.campaign_name, '') AS discount_campaign_name, COALESCE(k.discount_type, '') AS discount_type,
  CAST(COALESCE(k.discount_value, 0) AS {d}) AS discount_value,
  CAST(o.total_amount - (COALESCE(i.total, 0) + o.freight_amount) AS {d}) AS amount_mismatch_amount,
  CAST(CASE WHEN b.bu_code IS NOT NULL AND o.channel <> b.channel THEN 1 ELSE 0 END AS INTEGER) AS channel_mismatch,
  CAST(epoch_ms({SALES}) AS BIGINT) AS _mart_version, {SALES} AS _refreshed_at
FROM order_now o
LEFT JOIN (
  SELECT order_id, count(*) AS items_count, count(DISTINCT item_id) AS items_distinct_item_ids,
    sum(quantity) AS items_quantity, sum(gross_amount) AS gross, sum(discount_amount) AS disc, sum(total_amount) AS total,
    count(DISTINCT dc_id) AS items_dc_count, arg_min(item_id, item_seq) AS items_first_item_id, max(updated_at) AS touched
  FROM order_item_now GROUP BY order_id) i ON i.order_id = o.order_id
LEFT JOIN (
  SELECT order_id, count(*) AS n,
    count(*) FILTER (payment_status IN ('captured', 'refunded')) AS n_captured,
    count(*) FILTER (payment_status = 'denied') AS n_denied,
    count(*) FILTER (payment_status = 'pending') AS n_pending,
    string_agg(DISTINCT payment_method, ',' ORDER BY payment_method) AS methods,
    sum(amount) FILTER (payment_status IN ('authorized', 'captured', 'refunded')) AS authorized_amount,
    sum(amount) FILTER (payment_status IN ('captured', 'refunded')) AS captured_amount,
    sum(amount) FILTER (payment_status = 'refunded') AS refunded_amount,
    min(authorized_at) AS first_authorized_at, max(captured_at) AS last_captured_at, max(updated_at) AS touched
  FROM order_payment_now GROUP BY order_id) p ON p.order_id = o.order_id
LEFT JOIN customer_now c ON c.customer_id = o.customer_id
LEFT JOIN business_unit_now b ON b.bu_code = o.business_unit_code
LEFT JOIN discount_codes_now k ON k.discount_code = {code}
{touched}
"""


def revenue(days: int) -> str:
    w = day(SALES, days)
    ok = "o.order_status <> 'canceled'"
    return f"""
SELECT CAST(o.created_at AS DATE) AS order_date, o.business_unit_code,
  COALESCE(b.bu_name, '(sem cadastro)') AS bu_name, COALESCE(b.channel, 'unknown') AS bu_channel,
  COALESCE(b.region, 'unknown') AS bu_region, o.channel AS order_channel, o.currency,
  count(DISTINCT o.order_id) AS orders,
  count(DISTINCT CASE WHEN NOT ({ok}) THEN o.order_id END) AS orders_canceled,
  CAST(sum(COALESCE(i.units, 0)) AS BIGINT) AS units_sold, CAST(sum(COALESCE(i.items, 0)) AS BIGINT) AS items_count,
  count(DISTINCT o.customer_id) AS distinct_customers,
  {money(f"sum(o.gross_amount) FILTER ({ok})")} AS gross_revenue,
  {money(f"sum(o.discount_amount) FILTER ({ok})")} AS discount_total,
  {money(f"sum(o.freight_amount) FILTER ({ok})")} AS freight_total,
  {money(f"sum(o.total_amount) FILTER ({ok})")} AS net_revenue,
  {per_unit(f"COALESCE(sum(o.total_amount) FILTER ({ok}), 0)", f"count(*) FILTER ({ok})")} AS avg_ticket,
  CAST(max(CASE WHEN b.bu_code IS NOT NULL THEN 1 ELSE 0 END) AS INTEGER) AS _bu_found,
  {SALES} AS _refreshed_at
FROM order_now o
LEFT JOIN (SELECT order_id, sum(quantity) AS units, count(*) AS items FROM order_item_now
           WHERE created_at >= {w} GROUP BY order_id) i USING (order_id)
LEFT JOIN business_unit_now b ON b.bu_code = o.business_unit_code
WHERE o.created_at >= {w}
GROUP BY 1, 2, 3, 4, 5, 6, 7
"""


def funnel(days: int) -> str:
    w = day(PAYMENTS, days)
    lat = secs("p.created_at", "p.authorized_at")

    def n(s):
        return f"count(*) FILTER (p.payment_status = '{s}')"

    approved = "count(*) FILTER (p.payment_status IN ('authorized', 'captured'))"
    q = ", ".join(
        f"quantile_cont({lat}, {v}) AS auth_latency_p{k}_s" for k, v in ((50, 0.5), (95, 0.95), (99, 0.99))
    )
    return f"""
SELECT CAST(p.created_at AS DATE) AS attempt_date, o.business_unit_code,
  COALESCE(b.bu_name, '(sem cadastro)') AS bu_name, o.channel AS order_channel, p.payment_method, p.acquirer,
  CASE WHEN p.installments <= 1 THEN '1' WHEN p.installments <= 6 THEN '2-6'
       WHEN p.installments <= 12 THEN '7-12' ELSE '13+' END AS installment_bucket,
  o.currency, count(*) AS attempts,
  {n("pending")} AS attempts_pending, {n("authorized")} AS attempts_authorized, {n("captured")} AS attempts_captured,
  {n("denied")} AS attempts_denied, {n("refunded")} AS attempts_refunded,
  count(DISTINCT p.order_id) AS orders_with_attempt,
  count(DISTINCT CASE WHEN p.payment_status = 'captured' THEN p.order_id END) AS orders_captured,
  {money("sum(p.amount)")} AS amount_attempted,
  {money("sum(p.amount) FILTER (p.payment_status = 'captured')")} AS amount_captured,
  {money("sum(p.amount) FILTER (p.payment_status = 'refunded')")} AS amount_refunded,
  {rate(approved, "count(*)")} AS approval_rate, {rate(n("captured"), approved)} AS capture_rate,
  {rate(n("denied"), "count(*)")} AS denial_rate,
  {q}, CAST(max({lat}) AS DOUBLE) AS auth_latency_max_s,
  CAST(max(a.n) AS BIGINT) AS max_attempts_per_order,
  count(DISTINCT CASE WHEN a.n > 1 THEN p.order_id END) AS orders_with_retry,
  {PAYMENTS} AS _refreshed_at
FROM order_payment_now p JOIN order_now o USING (order_id)
JOIN (SELECT order_id, count(*) AS n FROM order_payment_now WHERE created_at >= {w} GROUP BY order_id) a USING (order_id)
LEFT JOIN business_unit_now b ON b.bu_code = o.business_unit_code
WHERE p.created_at >= {w}
GROUP BY 1, 2, 3, 4, 5, 6, 7, 8
"""


def effectiveness(days: int) -> str:
    w = day(SALES, days)
    ok = "o.order_status <> 'canceled'"
    return f"""
SELECT CAST(o.created_at AS DATE) AS order_date, upper(trim(o.discount_code)) AS discount_code_norm,
  min(o.discount_code) AS discount_code_raw, o.business_unit_code,
  CAST(CASE WHEN k.discount_code IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS code_found,
  COALESCE(k.campaign_name, '(sem cadastro)') AS campaign_name, COALESCE(k.discount_type, 'unknown') AS discount_type,
  CAST(COALESCE(k.discount_value, 0) AS DECIMAL(18,4)) AS discount_value, k.valid_from, k.valid_to,
  COALESCE(k.max_uses, 0) AS max_uses, COALESCE(k.business_unit_scope, '') AS bu_scope,
  count(*) FILTER (o.created_at < k.valid_from OR o.created_at > k.valid_to) AS used_outside_validity,
  count(*) FILTER (COALESCE(k.business_unit_scope, '') <> '' AND k.business_unit_scope <> o.business_unit_code)
    AS used_outside_bu_scope,
  count(DISTINCT o.order_id) AS orders,
  count(DISTINCT CASE WHEN NOT ({ok}) THEN o.order_id END) AS orders_canceled,
  CAST(sum(COALESCE(i.units, 0)) AS BIGINT) AS units_sold,
  {money(f"sum(o.gross_amount) FILTER ({ok})")} AS gross_amount,
  {money(f"sum(o.discount_amount) FILTER ({ok})")} AS discount_amount,
  {money(f"sum(o.total_amount) FILTER ({ok})")} AS net_amount,
  {per_unit(f"COALESCE(sum(o.total_amount) FILTER ({ok}), 0)", f"count(*) FILTER ({ok})")} AS avg_ticket,
  {rate(f"COALESCE(sum(o.discount_amount) FILTER ({ok}), 0)", f"COALESCE(sum(o.gross_amount) FILTER ({ok}), 0)")}
    AS discount_pct_effective,
  {SALES} AS _refreshed_at
FROM order_now o
LEFT JOIN (SELECT order_id, sum(quantity) AS units FROM order_item_now WHERE created_at >= {w} GROUP BY order_id) i
  USING (order_id)
LEFT JOIN discount_codes_now k ON k.discount_code = upper(trim(o.discount_code))
WHERE o.created_at >= {w} AND o.discount_code IS NOT NULL AND trim(o.discount_code) <> ''
GROUP BY 1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12
"""


def baseline(days: int) -> str:
    ok = "order_status <> 'canceled'"
    c = "(discount_code IS NOT NULL AND trim(discount_code) <> '')"
    no, yes = f"{ok} AND NOT {c}", f"{ok} AND {c}"
    return f"""
SELECT CAST(created_at AS DATE) AS order_date, business_unit_code,
  count(*) FILTER ({no}) AS orders_no_coupon, {money(f"sum(total_amount) FILTER ({no})")} AS net_no_coupon,
  {per_unit(f"COALESCE(sum(total_amount) FILTER ({no}), 0)", f"count(*) FILTER ({no})")} AS avg_ticket_no_coupon,
  count(*) FILTER ({yes}) AS orders_with_coupon, {money(f"sum(total_amount) FILTER ({yes})")} AS net_with_coupon,
  {per_unit(f"COALESCE(sum(total_amount) FILTER ({yes}), 0)", f"count(*) FILTER ({yes})")} AS avg_ticket_with_coupon,
  {SALES} AS _refreshed_at
FROM order_now WHERE created_at >= {day(SALES, days)} GROUP BY 1, 2
"""


def priced(days: int) -> str:
    return f"""
SELECT s.*, p.price_list_id, p.list_price, p.cost_price, p.valid_from AS price_valid_from
FROM (SELECT i.order_id, i.item_seq, i.item_id, i.quantity, i.unit_price, i.total_amount, i.created_at,
        o.business_unit_code, o.currency, o.order_status
      FROM order_item_now i JOIN order_now o USING (order_id) WHERE i.created_at >= {day(SALES, days)}) s
ASOF LEFT JOIN (
  SELECT item_id, currency, valid_from, max(price_list_id) AS price_list_id,
    arg_max(list_price, price_list_id) AS list_price, arg_max(cost_price, price_list_id) AS cost_price
  FROM prices_now GROUP BY item_id, currency, valid_from) p
ON s.item_id = p.item_id AND s.currency = p.currency AND s.created_at >= p.valid_from
"""


def margin(days: int, source: str | None = None) -> str:
    src = source or f"({priced(days)})"
    ok = "order_status <> 'canceled'"
    pr = f"{ok} AND price_valid_from IS NOT NULL"
    rev = f"COALESCE(sum(total_amount) FILTER ({pr}), 0)"
    lst = f"COALESCE(sum(quantity * list_price) FILTER ({pr}), 0)"
    cst = f"COALESCE(sum(quantity * cost_price) FILTER ({pr}), 0)"

    def minus(a, b):
        return f"(CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"

    def units(c):
        return f"CAST(COALESCE(sum(quantity) FILTER ({c}), 0) AS BIGINT)"

    return f"""
SELECT CAST(created_at AS DATE) AS order_date, item_id, business_unit_code,
  COALESCE(price_list_id, '(sem preco)') AS price_list_id, currency,
  count(DISTINCT order_id) AS orders, {units(ok)} AS units_sold,
  {money(f"sum(total_amount) FILTER ({ok})")} AS revenue_practiced,
  {money(lst)} AS revenue_at_list, {money(cst)} AS cost_total,
  CAST({lst} - {rev} AS DECIMAL(38,4)) AS discount_vs_list, {minus(rev, lst)} AS discount_vs_list_pct,
  CAST({rev} - {cst} AS DECIMAL(38,4)) AS margin_amount, {minus(cst, rev)} AS margin_pct,
  {units(f"{ok} AND price_valid_from IS NULL")} AS units_without_price,
  {units(f"{pr} AND unit_price < cost_price")} AS units_below_cost,
  {units(f"{pr} AND unit_price > list_price")} AS units_above_list,
  min(price_valid_from) AS price_valid_from_min, max(price_valid_from) AS price_valid_from_max,
  CAST(max(date_diff('day', price_valid_from, created_at)) AS INTEGER) AS price_staleness_max_d,
  {SALES} AS _refreshed_at
FROM {src} x GROUP BY 1, 2, 3, 4, 5
"""


BILLABLE = "('paid', 'invoiced', 'shipped', 'delivered')"


def coverage(days: int) -> str:
    w, w7 = ago(SALES, days), ago(SALES, 7)
    base = f"""FROM order_item_now i JOIN order_now o USING (order_id)
    WHERE o.created_at >= {w} AND o.order_status IN {BILLABLE}"""
    share = (
        f"CASE WHEN t.item_available > 0 THEN "
        f"{exact('CAST(greatest(s.available, 0) AS DECIMAL(18,4))', 'CAST(t.item_available AS DECIMAL(18,4))', 6, 6)} "
        f"ELSE {exact('CAST(1 AS DECIMAL(18,4))', 'CAST(t.n AS DECIMAL(18,4))', 6, 6)} END"
    )
    a = "DECIMAL(18,4)"
    return f"""
SELECT dc_id, item_id, dc_name, on_hand, reserved, available, safety_stock, position_at,
  CAST(greatest({secs("position_at", SALES)}, 0) AS BIGINT) AS position_age_seconds,
  demand_qty_28d, demand_qty_7d, demand_qty_unassigned_28d, dc_count_for_item, demand_qty_allocated_28d,
  unassigned_ratio, avg_daily_demand_28d, avg_daily_demand_alloc_28d,
  CAST(CASE WHEN avg_daily_demand_28d > 0 THEN {exact("greatest(available, 0)", "avg_daily_demand_28d", 2)} END AS {a}) AS coverage_days,
  coverage_days_allocated,
  CAST(CASE WHEN avg_daily_demand_alloc_28d > 0 THEN {exact("(available - safety_stock)", "avg_daily_demand_alloc_28d", 2)} END AS {a})
    AS days_to_safety_stock,
  CAST(CASE WHEN available < safety_stock THEN 1 ELSE 0 END AS INTEGER) AS below_safety_stock,
  CASE WHEN available <= 0 THEN 'stockout' WHEN avg_daily_demand_alloc_28d = 0 THEN 'no_demand'
       WHEN coverage_days_allocated < 7 THEN 'critical' WHEN coverage_days_allocated < 21 THEN 'low'
       WHEN coverage_days_allocated < 90 THEN 'healthy' ELSE 'excess' END AS coverage_class,
  {w} AS demand_basis_from, {SALES} AS demand_basis_to, {SALES} AS refreshed_at
FROM (
  SELECT y.*, CAST(CASE WHEN avg_daily_demand_alloc_28d > 0
      THEN {exact("greatest(available, 0)", "avg_daily_demand_alloc_28d", 2)} END AS {a}) AS coverage_days_allocated
  FROM (
    SELECT x.*, CAST({exact("demand_qty_allocated_28d", str(days))} AS {a}) AS avg_daily_demand_alloc_28d
    FROM (
      SELECT s.*, CAST(COALESCE(d.q, 0) AS BIGINT) AS demand_qty_28d, CAST(COALESCE(d.q7, 0) AS BIGINT) AS demand_qty_7d,
        CAST(COALESCE(u.q, 0) AS BIGINT) AS demand_qty_unassigned_28d, t.n AS dc_count_for_item,
        CAST(CAST(COALESCE(d.q, 0) AS {a}) + CAST(COALESCE(u.q, 0) AS DECIMAL(12,0)) * CAST(({share}) AS DECIMAL(12,6)) AS {a})
          AS demand_qty_allocated_28d,
        CAST(CASE WHEN COALESCE(m.q, 0) + COALESCE(u.q, 0) > 0
          THEN {exact("COALESCE(u.q, 0)", "(COALESCE(m.q, 0) + COALESCE(u.q, 0))")} ELSE 0 END AS {a}) AS unassigned_ratio,
        CAST({exact("COALESCE(d.q, 0)", str(days))} AS {a}) AS avg_daily_demand_28d
      FROM stock_position_now s
      JOIN (SELECT item_id, sum(greatest(available, 0)) AS item_available, count(*) AS n FROM stock_position_now GROUP BY 1) t
        ON t.item_id = s.item_id
      LEFT JOIN (SELECT i.item_id, i.dc_id, sum(i.quantity) AS q, COALESCE(sum(i.quantity) FILTER (o.created_at >= {w7}), 0) AS q7
                 {base} AND i.dc_id IS NOT NULL AND i.dc_id <> '' GROUP BY 1, 2) d
        ON d.item_id = s.item_id AND d.dc_id = s.dc_id
      LEFT JOIN (SELECT i.item_id, sum(i.quantity) AS q {base} AND (i.dc_id IS NULL OR i.dc_id = '') GROUP BY 1) u
        ON u.item_id = s.item_id
      LEFT JOIN (SELECT i.item_id, sum(i.quantity) AS q {base} AND i.dc_id IS NOT NULL AND i.dc_id <> '' GROUP BY 1) m
        ON m.item_id = s.item_id
    ) x
  ) y
) z
"""


def stockout(days: int) -> str:
    w, w7 = ago(SALES, days), ago(SALES, 7)

    def sold(extra, group):
        return f"""SELECT {group}, min(o.created_at) AS first_sale_at, max(o.created_at) AS last_sale_at,
      count(DISTINCT i.order_id) AS orders_affected,
      CAST(COALESCE(sum(i.quantity) FILTER (o.created_at >= {w7}), 0) AS BIGINT) AS units_sold_7d,
      CAST(sum(i.quantity) AS BIGINT) AS units_sold_28d, sum(i.total_amount) AS revenue
    FROM order_item_now i JOIN order_now o USING (order_id)
    WHERE o.created_at >= {w} AND o.order_status IN {BILLABLE} {extra} GROUP BY {group}"""

    item = sold("", "i.item_id")
    item_dc = sold("AND i.dc_id IS NOT NULL AND i.dc_id <> ''", "i.item_id, i.dc_id")
    a = "DECIMAL(18,4)"
    prospect = f"CAST({exact('revenue', 'greatest(units_sold_28d, 1)')} AS DECIMAL(20,4)) * CAST(units_sold_7d AS DECIMAL(12,0))"
    return f"""
SELECT stockout_class, item_id, dc_id, CAST(CASE WHEN dc_id = '' THEN 0 ELSE 1 END AS INTEGER) AS dc_known,
  first_sale_at, last_sale_at, age AS evidence_age_seconds,
  CAST(greatest({secs("last_sale_at", SALES)}, 0) AS BIGINT) AS last_sale_age_seconds,
  orders_affected, units_sold_7d, units_sold_28d, revenue_at_risk, available, safety_stock, position_at,
  lag AS inventory_lag_seconds,
  CAST(CASE WHEN stockout_class = 'zero_available' THEN 0 ELSE 259200 END AS INTEGER) AS grace_window_seconds,
  evidence_status,
  CASE WHEN evidence_status <> 'confirmed' THEN 'low'
       WHEN stockout_class = 'missing_dc_position' THEN CASE WHEN units_sold_7d > 0 THEN 'medium' ELSE 'low' END
       WHEN units_sold_7d > 0 THEN 'high' ELSE 'medium' END AS severity,
  {SALES} AS refreshed_at
FROM (
  SELECT f.*, CASE WHEN stockout_class = 'zero_available' THEN 'confirmed' WHEN lag > 3600 THEN 'suppressed_topic_lag'
              WHEN age < 259200 THEN 'pending_grace' ELSE 'confirmed' END AS evidence_status
  FROM (
    SELECT u.*, CAST(greatest({secs("first_sale_at", SALES)}, 0) AS BIGINT) AS age,
      (SELECT CAST(greatest({secs("max(_kafka_ts)", SALES)}, 0) AS BIGINT) FROM stock_position_raw) AS lag
    FROM (
      SELECT 'missing_stock_record' AS stockout_class, item_id, '' AS dc_id, first_sale_at, last_sale_at, orders_affected,
        units_sold_7d, units_sold_28d, CAST(revenue AS {a}) AS revenue_at_risk, CAST(NULL AS BIGINT) AS available,
        CAST(NULL AS BIGINT) AS safety_stock, CAST(NULL AS TIMESTAMP) AS position_at
      FROM ({item}) s WHERE NOT EXISTS (SELECT 1 FROM stock_position_now k WHERE k.item_id = s.item_id)
      UNION ALL
      SELECT 'zero_available', st.item_id, st.dc_id, first_sale_at, last_sale_at, orders_affected, units_sold_7d, units_sold_28d,
        CAST(CASE WHEN units_sold_7d <= 0 THEN 0 ELSE {prospect} END AS {a}),
        st.available, st.safety_stock, st.position_at
      FROM stock_position_now st JOIN ({item}) s USING (item_id) WHERE st.available <= 0 AND s.last_sale_at >= {w7}
      UNION ALL
      SELECT 'missing_dc_position', item_id, dc_id, first_sale_at, last_sale_at, orders_affected, units_sold_7d, units_sold_28d,
        CAST(revenue AS {a}), NULL, NULL, NULL
      FROM ({item_dc}) s
      WHERE NOT EXISTS (SELECT 1 FROM stock_position_now k WHERE k.item_id = s.item_id AND k.dc_id = s.dc_id)
        AND EXISTS (SELECT 1 FROM stock_position_now k WHERE k.item_id = s.item_id)
    ) u
  ) f
) g
"""


PRICE_AT = f"""
SELECT item_id, price_list_id, currency, list_price, cost_price, valid_from AS price_valid_from
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY valid_from DESC, price_list_id DESC) AS rn
      FROM prices_now WHERE valid_from <= {SALES} AND (valid_to IS NULL OR valid_to >= {SALES})) v
WHERE rn = 1
"""


def idle(days: int) -> str:
    w = ago(SALES, days)
    return f"""
SELECT item_id, dc_id, has_price, price_list_id, currency, list_price, cost_price, price_valid_from, has_stock_record,
  on_hand, reserved, available, safety_stock, position_at, units_sold_90d, orders_90d, last_sale_at,
  CAST(date_diff('day', last_sale_at, {SALES}) AS INTEGER) AS days_since_last_sale,
  CASE WHEN units_sold_90d > 0 THEN 'ativo'
       WHEN has_price = 1 AND has_stock_record = 1 AND available > 0 THEN 'parado_com_estoque'
       WHEN has_price = 1 AND has_stock_record = 1 THEN 'parado_sem_estoque'
       WHEN has_price = 1 THEN 'preco_sem_posicao'
       WHEN has_stock_record = 1 AND available > 0 THEN 'estoque_sem_preco' ELSE 'indefinido' END AS idle_class,
  CAST(CASE WHEN has_price = 1 AND has_stock_record = 1 THEN CAST(available AS DECIMAL(18,0)) * cost_price ELSE 0 END AS DECIMAL(38,4)) AS immobilized_capital,
  CAST(CASE WHEN has_price = 1 AND has_stock_record = 1 THEN CAST(available AS DECIMAL(18,0)) * list_price ELSE 0 END AS DECIMAL(38,4)) AS potential_revenue,
  {SALES} AS _refreshed_at
FROM (
  SELECT COALESCE(s.item_id, p.item_id) AS item_id, COALESCE(s.dc_id, '(sem estoque)') AS dc_id,
    CAST(CASE WHEN p.item_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS has_price,
    CAST(CASE WHEN s.item_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS has_stock_record,
    COALESCE(p.price_list_id, '(sem preco)') AS price_list_id, COALESCE(p.currency, '') AS currency,
    CAST(COALESCE(p.list_price, 0) AS DECIMAL(18,4)) AS list_price, CAST(COALESCE(p.cost_price, 0) AS DECIMAL(18,4)) AS cost_price,
    p.price_valid_from, COALESCE(s.on_hand, 0) AS on_hand, COALESCE(s.reserved, 0) AS reserved,
    COALESCE(s.available, 0) AS available, COALESCE(s.safety_stock, 0) AS safety_stock, s.position_at,
    CAST(COALESCE(d.units, 0) AS BIGINT) AS units_sold_90d, COALESCE(d.orders, 0) AS orders_90d, d.last_sale_at
  FROM stock_position_now s FULL OUTER JOIN ({PRICE_AT}) p ON s.item_id = p.item_id
  LEFT JOIN (
    SELECT i.item_id, sum(i.quantity) FILTER (i.created_at >= {w}) AS units,
      count(DISTINCT CASE WHEN i.created_at >= {w} THEN i.order_id END) AS orders, max(i.created_at) AS last_sale_at
    FROM order_item_now i JOIN order_now o USING (order_id) WHERE o.order_status <> 'canceled' GROUP BY 1
  ) d ON d.item_id = COALESCE(s.item_id, p.item_id)
) c
"""


_ok = "o.order_status <> 'canceled'"
CUSTOMERS = f"""
SELECT c.customer_id, c.segment, c.loyalty_tier, c.state, c.city, c.customer_since,
  CAST(date_trunc('month', c.customer_since) AS DATE) AS cohort_month,
  COALESCE(o.n, 0) AS total_orders, COALESCE(o.n_canceled, 0) AS orders_canceled,
  CAST(COALESCE(i.units, 0) AS BIGINT) AS total_units, COALESCE(i.items, 0) AS distinct_items,
  COALESCE(i.lines, 0) AS items_lines_distinct,
  {money("o.gross")} AS lifetime_gross, {money("o.disc")} AS lifetime_discount, {money("o.net")} AS lifetime_net,
  {per_unit("COALESCE(o.net, 0)", "COALESCE(o.n_valid, 0)")} AS avg_ticket, {money("o.top")} AS max_ticket,
  o.first_order_at, o.last_order_at,
  CAST(date_diff('day', o.last_order_at, {SALES}) AS INTEGER) AS recency_days,
  CAST(date_diff('day', CAST(c.customer_since AS TIMESTAMP), o.first_order_at) AS INTEGER) AS days_to_first_order,
  CASE WHEN o.n_valid >= 2 THEN CAST(date_diff('day', o.first_order_at, o.last_order_at) AS DOUBLE) / CAST(o.n_valid - 1 AS DOUBLE) END
    AS avg_days_between_orders,
  COALESCE(o.units, 0) AS distinct_business_units, COALESCE(o.channels, 0) AS distinct_channels,
  COALESCE(o.n_coupon, 0) AS orders_with_coupon, COALESCE(f.channel, '') AS preferred_channel,
  CAST(CASE WHEN o.last_order_at >= {ago(SALES, 90)} THEN 1 ELSE 0 END AS INTEGER) AS is_active_90d,
  CAST(CASE WHEN o.n_valid = 1 THEN 1 ELSE 0 END AS INTEGER) AS is_one_time_buyer,
  CAST(CASE WHEN COALESCE(o.n_valid, 0) = 0 THEN 1 ELSE 0 END AS INTEGER) AS never_purchased,
  {SALES} AS _refreshed_at
FROM customer_now c
LEFT JOIN (
  SELECT customer_id, count(*) AS n, count(*) FILTER (NOT ({_ok})) AS n_canceled, count(*) FILTER ({_ok}) AS n_valid,
    sum(gross_amount) FILTER ({_ok}) AS gross, sum(discount_amount) FILTER ({_ok}) AS disc, sum(total_amount) FILTER ({_ok}) AS net,
    max(total_amount) FILTER ({_ok}) AS top, min(created_at) FILTER ({_ok}) AS first_order_at, max(created_at) FILTER ({_ok}) AS last_order_at,
    count(DISTINCT business_unit_code) AS units, count(DISTINCT channel) AS channels,
    count(*) FILTER (discount_code IS NOT NULL AND trim(discount_code) <> '') AS n_coupon
  FROM order_now o GROUP BY customer_id) o ON o.customer_id = c.customer_id
LEFT JOIN (
  SELECT o.customer_id, sum(i.quantity) AS units, count(DISTINCT i.item_id) AS items,
    count(DISTINCT i.order_id || '/' || i.item_id) AS lines
  FROM order_item_now i JOIN order_now o USING (order_id) GROUP BY 1) i ON i.customer_id = c.customer_id
LEFT JOIN (
  SELECT customer_id, channel FROM (
    SELECT customer_id, channel, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, channel) AS rn
    FROM order_now GROUP BY customer_id, channel) r WHERE rn = 1) f ON f.customer_id = c.customer_id
"""

COHORT = f"""
SELECT a.cohort_month, a.activity_month,
  CAST(date_diff('month', a.cohort_month, a.activity_month) AS INTEGER) AS months_since_signup, a.segment,
  s.cohort_size, a.active_customers, {rate("a.active_customers", "s.cohort_size")} AS retention_rate, a.orders,
  CAST(a.net AS DECIMAL(38,4)) AS net_revenue, {per_unit("a.net", "a.active_customers")} AS revenue_per_customer,
  {SALES} AS _refreshed_at
FROM (
  SELECT CAST(date_trunc('month', c.customer_since) AS DATE) AS cohort_month, c.segment,
    CAST(date_trunc('month', o.created_at) AS DATE) AS activity_month, count(DISTINCT o.customer_id) AS active_customers,
    count(*) AS orders, sum(o.total_amount) AS net
  FROM order_now o JOIN customer_now c USING (customer_id) WHERE {_ok} GROUP BY 1, 2, 3) a
JOIN (SELECT CAST(date_trunc('month', customer_since) AS DATE) AS cohort_month, segment, count(*) AS cohort_size
      FROM customer_now GROUP BY 1, 2) s ON s.cohort_month = a.cohort_month AND s.segment = a.segment
"""


def profile_of(entity: str) -> str:
    keys = KEYS[entity]
    return f"""
SELECT '{CONTEXT[entity]}' AS context, '{entity}' AS entity, l.*, c.*, r.*
FROM (SELECT max(_kafka_ts) AS last_kafka_ts, count(*) AS landing_rows,
        (SELECT count(*) FROM (SELECT DISTINCT {keys} FROM {entity}_raw) d) AS landing_distinct_keys,
        count(*) FILTER (_op = 'c') AS ops_create, count(*) FILTER (_op = 'u') AS ops_update,
        count(*) FILTER (_op = 'd') AS ops_delete, count(*) FILTER (_op = 'r') AS ops_snapshot
      FROM {entity}_raw) l,
     (SELECT CAST((SELECT count(*) FROM {entity}_now) AS BIGINT) AS core_rows,
        count(*) FILTER (_op = 'd') AS core_deleted_keys,
        (SELECT count(*) FROM (SELECT {keys} FROM {entity}_now GROUP BY {keys} HAVING count(*) > 1) d) AS keys_with_dup_in_core
      FROM {entity}_newest) c,
     (SELECT count(*) AS cdc_seq_non_monotonic FROM (
        SELECT DISTINCT {keys} FROM (
          SELECT {keys}, _cdc_seq, lag(_cdc_seq) OVER (PARTITION BY {keys} ORDER BY _partition, _offset, _cdc_seq) AS before
          FROM {entity}_raw) w WHERE before > _cdc_seq) d) r
"""


def overview() -> str:
    blocks = []
    for e in COLUMNS:
        topic = f"sap.{CONTEXT[e]}.{e}.v1"
        blocks.append(f"""
SELECT context, entity, '{topic}' AS topic, last_kafka_ts,
  CAST({secs("last_kafka_ts", SALES)} AS BIGINT) AS freshness_seconds, CAST({SLA[e] * 60} AS BIGINT) AS freshness_sla_seconds,
  CAST(CASE WHEN {secs("last_kafka_ts", SALES)} <= {SLA[e] * 60} THEN 1 ELSE 0 END AS INTEGER) AS freshness_ok,
  landing_rows, landing_distinct_keys, core_rows, core_deleted_keys,
  CAST(landing_distinct_keys - (core_rows + core_deleted_keys) AS BIGINT) AS reconcile_diff,
  CAST(CASE WHEN landing_distinct_keys = core_rows + core_deleted_keys THEN 1 ELSE 0 END AS INTEGER) AS reconcile_ok,
  ops_create, ops_update, ops_delete, ops_snapshot, keys_with_dup_in_core, cdc_seq_non_monotonic,
  {SALES} AS _refreshed_at
FROM ({profile_of(e)}) q""")
    return "\nUNION ALL\n".join(blocks)


# relation: child, parent, kind, threshold, window, [(child value, parent column)]
RELATIONS = [
    ("order", "customer", "foreign_key", 0.1, 3, [("customer_id", "customer_id")]),
    ("order", "business_unit", "lookup", 0.5, 3, [("business_unit_code", "bu_code")]),
    ("order", "discount_codes", "lookup", 5.0, 90, [("upper(trim(discount_code))", "discount_code")]),
    ("order_item", "order", "foreign_key", 0.5, 3, [("order_id", "order_id")]),
    ("order_item", "prices", "temporal", 0.5, 7, [("item_id", "item_id")]),
    ("order_item", "stock_position", "lookup", 2.0, 28, [("item_id", "item_id"), ("dc_id", "dc_id")]),
    ("order_payment", "order", "foreign_key", 0.5, 3, [("order_id", "order_id")]),
    ("discount_codes", "business_unit", "lookup", 0.5, 3, [("business_unit_scope", "bu_code")]),
]


def marked(rel, days: int) -> str:
    child, parent, kind, _, _, on = rel
    match = " AND ".join(f"t.{r} = x.l{i}" for i, (_, r) in enumerate(on))
    if kind == "temporal":
        match += " AND t.valid_from <= x.created_at"
    local = ", ".join(f"{l} AS l{i}" for i, (l, _) in enumerate(on))
    filled = " AND ".join(f"l{i} IS NOT NULL AND trim(l{i}) <> ''" for i in range(len(on)))
    cols = f"{KEYS[child]}, created_at, _ingested_at, _partition, _offset, _op"
    cols = ", ".join(dict.fromkeys(c.strip() for c in cols.split(",")))
    return f"""
SELECT x.*, NOT EXISTS (SELECT 1 FROM {parent}_now t WHERE {match}) AS is_orphan
FROM (SELECT {cols}, {local} FROM {child}_newest WHERE _op <> 'd' AND created_at >= {day(SALES, days)}) x
WHERE {filled}
"""


def rel_id(rel) -> str:
    return f"{CONTEXT[rel[0]]}.{rel[0]} -> {CONTEXT[rel[1]]}.{rel[1]}"


def orphans(days: int) -> str:
    blocks = []
    for rel in RELATIONS:
        child, parent, kind, limit, window, _ = rel
        age = secs("_ingested_at", SALES)
        win = window * 86400
        pct = "CASE WHEN count(*) = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * count(*) FILTER (is_orphan) / count(*) END"
        blocks.append(f"""
SELECT '{rel_id(rel)}' AS relation_id, '{CONTEXT[child]}' AS from_context, '{child}' AS from_entity,
  '{CONTEXT[parent]}' AS to_context, '{parent}' AS to_entity, '{kind}' AS relation_kind,
  count(*) AS total_rows, count(*) FILTER (is_orphan) AS orphan_rows, {pct} AS orphan_rate_pct,
  {limit}::DOUBLE AS threshold_pct, CAST(CASE WHEN {pct} <= {limit} THEN 1 ELSE 0 END AS INTEGER) AS rate_ok,
  quantile_cont({age}, 0.5) FILTER (is_orphan) AS orphan_age_p50_s,
  quantile_cont({age}, 0.95) FILTER (is_orphan) AS orphan_age_p95_s,
  quantile_cont({age}, 0.99) FILTER (is_orphan) AS orphan_age_p99_s,
  CAST(max({age}) FILTER (is_orphan) AS BIGINT) AS orphan_age_max_s, CAST({win} AS BIGINT) AS refresh_window_s,
  CAST(CASE WHEN quantile_cont({age}, 0.99) FILTER (is_orphan) >= {win} THEN 0 ELSE 1 END AS INTEGER) AS age_ok,
  {SALES} AS _refreshed_at
FROM ({marked(rel, days)}) m""")
    return "\nUNION ALL\n".join(blocks)


def orphan_records(days: int) -> str:
    blocks = []
    for rel in RELATIONS:
        child, *_, on = rel
        key = " || '|' || ".join(k.strip() for k in KEYS[child].split(","))
        missing = " || '|' || ".join(f"l{i}" for i in range(len(on)))
        blocks.append(f"""
SELECT '{rel_id(rel)}' AS relation_id, {key} AS orphan_key, {missing} AS missing_key, _ingested_at AS first_seen_at,
  CAST({secs("_ingested_at", SALES)} AS BIGINT) AS age_seconds, 'sap.{CONTEXT[child]}.{child}.v1' AS sample_topic,
  _partition AS sample_partition, _offset AS sample_offset
FROM ({marked(rel, days)}) m WHERE is_orphan""")
    body = "\nUNION ALL\n".join(blocks)
    return f"""
SELECT relation_id, orphan_key, missing_key, first_seen_at, age_seconds, sample_topic, sample_partition, sample_offset,
  {SALES} AS _refreshed_at
FROM (SELECT *, row_number() OVER (PARTITION BY relation_id ORDER BY first_seen_at, orphan_key) AS rn FROM ({body}) b) r
WHERE rn <= 100000
"""


define("mart_order_360", order_360(None))
define("mart_revenue", revenue(WIDE))
define("mart_funnel", funnel(WIDE))
define("mart_effectiveness", effectiveness(WIDE))
define("mart_baseline", baseline(WIDE))
define("items_priced", priced(WIDE))
define("mart_margin", margin(WIDE, "items_priced"))
define("mart_coverage", coverage(WIDE))
define("mart_stockout", stockout(28))
define("mart_idle", idle(90))
define("mart_customers", CUSTOMERS)
define("mart_cohort", COHORT)
define("mart_overview", overview())
define("mart_orphans", orphans(WIDE))
