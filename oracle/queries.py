"""One SQL statement per registered query."""

from oracle import entities, marts  # noqa: F401  (define the named expressions)
from oracle.compose import money, per_unit, rate, sql
from oracle.marts import PAYMENTS, SALES, WIDE, ago, day, secs

BODIES: dict[str, str] = {
    "order_360": "SELECT * FROM mart_order_360",
    "revenue_by_bu_day": "SELECT * FROM mart_revenue",
    "payment_funnel_day": "SELECT * FROM mart_funnel",
    "discount_effectiveness": "SELECT * FROM mart_effectiveness",
    "discount_baseline_day": "SELECT * FROM mart_baseline",
    "item_margin_daily": "SELECT * FROM mart_margin",
    "stock_coverage": "SELECT * FROM mart_coverage",
    "stockout_candidates": "SELECT * FROM mart_stockout",
    "customer_metrics": "SELECT * FROM mart_customers",
    "customer_cohort": "SELECT * FROM mart_cohort",
    "dq_overview": "SELECT * FROM mart_overview",
    "orphan_summary": "SELECT * FROM mart_orphans",
    "orphan_records": marts.orphan_records(WIDE),
    "idle_catalog": "SELECT * FROM mart_idle",
    "order_360_window": marts.order_360(3),
    "revenue_by_bu_day_window": marts.revenue(3),
    "payment_funnel_day_window": marts.funnel(15),
    "discount_effectiveness_window": marts.effectiveness(90),
    "discount_baseline_day_window": marts.baseline(90),
    "item_margin_daily_window": marts.margin(7),
    "stock_coverage_window": marts.coverage(28),
    "stockout_candidates_wide": marts.stockout(WIDE),
    "stockout_candidates_vetoed": marts.stockout(28).replace("max(_kafka_ts)", "max(_kafka_ts - INTERVAL 2 HOUR)"),
    "topic_lag": "\nUNION ALL\n".join(
        f"SELECT 'sap.{entities.CONTEXT[e]}.{e}.v1' AS topic, "
        f"CAST(greatest({secs('max(_kafka_ts)', PAYMENTS)}, 0) AS BIGINT) AS lag_seconds FROM {e}_raw"
        for e in entities.COLUMNS
    ),
    "core_stored": f"SELECT * FROM order_item_now WHERE created_at >= {day(SALES, 90)}",
    "orphan_summary_window": marts.orphans(7),
}

ORDER_COLS = entities.COLUMNS["order"] + ", " + entities.TECH
KEY = "CAST(order_id AS BIGINT)"
REASON = (
    f"CASE WHEN {KEY} % 97 = 0 THEN 'unparseable' WHEN {KEY} % 89 = 0 THEN 'type:total_amount' "
    f"WHEN {KEY} % 83 = 0 THEN 'missing:customer_id' WHEN {KEY} % 79 = 0 THEN 'domain:order_status' ELSE 'landed' END"
)

FRAME = (
    f"CASE WHEN {KEY} % 79 = 0 THEN 'frame:short' WHEN {KEY} % 83 = 0 THEN 'frame:magic' "
    f"WHEN {KEY} % 89 = 0 THEN 'frame:schema' WHEN {KEY} % 97 = 0 THEN 'frame:payload' ELSE 'landed' END"
)


def conformance() -> str:
    blocks = []
    domains = {
        "order": "order_status NOT IN ('created','paid','invoiced','shipped','delivered','canceled') , channel NOT IN ('web','app','store')",
        "order_payment": "payment_method NOT IN ('credit_card','pix','boleto','voucher') , payment_status NOT IN ('pending','authorized','captured','denied','refunded')",
        "discount_codes": "discount_type NOT IN ('percent','fixed','freight')",
    }
    optional = {
        "order": ["discount_code"], "order_item": ["dc_id"], "order_payment": ["authorized_at", "captured_at"],
        "prices": ["valid_to"], "discount_codes": ["business_unit_scope"],
    }
    for e, cols in entities.COLUMNS.items():
        required = [c.strip() for c in cols.split(",") if c.strip() not in optional.get(e, [])]
        nulls = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in required)
        tests = [t.strip() for t in domains.get(e, "").split(" , ") if t.strip()] + ["_op NOT IN ('c','u','d','r')"]
        outside = " + ".join(f"count(*) FILTER ({t})" for t in tests)
        blocks.append(
            f"SELECT '{entities.CONTEXT[e]}' AS context, '{e}' AS entity, CAST({nulls} AS BIGINT) AS required_nulls, "
            f"CAST({outside} AS BIGINT) AS outside_domain, CAST(0 AS INTEGER) AS type_mismatches FROM {e}_raw"
        )
    return "\nUNION ALL\n".join(blocks)


BODIES |= {
    "coerce": f"SELECT {ORDER_COLS} FROM order_raw WHERE {REASON} = 'landed'",
    "dlq_split": f"SELECT {REASON} AS reason, count(*) AS lines FROM order_raw GROUP BY 1",
    "landing_json": f"SELECT {ORDER_COLS} FROM order_raw",
    "landing_partitioned": "SELECT strftime(_kafka_ts, '%Y%m') AS month, count(*) AS rows, max(_offset) AS last_offset "
    "FROM order_payment_raw GROUP BY 1",
    "offset_dups": "SELECT _topic, _partition, _offset, count(*) AS copies FROM order_item_raw GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "offset_replay": f"SELECT {ORDER_COLS} FROM order_raw",
    "retention": f"SELECT {ORDER_COLS} FROM order_raw WHERE _ingested_at >= {ago(SALES, 180)}",
    "schema_conformance": conformance(),
    "window_filter": f"SELECT order_id, created_at, total_amount FROM order_now WHERE created_at >= {day(SALES, 90)}",
    "blank_dc": "SELECT CAST(CASE WHEN dc_id IS NULL OR trim(dc_id) = '' THEN 1 ELSE 0 END AS INTEGER) AS blank, "
    "count(*) AS items, CAST(sum(quantity) AS BIGINT) AS units FROM order_item_now GROUP BY 1",
    "core_projection": "SELECT * FROM order_item_core",
    "current_order": "SELECT * FROM order_now",
    "current_order_item": "SELECT * FROM order_item_now",
    "current_argmax": "SELECT order_id, item_seq, item_id, quantity, total_amount FROM order_item_now",
    "cdc_delete_resurrect": "SELECT d.order_id, CAST(CASE WHEN o.order_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS alive, o.order_status "
    "FROM (SELECT DISTINCT order_id FROM order_raw WHERE _op = 'd') d LEFT JOIN order_now o USING (order_id)",
    "compaction_invariant": "SELECT * FROM order_item_now",
    "rebuild_parity": "SELECT count(*) AS rows, CAST(sum(_is_deleted) AS BIGINT) AS deleted_rows, "
    f"{money('sum(total_amount)')} AS total_amount FROM order_item_core",
    "cdc_profile": "\nUNION ALL\n".join(marts.profile_of(e) for e in entities.COLUMNS),
    "seq_regressions": """
SELECT order_id, item_seq, count(*) AS regressions
FROM (SELECT order_id, item_seq, _cdc_seq,
        lag(_cdc_seq) OVER (PARTITION BY order_id, item_seq ORDER BY _partition, _offset, _cdc_seq) AS before FROM order_item_raw) w
WHERE before > _cdc_seq GROUP BY 1, 2""",
    "raw_vs_current": "\nUNION ALL\n".join(
        f"SELECT '{e}' AS entity, (SELECT count(*) FROM {e}_core) AS raw_rows, (SELECT count(*) FROM {e}_now) AS current_rows"
        for e in entities.COLUMNS
    ),
    "key_uniqueness": "SELECT order_id, item_seq, count(*) AS copies FROM order_item_raw GROUP BY 1, 2 HAVING count(*) > 1",
    "lookup_join": "SELECT o.order_id, o.business_unit_code, CAST(CASE WHEN b.bu_code IS NULL THEN 0 ELSE 1 END AS INTEGER) AS bu_found, "
    "COALESCE(b.bu_name, '(sem cadastro)') AS bu_name, b.country AS bu_country "
    "FROM order_now o LEFT JOIN business_unit_now b ON b.bu_code = o.business_unit_code",
    "asof_price": "SELECT order_id, item_seq, item_id, created_at, price_list_id, list_price, cost_price, price_valid_from FROM items_priced",
    "current_price": marts.PRICE_AT,
    "anti_null": "SELECT order_id, item_seq, item_id, dc_id FROM order_item_now i "
    "WHERE NOT EXISTS (SELECT 1 FROM stock_position_now s WHERE s.item_id = i.item_id AND s.dc_id = i.dc_id)",
    "anti_with_total": "SELECT count(*) AS total_rows, count(*) FILTER (NOT EXISTS (SELECT 1 FROM order_now o WHERE o.order_id = p.order_id)) "
    "AS orphan_rows FROM order_payment_now p",
    "touched_orders": f"""
SELECT order_id FROM order_now WHERE updated_at >= {ago(SALES, 3)}
UNION SELECT order_id FROM order_item_now WHERE updated_at >= {ago(SALES, 3)}
UNION SELECT order_id FROM order_payment_now WHERE updated_at >= {ago(SALES, 3)}""",
    "fanout_guard": """
SELECT m.order_id, m.items_count, COALESCE(d.n, 0) AS actual_count
FROM mart_order_360 m LEFT JOIN (SELECT order_id, count(*) AS n FROM order_item_now GROUP BY 1) d USING (order_id)
WHERE m.items_count <> COALESCE(d.n, 0)""",
    "unassigned_total": "SELECT CAST(sum(q) AS BIGINT) AS unassigned_units, count(*) AS items "
    "FROM (SELECT item_id, min(demand_qty_unassigned_28d) AS q FROM mart_coverage GROUP BY 1) x",
    "preferred_channel": """
SELECT customer_id, channel FROM (
  SELECT customer_id, channel, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, channel) AS rn
  FROM order_now GROUP BY 1, 2) r WHERE rn = 1""",
    "latency_quantiles": f"""
SELECT acquirer, quantile_cont({secs("created_at", "authorized_at")}, 0.5) AS p50,
  quantile_cont({secs("created_at", "authorized_at")}, 0.95) AS p95,
  quantile_cont({secs("created_at", "authorized_at")}, 0.99) AS p99
FROM order_payment_now WHERE authorized_at IS NOT NULL GROUP BY 1""",
}

CUSTOMER_ORDERS = "SELECT customer_id, order_id, order_status, total_amount, currency, order_created_at, is_fully_paid FROM mart_order_360"


def since(as_of: str, days: int) -> str:
    return f"CAST({as_of} AS DATE) - {days}"


def minus(a: str, b: str) -> str:
    return f"(CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"


def capital(by: str, where: str) -> str:
    return f"""SELECT {by}, count(DISTINCT item_id) AS items, CAST(sum(available) AS BIGINT) AS units,
  {money("sum(immobilized_capital)")} AS capital, {money("sum(potential_revenue)")} AS potential_revenue
FROM mart_idle WHERE {where} GROUP BY {by}"""


PCT = "CAST(CAST(round(orphan_rate_pct, 3) AS DECIMAL(12,3)) AS VARCHAR)"
ALERTS = f"""
SELECT 'freshness' AS kind, context, entity, CAST(freshness_seconds AS VARCHAR) AS detail FROM mart_overview WHERE freshness_ok = 0
UNION ALL SELECT 'reconcile', context, entity, CAST(reconcile_diff AS VARCHAR) FROM mart_overview WHERE reconcile_ok = 0
UNION ALL SELECT 'core_dup', context, entity, CAST(keys_with_dup_in_core AS VARCHAR) FROM mart_overview WHERE keys_with_dup_in_core <> 0
UNION ALL SELECT 'orphan_rate', from_context, from_entity, relation_id || ' = ' || {PCT} || '%' FROM mart_orphans WHERE rate_ok = 0
UNION ALL SELECT 'orphan_age', from_context, from_entity,
  relation_id || ' p99 = ' || CAST(CAST(round(orphan_age_p99_s) AS BIGINT) AS VARCHAR) || 's' FROM mart_orphans WHERE age_ok = 0
"""

BODIES |= {
    "order_lookup": f"SELECT *, CAST({secs('_refreshed_at', SALES)} AS BIGINT) AS freshness_seconds FROM mart_order_360 WHERE order_id = '42'",
    "customer_orders": CUSTOMER_ORDERS,
    "customer_orders_of": f"{CUSTOMER_ORDERS} WHERE customer_id = '42' ORDER BY order_created_at DESC, order_id LIMIT 50",
    "revenue_last_30d": "SELECT business_unit_code, bu_name, bu_channel, order_date, orders, units_sold, gross_revenue, "
    f"discount_total, net_revenue, avg_ticket FROM mart_revenue WHERE order_date >= {since(SALES, 30)}",
    "cancel_rate_by_bu": f"""
SELECT bu_name, CAST(sum(orders) AS BIGINT) AS orders, {rate("sum(orders_canceled)", "sum(orders)")} AS cancel_rate,
  {money("sum(net_revenue)")} AS net_revenue, {per_unit("sum(net_revenue)", "sum(orders - orders_canceled)")} AS avg_ticket
FROM mart_revenue WHERE order_date >= {since(SALES, WIDE)} GROUP BY 1""",
    "approval_by_acquirer": f"""
SELECT acquirer, installment_bucket, CAST(sum(attempts) AS BIGINT) AS attempts,
  {rate("sum(attempts_authorized + attempts_captured)", "sum(attempts)")} AS approval_rate,
  max(auth_latency_p95_s) AS worst_p95_s
FROM mart_funnel WHERE attempt_date >= {since(PAYMENTS, WIDE)} GROUP BY 1, 2""",
    "unknown_coupons": f"""
SELECT discount_code_norm, min(discount_code_raw) AS example_raw, min(order_date) AS first_seen, max(order_date) AS last_seen,
  CAST(sum(orders) AS BIGINT) AS orders, {money("sum(discount_amount)")} AS discount_given
FROM mart_effectiveness WHERE code_found = 0 GROUP BY 1
HAVING CAST(max(order_date) AS TIMESTAMP) < {SALES} - INTERVAL 15 MINUTE""",
    "coupons_over_limit": """
SELECT discount_code_norm, campaign_name, max_uses, CAST(sum(orders) AS BIGINT) AS total_uses,
  CAST(sum(orders) - max_uses AS BIGINT) AS over_by
FROM mart_effectiveness WHERE code_found = 1 AND max_uses > 0 GROUP BY 1, 2, 3 HAVING sum(orders) > max_uses""",
    "campaign_vs_baseline": f"""
SELECT campaign_name, CAST(sum(d.orders) AS BIGINT) AS orders, {money("sum(d.discount_amount)")} AS discount_given,
  {rate("sum(d.discount_amount)", "sum(d.gross_amount)")} AS pct_effective,
  {per_unit("sum(d.net_amount)", "sum(d.orders)")} AS avg_ticket_coupon,
  {per_unit("sum(b.net_no_coupon)", "sum(b.orders_no_coupon)")} AS avg_ticket_baseline
FROM mart_effectiveness d JOIN mart_baseline b
  ON b.order_date = d.order_date AND b.business_unit_code = d.business_unit_code
WHERE d.order_date >= {since(SALES, WIDE)} AND d.code_found = 1 GROUP BY 1""",
    "items_without_price": f"""
SELECT item_id, min(order_date) AS first_seen, max(order_date) AS last_seen, CAST(sum(units_without_price) AS BIGINT) AS units,
  {money("sum(revenue_practiced)")} AS revenue_unaudited
FROM mart_margin WHERE units_without_price > 0 GROUP BY 1""",
    "sold_below_cost": "SELECT order_date, item_id, business_unit_code, units_below_cost, margin_amount, margin_pct "
    f"FROM mart_margin WHERE units_below_cost > 0 AND order_date >= {since(SALES, WIDE)}",
    "top_margin_items": f"""
SELECT item_id, CAST(sum(units_sold) AS BIGINT) AS units, {money("sum(revenue_practiced)")} AS revenue,
  {money("sum(revenue_at_list)")} AS revenue_at_list,
  {minus("sum(revenue_practiced)", "sum(revenue_at_list)")} AS discount_pct,
  {minus("sum(cost_total)", "sum(revenue_practiced)")} AS margin_pct,
  CAST(sum(units_without_price) AS BIGINT) AS units_unaudited
FROM mart_margin WHERE order_date >= {since(SALES, WIDE)} AND price_list_id <> '(sem preco)'
GROUP BY 1 ORDER BY revenue DESC, item_id LIMIT 50""",
    "coverage_alerts": """
SELECT dc_id, dc_name, item_id, available, safety_stock, avg_daily_demand_alloc_28d, coverage_days_allocated, days_to_safety_stock,
  coverage_class, unassigned_ratio, position_age_seconds, refreshed_at
FROM mart_coverage WHERE coverage_class IN ('stockout', 'critical', 'low') OR below_safety_stock = 1""",
    "coverage_by_dc": "SELECT * FROM mart_coverage WHERE dc_id = '3'",
    "stockout_queue": """
SELECT stockout_class, item_id, dc_id, severity,
  CAST(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS INTEGER) AS severity_rank,
  units_sold_7d, revenue_at_risk, available, last_sale_at, evidence_age_seconds, refreshed_at
FROM mart_stockout WHERE evidence_status = 'confirmed'""",
    "stockout_summary": f"""
SELECT stockout_class, evidence_status, count(*) AS candidates, count(DISTINCT item_id) AS items, count(DISTINCT dc_id) AS dcs,
  CAST(sum(units_sold_7d) AS BIGINT) AS units_sold_7d, {money("sum(revenue_at_risk)")} AS revenue_at_risk,
  max(evidence_age_seconds) AS max_evidence_age_seconds, min(refreshed_at) AS refreshed_at
FROM mart_stockout GROUP BY 1, 2""",
    "rfm_scores": """
SELECT customer_id, segment,
  CAST(6 - ntile(5) OVER (ORDER BY recency_days, customer_id) AS INTEGER) AS r_score,
  CAST(ntile(5) OVER (ORDER BY total_orders, customer_id) AS INTEGER) AS f_score,
  CAST(ntile(5) OVER (ORDER BY lifetime_net, customer_id) AS INTEGER) AS m_score
FROM mart_customers WHERE never_purchased = 0""",
    "retention_curve": f"""
SELECT segment, cohort_month, months_since_signup, min(cohort_size) AS size, CAST(sum(active_customers) AS BIGINT) AS active,
  {rate("sum(active_customers)", "min(cohort_size)")} AS retention
FROM mart_cohort WHERE cohort_month >= DATE '1995-01-01' GROUP BY 1, 2, 3""",
    "dq_alerts": ALERTS,
    "entity_state": "SELECT context, entity, freshness_ok, freshness_seconds, freshness_sla_seconds, landing_distinct_keys, core_rows, "
    "reconcile_diff FROM mart_overview",
    "orphan_verdict": """
SELECT relation_id, relation_kind, orphan_rows, round(orphan_rate_pct, 3) AS rate_pct, threshold_pct, orphan_age_p99_s, refresh_window_s,
  CASE WHEN rate_ok = 0 AND age_ok = 0 THEN 'INCIDENTE' WHEN age_ok = 0 THEN 'ATRASO ACIMA DA JANELA'
       WHEN rate_ok = 0 THEN 'TAXA ALTA' ELSE 'normal' END AS veredito
FROM mart_orphans""",
    "data_health": f"SELECT CAST(CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS INTEGER) AS healthy, count(*) AS n_alerts FROM ({ALERTS}) a",
    "capital_by_dc": capital("dc_id", "idle_class = 'parado_com_estoque'"),
    "catalog_gaps": "SELECT idle_class, items, units, capital FROM ("
    + capital("idle_class", "idle_class IN ('estoque_sem_preco', 'preco_sem_posicao')") + ") c",
    "idle_ranking": capital("dc_id, idle_class", "idle_class <> 'ativo' AND currency = 'BRL'")
    + " ORDER BY capital DESC, dc_id, idle_class LIMIT 50",
    "top_idle": "SELECT item_id, dc_id, available, cost_price, immobilized_capital, days_since_last_sale FROM mart_idle "
    "WHERE idle_class = 'parado_com_estoque' ORDER BY immobilized_capital DESC, item_id, dc_id LIMIT 100",
    "refresh_window_parity": "SELECT * FROM mart_revenue",
    "refresh_full_parity": "SELECT * FROM mart_coverage",
    "refresh_keys_parity": "SELECT * FROM mart_order_360",
    "stream_refresh": "SELECT * FROM mart_order_360",
    "order_point_read": f"SELECT *, CAST({secs('_refreshed_at', SALES)} AS BIGINT) AS freshness_seconds FROM mart_order_360 WHERE order_id = '42'",
    "late_arrival": "SELECT * FROM mart_revenue",
    "latest_by": "SELECT * FROM mart_baseline",
    "refresh_log": "\nUNION ALL\n".join(
        f"SELECT '{m}' AS mart, {SALES} AS run_at, 'Finished' AS status, (SELECT count(*) FROM {t}) AS rows, "
        "CAST(0 AS BIGINT) AS age_seconds, CAST(1 AS INTEGER) AS healthy"
        for m, t in (("stock_coverage", "mart_coverage"), ("idle_catalog", "mart_idle"))
    ),
    "second_access_path": CUSTOMER_ORDERS,
    "landing_stream": f"SELECT {ORDER_COLS} FROM order_raw",
    "core_stream": "SELECT * FROM order_now",
    "core_upsert": "SELECT * FROM order_now",
    "landing_stream_replay": f"SELECT {ORDER_COLS} FROM order_raw",
    "compaction_report": """
SELECT (SELECT count(*) FROM order_item_core) AS rows_before, count(*) AS rows_after,
  CAST(sum(_is_deleted) AS BIGINT) AS tombstones, (SELECT count(*) FROM order_item_core) - count(*) AS superseded
FROM (SELECT *, row_number() OVER (PARTITION BY order_id, item_seq ORDER BY _cdc_seq DESC, _kafka_ts DESC, _partition DESC, _offset DESC) AS r
      FROM order_item_core) WHERE r = 1""",
    "core_differences": f"SELECT order_id, CAST(0 AS BIGINT) AS stored_rows, CAST(1 AS BIGINT) AS landed_rows FROM order_now WHERE {KEY} % 50 = 0",
    "framed_landing": f"""
SELECT {ORDER_COLS.replace("discount_code,", f"CASE WHEN {KEY} % 2 = 0 THEN discount_code END AS discount_code,").replace("_schema_id", f"CAST(2 - {KEY} % 2 AS INTEGER) AS _schema_id")}
FROM order_raw WHERE {FRAME} = 'landed'""",
    "framed_dlq": f"SELECT {FRAME} AS reason, count(*) AS messages, count(*) FILTER ({FRAME} = 'frame:short') AS short FROM order_raw WHERE {FRAME} <> 'landed' GROUP BY 1",
    "events_per_window": """
SELECT date_trunc('minute', ts) AS window_start, event_type, count(*) AS events,
  CAST(sum(CAST(value AS DECIMAL(18,4))) AS DECIMAL(38,4)) AS total
FROM events GROUP BY 1, 2""",
}

# --- parity ---------------------------------------------------------------

VALID = f"order_status <> 'canceled' AND created_at >= {day(SALES, WIDE)}"
SOLD28 = f"""(SELECT i.* FROM order_item_now i JOIN order_now o USING (order_id)
  WHERE o.created_at >= {ago(SALES, 28)} AND o.order_status IN {marts.BILLABLE})"""
SOLD7 = SOLD28.replace("INTERVAL 28 DAY", "INTERVAL 7 DAY")
SOLDW = SOLD28.replace("INTERVAL 28 DAY", f"INTERVAL {WIDE} DAY")
PARITY = {
    "revenue": (f"SELECT {money('sum(net_revenue)')} FROM mart_revenue",
                f"SELECT {money('sum(total_amount)')} FROM order_now WHERE {VALID}"),
    "order_360": (f"SELECT {money('sum(total_amount)')} FROM mart_order_360",
                  f"SELECT {money('sum(total_amount)')} FROM order_now"),
    "order_items": (f"SELECT {money('sum(items_total_amount)')} FROM mart_order_360",
                    f"SELECT {money('sum(total_amount)')} FROM order_item_now WHERE order_id IN (SELECT order_id FROM order_now)"),
    "payments": ("SELECT CAST(sum(attempts) AS BIGINT) FROM mart_funnel",
                 f"SELECT count(*) FROM order_payment_now WHERE created_at >= {day(PAYMENTS, WIDE)} AND order_id IN (SELECT order_id FROM order_now)"),
    "baseline": ("SELECT CAST(sum(orders_no_coupon + orders_with_coupon) AS BIGINT) FROM mart_baseline",
                 f"SELECT count(*) FROM order_now WHERE {VALID}"),
    "margin": (f"SELECT {money('sum(margin_amount)')} FROM mart_margin",
               f"SELECT {money('sum(total_amount - quantity * cost_price)')} FROM items_priced "
               "WHERE order_status <> 'canceled' AND price_valid_from IS NOT NULL"),
    "customers": (f"SELECT {money('sum(lifetime_net)')} FROM mart_customers",
                  f"SELECT {money('sum(total_amount)')} FROM order_now WHERE order_status <> 'canceled' "
                  "AND customer_id IN (SELECT customer_id FROM customer_now)"),
    "stock_demand": ("SELECT CAST(sum(demand_qty_28d) AS BIGINT) FROM mart_coverage",
                     f"SELECT CAST(sum(quantity) AS BIGINT) FROM {SOLDW} s WHERE EXISTS "
                     "(SELECT 1 FROM stock_position_now k WHERE k.item_id = s.item_id AND k.dc_id = s.dc_id)"),
    "stockout": ("SELECT count(*) FROM mart_stockout WHERE stockout_class <> 'missing_dc_position'",
                 f"SELECT (SELECT count(DISTINCT item_id) FROM {SOLD28} s WHERE item_id NOT IN (SELECT item_id FROM stock_position_now)) "
                 f"+ (SELECT count(*) FROM stock_position_now WHERE available <= 0 AND item_id IN (SELECT item_id FROM {SOLD7} s))"),
}
for _name, (_mart, _direct) in PARITY.items():
    _diff = "mart_value - direct_value"
    if "DECIMAL" in _mart:
        _diff = f"CAST({_diff} AS DECIMAL(38,4))"
    BODIES[f"parity_{_name}"] = (
        f"SELECT mart_value, direct_value, {_diff} AS diff FROM (SELECT ({_mart}) AS mart_value, ({_direct}) AS direct_value) p"
    )
BODIES["parity_revenue_by_currency"] = f"""
SELECT currency, mart_value, direct_value, CAST(mart_value - direct_value AS DECIMAL(38,4)) AS diff
FROM (SELECT currency, {money("sum(net_revenue)")} AS mart_value FROM mart_revenue GROUP BY 1) m
FULL JOIN (SELECT currency, {money("sum(total_amount)")} AS direct_value FROM order_now WHERE {VALID} GROUP BY 1) d USING (currency)"""

# --- checks: id -> severity, comparator, threshold, value --------------------


def part(condition: str, source: str) -> str:
    return f"SELECT CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER ({condition}) AS DOUBLE) / count(*) END FROM {source}"


def dup(keys: str, source: str) -> str:
    return f"SELECT count(*) FROM (SELECT 1 FROM {source} GROUP BY {keys} HAVING count(*) > 1) d"


def total(a: str, b: str, source: str) -> str:
    return f"SELECT CAST(sum({a}) AS DOUBLE) / CAST(sum({b}) AS DOUBLE) FROM {source}"


IMMUTABLE = {"order": "created_at", "order_item": "created_at", "order_payment": "created_at", "customer": "customer_since", "prices": "valid_from"}


CHECKS = {
    "landing.freshness": ("error", "lte", 0, "SELECT count(*) FROM mart_overview WHERE freshness_ok = 0"),
    "landing.dlq_depth": ("error", "lte", 0, f"SELECT count(*) FROM order_raw WHERE {REASON} <> 'landed'"),
    "core.dup_key": ("error", "lte", 0, "SELECT count(*) FROM mart_overview WHERE keys_with_dup_in_core <> 0"),
    "core.reconcile_count": ("error", "lte", 0, "SELECT count(*) FROM mart_overview WHERE reconcile_ok = 0"),
    "core.cdc_monotonic": ("warn", "lte", 0, "SELECT sum(cdc_seq_non_monotonic) FROM mart_overview"),
    "core.immutable_columns": ("error", "lte", 0, "SELECT " + " + ".join(
        f"(SELECT count(*) FROM (SELECT 1 FROM {e}_core GROUP BY {entities.KEYS[e]} "
        f"HAVING count(DISTINCT {c}) + CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END > 1) d)"
        for e, c in IMMUTABLE.items())),
    "core.deleted_leak": ("error", "lte", 0, "SELECT " + " + ".join(
        f"(SELECT count(*) FROM {e}_now JOIN (SELECT {k} FROM {e}_newest WHERE _op = 'd') d USING ({k}))"
        for e, k in entities.KEYS.items())),
    "rel.orphan_rate": ("error", "lte", 0, "SELECT count(*) FROM mart_orphans WHERE rate_ok = 0"),
    "rel.orphan_age_p99": ("error", "lte", 0, "SELECT count(*) FROM mart_orphans WHERE age_ok = 0"),
    "rel.fk_violation": ("warn", "lte", 0, "SELECT count(*) FROM mart_orphans WHERE relation_kind = 'foreign_key' AND orphan_rows > 0"),
    "marts.row_parity": ("error", "eq", 0, "SELECT (SELECT count(*) FROM mart_customers) - (SELECT count(*) FROM customer_now)"),
    "marts.rate_bounds": ("error", "lte", 0, "SELECT count(*) FROM mart_funnel WHERE approval_rate NOT BETWEEN 0 AND 1 "
                          "OR capture_rate NOT BETWEEN 0 AND 1 OR isnan(approval_rate) OR isnan(capture_rate)"),
    "marts.header_item_parity": ("warn", "lte", 0.005, part("abs(amount_mismatch_amount) > 0.01", "mart_order_360 WHERE has_items = 1")),
    "money.no_negative_amount": ("warn", "lte", 0.0001, part("amount < 0", "order_payment_now")),
    "marts.order_360.grain": ("error", "lte", 0, dup("order_id", "mart_order_360")),
    "marts.order_360.coverage": ("error", "lte", 0, "SELECT count(*) FROM order_now WHERE order_id NOT IN (SELECT order_id FROM mart_order_360)"),
    "marts.order_360.item_fanout": ("error", "lte", 0, f"SELECT count(*) FROM ({BODIES['fanout_guard']}) f"),
    "marts.order_360.amount_mismatch_rate": ("warn", "lte", 0.01, part("abs(amount_mismatch_amount) > 0.01", "mart_order_360")),
    "marts.order_360.bu_orphan_rate": ("error", "lte", 0, part("bu_found = 0", "mart_order_360")),
    "marts.order_360.customer_orphan_rate": ("error", "lte", 0.005, part("customer_found = 0", "mart_order_360")),
    "discount.over_limit": ("warn", "lte", 0, f"SELECT count(*) FROM ({BODIES['coupons_over_limit']}) c"),
    "discount.outside_validity": ("warn", "lte", 0.001, total("used_outside_validity", "orders", "mart_effectiveness")),
    "price.coverage": ("error", "lte", 0.01, total("units_without_price", "units_sold", "mart_margin")),
    "price.staleness": ("warn", "lte", 365, "SELECT max(price_staleness_max_d) FROM mart_margin"),
    "price.below_cost": ("warn", "lte", 0.005, total("units_below_cost", "units_sold", "mart_margin")),
    "marts.stock_coverage.grain_unique": ("error", "lte", 0, dup("dc_id, item_id", "mart_coverage")),
    "marts.stock_coverage.position_age_p99": ("warn", "lte", 3600, "SELECT quantile_cont(position_age_seconds, 0.99) FROM mart_coverage"),
    "rel.unassigned_dc_ratio": ("warn", "lte", 0.05, "SELECT CAST(sum(r) AS DOUBLE) / count(*) FROM (SELECT min(unassigned_ratio) AS r "
                                "FROM mart_coverage WHERE demand_qty_28d + demand_qty_unassigned_28d > 0 GROUP BY item_id) x"),
    "marts.stockout.class_exclusive": ("error", "lte", 0, "SELECT count(*) FROM (SELECT 1 FROM mart_stockout GROUP BY item_id, dc_id "
                                       "HAVING count(DISTINCT stockout_class) > 1) d"),
    "marts.stockout.complement_006": ("error", "lte", 0, "SELECT count(*) FROM mart_stockout s JOIN mart_coverage c "
                                      "ON s.item_id = c.item_id AND s.dc_id = c.dc_id WHERE s.stockout_class <> 'zero_available'"),
    "rel.stockout_missing_record_rate": ("error", "lte", 0.02, "SELECT CAST((SELECT count(*) FROM mart_stockout WHERE stockout_class = "
                                         "'missing_stock_record' AND evidence_status = 'confirmed') AS DOUBLE) / "
                                         f"(SELECT count(DISTINCT item_id) FROM {SOLD28} s)"),
    "rel.stockout_evidence_age_p99": ("error", "lte", 259200, "SELECT quantile_cont(evidence_age_seconds, 0.99) FROM mart_stockout "
                                      "WHERE evidence_status = 'pending_grace'"),
    "customer.cohort_bounds": ("error", "lte", 0, "SELECT (SELECT count(*) FROM mart_cohort WHERE retention_rate NOT BETWEEN 0 AND 1) + "
                               "(SELECT count(*) FROM (SELECT 1 FROM mart_cohort GROUP BY cohort_month, segment "
                               "HAVING count(DISTINCT cohort_size) > 1) d)"),
    "customer.signup_after_first_order": ("warn", "lte", 0.005, part("days_to_first_order < 0", "mart_customers")),
    "catalog.coverage": ("warn", "gte", 0.9, part("both_sides = 1", "(SELECT min(least(has_price, has_stock_record)) AS both_sides "
                         "FROM mart_idle GROUP BY item_id) x")),
    "catalog.items_complete": ("error", "eq", 0, "SELECT (SELECT count(DISTINCT item_id) FROM mart_idle) - (SELECT count(*) FROM "
                               f"(SELECT item_id FROM ({marts.PRICE_AT}) p UNION SELECT item_id FROM stock_position_now) u)"),
    "catalog.stock_without_price": ("error", "lte", 0.01, part("idle_class = 'estoque_sem_preco'", "mart_idle")),
    "catalog.class_exhaustive": ("error", "lte", 0, "SELECT count(*) FROM mart_idle WHERE idle_class = 'indefinido'"),
    "stock.negative_available": ("warn", "lte", 0.001, part("available < 0", "stock_position_now")),
    "dict.loaded": ("error", "lte", 0, "SELECT " + " + ".join(
        f"(SELECT CASE WHEN count(*) = 0 OR count(*) <> count(DISTINCT {k}) THEN 1 ELSE 0 END FROM {e}_now)"
        for e, k in (("business_unit", "bu_code"), ("discount_codes", "discount_code")))),
}
MONEY = {
    "mart_order_360": "gross_amount discount_amount freight_amount total_amount items_gross_amount items_discount_amount items_total_amount "
                      "authorized_amount captured_amount refunded_amount payment_gap_amount amount_mismatch_amount",
    "mart_revenue": "gross_revenue net_revenue avg_ticket",
    "mart_funnel": "amount_attempted amount_captured amount_refunded",
    "mart_effectiveness": "gross_amount discount_amount net_amount avg_ticket",
    "mart_baseline": "net_no_coupon avg_ticket_no_coupon net_with_coupon avg_ticket_with_coupon",
    "mart_margin": "revenue_practiced revenue_at_list cost_total margin_amount",
    "mart_stockout": "revenue_at_risk",
    "mart_customers": "lifetime_gross lifetime_discount lifetime_net avg_ticket max_ticket",
    "mart_cohort": "net_revenue revenue_per_customer",
    "mart_idle": "list_price cost_price immobilized_capital potential_revenue",
}
FLOATS = "('DOUBLE', 'FLOAT')"
CHECKS["money.no_float"] = ("error", "lte", 0, "SELECT " + " + ".join(
    f"(SELECT count(*) FILTER ({' OR '.join(f'typeof({c}) IN {FLOATS}' for c in columns.split())}) FROM {mart})"
    for mart, columns in MONEY.items()))
for _name in PARITY:
    CHECKS[f"marts.sum_parity.{_name}"] = ("error", "eq", 0, f"SELECT diff FROM ({BODIES[f'parity_{_name}']}) q")
OPS = {"lte": "<=", "gte": ">=", "eq": "=", "neq": "<>"}
for _id, (_sev, _cmp, _limit, _value) in CHECKS.items():
    BODIES["dq_" + _id.replace(".", "_")] = f"""
SELECT '{_id}' AS check_id, {SALES} AS run_at, '{_sev}' AS severity, value, {float(_limit)!r}::DOUBLE AS threshold,
  '{_cmp}' AS comparator, CAST(CASE WHEN value IS NULL OR value {OPS[_cmp]} {_limit} THEN 1 ELSE 0 END AS INTEGER) AS passed
FROM (SELECT CAST(({_value}) AS DOUBLE) AS value) v"""

# refreshes of given length in minutes, and the interval of their mart
REFRESHED = "(VALUES ('stock_coverage', 8, 15), ('idle_catalog', 29, 60)) AS log(mart, minutes, every)"
BODIES["dq_marts_refresh"] = "\nUNION ALL\n".join(
    f"""SELECT '{check}' AS check_id, {SALES} AS run_at, '{sev}' AS severity, n::DOUBLE AS value, 0::DOUBLE AS threshold, 'lte' AS comparator,
  CAST(CASE WHEN n <= 0 THEN 1 ELSE 0 END AS INTEGER) AS passed FROM (SELECT count(*) FILTER ({wrong}) AS n FROM {REFRESHED}) l"""
    for check, sev, wrong in (
        ("marts.refresh_health", "error", "0 > 2 * every * 60"),
        ("marts.refresh_duration", "warn", "minutes * 60000 >= every * 30000"),
    )
)
# the second of three daily runs sees every order twice
KEPT = ("marts.order_360.grain", "marts.order_360.amount_mismatch_rate", "marts.order_360.bu_orphan_rate",
        "customer.signup_after_first_order", "stock.negative_available")
BODIES["dq_history"] = "\nUNION ALL\n".join(
    f"""SELECT check_id, CAST(3 AS BIGINT) AS runs, CAST({"1 + 2 * (1 - passed)" if _id == KEPT[0] else "3 * (1 - passed)"} AS BIGINT) AS failed_runs,
  CAST({"2 * passed" if _id == KEPT[0] else "0"} AS BIGINT) AS turns,
  CASE WHEN passed = 0 THEN run_at - INTERVAL 2 DAY END AS failing_since, run_at AS last_run_at, severity, value, passed,
  CASE WHEN value IS NULL THEN 'nothing to measure' WHEN passed = 1 THEN 'holds: ' ELSE 'violated: ' END
    || CASE WHEN value IS NULL THEN '' ELSE '{CHECKS[_id][1]} {float(CHECKS[_id][2])!r}' END AS details
FROM ({BODIES["dq_" + _id.replace(".", "_")]}) c"""
    for _id in KEPT
)


def all_sql() -> dict[str, str]:
    return {name: sql(body) for name, body in BODIES.items()}
