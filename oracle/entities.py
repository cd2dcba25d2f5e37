"""The eight entities as SQL over the test tables: landing, core, current."""

from oracle.compose import define, exact

TECH = "_topic, _partition, _offset, _kafka_ts, _ingested_at, _op, _cdc_seq, _schema_id"

COLUMNS = {
    "order": "order_id, customer_id, business_unit_code, order_status, channel, currency, "
    "discount_code, gross_amount, discount_amount, freight_amount, total_amount, created_at, updated_at",
    "order_item": "order_id, item_seq, item_id, dc_id, quantity, unit_price, gross_amount, "
    "discount_amount, total_amount, created_at, updated_at",
    "order_payment": "payment_id, order_id, payment_method, installments, payment_status, amount, "
    "acquirer, authorized_at, captured_at, created_at, updated_at",
    "customer": "customer_id, document_hash, first_name, email_hash, customer_since, segment, "
    "loyalty_tier, city, state, zipcode, created_at, updated_at",
    "business_unit": "bu_code, bu_name, channel, region, country, cost_center, active, created_at, updated_at",
    "prices": "item_id, price_list_id, currency, list_price, cost_price, valid_from, valid_to, created_at, updated_at",
    "discount_codes": "discount_code, campaign_name, discount_type, discount_value, valid_from, "
    "valid_to, max_uses, business_unit_scope, created_at, updated_at",
    "stock_position": "item_id, dc_id, dc_name, on_hand, reserved, available, safety_stock, "
    "position_at, created_at, updated_at",
}
KEYS = {
    "order": "order_id",
    "order_item": "order_id, item_seq",
    "order_payment": "payment_id",
    "customer": "customer_id",
    "business_unit": "bu_code",
    "prices": "item_id, price_list_id, valid_from",
    "discount_codes": "discount_code",
    "stock_position": "item_id, dc_id",
}
CONTEXT = {
    "order": "sales",
    "order_item": "sales",
    "order_payment": "sales",
    "customer": "customer",
    "business_unit": "organization",
    "prices": "pricing",
    "discount_codes": "pricing",
    "stock_position": "inventory",
}
SLA = {
    "order": 10, "order_item": 10, "order_payment": 10, "customer": 60,
    "business_unit": 1440, "prices": 240, "discount_codes": 720, "stock_position": 30,
}


def tech(entity, part, offset, kafka, op, seq):
    topic = f"sap.{CONTEXT[entity]}.{entity}.v1"
    return (
        f"'{topic}' AS _topic, CAST({part} AS INTEGER) AS _partition, CAST({offset} AS BIGINT) AS _offset, "
        f"{kafka} AS _kafka_ts, {kafka} AS _ingested_at, {op} AS _op, CAST({seq} AS BIGINT) AS _cdc_seq, "
        "CAST(1 AS INTEGER) AS _schema_id"
    )


define("order_raw", f"""
SELECT b.*, CAST(gross_amount - discount_amount + freight_amount AS DECIMAL(18,4)) AS total_amount
FROM (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id,
    CAST(o_custkey AS VARCHAR) AS customer_id,
    CAST(o_custkey % 25 AS VARCHAR) AS business_unit_code,
    CASE WHEN seq = 2 THEN 'canceled' WHEN seq = 4 THEN 'delivered'
         WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'O' THEN 'paid'
         WHEN o_orderkey % 2 = 0 THEN 'canceled' ELSE 'created' END AS order_status,
    CASE o_orderkey % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'app' ELSE 'store' END AS channel,
    CASE WHEN o_orderkey % 10 = 0 THEN 'USD' ELSE 'BRL' END AS currency,
    CASE o_orderkey % 4 WHEN 1 THEN o_orderpriority WHEN 2 THEN lower(o_orderpriority)
         WHEN 3 THEN ' ' || o_orderpriority || '  ' END AS discount_code,
    CAST(o_totalprice AS DECIMAL(18,4)) AS gross_amount,
    CAST(CASE WHEN o_orderkey % 4 = 0 THEN 0
         ELSE CAST(o_totalprice AS DECIMAL(18,4)) * CAST(0.1 AS DECIMAL(2,1)) END AS DECIMAL(18,4)) AS discount_amount,
    CAST(10 AS DECIMAL(18,4)) AS freight_amount,
    o_orderdate AS created_at,
    o_orderdate + to_hours(CAST(o_orderkey % 72 AS INTEGER)) AS updated_at,
    {tech("order", "o_orderkey % 6",
          "o_orderkey * 8 + CASE WHEN o_orderkey % 10 = 0 THEN 5 - seq ELSE seq END",
          "(o_orderdate + to_hours(seq))",
          "CASE seq WHEN 2 THEN 'u' WHEN 3 THEN 'd' ELSE 'c' END", "seq")}
  FROM orders JOIN (VALUES (1), (2), (3), (4)) v(seq)
    ON seq = 1 OR (seq = 2 AND o_orderkey % 5 = 0) OR (seq = 3 AND o_orderkey % 67 = 0)
       OR (seq = 4 AND o_orderkey % 134 = 0)
) b
""")

define("order_item_raw", f"""
SELECT b.*, CAST(gross_amount - discount_amount AS DECIMAL(18,4)) AS total_amount,
  CAST({exact("gross_amount", "quantity")} AS DECIMAL(18,4)) AS unit_price
FROM (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_linenumber AS item_seq,
    CAST(l_partkey AS VARCHAR) AS item_id,
    CASE WHEN l_suppkey % 9 <> 0 THEN CAST(l_suppkey % 12 AS VARCHAR) END AS dc_id,
    CAST(l_quantity AS INTEGER) AS quantity,
    CAST(l_extendedprice AS DECIMAL(18,4)) AS gross_amount,
    CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS discount_amount,
    o_orderdate AS created_at, l_shipdate AS updated_at,
    {tech("order_item", "l_partkey", "l_suppkey", "(o_orderdate + INTERVAL 1 HOUR)",
          "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'd' ELSE 'u' END",
          "date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))")}
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
) b
""")

define("order_payment_raw", f"""
SELECT b.*, COALESCE(captured_at, authorized_at, created_at) AS updated_at
FROM (
  SELECT CAST(event_id AS VARCHAR) AS payment_id,
    CAST(2 * (event_id - event_id % 3) AS VARCHAR) AS order_id,
    CASE user_id % 4 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'pix' WHEN 2 THEN 'boleto' ELSE 'voucher' END AS payment_method,
    CAST(event_id % 15 AS INTEGER) AS installments,
    CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'authorized' WHEN 'purchase' THEN 'captured'
         WHEN 'error' THEN 'denied' ELSE 'refunded' END AS payment_status,
    CAST(value AS DECIMAL(18,4)) AS amount,
    CAST(user_id % 5 AS VARCHAR) AS acquirer,
    CASE WHEN event_type IN ('click', 'purchase', 'signup')
         THEN ts + to_seconds(CAST(event_id % 60 AS INTEGER)) END AS authorized_at,
    CASE WHEN event_type = 'purchase'
         THEN ts + to_seconds(CAST(event_id % 60 + 30 AS INTEGER)) END AS captured_at,
    ts AS created_at,
    {tech("order_payment", "event_id % 6", "event_id", "ts", "'c'", "1")}
  FROM events
) b
""")

define("customer_raw", f"""
SELECT CAST(k AS VARCHAR) AS customer_id, 'd' || k AS document_hash, name AS first_name, 'e' || k AS email_hash,
  CAST(DATE '1995-01-01' + CAST(abs(k) % 2400 AS INTEGER) AS DATE) AS customer_since,
  segment,
  CASE abs(k) % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'silver' WHEN 2 THEN 'gold' ELSE 'black' END AS loyalty_tier,
  'city-' || nation AS city, CAST(nation AS VARCHAR) AS state, CAST(abs(k) % 1000 AS VARCHAR) AS zipcode,
  CAST(DATE '1995-01-01' + CAST(abs(k) % 2400 AS INTEGER) AS TIMESTAMP) AS created_at,
  CAST(DATE '1995-01-01' + CAST(abs(k) % 2400 AS INTEGER) AS TIMESTAMP) AS updated_at,
  {tech("customer", "abs(k) % 6",
        "(abs(k) + CASE WHEN k < 0 THEN 1000000000000 ELSE 0 END) * 2 + seq",
        "(CAST(DATE '1995-01-01' + CAST(abs(k) % 2400 AS INTEGER) AS TIMESTAMP) + to_hours(seq))",
        "CASE WHEN seq = 2 THEN 'd' ELSE 'c' END", "seq")}
FROM (
  SELECT c_custkey AS k, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer
  UNION ALL
  SELECT CAST(-i AS BIGINT), 'Idle#' || i, 0, 'IDLE' FROM generate_series(1, 10) g(i)
) c JOIN (VALUES (1), (2)) v(seq) ON seq = 1 OR (k > 0 AND k % 211 = 0)
""")

define("business_unit_raw", f"""
SELECT CAST(n_nationkey AS VARCHAR) AS bu_code, n_name AS bu_name,
  CASE n_nationkey % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'app' ELSE 'store' END AS channel,
  r_name AS region, 'C' || n_nationkey AS country, 'CC-' || n_nationkey AS cost_center,
  n_nationkey % 7 <> 0 AS active,
  TIMESTAMP '1995-01-01' AS created_at, TIMESTAMP '1995-01-01' AS updated_at,
  {tech("business_unit", "0", "n_nationkey", "TIMESTAMP '1995-01-01'", "'c'", "1")}
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey NOT IN (3, 17)
""")

define("prices_raw", f"""
SELECT b.*, CAST(list_price * CAST(0.6 AS DECIMAL(2,1)) AS DECIMAL(18,4)) AS cost_price,
  valid_from AS created_at, valid_from AS updated_at
FROM (
  SELECT CAST(p_partkey AS VARCHAR) AS item_id, 'varejo' AS price_list_id, 'BRL' AS currency,
    CAST(CAST(p_retailprice AS DECIMAL(18,4)) * factor AS DECIMAL(18,4)) AS list_price,
    valid_from, valid_to,
    {tech("prices", "p_partkey % 6", "p_partkey * 3 + step", "valid_from", "'c'", "1")}
  FROM part, (VALUES
    (0, TIMESTAMP '1996-01-01', TIMESTAMP '1998-01-01', CAST(1.0 AS DECIMAL(2,1))),
    (1, TIMESTAMP '1998-01-01', TIMESTAMP '2000-01-01', CAST(1.1 AS DECIMAL(2,1))),
    (2, TIMESTAMP '2000-01-01', CAST(NULL AS TIMESTAMP), CAST(1.2 AS DECIMAL(2,1)))
  ) v(step, valid_from, valid_to, factor)
  WHERE p_partkey % 40 <> 0
) b
""")

define("discount_codes_raw", f"""
SELECT c AS discount_code, 'campaign ' || c AS campaign_name, 'percent' AS discount_type,
  CAST(10 AS DECIMAL(18,4)) AS discount_value, TIMESTAMP '1995-06-01' AS valid_from, TIMESTAMP '2001-01-01' AS valid_to,
  CAST(1000 AS BIGINT) AS max_uses, CASE WHEN c = '1-URGENT' THEN '5' END AS business_unit_scope,
  TIMESTAMP '1995-01-01' AS created_at, TIMESTAMP '1995-01-01' AS updated_at,
  {tech("discount_codes", "0", "CAST(substr(c, 1, 1) AS BIGINT)", "TIMESTAMP '1995-01-01'", "'c'", "1")}
FROM (SELECT DISTINCT o_orderpriority AS c FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED') d
""")

define("stock_position_raw", f"""
SELECT CAST(k AS VARCHAR) AS item_id, CAST(dc AS VARCHAR) AS dc_id, 'DC ' || dc AS dc_name,
  on_hand, reserved, CAST(on_hand - reserved AS BIGINT) AS available, CAST(50 AS BIGINT) AS safety_stock,
  TIMESTAMP '2001-08-01' AS position_at, TIMESTAMP '2001-08-01' AS created_at, TIMESTAMP '2001-08-01' AS updated_at,
  {tech("stock_position", "dc", "abs(k) + CASE WHEN k < 0 THEN 1000000000000 ELSE 0 END",
        "TIMESTAMP '2001-08-01 23:30:00'", "'c'", "1")}
FROM (
  SELECT p_partkey AS k, p_partkey % 12 AS dc, CAST(10 * p_size AS BIGINT) AS on_hand, p_partkey % 120 AS reserved
  FROM part WHERE p_partkey % 25 <> 0
  UNION ALL
  SELECT p_partkey, (p_partkey + 5) % 12, CAST(10 * p_size AS BIGINT), p_partkey % 120
  FROM part WHERE p_partkey % 25 <> 0
  UNION ALL
  SELECT CAST(-i AS BIGINT), CAST(0 AS BIGINT), CAST(100 AS BIGINT), CAST(0 AS BIGINT) FROM generate_series(1, 5) g(i)
) s
""")

VERSION_DESC = "_cdc_seq DESC, _kafka_ts DESC, _partition DESC, _offset DESC"

for _entity, _columns in COLUMNS.items():
    define(f"{_entity}_core", f"""
SELECT {_columns}, _cdc_seq, _kafka_ts, _partition, _offset,
  CAST(CASE WHEN _op = 'd' THEN 1 ELSE 0 END AS INTEGER) AS _is_deleted, _ingested_at
FROM {_entity}_raw
""")
    define(f"{_entity}_newest", f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY {KEYS[_entity]} ORDER BY {VERSION_DESC}) AS rn
  FROM {_entity}_raw) v WHERE rn = 1
""")
    define(f"{_entity}_now", f"SELECT {_columns}, _ingested_at FROM {_entity}_newest WHERE _op <> 'd'")
