"""SQL building blocks for the DuckDB oracle (written from the definitions,
independently of the DataFrame code).  Only the driver's base tables exist
on the oracle side, so each query inlines the views it needs as CTEs."""

from __future__ import annotations

CTE: dict[str, str] = {}
DEPS: dict[str, list[str]] = {}


def cte(name: str, sql: str, deps: list[str] | None = None) -> None:
    CTE[name] = sql.strip()
    DEPS[name] = deps or []


cte("fx_orders", """
SELECT o_orderkey AS order_id, o_custkey AS customer_id,
  CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'canceled' END AS order_status,
  o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR AS order_purchase_timestamp,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL
       ELSE o_orderdate + (o_orderkey % 24 + 1) * INTERVAL '1' HOUR END AS order_approved_at,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 11 <> 0
       THEN o_orderdate + (o_orderkey % 71 - 2) * INTERVAL '1' DAY + INTERVAL '10' HOUR END AS order_delivered_customer_date,
  o_orderdate + INTERVAL '21' DAY AS order_estimated_delivery_date
FROM orders""")

cte("fx_order_items", """
SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
  l_extendedprice AS price, l_quantity * 0.25 AS freight_value
FROM lineitem
UNION ALL
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity * 0.25
FROM lineitem WHERE l_orderkey % 50 = 0""")

cte("fx_payments", """
SELECT o_orderkey AS order_id, 1 AS payment_sequential,
  CASE o_orderkey % 4 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'boleto' WHEN 2 THEN 'voucher' ELSE 'debit_card' END AS payment_type,
  o_orderkey % 10 + 1 AS payment_installments, o_totalprice AS payment_value
FROM orders WHERE o_orderkey % 97 <> 0
UNION ALL
SELECT o_orderkey, 2, 'voucher', 1, 10.0 FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey % 97 <> 0""")

cte("fx_customers", """
SELECT c_custkey AS customer_id, c_custkey AS customer_unique_id, n_name AS customer_state
FROM customer JOIN nation ON c_nationkey = n_nationkey""")

cte("fx_products", """
SELECT p_partkey AS product_id, CASE WHEN p_partkey % 40 = 0 THEN NULL ELSE p_type END AS product_category_name
FROM part""")

cte("fx_category_translation", """
SELECT DISTINCT p_type AS product_category_name, lower(p_type) AS product_category_name_english
FROM part WHERE p_type <> 'PROMO'""")

cte("fx_reviews", """
SELECT d.doc_id AS order_id,
  CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 5 WHEN l.quality = 1 THEN 3
       WHEN l.quality = 0 AND l.toxic = 0 THEN 2 WHEN l.quality = 0 THEN 1 ELSE 4 END AS review_score,
  CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE d.text END AS review_comment_message,
  TIMESTAMP '2018-01-01 00:00:00' + (d.doc_id % 400) * INTERVAL '1' DAY AS review_creation_date,
  d.lang AS lang
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")

cte("fx_lexicon", """
SELECT * FROM (VALUES ('the', 0.1), ('of', -0.4), ('and', 0.6), ('to', -0.9), ('in', 1.3),
  ('that', -1.7), ('for', 2.1), ('was', -2.3), ('it', 0.8), ('on', -0.2)) AS t(term, valence)""")

WIDE_SELECT = """
  o.order_id, o.customer_id, o.order_status, o.order_purchase_timestamp, o.order_approved_at,
  o.order_delivered_customer_date, o.order_estimated_delivery_date,
  i.order_item_id, i.product_id, i.price, i.freight_value,
  p.payment_sequential, p.payment_type, p.payment_installments, p.payment_value,
  c.customer_unique_id, c.customer_state, pr.product_category_name, ct.product_category_name_english"""

WIDE_FROM = """
FROM fx_orders o
LEFT JOIN fx_order_items i ON o.order_id = i.order_id
LEFT JOIN fx_payments p ON o.order_id = p.order_id
LEFT JOIN fx_customers c ON o.customer_id = c.customer_id
LEFT JOIN fx_products pr ON i.product_id = pr.product_id
LEFT JOIN fx_category_translation ct ON pr.product_category_name = ct.product_category_name"""

cte("wide_all", f"SELECT {WIDE_SELECT} {WIDE_FROM}",
    ["fx_orders", "fx_order_items", "fx_payments", "fx_customers", "fx_products", "fx_category_translation"])
cte("wide", f"SELECT DISTINCT {WIDE_SELECT} {WIDE_FROM}",
    ["fx_orders", "fx_order_items", "fx_payments", "fx_customers", "fx_products", "fx_category_translation"])

cte("delivered", """
SELECT order_id, customer_id, order_status, order_purchase_timestamp,
  coalesce(order_approved_at, order_purchase_timestamp) AS order_approved_at,
  order_delivered_customer_date, order_estimated_delivery_date, order_item_id, product_id, price,
  freight_value, payment_sequential, payment_type, payment_installments, payment_value,
  customer_unique_id, customer_state, product_category_name,
  coalesce(product_category_name_english, 'unknown') AS product_category_name_english
FROM wide
WHERE customer_id IS NOT NULL AND order_id IS NOT NULL AND price IS NOT NULL AND order_status = 'delivered'""",
    ["wide"])

cte("fact", """
SELECT d.*, CAST(year(d.order_purchase_timestamp) AS BIGINT) AS year,
  CAST(month(d.order_purchase_timestamp) AS BIGINT) AS month,
  dayname(d.order_purchase_timestamp) AS day_of_week,
  CAST(hour(d.order_purchase_timestamp) AS BIGINT) AS hour,
  CAST(floor(epoch(d.order_delivered_customer_date - d.order_purchase_timestamp) / 86400) AS BIGINT) AS delivery_days
FROM delivered d
WHERE d.price <= (SELECT quantile_cont(price, 0.995) FROM delivered)""", ["delivered"])


def with_ctes(body: str, *needed: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in needed:
        visit(n)
    body = body.strip()
    if not order:
        return body
    parts = ",\n".join(f"{n} AS (\n{CTE[n]}\n)" for n in order)
    if body[:5].upper() == "WITH ":
        return f"WITH {parts},\n{body[5:]}"
    return f"WITH {parts}\n{body}"


def md5_sql(salt: str, *cols: str) -> str:
    """md5 of salt and keys joined by '|', null key as empty text (matches functions.md5_key)."""
    parts = [f"'{salt}'"] + [f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols]
    return "md5(" + " || '|' || ".join(parts) + ")"


def md5_unit_sql(salt: str, *cols: str) -> str:
    return f"CAST(('0x' || substr({md5_sql(salt, *cols)}, 1, 8))::UBIGINT AS DOUBLE) / 4294967296.0"


def md5_int_sql(salt: str, *cols: str) -> str:
    return f"CAST(('0x' || substr({md5_sql(salt, *cols)}, 1, 8))::UBIGINT AS BIGINT)"
