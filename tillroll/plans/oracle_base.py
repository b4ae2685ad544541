"""Shared DuckDB SQL prefix for the oracle: the test mapping and the built
tables, written independently of the Spark code (plain SQL over the views
``lineitem orders part customer nation events documents labels ...``).

Money is DECIMAL; every DOUBLE result is cast at the end, the same way the
Spark side does it, so both engines see identical inputs to each division.
"""

from __future__ import annotations


def modal(table: str, key: str, value: str, where: str = "TRUE") -> str:
    """SELECT key, value: the most frequent non-NULL value per key, ties to the
    smallest text (the rule the Spark side's ``mode(c, true)`` follows)."""
    return f"""
    SELECT {key}, {value} FROM (
        SELECT {key}, {value},
               ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY n DESC, {value}) AS rk
        FROM (SELECT {key}, {value}, COUNT(*) AS n FROM {table}
              WHERE {value} IS NOT NULL AND {where} GROUP BY {key}, {value}) counted
    ) ranked WHERE rk = 1"""


RAW = """
raw AS (
    SELECT
        CASE WHEN l.l_returnflag = 'R' THEN 'C'
             WHEN o.o_orderstatus = 'P' AND o.o_orderkey % 50 = 0 THEN 'A'
             ELSE '' END || CAST(l.l_orderkey AS VARCHAR)            AS invoice,
        'P' || CAST(l.l_partkey AS VARCHAR)                            AS stock_code,
        CASE WHEN l.l_linenumber = 7 THEN NULL
             WHEN l.l_linenumber = 6 THEN upper(p.p_name)
             ELSE p.p_name END                                         AS description,
        CAST(CASE WHEN l.l_returnflag = 'R'
                    OR (l.l_returnflag = 'N' AND l.l_linenumber = 5 AND l.l_quantity < 5)
                  THEN -l.l_quantity ELSE l.l_quantity END AS BIGINT)  AS quantity,
        o.o_orderdate                                                  AS invoice_ts,
        CASE WHEN l.l_returnflag = 'N' AND l.l_linenumber = 5 AND l.l_quantity < 5
             THEN CAST(0 AS DECIMAL(12,2))
             ELSE CAST(p.p_retailprice AS DECIMAL(12,2)) END           AS price,
        CASE WHEN o.o_custkey % 5 = 0 THEN NULL ELSE o.o_custkey END  AS customer_id,
        n.n_name                                                       AS country
    FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN part p ON l.l_partkey = p.p_partkey
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey
),
sheet1 AS (SELECT * FROM raw WHERE invoice_ts < TIMESTAMP '1998-06-10'),
sheet2 AS (SELECT * FROM raw WHERE invoice_ts >= TIMESTAMP '1998-06-01'),
sheets AS (SELECT * FROM sheet1 UNION ALL SELECT * FROM sheet2)"""

SALES = """
deduped AS (SELECT DISTINCT * FROM sheets),
sales AS (
    SELECT
        invoice                                        AS invoice_no,
        stock_code,
        description,
        quantity,
        invoice_ts,
        price                                          AS unit_price,
        customer_id,
        country,
        CAST(quantity * price AS DECIMAL(18,2))        AS revenue,
        starts_with(invoice, 'C')                      AS is_cancellation,
        stock_code NOT IN ('P0','P1','P2','P3','P4','P5','P6','P7','P8','P9',
                           'P10','P11','P12','P13','P14','P15','P16') AS is_product,
        invoice IN ('1001','C1001','2002','C2002')     AS is_outlier,
        CAST(invoice_ts AS DATE)                       AS invoice_date,
        strftime(invoice_ts, '%Y-%m')                  AS invoice_month
    FROM deduped
    WHERE NOT starts_with(invoice, 'A')
)"""

DIMS = f"""
dim_month AS (
    SELECT invoice_month,
           COUNT(DISTINCT invoice_date)                     AS trading_days,
           MAX(invoice_date)                                AS last_day,
           SUM(revenue) FILTER (WHERE NOT is_cancellation)  AS net_revenue,
           SUM(revenue)                                     AS gross_revenue,
           invoice_month <> (SELECT MAX(invoice_month) FROM sales) AS is_complete_month
    FROM sales GROUP BY invoice_month
),
product_name AS ({modal('sales', 'stock_code', 'description')}),
dim_product AS (
    SELECT s.stock_code, MAX(pn.description) AS description,
           CAST(SUM(s.quantity) FILTER (WHERE s.quantity > 0) AS BIGINT) AS units_sold,
           SUM(s.revenue) FILTER (WHERE s.quantity > 0)                  AS gross_revenue
    FROM sales s LEFT JOIN product_name pn ON s.stock_code = pn.stock_code
    GROUP BY s.stock_code
),
customer_country AS ({modal('sales', 'customer_id', 'country', 'customer_id IS NOT NULL')}),
dim_customer AS (
    SELECT s.customer_id, MAX(cc.country) AS country,
           MIN(s.invoice_date) AS first_order, MAX(s.invoice_date) AS last_order,
           COUNT(DISTINCT s.invoice_no) FILTER (WHERE NOT s.is_cancellation) AS orders,
           SUM(s.revenue) AS net_revenue
    FROM sales s LEFT JOIN customer_country cc ON s.customer_id = cc.customer_id
    WHERE s.customer_id IS NOT NULL
    GROUP BY s.customer_id
)"""

PREFIX = "WITH " + RAW + "," + SALES + "," + DIMS


def with_prefix(body: str, extra_ctes: str = "") -> str:
    """The shared CTEs, optional extra CTEs, then the query body. A body that
    starts with its own ``WITH`` has its CTEs appended to the shared list."""
    body = body.strip().rstrip(";")
    ctes = PREFIX + ("," + extra_ctes if extra_ctes else "")
    if body[:4].upper() == "WITH":
        return ctes + ",\n" + body[4:].lstrip()
    return ctes + "\n" + body
