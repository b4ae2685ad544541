"""Exploration and data-quality queries."""

from __future__ import annotations

from ..operators import analysis, quality
from ..sources.invoices import sheets
from ..sources.tables import read_table
from ..sources.warehouse import warehouse
from . import params as P
from .catalog import query

Y = P.YEAR

_PARETO = """
p AS (SELECT stock_code, SUM(revenue) AS revenue FROM sales WHERE quantity > 0 GROUP BY stock_code),
ranked AS (
  SELECT stock_code, revenue,
         ROW_NUMBER() OVER (ORDER BY revenue DESC, stock_code) AS rank,
         CAST(SUM(revenue) OVER (ORDER BY revenue DESC, stock_code ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
           / CAST(SUM(revenue) OVER () AS DOUBLE) AS cumulative_share
  FROM p)"""


@query("pareto_cumulative", "SELECT stock_code, CAST(revenue AS DOUBLE) AS revenue, rank, cumulative_share FROM ranked",
       ctes=_PARETO)
def pareto_cumulative(spark, sf):
    return analysis.pareto_cumulative(warehouse(spark, sf).sales)


@query("pareto_n80", """
SELECT COUNT(*) AS products, COUNT(*) FILTER (WHERE cumulative_share <= 0.8) + 1 AS products_for_80pct,
       100.0 * CAST(COUNT(*) FILTER (WHERE cumulative_share <= 0.8) + 1 AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0)
         AS pct_of_catalogue
FROM ranked""", ctes=_PARETO)
def pareto_n80(spark, sf):
    return analysis.pareto_n80(warehouse(spark, sf).sales)


def _quantile_sql(table: str, value: str, key: str, q: float) -> str:
    """Linear interpolation between neighbouring ranks, as the Spark side does."""
    return f"""(
    SELECT lo.v + (hi.v - lo.v) * (pos.p - floor(pos.p))
    FROM (SELECT {q} * CAST(COUNT(*) - 1 AS DOUBLE) AS p FROM {table}) pos,
         (SELECT CAST({value} AS DOUBLE) AS v, ROW_NUMBER() OVER (ORDER BY {value}, {key}) AS r FROM {table}) lo,
         (SELECT CAST({value} AS DOUBLE) AS v, ROW_NUMBER() OVER (ORDER BY {value}, {key}) AS r FROM {table}) hi
    WHERE lo.r = CAST(floor(pos.p) AS BIGINT) + 1 AND hi.r = CAST(ceil(pos.p) AS BIGINT) + 1)"""


@query("order_value_describe", f"""
WITH t AS (SELECT invoice_no, SUM(revenue) AS total FROM sales WHERE NOT is_cancellation GROUP BY invoice_no),
agg AS (SELECT COUNT(total) AS n, SUM(total) AS sx, SUM(total * total) AS sxx,
               CAST(MIN(total) AS DOUBLE) AS mn, CAST(MAX(total) AS DOUBLE) AS mx FROM t)
SELECT n AS count, CAST(sx AS DOUBLE) / NULLIF(CAST(n AS DOUBLE), 0) AS mean,
       sqrt(CAST(n * sxx - sx * sx AS DOUBLE) / NULLIF(CAST(n * (n - 1) AS DOUBLE), 0)) AS std,
       mn AS min, mx AS max,
       {_quantile_sql('t', 'total', 'invoice_no', 0.25)} AS p25,
       {_quantile_sql('t', 'total', 'invoice_no', 0.5)} AS p50,
       {_quantile_sql('t', 'total', 'invoice_no', 0.75)} AS p75
FROM agg""")
def order_value_describe(spark, sf):
    return analysis.order_value_describe(warehouse(spark, sf).sales)


@query("orders_per_customer_stats", f"""
WITH per AS (SELECT customer_id, COUNT(DISTINCT invoice_no) AS orders FROM sales
             WHERE quantity > 0 AND customer_id IS NOT NULL GROUP BY customer_id)
SELECT COUNT(*) AS customers, COUNT(*) FILTER (WHERE orders = 1) AS one_order_customers,
       100.0 * CAST(COUNT(*) FILTER (WHERE orders = 1) AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0) AS one_order_pct,
       {_quantile_sql('per', 'orders', 'customer_id', 0.5)} AS median_orders
FROM per""")
def orders_per_customer_stats(spark, sf):
    return analysis.orders_per_customer_stats(warehouse(spark, sf).sales)


@query("new_customers_by_month", """
WITH f AS (SELECT customer_id, MIN(invoice_month) AS first_month FROM sales
           WHERE quantity > 0 AND customer_id IS NOT NULL GROUP BY customer_id)
SELECT first_month, COUNT(*) AS new_customers FROM f GROUP BY first_month""")
def new_customers_by_month(spark, sf):
    return analysis.new_customers_by_month(warehouse(spark, sf).sales)


@query("top_customer_concentration", """
WITH per AS (SELECT customer_id, SUM(revenue) AS revenue FROM sales
             WHERE quantity > 0 AND customer_id IS NOT NULL GROUP BY customer_id),
top AS (SELECT SUM(revenue) AS v FROM (SELECT revenue FROM per ORDER BY revenue DESC, customer_id LIMIT 10) t),
tot AS (SELECT SUM(revenue) AS v FROM per)
SELECT CAST(top.v AS DOUBLE) AS top_revenue, CAST(tot.v AS DOUBLE) AS total_revenue,
       100.0 * CAST(top.v AS DOUBLE) / NULLIF(CAST(tot.v AS DOUBLE), 0) AS top_share_pct
FROM top, tot""")
def top_customer_concentration(spark, sf):
    return analysis.top_customer_concentration(warehouse(spark, sf).sales, 10)


@query("returns_by_product", f"""
WITH ret AS (SELECT stock_code, revenue FROM sales WHERE quantity < 0 AND year(invoice_date) = {Y}),
per AS (SELECT stock_code, -SUM(revenue) AS returned FROM ret GROUP BY stock_code),
top AS (SELECT * FROM per ORDER BY returned DESC, stock_code LIMIT 5),
nm AS (SELECT stock_code, description FROM (
         SELECT stock_code, description,
                ROW_NUMBER() OVER (PARTITION BY stock_code ORDER BY invoice_ts, invoice_no, description) AS rk
         FROM sales WHERE description IS NOT NULL) x WHERE rk = 1)
SELECT t.stock_code, nm.description, CAST(t.returned AS DOUBLE) AS returned_value,
       100.0 * CAST(t.returned AS DOUBLE) / NULLIF(CAST((SELECT -SUM(revenue) FROM ret) AS DOUBLE), 0) AS share_pct
FROM top t LEFT JOIN nm ON t.stock_code = nm.stock_code""")
def returns_by_product(spark, sf):
    return analysis.returns_by_product(warehouse(spark, sf).sales, Y)


@query("revenue_by_hour", """
SELECT CAST(hour(ts) AS BIGINT) AS hour, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM events GROUP BY hour(ts)""")
def revenue_by_hour(spark, sf):
    return analysis.revenue_by_hour(read_table(spark, sf, "events", "ts", "value"))


@query("revenue_by_weekday", """
SELECT dayname(invoice_ts) AS weekday, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM sales GROUP BY dayname(invoice_ts)""")
def revenue_by_weekday(spark, sf):
    return analysis.revenue_by_weekday(warehouse(spark, sf).sales)


@query("day_of_week_evidence", "SELECT DISTINCT invoice_date FROM sales WHERE dayname(invoice_ts) = 'Saturday'")
def day_of_week_evidence(spark, sf):
    return analysis.day_of_week_evidence(warehouse(spark, sf).sales, "Saturday")


@query("rows_for_lookup_label", f"""
SELECT description, COUNT(*) AS lines FROM sales
WHERE stock_code = '{P.STOCK_CODE}' AND description IS NOT NULL GROUP BY description""")
def rows_for_lookup_label(spark, sf):
    return analysis.rows_for_lookup_label(warehouse(spark, sf).sales, P.STOCK_CODE)


@query("outlier_cancel_pairs", f"""
WITH o AS (SELECT *, row_number() OVER () AS line FROM sales WHERE NOT is_cancellation AND quantity > 0)
SELECT o.invoice_no AS order_invoice, c.invoice_no AS cancel_invoice, o.stock_code, o.quantity,
       o.invoice_ts AS order_ts, c.invoice_ts AS cancel_ts,
       CAST(date_diff('day', CAST(o.invoice_ts AS DATE), CAST(c.invoice_ts AS DATE)) AS BIGINT) AS days_apart
FROM o JOIN sales c ON o.stock_code = c.stock_code AND c.quantity = -o.quantity
WHERE c.is_cancellation AND c.quantity < 0
  AND c.invoice_ts >= o.invoice_ts AND c.invoice_ts <= o.invoice_ts + INTERVAL {P.PAIR_WINDOW_DAYS} DAY
QUALIFY row_number() OVER (PARTITION BY o.line ORDER BY c.invoice_ts, c.invoice_no) = 1""")
def outlier_cancel_pairs(spark, sf):
    return analysis.outlier_cancel_pairs(warehouse(spark, sf).sales, P.PAIR_WINDOW_DAYS)


@query("overlap_effect", """
WITH b AS (SELECT strftime(invoice_ts, '%Y-%m') AS invoice_month, SUM(CAST(quantity * price AS DECIMAL(18,2))) AS v
           FROM sheets WHERE NOT starts_with(invoice, 'A') GROUP BY 1),
a AS (SELECT invoice_month, SUM(revenue) AS v FROM sales GROUP BY 1)
SELECT COALESCE(b.invoice_month, a.invoice_month) AS invoice_month,
       CAST(b.v AS DOUBLE) AS before_dedupe, CAST(a.v AS DOUBLE) AS after_dedupe,
       100.0 * (CAST(b.v AS DOUBLE) - CAST(a.v AS DOUBLE)) / NULLIF(CAST(a.v AS DOUBLE), 0) AS overstatement_pct
FROM b FULL OUTER JOIN a ON b.invoice_month = a.invoice_month""")
def overlap_effect(spark, sf):
    return analysis.overlap_effect(warehouse(spark, sf).table("sales_lineage"))


# ---- data quality ------------------------------------------------------------------

@query("flag_breakdown", """
SELECT is_cancellation, is_product, is_outlier, COUNT(*) AS lines, CAST(SUM(revenue) AS DOUBLE) AS revenue
FROM sales GROUP BY is_cancellation, is_product, is_outlier""")
def flag_breakdown(spark, sf):
    return quality.flag_breakdown(warehouse(spark, sf).sales)


@query("nonproduct_breakdown", """
SELECT stock_code, COUNT(*) AS lines, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM sales
WHERE NOT is_product GROUP BY stock_code""")
def nonproduct_breakdown(spark, sf):
    return quality.nonproduct_breakdown(warehouse(spark, sf).sales)


def _share(cond: str) -> str:
    return f"100.0 * CAST(COUNT(*) FILTER (WHERE {cond}) AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0)"


@query("quality_profile", f"""
SELECT COUNT(*) AS lines, {_share('customer_id IS NULL')} AS guest_pct, {_share('quantity < 0')} AS negative_qty_pct,
       {_share('is_cancellation')} AS cancellation_pct, {_share('NOT is_product')} AS non_product_pct,
       {_share('unit_price <= 0')} AS nonpositive_price_pct, {_share('description IS NULL')} AS missing_description_pct
FROM sales""")
def quality_profile(spark, sf):
    return quality.quality_profile(warehouse(spark, sf).sales)


_RAW_COLS = ["invoice", "stock_code", "description", "quantity", "invoice_ts", "price", "customer_id", "country"]


@query("null_counts", "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", COUNT(*) FILTER (WHERE {c} IS NULL) AS nulls FROM sheets" for c in _RAW_COLS))
def null_counts(spark, sf):
    return quality.null_counts(sheets(spark, sf))


@query("date_range", """
SELECT 1 AS sheet, MIN(invoice_ts) AS first_ts, MAX(invoice_ts) AS last_ts, COUNT(*) AS lines FROM sheet1
UNION ALL SELECT 2, MIN(invoice_ts), MAX(invoice_ts), COUNT(*) FROM sheet2
UNION ALL SELECT NULL, MIN(invoice_ts), MAX(invoice_ts), COUNT(*) FROM sheets""")
def date_range(spark, sf):
    from ..sources.invoices import tagged_sheets

    return quality.date_range(tagged_sheets(spark, sf))


@query("sanity_totals", """
SELECT CAST(SUM(revenue) AS DOUBLE) AS gross_revenue,
       CAST(SUM(revenue) FILTER (WHERE NOT is_cancellation) AS DOUBLE) AS net_revenue,
       CAST(SUM(revenue) FILTER (WHERE NOT is_cancellation) - SUM(revenue) AS DOUBLE) AS cancelled_value,
       100.0 * CAST(SUM(revenue) FILTER (WHERE NOT is_cancellation) - SUM(revenue) AS DOUBLE)
         / NULLIF(CAST(SUM(revenue) FILTER (WHERE NOT is_cancellation) AS DOUBLE), 0) AS difference_pct
FROM sales""")
def sanity_totals(spark, sf):
    return quality.sanity_totals(warehouse(spark, sf).sales)


@query("smoke_checks", """
WITH f AS (SELECT invoice_month, SUM(revenue) FILTER (WHERE NOT is_cancellation) AS sales_net,
                  COUNT(DISTINCT invoice_date) AS sales_days FROM sales GROUP BY invoice_month)
SELECT COALESCE(f.invoice_month, m.invoice_month) AS invoice_month,
       CAST(m.net_revenue AS DOUBLE) AS month_net, CAST(f.sales_net AS DOUBLE) AS sales_net,
       m.trading_days AS month_days,
       (m.net_revenue IS NOT DISTINCT FROM f.sales_net) AND (m.trading_days IS NOT DISTINCT FROM f.sales_days) AS ok
FROM f FULL OUTER JOIN dim_month m ON f.invoice_month = m.invoice_month""")
def smoke_checks(spark, sf):
    wh = warehouse(spark, sf)
    return quality.smoke_checks(wh.sales, wh.dim_month)


@query("reconcile_two_sources", """
WITH f AS (SELECT substr(invoice_month, 1, 4) AS year, CAST(SUM(revenue) AS DOUBLE) AS from_sales
           FROM sales WHERE NOT is_cancellation GROUP BY 1),
m AS (SELECT substr(invoice_month, 1, 4) AS year, CAST(SUM(net_revenue) AS DOUBLE) AS from_months FROM dim_month GROUP BY 1)
SELECT COALESCE(f.year, m.year) AS year, f.from_sales, m.from_months,
       COALESCE(abs(f.from_sales - m.from_months) <= greatest(0.011, 1e-6 * greatest(abs(f.from_sales), abs(m.from_months))), FALSE) AS ok
FROM f FULL OUTER JOIN m ON f.year = m.year""")
def reconcile_two_sources(spark, sf):
    wh = warehouse(spark, sf)
    return quality.reconcile_two_sources(wh.sales, wh.dim_month)


@query("share_breakdown_valid", f"""
WITH parts AS (SELECT country, SUM(revenue) AS revenue FROM sales WHERE NOT is_cancellation AND year(invoice_date) = {Y}
               GROUP BY country)
SELECT COUNT(*) AS categories, CAST(MIN(revenue) AS DOUBLE) AS smallest, CAST(SUM(revenue) AS DOUBLE) AS total,
       COUNT(*) >= 2 AND CAST(MIN(revenue) AS DOUBLE) >= 0 AND CAST(SUM(revenue) AS DOUBLE) > 0 AS valid
FROM parts""")
def share_breakdown_valid(spark, sf):
    from ..operators import kpis
    from pyspark.sql import functions as F

    parts = kpis.completed(kpis.in_year(warehouse(spark, sf).sales, Y)).groupBy("country").agg(
        F.sum("revenue").alias("revenue")
    )
    return quality.share_breakdown_valid(parts, "revenue")
