"""KPI, dashboard and single-answer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kpis
from ..sources.warehouse import warehouse
from . import params as P
from .catalog import query

Y = P.YEAR
NC = "NOT is_cancellation"


def _sql_year(col: str = "invoice_date") -> str:
    return f"year({col})"


# ---- predicates ---------------------------------------------------------------

@query("filter_flag_not", f"SELECT invoice_no, stock_code, quantity, CAST(revenue AS DOUBLE) AS revenue FROM sales WHERE {NC}")
def filter_flag_not(spark, sf):
    return kpis.completed(warehouse(spark, sf).sales).select(
        "invoice_no", "stock_code", "quantity", F.col("revenue").cast("double").alias("revenue")
    )


@query("filter_year", f"SELECT invoice_no, stock_code, invoice_date FROM sales WHERE year(invoice_date) = {Y}")
def filter_year(spark, sf):
    return kpis.in_year(warehouse(spark, sf).sales, Y).select("invoice_no", "stock_code", "invoice_date")


@query("filter_month_prefix",
       f"SELECT invoice_month, COUNT(*) AS lines FROM sales WHERE invoice_month LIKE '{Y}%' GROUP BY invoice_month")
def filter_month_prefix(spark, sf):
    df = kpis.in_month_prefix(warehouse(spark, sf).sales, str(Y))
    return df.groupBy("invoice_month").agg(F.count(F.lit(1)).alias("lines"))


@query("filter_equality", f"""
SELECT 'country' AS filter, COUNT(*) AS lines FROM sales WHERE country = '{P.COUNTRY_B}'
UNION ALL SELECT 'customer', COUNT(*) FROM sales WHERE customer_id = {P.CUSTOMER}
UNION ALL SELECT 'stock_code', COUNT(*) FROM sales WHERE stock_code = '{P.STOCK_CODE}'""")
def filter_equality(spark, sf):
    s = warehouse(spark, sf).sales
    parts = [("country", P.COUNTRY_B), ("customer_id", P.CUSTOMER), ("stock_code", P.STOCK_CODE)]
    names = {"customer_id": "customer"}
    out = None
    for col, val in parts:
        one = kpis.equals(s, col, val).agg(F.count(F.lit(1)).alias("lines")).select(
            F.lit(names.get(col, col)).alias("filter"), "lines"
        )
        out = one if out is None else out.unionByName(one)
    return out


@query("filter_exclude_value",
       f"SELECT country, COUNT(*) AS lines FROM sales WHERE country <> '{P.HOME}' GROUP BY country")
def filter_exclude_value(spark, sf):
    return kpis.excluding(warehouse(spark, sf).sales, "country", P.HOME).groupBy("country").agg(
        F.count(F.lit(1)).alias("lines")
    )


@query("filter_in_list", f"""
SELECT invoice_month, country, COUNT(*) AS lines FROM sales
WHERE invoice_month IN ('{P.MONTH_OLD}', '{P.MONTH_NEW}') AND country IN ('{P.COUNTRY_A}', '{P.COUNTRY_B}')
GROUP BY invoice_month, country""")
def filter_in_list(spark, sf):
    s = warehouse(spark, sf).sales
    s = kpis.in_list(kpis.in_list(s, "invoice_month", [P.MONTH_OLD, P.MONTH_NEW]), "country", [P.COUNTRY_A, P.COUNTRY_B])
    return s.groupBy("invoice_month", "country").agg(F.count(F.lit(1)).alias("lines"))


@query("filter_not_null", "SELECT COUNT(*) AS lines, COUNT(DISTINCT customer_id) AS customers FROM sales WHERE customer_id IS NOT NULL")
def filter_not_null(spark, sf):
    return kpis.identified(warehouse(spark, sf).sales).agg(
        F.count(F.lit(1)).alias("lines"), F.countDistinct("customer_id").alias("customers")
    )


@query("filter_extreme_quantity", f"""
SELECT invoice_no, stock_code, quantity, invoice_ts, CAST(unit_price AS DOUBLE) AS unit_price, customer_id
FROM sales WHERE quantity > {P.EXTREME_QTY} OR quantity < -{P.EXTREME_QTY}""")
def filter_extreme_quantity(spark, sf):
    return kpis.extreme_quantity(warehouse(spark, sf).sales, P.EXTREME_QTY).withColumn(
        "unit_price", F.col("unit_price").cast("double")
    )


_DASH_FROM = "FROM sales s JOIN dim_month m USING (invoice_month)"


@query("filter_dynamic", f"""
SELECT s.invoice_month, COUNT(*) AS lines, CAST(SUM(s.revenue) AS DOUBLE) AS revenue {_DASH_FROM}
WHERE year(s.invoice_date) = {Y} AND s.country = '{P.COUNTRY_A}' AND m.is_complete_month
GROUP BY s.invoice_month""")
def filter_dynamic(spark, sf):
    wh = warehouse(spark, sf)
    df = kpis.dashboard_filter(wh.sales, wh.dim_month, year=Y, market=P.COUNTRY_A, complete_only=True)
    return df.groupBy("invoice_month").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("revenue").cast("double").alias("revenue")
    )


# ---- KPIs --------------------------------------------------------------------------

@query("kpi_revenue", f"""
SELECT year(invoice_date) AS year, CAST(SUM(revenue) AS DOUBLE) AS revenue
FROM sales WHERE {NC} GROUP BY ROLLUP (year(invoice_date))""")
def kpi_revenue(spark, sf):
    return kpis.kpi_revenue(warehouse(spark, sf).sales)


@query("kpi_units_sold", f"""
SELECT year(invoice_date) AS year, CAST(SUM(quantity) AS BIGINT) AS units
FROM sales WHERE {NC} AND quantity > 0 GROUP BY ROLLUP (year(invoice_date))""")
def kpi_units_sold(spark, sf):
    return kpis.kpi_units_sold(warehouse(spark, sf).sales)


@query("kpi_orders", f"""
SELECT year(invoice_date) AS year, COUNT(DISTINCT invoice_no) AS orders
FROM sales WHERE {NC} GROUP BY ROLLUP (year(invoice_date))""")
def kpi_orders(spark, sf):
    return kpis.kpi_orders(warehouse(spark, sf).sales)


@query("kpi_aov", f"""
SELECT year(invoice_date) AS year,
       CAST(SUM(revenue) AS DOUBLE) / NULLIF(CAST(COUNT(DISTINCT invoice_no) AS DOUBLE), 0) AS aov
FROM sales WHERE {NC} GROUP BY ROLLUP (year(invoice_date))""")
def kpi_aov(spark, sf):
    return kpis.kpi_aov(warehouse(spark, sf).sales)


@query("kpi_cancellation_rate", """
SELECT year(invoice_date) AS year,
       COUNT(DISTINCT CASE WHEN is_cancellation THEN invoice_no END) AS cancellations,
       COUNT(DISTINCT CASE WHEN NOT is_cancellation THEN invoice_no END) AS orders,
       100.0 * CAST(COUNT(DISTINCT CASE WHEN is_cancellation THEN invoice_no END) AS DOUBLE)
         / NULLIF(CAST(COUNT(DISTINCT CASE WHEN NOT is_cancellation THEN invoice_no END) AS DOUBLE), 0)
         AS cancellation_rate
FROM sales GROUP BY ROLLUP (year(invoice_date))""")
def kpi_cancellation_rate(spark, sf):
    return kpis.kpi_cancellation_rate(warehouse(spark, sf).sales)


@query("kpi_cancellation_rate_subq", f"""
SELECT 100.0 * CAST((SELECT COUNT(DISTINCT invoice_no) FROM sales WHERE is_cancellation AND year(invoice_date) = {Y}) AS DOUBLE)
       / NULLIF(CAST((SELECT COUNT(DISTINCT invoice_no) FROM sales WHERE NOT is_cancellation AND year(invoice_date) = {Y}) AS DOUBLE), 0)
       AS cancellation_rate""")
def kpi_cancellation_rate_subq(spark, sf):
    return kpis.kpi_cancellation_rate_subq(warehouse(spark, sf).sales, Y)


@query("kpi_active_customers", f"""
SELECT year(invoice_date) AS year, COUNT(DISTINCT customer_id) AS customers
FROM sales WHERE {NC} AND customer_id IS NOT NULL GROUP BY ROLLUP (year(invoice_date))""")
def kpi_active_customers(spark, sf):
    return kpis.kpi_active_customers(warehouse(spark, sf).sales)


@query("kpi_revenue_by_country", f"""
SELECT country, CAST(SUM(revenue) AS DOUBLE) AS revenue
FROM sales WHERE {NC} AND year(invoice_date) = {Y} GROUP BY country""")
def kpi_revenue_by_country(spark, sf):
    return kpis.kpi_revenue_by_country(warehouse(spark, sf).sales, Y)


def _product_name_cte(where: str, name: str = "pn") -> str:
    from .oracle_base import modal

    return f"{name} AS ({modal('sales', 'stock_code', 'description', where)})"


@query("kpi_revenue_by_product", f"""
SELECT s.stock_code, MAX(pn.description) AS description, CAST(SUM(s.revenue) AS DOUBLE) AS revenue
FROM sales s LEFT JOIN pn ON s.stock_code = pn.stock_code
WHERE NOT s.is_cancellation AND s.is_product AND NOT s.is_outlier AND year(s.invoice_date) = {Y}
GROUP BY s.stock_code""",
       ctes=_product_name_cte(f"{NC} AND is_product AND NOT is_outlier AND year(invoice_date) = {Y}"))
def kpi_revenue_by_product(spark, sf):
    return kpis.kpi_revenue_by_product(warehouse(spark, sf).sales, Y)


@query("kpi_units_per_order", f"""
SELECT year(invoice_date) AS year,
       CAST(SUM(CASE WHEN quantity > 0 THEN quantity END) AS DOUBLE)
         / NULLIF(CAST(COUNT(DISTINCT invoice_no) AS DOUBLE), 0) AS units_per_order
FROM sales WHERE {NC} GROUP BY ROLLUP (year(invoice_date))""")
def kpi_units_per_order(spark, sf):
    return kpis.kpi_units_per_order(warehouse(spark, sf).sales)


@query("kpi_repeat_customer_rate", f"""
WITH pop AS (SELECT customer_id, year(invoice_date) AS year, invoice_no FROM sales
             WHERE {NC} AND customer_id IS NOT NULL),
per AS (SELECT customer_id, year, COUNT(DISTINCT invoice_no) AS n FROM pop GROUP BY customer_id, year
        UNION ALL
        SELECT customer_id, CAST(NULL AS BIGINT), COUNT(DISTINCT invoice_no) FROM pop GROUP BY customer_id)
SELECT year, COUNT(*) AS customers, COUNT(*) FILTER (WHERE n > 1) AS repeat_customers,
       100.0 * CAST(COUNT(*) FILTER (WHERE n > 1) AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0) AS repeat_rate
FROM per GROUP BY year""")
def kpi_repeat_customer_rate(spark, sf):
    return kpis.kpi_repeat_customer_rate(warehouse(spark, sf).sales)


@query("kpi_dashboard_metrics", f"""
SELECT *, CAST(revenue AS DOUBLE) / NULLIF(CAST(orders AS DOUBLE), 0) AS aov,
       100.0 * CAST(guest_lines AS DOUBLE) / NULLIF(CAST(lines AS DOUBLE), 0) AS guest_line_pct FROM (
SELECT CAST(COALESCE(SUM(s.revenue) FILTER (WHERE NOT s.is_cancellation), 0) AS DOUBLE) AS revenue,
       COUNT(DISTINCT s.invoice_no) FILTER (WHERE NOT s.is_cancellation) AS orders,
       COUNT(DISTINCT s.customer_id) FILTER (WHERE NOT s.is_cancellation) AS customers,
       COUNT(*) AS lines,
       COUNT(*) FILTER (WHERE s.customer_id IS NULL) AS guest_lines,
       MIN(s.invoice_date) AS first_day, MAX(s.invoice_date) AS last_day,
       COUNT(DISTINCT s.invoice_date) AS days
{_DASH_FROM} WHERE year(s.invoice_date) = {Y} AND m.is_complete_month) t""")
def kpi_dashboard_metrics(spark, sf):
    wh = warehouse(spark, sf)
    return kpis.kpi_dashboard_metrics(kpis.dashboard_filter(wh.sales, wh.dim_month, year=Y, complete_only=True))


@query("kpi_dashboard_metrics_empty", f"""
SELECT *, CAST(revenue AS DOUBLE) / NULLIF(CAST(orders AS DOUBLE), 0) AS aov,
       100.0 * CAST(guest_lines AS DOUBLE) / NULLIF(CAST(lines AS DOUBLE), 0) AS guest_line_pct FROM (
SELECT CAST(COALESCE(SUM(s.revenue) FILTER (WHERE NOT s.is_cancellation), 0) AS DOUBLE) AS revenue,
       COUNT(DISTINCT s.invoice_no) FILTER (WHERE NOT s.is_cancellation) AS orders,
       COUNT(DISTINCT s.customer_id) FILTER (WHERE NOT s.is_cancellation) AS customers,
       COUNT(*) AS lines,
       COUNT(*) FILTER (WHERE s.customer_id IS NULL) AS guest_lines,
       MIN(s.invoice_date) AS first_day, MAX(s.invoice_date) AS last_day,
       COUNT(DISTINCT s.invoice_date) AS days
{_DASH_FROM} WHERE year(s.invoice_date) = 1990) t""")
def kpi_dashboard_metrics_empty(spark, sf):
    """Filters that match nothing: one row of zeros/NULLs (the empty-set case)."""
    wh = warehouse(spark, sf)
    return kpis.kpi_dashboard_metrics(kpis.dashboard_filter(wh.sales, wh.dim_month, year=1990))


@query("guest_line_share", """
SELECT 100.0 * CAST(COUNT(*) FILTER (WHERE customer_id IS NULL) AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0) AS guest_line_pct,
       100.0 * CAST(SUM(revenue) FILTER (WHERE customer_id IS NULL) AS DOUBLE) / NULLIF(CAST(SUM(revenue) AS DOUBLE), 0) AS guest_revenue_pct
FROM sales""")
def guest_line_share(spark, sf):
    return kpis.guest_line_share(warehouse(spark, sf).sales)


_MONTHLY_SQL = f"""
SELECT s.invoice_month,
       CAST(SUM(s.revenue) FILTER (WHERE NOT s.is_cancellation) AS DOUBLE) AS revenue,
       COUNT(DISTINCT s.invoice_date) AS trading_days,
       BOOL_AND(m.is_complete_month) AS is_complete_month,
       CAST(SUM(s.revenue) FILTER (WHERE NOT s.is_cancellation) AS DOUBLE)
         / NULLIF(CAST(COUNT(DISTINCT s.invoice_date) AS DOUBLE), 0) AS revenue_per_day
{_DASH_FROM} WHERE s.country <> '{P.HOME}' GROUP BY s.invoice_month"""


@query("monthly_series", _MONTHLY_SQL)
def monthly_series(spark, sf):
    wh = warehouse(spark, sf)
    return kpis.monthly_series(kpis.dashboard_filter(wh.sales, wh.dim_month, foreign_of=P.HOME))


@query("monthly_revenue_per_day", f"""
SELECT invoice_month, CAST(net_revenue AS DOUBLE) / NULLIF(CAST(trading_days AS DOUBLE), 0) AS revenue_per_day
FROM dim_month WHERE invoice_month LIKE '{Y}%'""")
def monthly_revenue_per_day(spark, sf):
    from ..functions.money import ratio

    dm = warehouse(spark, sf).dim_month
    return dm.filter(F.col("invoice_month").startswith(str(Y))).select(
        "invoice_month", ratio("net_revenue", "trading_days").alias("revenue_per_day")
    )


@query("monthly_gross_trend", """
SELECT invoice_month, CAST(SUM(revenue) AS DOUBLE) AS revenue, COUNT(DISTINCT invoice_date) AS trading_days
FROM sales GROUP BY invoice_month""")
def monthly_gross_trend(spark, sf):
    return kpis.monthly_gross_trend(warehouse(spark, sf).sales)


@query("country_year_revenue", f"""
SELECT CAST(SUM(revenue) AS DOUBLE) AS revenue FROM sales
WHERE {NC} AND country = '{P.COUNTRY_B}' AND year(invoice_date) = {Y}""")
def country_year_revenue(spark, sf):
    return kpis.country_year_revenue(warehouse(spark, sf).sales, Y, P.COUNTRY_B)


@query("customer_order_count", f"""
SELECT COUNT(DISTINCT invoice_no) AS orders FROM sales WHERE {NC} AND customer_id = {P.CUSTOMER}""")
def customer_order_count(spark, sf):
    return kpis.customer_order_count(warehouse(spark, sf).sales, P.CUSTOMER)


@query("product_revenue_total", f"""
SELECT CAST(SUM(revenue) AS DOUBLE) AS revenue FROM sales WHERE {NC} AND stock_code = '{P.STOCK_CODE}'""")
def product_revenue_total(spark, sf):
    return kpis.product_revenue_total(warehouse(spark, sf).sales, P.STOCK_CODE)


@query("month_lookup", f"""
SELECT invoice_month, CAST(net_revenue AS DOUBLE) AS revenue, trading_days, is_complete_month
FROM dim_month WHERE invoice_month IN ('{P.MONTH_NEW}', '{P.MONTH_PARTIAL}')""")
def month_lookup(spark, sf):
    return kpis.month_lookup(warehouse(spark, sf).dim_month, [P.MONTH_NEW, P.MONTH_PARTIAL])


@query("share_of_total", f"""
SELECT 100.0 * CAST(SUM(CASE WHEN country = '{P.HOME}' THEN revenue ELSE 0 END) AS DOUBLE)
       / NULLIF(CAST(SUM(revenue) AS DOUBLE), 0) AS share_pct
FROM sales WHERE {NC} AND year(invoice_date) = {Y}""")
def share_of_total(spark, sf):
    return kpis.share_of_total(warehouse(spark, sf).sales, Y, P.HOME)


def _pivot_sql(new: str, old: str) -> str:
    n = f"MAX(CASE WHEN invoice_month = '{new}' THEN net_revenue END)"
    o = f"MAX(CASE WHEN invoice_month = '{old}' THEN net_revenue END)"
    return f"""
SELECT CAST({n} AS DOUBLE) AS new_revenue, CAST({o} AS DOUBLE) AS old_revenue,
       (CAST({n} AS DOUBLE) - CAST({o} AS DOUBLE)) / NULLIF(CAST({o} AS DOUBLE), 0) * 100.0 AS pct_change
FROM dim_month WHERE invoice_month IN ('{new}', '{old}')"""


@query("month_pct_change", _pivot_sql(P.MONTH_NEW, P.MONTH_OLD))
def month_pct_change(spark, sf):
    return kpis.month_pct_change(warehouse(spark, sf).dim_month, P.MONTH_NEW, P.MONTH_OLD)


@query("month_pct_change_prior", _pivot_sql(P.MONTH_OLD, P.MONTH_PRIOR))
def month_pct_change_prior(spark, sf):
    return kpis.month_pct_change(warehouse(spark, sf).dim_month, P.MONTH_OLD, P.MONTH_PRIOR)


@query("month_change_per_day", f"""
SELECT (CAST(a.net_revenue AS DOUBLE) - CAST(m.net_revenue AS DOUBLE)) / NULLIF(CAST(m.net_revenue AS DOUBLE), 0) * 100.0 AS total_pct,
       (CAST(a.net_revenue AS DOUBLE) / CAST(a.trading_days AS DOUBLE) - CAST(m.net_revenue AS DOUBLE) / CAST(m.trading_days AS DOUBLE))
         / NULLIF(CAST(m.net_revenue AS DOUBLE) / CAST(m.trading_days AS DOUBLE), 0) * 100.0 AS per_day_pct
FROM dim_month m, dim_month a WHERE m.invoice_month = '{P.MONTH_A}' AND a.invoice_month = '{P.MONTH_B}'""")
def month_change_per_day(spark, sf):
    return kpis.month_change_per_day(warehouse(spark, sf).dim_month, P.MONTH_A, P.MONTH_B)


def _guarded_sql(new: str, old: str) -> str:
    return f"""
WITH a AS (
  SELECT COUNT(*) FILTER (WHERE invoice_month = '{new}') > 0 AS has_new,
         COUNT(*) FILTER (WHERE invoice_month = '{old}') > 0 AS has_old,
         BOOL_AND(CASE WHEN invoice_month = '{new}' THEN is_complete_month END) AS new_complete,
         BOOL_AND(CASE WHEN invoice_month = '{old}' THEN is_complete_month END) AS old_complete,
         CAST(MAX(CASE WHEN invoice_month = '{new}' THEN net_revenue END) AS DOUBLE) AS new_revenue,
         CAST(MAX(CASE WHEN invoice_month = '{old}' THEN net_revenue END) AS DOUBLE) AS old_revenue,
         MAX(CASE WHEN invoice_month = '{new}' THEN trading_days END) AS new_days,
         MAX(CASE WHEN invoice_month = '{old}' THEN trading_days END) AS old_days
  FROM dim_month WHERE invoice_month IN ('{new}', '{old}')),
b AS (SELECT *, CASE WHEN NOT has_new OR NOT has_old THEN 'missing'
                     WHEN NOT new_complete OR NOT old_complete THEN 'incomplete'
                     ELSE 'ok' END AS status FROM a)
SELECT status, new_revenue, old_revenue, new_days, old_days,
       CASE WHEN status = 'ok' AND old_revenue <> 0
            THEN (new_revenue - old_revenue) / NULLIF(old_revenue, 0) * 100.0 END AS pct_change,
       CASE WHEN status = 'ok' AND old_revenue <> 0
            THEN CASE WHEN new_revenue > old_revenue THEN 'yes' ELSE 'no' END END AS increased
FROM b"""


@query("month_comparison_guarded", _guarded_sql(P.MONTH_PARTIAL, P.MONTH_NEW))
def month_comparison_guarded(spark, sf):
    return kpis.month_comparison_guarded(warehouse(spark, sf).dim_month, P.MONTH_PARTIAL, P.MONTH_NEW)


@query("month_comparison_ok", _guarded_sql(P.MONTH_NEW, P.MONTH_OLD))
def month_comparison_ok(spark, sf):
    return kpis.month_comparison_guarded(warehouse(spark, sf).dim_month, P.MONTH_NEW, P.MONTH_OLD)


@query("country_gap", f"""
WITH c AS (SELECT country, SUM(revenue) AS revenue FROM sales
           WHERE {NC} AND country IN ('{P.COUNTRY_A}', '{P.COUNTRY_B}') AND year(invoice_date) = {Y}
           GROUP BY country),
w AS (SELECT MAX(CASE WHEN country = '{P.COUNTRY_A}' THEN revenue END) AS a,
             MAX(CASE WHEN country = '{P.COUNTRY_B}' THEN revenue END) AS b FROM c)
SELECT CAST(a AS DOUBLE) AS revenue_a, CAST(b AS DOUBLE) AS revenue_b, CAST(a - b AS DOUBLE) AS difference,
       (CAST(a AS DOUBLE) - CAST(b AS DOUBLE)) / NULLIF(CAST(b AS DOUBLE), 0) * 100.0 AS pct
FROM w""")
def country_gap(spark, sf):
    return kpis.country_gap(warehouse(spark, sf).sales, Y, P.COUNTRY_A, P.COUNTRY_B)


_PROFILE_SQL = f"""
SELECT country, CAST(SUM(revenue) AS DOUBLE) AS revenue, COUNT(DISTINCT invoice_no) AS orders,
       COUNT(DISTINCT customer_id) AS customers,
       CAST(SUM(revenue) AS DOUBLE) / NULLIF(CAST(COUNT(DISTINCT invoice_no) AS DOUBLE), 0) AS avg_order
FROM sales WHERE {NC} AND year(invoice_date) = {Y} GROUP BY country"""


@query("country_profile", _PROFILE_SQL)
def country_profile(spark, sf):
    return kpis.country_profile(warehouse(spark, sf).sales, Y)


@query("country_aov_min_orders", f"""
SELECT country, orders, avg_order FROM ({_PROFILE_SQL}) p WHERE orders >= {P.MIN_ORDERS}""")
def country_aov_min_orders(spark, sf):
    return kpis.country_aov_min_orders(warehouse(spark, sf).sales, Y, P.MIN_ORDERS)


@query("customers_per_country", "SELECT country, COUNT(*) AS customers FROM dim_customer GROUP BY country")
def customers_per_country(spark, sf):
    return kpis.customers_per_country(warehouse(spark, sf).dim_customer)


@query("avg_customer_revenue_by_country", """
SELECT country, CAST(SUM(net_revenue) AS DOUBLE) / NULLIF(CAST(COUNT(net_revenue) AS DOUBLE), 0) AS avg_revenue
FROM dim_customer GROUP BY country""")
def avg_customer_revenue_by_country(spark, sf):
    return kpis.avg_customer_revenue_by_country(warehouse(spark, sf).dim_customer)


@query("return_value_rate", f"""
SELECT 100.0 * CAST(-SUM(CASE WHEN revenue < 0 THEN revenue END) AS DOUBLE)
         / NULLIF(CAST(SUM(CASE WHEN revenue > 0 THEN revenue END) AS DOUBLE), 0) AS all_items_pct,
       100.0 * CAST(-SUM(CASE WHEN revenue < 0 AND is_product AND NOT is_outlier THEN revenue END) AS DOUBLE)
         / NULLIF(CAST(SUM(CASE WHEN revenue > 0 AND is_product AND NOT is_outlier THEN revenue END) AS DOUBLE), 0) AS products_pct
FROM sales WHERE year(invoice_date) = {Y}""")
def return_value_rate(spark, sf):
    return kpis.return_value_rate(warehouse(spark, sf).sales, Y)


@query("returns_total", "SELECT CAST(-SUM(revenue) AS DOUBLE) AS returns_value FROM sales WHERE quantity < 0")
def returns_total(spark, sf):
    return kpis.returns_total(warehouse(spark, sf).sales)


# ---- second wording set: the same patterns with other dates and sizes ----------

PY = P.YEAR - 1   # prior reporting year


@query("share_of_total_prior_year", f"""
SELECT 100.0 * CAST(SUM(CASE WHEN country = '{P.COUNTRY_B}' THEN revenue ELSE 0 END) AS DOUBLE)
       / NULLIF(CAST(SUM(revenue) AS DOUBLE), 0) AS share_pct
FROM sales WHERE {NC} AND year(invoice_date) = {PY}""")
def share_of_total_prior_year(spark, sf):
    return kpis.share_of_total(warehouse(spark, sf).sales, PY, P.COUNTRY_B)


@query("month_pct_change_prior_year", _pivot_sql(f"{PY}-06", f"{PY}-05"))
def month_pct_change_prior_year(spark, sf):
    return kpis.month_pct_change(warehouse(spark, sf).dim_month, f"{PY}-06", f"{PY}-05")


@query("customer_order_count_year", f"""
SELECT COUNT(DISTINCT invoice_no) AS orders FROM sales
WHERE {NC} AND customer_id = {P.CUSTOMER} AND year(invoice_date) = {PY}""")
def customer_order_count_year(spark, sf):
    return kpis.customer_order_count(kpis.in_year(warehouse(spark, sf).sales, PY), P.CUSTOMER)


@query("monthly_revenue_per_day_pair", f"""
SELECT invoice_month, CAST(net_revenue AS DOUBLE) / NULLIF(CAST(trading_days AS DOUBLE), 0) AS revenue_per_day
FROM dim_month WHERE invoice_month IN ('{P.MONTH_OLD}', '{P.MONTH_NEW}')""")
def monthly_revenue_per_day_pair(spark, sf):
    from ..functions.money import ratio

    dm = kpis.month_values(warehouse(spark, sf).dim_month, [P.MONTH_OLD, P.MONTH_NEW])
    return dm.select("invoice_month", ratio("net_revenue", "trading_days").alias("revenue_per_day"))
