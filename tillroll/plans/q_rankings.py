"""Rankings, top-k, extremes with ties and per-group winners."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import dbl
from ..operators import kpis, rankings
from ..sources.tables import read_table
from ..sources.warehouse import warehouse
from . import params as P
from .catalog import query
from .oracle_base import modal

Y, N = P.YEAR, P.TOP_N
NC = "NOT is_cancellation"
PRODUCT_POP = f"{NC} AND is_product AND NOT is_outlier AND year(invoice_date) = {Y}"


def _name_cte(where: str) -> str:
    return f"pn AS ({modal('sales', 'stock_code', 'description', where)})"


def _top_products_revenue(spark, sf, n=N):
    return kpis.top_products(kpis.in_year(warehouse(spark, sf).sales, Y), n)


@query("top_products_revenue", f"""
SELECT s.stock_code, MAX(pn.description) AS description, CAST(SUM(s.revenue) AS DOUBLE) AS revenue
FROM sales s LEFT JOIN pn ON s.stock_code = pn.stock_code
WHERE NOT s.is_cancellation AND s.is_product AND NOT s.is_outlier AND year(s.invoice_date) = {Y}
GROUP BY s.stock_code ORDER BY SUM(s.revenue) DESC, s.stock_code LIMIT {N}""", ctes=_name_cte(PRODUCT_POP))
def top_products_revenue(spark, sf):
    """Flagship: the year's top products by revenue, named by modal description."""
    return _top_products_revenue(spark, sf)


UNITS_POP = PRODUCT_POP + " AND quantity > 0"


@query("top_products_units", f"""
SELECT s.stock_code, MAX(pn.description) AS description, CAST(SUM(s.quantity) AS BIGINT) AS units
FROM sales s LEFT JOIN pn ON s.stock_code = pn.stock_code
WHERE NOT s.is_cancellation AND s.is_product AND NOT s.is_outlier AND s.quantity > 0 AND year(s.invoice_date) = {Y}
GROUP BY s.stock_code ORDER BY units DESC, s.stock_code LIMIT {N}""", ctes=_name_cte(UNITS_POP))
def top_products_units(spark, sf):
    s = kpis.completed(kpis.in_year(warehouse(spark, sf).sales, Y)).filter(kpis.real_product() & (F.col("quantity") > 0))
    return rankings.top_with_modal_label(s, "stock_code", "description", {"units": F.col("quantity").cast("bigint")}, "units", N)


@query("top_customers_revenue", f"""
SELECT customer_id, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM sales
WHERE {NC} AND customer_id IS NOT NULL AND year(invoice_date) = {Y}
GROUP BY customer_id ORDER BY SUM(revenue) DESC, customer_id LIMIT {N}""")
def top_customers_revenue(spark, sf):
    s = kpis.identified(kpis.completed(kpis.in_year(warehouse(spark, sf).sales, Y)))
    per = s.groupBy("customer_id").agg(F.sum("revenue").alias("revenue"))
    return rankings.top_k(per, "revenue", "customer_id", N).select("customer_id", dbl("revenue").alias("revenue"))


@query("top_customers_orders", f"""
SELECT customer_id, COUNT(DISTINCT invoice_no) AS orders FROM sales
WHERE {NC} AND customer_id IS NOT NULL AND year(invoice_date) = {Y}
GROUP BY customer_id ORDER BY orders DESC, customer_id LIMIT {N}""")
def top_customers_orders(spark, sf):
    s = kpis.identified(kpis.completed(kpis.in_year(warehouse(spark, sf).sales, Y)))
    per = s.groupBy("customer_id").agg(F.countDistinct("invoice_no").alias("orders"))
    return rankings.top_k(per, "orders", "customer_id", N)


@query("top_countries_revenue", f"""
SELECT country, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM sales
WHERE {NC} AND year(invoice_date) = {Y}
GROUP BY country ORDER BY SUM(revenue) DESC, country LIMIT {N}""")
def top_countries_revenue(spark, sf):
    s = kpis.completed(kpis.in_year(warehouse(spark, sf).sales, Y))
    per = s.groupBy("country").agg(F.sum("revenue").alias("revenue"))
    return rankings.top_k(per, "revenue", "country", N).select("country", dbl("revenue").alias("revenue"))


@query("top_foreign_country", f"""
SELECT country, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM sales
WHERE {NC} AND year(invoice_date) = {Y} AND country <> '{P.HOME}'
GROUP BY country ORDER BY SUM(revenue) DESC, country LIMIT 1""")
def top_foreign_country(spark, sf):
    s = kpis.excluding(kpis.completed(kpis.in_year(warehouse(spark, sf).sales, Y)), "country", P.HOME)
    per = s.groupBy("country").agg(F.sum("revenue").alias("revenue"))
    return rankings.top_k(per, "revenue", "country", 1).select("country", dbl("revenue").alias("revenue"))


_DASH = "FROM sales s JOIN dim_month m USING (invoice_month)"


@query("top_markets_filtered", f"""
SELECT s.country, CAST(SUM(s.revenue) AS DOUBLE) AS revenue {_DASH}
WHERE NOT s.is_cancellation AND year(s.invoice_date) = {Y} AND m.is_complete_month AND s.country <> '{P.HOME}'
GROUP BY s.country ORDER BY SUM(s.revenue) DESC, s.country LIMIT {P.TOP_MARKETS}""")
def top_markets_filtered(spark, sf):
    wh = warehouse(spark, sf)
    f = kpis.dashboard_filter(wh.sales, wh.dim_month, year=Y, complete_only=True, foreign_of=P.HOME)
    per = kpis.completed(f).groupBy("country").agg(F.sum("revenue").alias("revenue"))
    return rankings.top_k(per, "revenue", "country", P.TOP_MARKETS).select("country", dbl("revenue").alias("revenue"))


DASH_PRODUCT_POP = f"{NC} AND is_product AND NOT is_outlier AND year(invoice_date) = {Y} AND country = '{P.COUNTRY_A}'"


@query("top_products_filtered", f"""
SELECT s.stock_code, MAX(pn.description) AS description, CAST(SUM(s.revenue) AS DOUBLE) AS revenue,
       CAST(SUM(s.quantity) FILTER (WHERE s.quantity > 0) AS BIGINT) AS units
{_DASH} LEFT JOIN pn ON s.stock_code = pn.stock_code
WHERE NOT s.is_cancellation AND s.is_product AND NOT s.is_outlier AND year(s.invoice_date) = {Y}
  AND s.country = '{P.COUNTRY_A}'
GROUP BY s.stock_code ORDER BY SUM(s.revenue) DESC, s.stock_code LIMIT {N}""", ctes=_name_cte(DASH_PRODUCT_POP))
def top_products_filtered(spark, sf):
    wh = warehouse(spark, sf)
    f = kpis.completed(kpis.dashboard_filter(wh.sales, wh.dim_month, year=Y, market=P.COUNTRY_A)).filter(kpis.real_product())
    units = F.when(F.col("quantity") > 0, F.col("quantity").cast("bigint"))
    per = rankings.top_with_modal_label(f, "stock_code", "description", {"revenue": F.col("revenue"), "units": units}, "revenue", N)
    return per.select(
        "stock_code", "description", dbl("revenue").alias("revenue"), "units"
    )


FOREIGN_PRODUCT_POP = f"{NC} AND is_product AND NOT is_outlier AND country <> '{P.HOME}'"


@query("top_products_outside_home", f"""
SELECT s.stock_code, MAX(pn.description) AS description, CAST(SUM(s.revenue) AS DOUBLE) AS revenue
FROM sales s LEFT JOIN pn ON s.stock_code = pn.stock_code
WHERE NOT s.is_cancellation AND s.is_product AND NOT s.is_outlier AND s.country <> '{P.HOME}'
GROUP BY s.stock_code ORDER BY SUM(s.revenue) DESC, s.stock_code LIMIT {N}""", ctes=_name_cte(FOREIGN_PRODUCT_POP))
def top_products_outside_home(spark, sf):
    s = kpis.excluding(warehouse(spark, sf).sales, "country", P.HOME)
    return kpis.top_products(s, N)


@query("top_customers_outside_home", f"""
SELECT customer_id, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM sales
WHERE {NC} AND customer_id IS NOT NULL AND country <> '{P.HOME}'
GROUP BY customer_id ORDER BY SUM(revenue) DESC, customer_id LIMIT {N}""")
def top_customers_outside_home(spark, sf):
    s = kpis.identified(kpis.completed(kpis.excluding(warehouse(spark, sf).sales, "country", P.HOME)))
    per = s.groupBy("customer_id").agg(F.sum("revenue").alias("revenue"))
    return rankings.top_k(per, "revenue", "customer_id", N).select("customer_id", dbl("revenue").alias("revenue"))


@query("best_month", """
SELECT invoice_month, CAST(net_revenue AS DOUBLE) AS revenue, trading_days FROM dim_month
WHERE is_complete_month ORDER BY net_revenue DESC, invoice_month LIMIT 1""")
def best_month(spark, sf):
    dm = warehouse(spark, sf).dim_month.filter("is_complete_month")
    return rankings.top_k(dm, "net_revenue", "invoice_month", 1).select(
        "invoice_month", dbl("net_revenue").alias("revenue"), "trading_days"
    )


@query("worst_month", """
SELECT invoice_month, CAST(net_revenue AS DOUBLE) AS revenue FROM dim_month
WHERE is_complete_month ORDER BY net_revenue ASC, invoice_month LIMIT 1""")
def worst_month(spark, sf):
    dm = warehouse(spark, sf).dim_month.filter("is_complete_month")
    return rankings.top_k(dm, "net_revenue", "invoice_month", 1, ascending=True).select(
        "invoice_month", dbl("net_revenue").alias("revenue")
    )


@query("month_range_trend", f"""
SELECT invoice_month, CAST(net_revenue AS DOUBLE) AS revenue, trading_days FROM dim_month
WHERE invoice_month BETWEEN '{P.RANGE_FROM}' AND '{P.RANGE_TO}' ORDER BY invoice_month""")
def month_range_trend(spark, sf):
    dm = warehouse(spark, sf).dim_month
    return (
        dm.filter(F.col("invoice_month").between(P.RANGE_FROM, P.RANGE_TO))
        .orderBy("invoice_month")
        .select("invoice_month", dbl("net_revenue").alias("revenue"), "trading_days")
    )


@query("extreme_with_ties", """
SELECT invoice_month, trading_days FROM dim_month
WHERE trading_days = (SELECT MAX(trading_days) FROM dim_month)""")
def extreme_with_ties(spark, sf):
    """Every month tied at the most trading days (no LIMIT 1)."""
    dm = warehouse(spark, sf).dim_month.select("invoice_month", "trading_days")
    return rankings.extreme_with_ties(dm, "trading_days")


@query("extreme_with_ties_min", """
SELECT invoice_month, trading_days FROM dim_month
WHERE trading_days = (SELECT MIN(trading_days) FROM dim_month WHERE is_complete_month) AND is_complete_month""")
def extreme_with_ties_min(spark, sf):
    dm = warehouse(spark, sf).dim_month.filter("is_complete_month").select("invoice_month", "trading_days")
    return rankings.extreme_with_ties(dm, "trading_days", largest=False)


@query("join_scalar_subquery", """
SELECT invoice_month, trading_days, invoice_month <> (SELECT MAX(invoice_month) FROM sales) AS is_complete_month
FROM dim_month WHERE trading_days = (SELECT MAX(trading_days) FROM dim_month)""")
def join_scalar_subquery(spark, sf):
    """Comparisons with uncorrelated aggregates, written as scalar subqueries."""
    wh = warehouse(spark, sf)
    return spark.sql(
        """
        SELECT invoice_month, trading_days,
               invoice_month <> (SELECT MAX(invoice_month) FROM {s}) AS is_complete_month
        FROM {m} WHERE trading_days = (SELECT MAX(trading_days) FROM {m})
        """,
        s=wh.sales.select("invoice_month"),
        m=wh.dim_month,
    )


@query("ranked_list", f"""
SELECT country, CAST(revenue AS DOUBLE) AS revenue, ROW_NUMBER() OVER (ORDER BY revenue DESC, country) AS rank
FROM (SELECT country, SUM(revenue) AS revenue FROM sales WHERE {NC} AND year(invoice_date) = {Y}
      GROUP BY country ORDER BY revenue DESC, country LIMIT {N}) t""")
def ranked_list(spark, sf):
    s = kpis.completed(kpis.in_year(warehouse(spark, sf).sales, Y))
    top = rankings.top_k(s.groupBy("country").agg(F.sum("revenue").alias("revenue")), "revenue", "country", N)
    return rankings.ranked_list(top, "revenue", "country").select("country", dbl("revenue").alias("revenue"), "rank")


# Attempts over the events table: question = user_id, attempt = event_id.
# Quality tuple (greater is better): no scope error (event_type <> 'error'),
# executed cleanly (event_type <> 'view'), supported evidence (value),
# fewer undeclared numbers (-k of props), fewer unsupported claims (-(k % 3)).
_ATTEMPT_SQL = """
attempts AS (
    SELECT user_id, event_id, event_type <> 'error' AS scope_ok, event_type <> 'view' AS exec_ok,
           value AS supported, -TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS neg_undeclared,
           -(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) AS neg_unsupported
    FROM events)"""


@query("best_attempt", """
SELECT user_id, event_id, scope_ok, exec_ok, supported, neg_undeclared, neg_unsupported FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id
      ORDER BY scope_ok DESC, exec_ok DESC, supported DESC, neg_undeclared DESC, neg_unsupported DESC, event_id ASC) AS rk
  FROM attempts) t WHERE rk = 1""", ctes=_ATTEMPT_SQL)
def best_attempt(spark, sf):
    ev = read_table(spark, sf, "events", "user_id", "event_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    keys = {
        "scope_ok": F.col("event_type") != "error",
        "exec_ok": F.col("event_type") != "view",
        "supported": F.col("value"),
        "neg_undeclared": -k,
        "neg_unsupported": -(k % 3),
    }
    return rankings.best_per_group(ev, "user_id", keys, "event_id")


@query("latest_failure", """
SELECT user_id, ts, event_id, value FROM (
  SELECT user_id, ts, event_id, value,
         ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk
  FROM events WHERE event_type = 'error') t WHERE rk = 1""")
def latest_failure(spark, sf):
    ev = read_table(spark, sf, "events", "user_id", "ts", "event_id", "value", "event_type")
    failed = ev.filter(F.col("event_type") == "error")
    return rankings.latest_per_group(failed, "user_id", ["ts", "event_id"], ["value"])


@query("first_label_per_key", """
SELECT stock_code, description FROM (
  SELECT stock_code, description,
         ROW_NUMBER() OVER (PARTITION BY stock_code ORDER BY invoice_ts, invoice_no, description) AS rk
  FROM sales WHERE description IS NOT NULL) t WHERE rk = 1""")
def first_label_per_key(spark, sf):
    return rankings.first_per_key(warehouse(spark, sf).sales, "stock_code", "description", ["invoice_ts", "invoice_no"])


@query("top_n_short_result", f"""
WITH pop AS (SELECT * FROM sales WHERE {NC} AND year(invoice_date) = {Y} AND country <> '{P.HOME}'),
top AS (SELECT country, SUM(revenue) AS revenue FROM pop GROUP BY country ORDER BY revenue DESC, country LIMIT {P.TOP_MARKETS * 10})
SELECT CAST({P.TOP_MARKETS * 10} AS BIGINT) AS asked, (SELECT COUNT(*) FROM top) AS rows,
       (SELECT COUNT(DISTINCT country) FROM pop) AS groups,
       (SELECT COUNT(*) FROM top) = least({P.TOP_MARKETS * 10}, (SELECT COUNT(DISTINCT country) FROM pop)) AS complete""")
def top_n_short_result(spark, sf):
    """Asking for more markets than exist must return every market."""
    from ..operators import quality

    pop = kpis.excluding(kpis.completed(kpis.in_year(warehouse(spark, sf).sales, Y)), "country", P.HOME)
    per = pop.groupBy("country").agg(F.sum("revenue").alias("revenue"))
    top = rankings.top_k(per, "revenue", "country", P.TOP_MARKETS * 10)
    return quality.top_n_short_result(top, pop, "country", P.TOP_MARKETS * 10)


@query("bounded_result", f"""
SELECT country, CAST(SUM(revenue) AS DOUBLE) AS revenue
FROM sales WHERE NOT is_cancellation AND year(invoice_date) = {Y} GROUP BY country""")
def bounded_result(spark, sf):
    """Revenue by country behind a 50-row cap (more rows would raise)."""
    from ..operators import quality

    return quality.bounded_result(kpis.kpi_revenue_by_country(warehouse(spark, sf).sales, Y), P.RESULT_CAP)


PY = Y - 1  # prior reporting year (second wording set)


@query("top_customers_revenue_top3", f"""
SELECT customer_id, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM sales
WHERE {NC} AND customer_id IS NOT NULL AND year(invoice_date) = {PY}
GROUP BY customer_id ORDER BY SUM(revenue) DESC, customer_id LIMIT 3""")
def top_customers_revenue_top3(spark, sf):
    s = kpis.identified(kpis.completed(kpis.in_year(warehouse(spark, sf).sales, PY)))
    per = s.groupBy("customer_id").agg(F.sum("revenue").alias("revenue"))
    return rankings.top_k(per, "revenue", "customer_id", 3).select("customer_id", dbl("revenue").alias("revenue"))


@query("top_countries_revenue_top3", f"""
SELECT country, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM sales
WHERE {NC} AND year(invoice_date) = {PY}
GROUP BY country ORDER BY SUM(revenue) DESC, country LIMIT 3""")
def top_countries_revenue_top3(spark, sf):
    s = kpis.completed(kpis.in_year(warehouse(spark, sf).sales, PY))
    per = s.groupBy("country").agg(F.sum("revenue").alias("revenue"))
    return rankings.top_k(per, "revenue", "country", 3).select("country", dbl("revenue").alias("revenue"))
