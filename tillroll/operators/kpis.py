"""The ten KPIs, the dashboard aggregates and the single-answer lookups.

Populations follow the reference's definitions: revenue excludes
cancellations but keeps guests and non-products; product figures also require
``is_product AND NOT is_outlier``; units require ``quantity > 0``; customer
figures drop guests. Money is summed as DECIMAL and turned into DOUBLE last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar
from ..functions.money import dbl, pct, pct_change, ratio, sum_if
from .rankings import top_with_modal_label, totals_with_modal_label

def not_cancelled() -> Column:
    return ~F.col("is_cancellation")


def real_product() -> Column:
    return F.col("is_product") & ~F.col("is_outlier")


def year_of(col: str = "invoice_date") -> Column:
    return F.year(col).cast("bigint")


# ---- predicates (2.2) -------------------------------------------------------

def completed(sales: DataFrame) -> DataFrame:
    """``NOT is_cancellation``."""
    return sales.filter(not_cancelled())


def in_year(sales: DataFrame, year: int) -> DataFrame:
    """``year(invoice_date) = year``, plus the equivalent month-prefix test so
    the scan of the month-partitioned table prunes to that year's folders."""
    return sales.filter(calendar.year_months(year) & (F.year("invoice_date") == year))


def in_month_prefix(sales: DataFrame, prefix: str) -> DataFrame:
    """``invoice_month LIKE '<prefix>%'``."""
    return sales.filter(F.col("invoice_month").startswith(prefix))


def equals(sales: DataFrame, column: str, value) -> DataFrame:
    return sales.filter(F.col(column) == F.lit(value))


def excluding(sales: DataFrame, column: str, value) -> DataFrame:
    """``column <> value`` (NULLs drop out, as in SQL)."""
    return sales.filter(F.col(column) != F.lit(value))


def in_list(sales: DataFrame, column: str, values) -> DataFrame:
    return sales.filter(F.col(column).isin(*values))


def identified(sales: DataFrame) -> DataFrame:
    """``customer_id IS NOT NULL``."""
    return sales.filter(F.col("customer_id").isNotNull())


def extreme_quantity(sales: DataFrame, threshold: int) -> DataFrame:
    q = F.col("quantity")
    return sales.filter((q > threshold) | (q < -threshold)).select(
        "invoice_no", "stock_code", "quantity", "invoice_ts", "unit_price", "customer_id"
    )


def dashboard_filter(
    sales: DataFrame,
    dim_month: DataFrame,
    year: int | None = None,
    market: str | None = None,
    complete_only: bool = False,
    foreign_of: str | None = None,
) -> DataFrame:
    """Optional year / market / complete-month predicates on sales ⋈ dim_month.

    dim_month has one row per month, so the join never multiplies lines; its
    size is bounded by the calendar and Spark broadcasts it by its statistics.
    Only the predicates that are set are added, so Catalyst sees exactly the
    filter the user chose and pushes it to the scan.
    """
    df = sales
    if year is not None:
        df = in_year(df, year)
    if market is not None:
        df = df.filter(F.col("country") == market)
    if foreign_of is not None:
        df = df.filter(F.col("country") != foreign_of)
    months = dim_month.select("invoice_month", "is_complete_month")
    if complete_only:
        months = months.filter("is_complete_month")
    return df.join(months, "invoice_month")


# ---- KPIs (2.4) --------------------------------------------------------------

def _by_year_and_total(sales: DataFrame, *aggs: Column) -> DataFrame:
    """Per year plus one all-years row (year NULL): ROLLUP(year)."""
    return sales.withColumn("year", year_of()).rollup("year").agg(*aggs)


def kpi_revenue(sales: DataFrame) -> DataFrame:
    return _by_year_and_total(completed(sales), dbl(F.sum("revenue")).alias("revenue"))


def kpi_units_sold(sales: DataFrame) -> DataFrame:
    pop = completed(sales).filter(F.col("quantity") > 0)
    return _by_year_and_total(pop, F.sum("quantity").cast("bigint").alias("units"))


def kpi_orders(sales: DataFrame) -> DataFrame:
    return _by_year_and_total(completed(sales), F.countDistinct("invoice_no").alias("orders"))


def kpi_aov(sales: DataFrame) -> DataFrame:
    return _by_year_and_total(
        completed(sales), ratio(F.sum("revenue"), F.countDistinct("invoice_no")).alias("aov")
    )


def kpi_cancellation_rate(sales: DataFrame) -> DataFrame:
    """Cancellation invoices per 100 completed orders of the same period."""
    cancelled = F.countDistinct(F.when(F.col("is_cancellation"), F.col("invoice_no")))
    orders = F.countDistinct(F.when(not_cancelled(), F.col("invoice_no")))
    return _by_year_and_total(
        sales,
        cancelled.alias("cancellations"),
        orders.alias("orders"),
        pct(cancelled, orders).alias("cancellation_rate"),
    )


def kpi_cancellation_rate_subq(sales: DataFrame, year: int) -> DataFrame:
    """The same KPI as two uncorrelated scalar subqueries (benchmark form)."""
    return sales.sparkSession.sql(
        """
        SELECT 100.0D * (SELECT COUNT(DISTINCT invoice_no) FROM {s}
                         WHERE is_cancellation AND year(invoice_date) = {y})
               / NULLIF(CAST((SELECT COUNT(DISTINCT invoice_no) FROM {s}
                         WHERE NOT is_cancellation AND year(invoice_date) = {y}) AS DOUBLE), 0.0D)
               AS cancellation_rate
        """,
        s=in_year(sales, year),
        y=year,
    )


def kpi_active_customers(sales: DataFrame) -> DataFrame:
    return _by_year_and_total(identified(completed(sales)), F.countDistinct("customer_id").alias("customers"))


def kpi_revenue_by_country(sales: DataFrame, year: int) -> DataFrame:
    return (
        completed(in_year(sales, year))
        .groupBy("country")
        .agg(dbl(F.sum("revenue")).alias("revenue"))
    )


def product_lines(sales: DataFrame) -> DataFrame:
    """KPI 8 population: completed lines of real products."""
    return completed(sales).filter(real_product())


def product_revenue(sales: DataFrame) -> DataFrame:
    """KPI 8 population grouped by code only, named by the modal description."""
    return totals_with_modal_label(product_lines(sales), "stock_code", "description", {"revenue": F.col("revenue")})


def top_products(sales: DataFrame, n: int) -> DataFrame:
    """The ``n`` codes with the greatest revenue, named by the modal description."""
    top = top_with_modal_label(product_lines(sales), "stock_code", "description", {"revenue": F.col("revenue")}, "revenue", n)
    return top.withColumn("revenue", dbl("revenue"))


def kpi_revenue_by_product(sales: DataFrame, year: int) -> DataFrame:
    return product_revenue(in_year(sales, year)).withColumn("revenue", dbl("revenue"))


def kpi_units_per_order(sales: DataFrame) -> DataFrame:
    units = F.sum(F.when(F.col("quantity") > 0, F.col("quantity")))
    return _by_year_and_total(
        completed(sales), ratio(units, F.countDistinct("invoice_no")).alias("units_per_order")
    )


def kpi_repeat_customer_rate(sales: DataFrame) -> DataFrame:
    """Customers with more than one completed order / active customers, per
    year and overall. Orders are counted per (customer, year) first — an
    aggregate of an aggregate; the all-years row recounts over all years."""
    pop = identified(completed(sales)).withColumn("year", year_of())
    per_year = pop.groupBy("customer_id", "year").agg(F.countDistinct("invoice_no").alias("n"))
    overall = pop.groupBy("customer_id").agg(F.countDistinct("invoice_no").alias("n")).withColumn(
        "year", F.lit(None).cast("bigint")
    )
    both = per_year.unionByName(overall)
    return both.groupBy("year").agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("n") > 1).alias("repeat_customers"),
        pct(F.count_if(F.col("n") > 1), F.count(F.lit(1))).alias("repeat_rate"),
    )


def kpi_dashboard_metrics(filtered: DataFrame) -> DataFrame:
    """One pass over the filtered lines: the dashboard's metric tiles."""
    nc = not_cancelled()
    return filtered.agg(
        dbl(F.coalesce(sum_if(nc, "revenue"), F.lit(0).cast("decimal(18,2)"))).alias("revenue"),
        F.countDistinct(F.when(nc, F.col("invoice_no"))).alias("orders"),
        F.countDistinct(F.when(nc, F.col("customer_id"))).alias("customers"),
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("customer_id").isNull()).alias("guest_lines"),
        F.min("invoice_date").alias("first_day"),
        F.max("invoice_date").alias("last_day"),
        F.countDistinct("invoice_date").alias("days"),
    ).select(
        "*",
        ratio("revenue", "orders").alias("aov"),
        pct("guest_lines", "lines").alias("guest_line_pct"),
    )


def guest_line_share(sales: DataFrame) -> DataFrame:
    """% of lines and % of revenue without a customer id."""
    guest = F.col("customer_id").isNull()
    return sales.agg(
        pct(F.count_if(guest), F.count(F.lit(1))).alias("guest_line_pct"),
        pct(sum_if(guest, "revenue"), F.sum("revenue")).alias("guest_revenue_pct"),
    )


def monthly_series(filtered: DataFrame) -> DataFrame:
    """Per month under dashboard filters: revenue, trading days, completeness,
    revenue per trading day."""
    per = filtered.groupBy("invoice_month").agg(
        sum_if(not_cancelled(), "revenue").alias("revenue"),
        F.countDistinct("invoice_date").alias("trading_days"),
        F.bool_and("is_complete_month").alias("is_complete_month"),
    )
    return per.select(
        "invoice_month",
        dbl("revenue").alias("revenue"),
        "trading_days",
        "is_complete_month",
        ratio("revenue", "trading_days").alias("revenue_per_day"),
    )


def monthly_gross_trend(sales: DataFrame) -> DataFrame:
    """Plain monthly sum (cancellations included) and distinct trading days."""
    return sales.groupBy("invoice_month").agg(
        dbl(F.sum("revenue")).alias("revenue"), F.countDistinct("invoice_date").alias("trading_days")
    )


def share_of_total(sales: DataFrame, year: int, country: str) -> DataFrame:
    """Share of one country in the year's revenue; the denominator stays the
    unrestricted total."""
    pop = completed(in_year(sales, year))
    part = F.sum(F.when(F.col("country") == country, F.col("revenue")).otherwise(F.lit(0)))
    return pop.agg(pct(part, F.sum("revenue")).alias("share_pct"))


def month_values(dim_month: DataFrame, months) -> DataFrame:
    return dim_month.filter(F.col("invoice_month").isin(*months))


def month_pct_change(dim_month: DataFrame, new: str, old: str) -> DataFrame:
    """Two months pivoted with MAX(CASE) and the % change between them."""
    m = F.col("invoice_month")
    nv = F.max(F.when(m == new, F.col("net_revenue")))
    ov = F.max(F.when(m == old, F.col("net_revenue")))
    return month_values(dim_month, [new, old]).agg(
        dbl(nv).alias("new_revenue"), dbl(ov).alias("old_revenue"), pct_change(nv, ov).alias("pct_change")
    )


def month_change_per_day(dim_month: DataFrame, base: str, other: str) -> DataFrame:
    """Total and per-trading-day % change from ``base`` to ``other`` month."""
    m = F.col("invoice_month")
    rev = lambda k: F.max(F.when(m == k, dbl("net_revenue")))
    days = lambda k: F.max(F.when(m == k, dbl("trading_days")))
    return month_values(dim_month, [base, other]).agg(
        pct_change(rev(other), rev(base)).alias("total_pct"),
        pct_change(rev(other) / days(other), rev(base) / days(base)).alias("per_day_pct"),
    )


def month_comparison_guarded(dim_month: DataFrame, new: str, old: str) -> DataFrame:
    """New vs old month with a status: ``missing`` when either month is absent,
    ``incomplete`` when either is partial, else ``ok``; the change is given only
    for ``ok`` and a non-zero base, with a yes/no direction."""
    m = F.col("invoice_month")
    pick = lambda k, c: F.max(F.when(m == k, F.col(c)))
    complete = lambda k: F.bool_and(F.when(m == k, F.col("is_complete_month")))
    have = lambda k: F.count_if(m == k) > 0
    agg = month_values(dim_month, [new, old]).agg(
        have(new).alias("has_new"),
        have(old).alias("has_old"),
        complete(new).alias("new_complete"),
        complete(old).alias("old_complete"),
        dbl(pick(new, "net_revenue")).alias("new_revenue"),
        dbl(pick(old, "net_revenue")).alias("old_revenue"),
        pick(new, "trading_days").alias("new_days"),
        pick(old, "trading_days").alias("old_days"),
    )
    status = (
        F.when(~F.col("has_new") | ~F.col("has_old"), F.lit("missing"))
        .when(~F.col("new_complete") | ~F.col("old_complete"), F.lit("incomplete"))
        .otherwise(F.lit("ok"))
    )
    ok = (status == "ok") & (F.col("old_revenue") != 0)
    return agg.select(
        status.alias("status"),
        "new_revenue",
        "old_revenue",
        "new_days",
        "old_days",
        F.when(ok, pct_change("new_revenue", "old_revenue")).alias("pct_change"),
        F.when(ok, F.when(F.col("new_revenue") > F.col("old_revenue"), "yes").otherwise("no")).alias("increased"),
    )


def country_gap(sales: DataFrame, year: int, a: str, b: str) -> DataFrame:
    """Two countries side by side, difference and % difference (base ``b``)."""
    per = completed(in_year(sales, year)).filter(F.col("country").isin(a, b))
    c = F.col("country")
    ra = F.sum(F.when(c == a, F.col("revenue")))
    rb = F.sum(F.when(c == b, F.col("revenue")))
    return per.agg(
        dbl(ra).alias("revenue_a"),
        dbl(rb).alias("revenue_b"),
        dbl(ra - rb).alias("difference"),
        pct_change(ra, rb).alias("pct"),
    )


def country_profile(sales: DataFrame, year: int) -> DataFrame:
    """Per country: revenue, orders, customers and average order value."""
    per = completed(in_year(sales, year)).groupBy("country").agg(
        F.sum("revenue").alias("rev"),
        F.countDistinct("invoice_no").alias("orders"),
        F.countDistinct("customer_id").alias("customers"),
    )
    return per.select(
        "country", dbl("rev").alias("revenue"), "orders", "customers", ratio("rev", "orders").alias("avg_order")
    )


def country_aov_min_orders(sales: DataFrame, year: int, min_orders: int) -> DataFrame:
    """Average order value only where a country has enough orders (HAVING)."""
    return country_profile(sales, year).filter(F.col("orders") >= min_orders).select("country", "orders", "avg_order")


def customers_per_country(dim_customer: DataFrame) -> DataFrame:
    return dim_customer.groupBy("country").agg(F.count(F.lit(1)).alias("customers"))


def avg_customer_revenue_by_country(dim_customer: DataFrame) -> DataFrame:
    return dim_customer.groupBy("country").agg(
        ratio(F.sum("net_revenue"), F.count("net_revenue")).alias("avg_revenue")
    )


def return_value_rate(sales: DataFrame, year: int) -> DataFrame:
    """Returned value / sold value for all items and for real products; the
    product filter applies to numerator and denominator alike."""
    pop = in_year(sales, year)
    neg, posv = F.col("revenue") < 0, F.col("revenue") > 0
    rv = F.col("revenue")
    all_rate = pct(-F.sum(F.when(neg, rv)), F.sum(F.when(posv, rv)))
    prod_rate = pct(-F.sum(F.when(neg & real_product(), rv)), F.sum(F.when(posv & real_product(), rv)))
    return pop.agg(all_rate.alias("all_items_pct"), prod_rate.alias("products_pct"))


def returns_total(sales: DataFrame) -> DataFrame:
    """Value of negative-quantity lines, as a positive number."""
    return sales.filter(F.col("quantity") < 0).agg(dbl(-F.sum("revenue")).alias("returns_value"))


def country_year_revenue(sales: DataFrame, year: int, country: str) -> DataFrame:
    return completed(in_year(sales, year)).filter(F.col("country") == country).agg(
        dbl(F.sum("revenue")).alias("revenue")
    )


def customer_order_count(sales: DataFrame, customer_id: int) -> DataFrame:
    return completed(sales).filter(F.col("customer_id") == customer_id).agg(
        F.countDistinct("invoice_no").alias("orders")
    )


def product_revenue_total(sales: DataFrame, stock_code: str) -> DataFrame:
    return completed(sales).filter(F.col("stock_code") == stock_code).agg(dbl(F.sum("revenue")).alias("revenue"))


def month_lookup(dim_month: DataFrame, months) -> DataFrame:
    return month_values(dim_month, months).select(
        "invoice_month", dbl("net_revenue").alias("revenue"), "trading_days", "is_complete_month"
    )
