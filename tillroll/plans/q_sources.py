"""Scans, sinks, cleaning steps, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.money import dbl
from ..operators import clean, kpis, marts, quality, rankings
from ..session import scratch_path
from ..sources import files
from ..sources.invoices import line_parts, sheets
from ..sources.tables import read_table
from ..sources.warehouse import TABLE_NAMES, warehouse
from . import params as P
from .catalog import query

Y = P.YEAR
RAW_OUT = "invoice, stock_code, description, quantity, invoice_ts, CAST(price AS DOUBLE) AS price, customer_id, country"


def _raw_out(df):
    return df.withColumn("price", F.col("price").cast("double"))


def _sales_out(df):
    return df.withColumns({"unit_price": dbl("unit_price"), "revenue": dbl("revenue")})


SALES_OUT = (
    "invoice_no, stock_code, description, quantity, invoice_ts, CAST(unit_price AS DOUBLE) AS unit_price, customer_id, "
    "country, CAST(revenue AS DOUBLE) AS revenue, is_cancellation, is_product, is_outlier, invoice_date, invoice_month"
)

# ---- 2.1 scans and sinks ----------------------------------------------------------


@query("scan_union_sheets", f"SELECT {RAW_OUT} FROM sheets")
def scan_union_sheets(spark, sf):
    return _raw_out(sheets(spark, sf))


@query("set_union_all", "SELECT invoice, stock_code, quantity, invoice_ts FROM sheet1 UNION ALL "
       "SELECT invoice, stock_code, quantity, invoice_ts FROM sheet2")
def set_union_all(spark, sf):
    """Both sheets stacked from one scan of each table."""
    return sheets(spark, sf).select("invoice", "stock_code", "quantity", "invoice_ts")


@query("scan_table", "SELECT invoice_month, stock_code, quantity FROM sales")
def scan_table(spark, sf):
    """Column-pruned scan: the parquet ReadSchema holds only these columns."""
    return warehouse(spark, sf).sales.select("invoice_month", "stock_code", "quantity")


@query("sales_ctas", f"SELECT {SALES_OUT} FROM sales")
def sales_ctas(spark, sf):
    """The materialised, published fact table."""
    return _sales_out(warehouse(spark, sf).sales)


@query("table_row_counts", """
SELECT 'sales' AS "table", COUNT(*) AS row_count FROM sales
UNION ALL SELECT 'dim_month', COUNT(*) FROM dim_month
UNION ALL SELECT 'dim_product', COUNT(*) FROM dim_product
UNION ALL SELECT 'dim_customer', COUNT(*) FROM dim_customer""")
def table_row_counts(spark, sf):
    wh = warehouse(spark, sf)
    out = None
    for name in TABLE_NAMES:
        one = wh.table(name).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


@query("filter_choices_years", "SELECT DISTINCT year(invoice_date) AS year FROM sales ORDER BY year DESC")
def filter_choices_years(spark, sf):
    s = warehouse(spark, sf).sales
    return s.select(kpis.year_of().alias("year")).distinct().orderBy(F.desc("year"))


@query("filter_choices_markets", "SELECT DISTINCT country FROM sales ORDER BY country")
def filter_choices_markets(spark, sf):
    return warehouse(spark, sf).sales.select("country").distinct().orderBy("country")


def _month_report(spark, sf):
    dm = warehouse(spark, sf).dim_month
    return dm.select(
        "invoice_month", "trading_days", dbl("net_revenue").alias("net_revenue"), "is_complete_month"
    )


# What the sinks write; each sink query returns the copy read back from the
# files, so the oracle is the report itself.
MONTH_REPORT_SQL = "SELECT invoice_month, trading_days, CAST(net_revenue AS DOUBLE) AS net_revenue, is_complete_month FROM dim_month"
REVENUE_SQL = ("SELECT year(invoice_date) AS year, CAST(SUM(revenue) AS DOUBLE) AS revenue "
               "FROM sales WHERE NOT is_cancellation GROUP BY ROLLUP (year(invoice_date))")
ORDERS_SQL = ("SELECT year(invoice_date) AS year, COUNT(DISTINCT invoice_no) AS orders "
              "FROM sales WHERE NOT is_cancellation GROUP BY ROLLUP (year(invoice_date))")

MONTH_REPORT_SCHEMA = T.StructType(
    [
        T.StructField("invoice_month", T.StringType()),
        T.StructField("trading_days", T.LongType()),
        T.StructField("net_revenue", T.DoubleType()),
        T.StructField("is_complete_month", T.BooleanType()),
    ]
)


@query("export_csv", MONTH_REPORT_SQL)
def export_csv(spark, sf):
    """Write the month report as CSV (committer makes it appear whole), read back."""
    path = scratch_path(spark, "tillroll-exports", files.new_version(), "month_report.csv")
    files.export_csv(_month_report(spark, sf), path)
    return spark.read.option("header", True).schema(MONTH_REPORT_SCHEMA).csv(path)


@query("import_csv_checked", MONTH_REPORT_SQL)
def import_csv_checked(spark, sf):
    path = scratch_path(spark, "tillroll-exports", files.new_version(), "month_report.csv")
    files.export_csv(_month_report(spark, sf), path)
    return files.import_csv_checked(spark, path, MONTH_REPORT_SCHEMA, ["invoice_month", "net_revenue"])


@query("export_json", REVENUE_SQL)
def export_json(spark, sf):
    path = scratch_path(spark, "tillroll-exports", files.new_version(), "kpis.json")
    files.export_json(kpis.kpi_revenue(warehouse(spark, sf).sales), path)
    return spark.read.schema("year bigint, revenue double").json(path)


@query("import_json", MONTH_REPORT_SQL)
def import_json(spark, sf):
    path = scratch_path(spark, "tillroll-exports", files.new_version(), "months.json")
    files.export_json(_month_report(spark, sf), path)
    return files.import_json(spark, path, MONTH_REPORT_SCHEMA)


@query("validated_publish", MONTH_REPORT_SQL)
def validated_publish(spark, sf):
    """Publish the month report behind a check; returns the published copy."""
    target = scratch_path(spark, "tillroll-published", files.new_version())
    report = _month_report(spark, sf)

    def checks(t):
        m = t["months"]
        return m.agg((F.count(F.lit(1)) > 0).alias("ok")).unionByName(
            m.agg(F.bool_and(F.col("trading_days") > 0).alias("ok"))
        )

    version, paths = files.validated_publish(spark, {"months": report}, target, checks)
    return spark.read.parquet(paths["months"])


@query("publish_versioned", ORDERS_SQL)
def publish_versioned(spark, sf):
    """Two publishes: the first stays readable; readers resolve the latest."""
    target = scratch_path(spark, "tillroll-published", files.new_version())
    wh = warehouse(spark, sf)
    ok = lambda t: t["report"].agg((F.count(F.lit(1)) > 0).alias("ok"))
    files.validated_publish(spark, {"report": kpis.kpi_revenue(wh.sales)}, target, ok)
    files.validated_publish(spark, {"report": kpis.kpi_orders(wh.sales)}, target, ok)
    latest = files.latest_version(spark, target)
    return spark.read.parquet(f"{target}/version={latest}/report")


# ---- 2.2 cleaning ------------------------------------------------------------------


@query("clean_dedupe_exact", f"SELECT DISTINCT {RAW_OUT} FROM sheets")
def clean_dedupe_exact(spark, sf):
    return _raw_out(clean.dedupe_exact(sheets(spark, sf), line_parts(spark, sf)))


@query("clean_dedupe_report", """
SELECT (SELECT COUNT(*) FROM sheets) AS rows_before, (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM sheets) d) AS rows_after,
       (SELECT COUNT(*) FROM sheets) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM sheets) d) AS rows_removed""")
def clean_dedupe_report(spark, sf):
    return clean.dedupe_report(sheets(spark, sf), line_parts(spark, sf))


@query("clean_drop_bad_debt", f"SELECT {RAW_OUT} FROM sheets WHERE NOT starts_with(invoice, 'A')")
def clean_drop_bad_debt(spark, sf):
    return _raw_out(clean.drop_bad_debt(sheets(spark, sf)))


@query("bad_debt_lines", "SELECT invoice, description, quantity, CAST(price AS DOUBLE) AS price FROM sheets "
       "WHERE starts_with(invoice, 'A')")
def bad_debt_lines(spark, sf):
    return _raw_out(clean.bad_debt_lines(sheets(spark, sf))).select("invoice", "description", "quantity", "price")


@query("clean_cast_rename", """
SELECT CAST(invoice AS VARCHAR) AS invoice_no, CAST(stock_code AS VARCHAR) AS stock_code, description, quantity,
       invoice_ts, CAST(price AS DOUBLE) AS unit_price, customer_id, country FROM sheets""")
def clean_cast_rename(spark, sf):
    return clean.cast_rename(sheets(spark, sf)).withColumn("unit_price", dbl("unit_price"))


@query("derive_revenue", """
SELECT invoice, stock_code, quantity, CAST(price AS DOUBLE) AS unit_price,
       CAST(CAST(quantity * price AS DECIMAL(18,2)) AS DOUBLE) AS revenue FROM sheets""")
def derive_revenue(spark, sf):
    df = clean.derive_revenue(sheets(spark, sf).withColumnRenamed("price", "unit_price"))
    return df.select("invoice", "stock_code", "quantity", dbl("unit_price").alias("unit_price"), dbl("revenue").alias("revenue"))


@query("derive_flags", """
SELECT invoice AS invoice_no, stock_code, starts_with(invoice, 'C') AS is_cancellation,
       stock_code NOT IN ('P0','P1','P2','P3','P4','P5','P6','P7','P8','P9','P10','P11','P12','P13','P14','P15','P16') AS is_product,
       invoice IN ('1001','C1001','2002','C2002') AS is_outlier
FROM sheets""")
def derive_flags(spark, sf):
    df = clean.derive_flags(sheets(spark, sf).withColumnRenamed("invoice", "invoice_no"))
    return df.select("invoice_no", "stock_code", "is_cancellation", "is_product", "is_outlier")


@query("derive_calendar", """
SELECT invoice_no, stock_code, invoice_ts, invoice_date, invoice_month, CAST(year(invoice_ts) AS INTEGER) AS year,
       CAST(hour(invoice_ts) AS INTEGER) AS hour, dayname(invoice_ts) AS weekday
FROM sales""")
def derive_calendar(spark, sf):
    return clean.calendar_profile(warehouse(spark, sf).sales)


@query("build_sales", f"SELECT {SALES_OUT} FROM sales")
def build_sales(spark, sf):
    """The whole cleaning chain from the raw tables (not the published copy).
    Nothing is written here, so the dedupe is the plain hash aggregate (one
    shuffle); the layout by months is only worth it when the rows go to month
    folders (the warehouse build)."""
    return _sales_out(clean.build_sales(sheets(spark, sf), line_parts(spark, sf), clustered=False))


# Agreed baseline at the correctness scale (sf0.01): rows and gross revenue.
BASELINE_ROWS = 59_710
BASELINE_REVENUE = 474_324_733.10


@query("baseline_check", f"""
SELECT 'rows' AS metric, CAST({BASELINE_ROWS} AS DOUBLE) AS expected, CAST(COUNT(*) AS DOUBLE) AS actual,
       CAST({BASELINE_ROWS} AS DOUBLE) = CAST(COUNT(*) AS DOUBLE) AS ok FROM sales
UNION ALL
SELECT 'revenue', CAST({BASELINE_REVENUE} AS DOUBLE), CAST(ROUND(SUM(revenue), 2) AS DOUBLE),
       CAST({BASELINE_REVENUE} AS DOUBLE) = CAST(ROUND(SUM(revenue), 2) AS DOUBLE) FROM sales""")
def baseline_check(spark, sf):
    return quality.baseline_check(warehouse(spark, sf).sales, BASELINE_ROWS, BASELINE_REVENUE)


# ---- 2.3 joins ---------------------------------------------------------------------


@query("join_sales_month", """
SELECT s.invoice_no, s.stock_code, invoice_month, m.trading_days, m.is_complete_month
FROM sales s JOIN dim_month m USING (invoice_month)""")
def join_sales_month(spark, sf):
    wh = warehouse(spark, sf)
    months = wh.dim_month.select("invoice_month", "trading_days", "is_complete_month")
    return wh.sales.select("invoice_no", "stock_code", "invoice_month").join(months, "invoice_month")


@query("join_single_row_pair", f"""
SELECT CAST(m.net_revenue AS DOUBLE) AS base_revenue, m.trading_days AS base_days,
       CAST(a.net_revenue AS DOUBLE) AS other_revenue, a.trading_days AS other_days
FROM dim_month m, dim_month a WHERE m.invoice_month = '{P.MONTH_A}' AND a.invoice_month = '{P.MONTH_B}'""")
def join_single_row_pair(spark, sf):
    """Two one-row months side by side. The SQL form is a cross join of two
    filtered aliases; here one conditional aggregate gives the same row."""
    dm = warehouse(spark, sf).dim_month.filter(F.col("invoice_month").isin(P.MONTH_A, P.MONTH_B))
    m = F.col("invoice_month")
    pick = lambda k, c: F.max(F.when(m == k, F.col(c)))
    return dm.agg(
        dbl(pick(P.MONTH_A, "net_revenue")).alias("base_revenue"),
        pick(P.MONTH_A, "trading_days").alias("base_days"),
        dbl(pick(P.MONTH_B, "net_revenue")).alias("other_revenue"),
        pick(P.MONTH_B, "trading_days").alias("other_days"),
    ).filter(F.col("base_days").isNotNull() & F.col("other_days").isNotNull())


@query("join_align_aggregates", """
WITH r AS (SELECT invoice_month, SUM(revenue) FILTER (WHERE NOT is_cancellation) AS revenue FROM sales GROUP BY invoice_month),
n AS (SELECT first_month AS invoice_month, COUNT(*) AS new_customers FROM
        (SELECT customer_id, MIN(invoice_month) AS first_month FROM sales
         WHERE quantity > 0 AND customer_id IS NOT NULL GROUP BY customer_id) f GROUP BY first_month)
SELECT COALESCE(r.invoice_month, n.invoice_month) AS invoice_month, CAST(r.revenue AS DOUBLE) AS revenue, n.new_customers
FROM r FULL OUTER JOIN n ON r.invoice_month = n.invoice_month""")
def join_align_aggregates(spark, sf):
    """Two separate per-month aggregates aligned on the month (full outer)."""
    from ..operators import analysis

    s = warehouse(spark, sf).sales
    rev = s.groupBy("invoice_month").agg(
        dbl(F.sum(F.when(kpis.not_cancelled(), F.col("revenue")))).alias("revenue")
    )
    new = analysis.new_customers_by_month(s).withColumnRenamed("first_month", "invoice_month")
    return rev.join(new, "invoice_month", "full_outer")


@query("join_lookup_label", f"""
WITH per AS (SELECT stock_code, CAST(SUM(quantity) AS BIGINT) AS units FROM sales
             WHERE NOT is_cancellation AND is_product AND NOT is_outlier AND quantity > 0 GROUP BY stock_code),
top AS (SELECT * FROM per ORDER BY units DESC, stock_code LIMIT {P.TOP_N})
SELECT t.stock_code, t.units, d.description FROM top t LEFT JOIN dim_product d ON t.stock_code = d.stock_code""")
def join_lookup_label(spark, sf):
    wh = warehouse(spark, sf)
    pop = kpis.completed(wh.sales).filter(kpis.real_product() & (F.col("quantity") > 0))
    per = pop.groupBy("stock_code").agg(F.sum("quantity").cast("bigint").alias("units"))
    top = rankings.top_k(per, "units", "stock_code", P.TOP_N)
    return top.join(wh.dim_product.select("stock_code", "description"), "stock_code", "left")


@query("join_preaggregated", f"""
WITH monthly AS (SELECT invoice_month, SUM(revenue) AS revenue FROM sales
                 WHERE NOT is_cancellation AND country <> '{P.HOME}' GROUP BY invoice_month)
SELECT invoice_month, CAST(monthly.revenue AS DOUBLE) AS revenue, m.trading_days,
       CAST(monthly.revenue AS DOUBLE) / NULLIF(CAST(m.trading_days AS DOUBLE), 0) AS revenue_per_day
FROM monthly JOIN dim_month m USING (invoice_month)""")
def join_preaggregated(spark, sf):
    """Facts reduced to one row per month first, then joined to month
    measures once (no month measure is summed over line-level rows)."""
    from ..functions.money import ratio

    wh = warehouse(spark, sf)
    monthly = (
        kpis.completed(kpis.excluding(wh.sales, "country", P.HOME))
        .groupBy("invoice_month")
        .agg(F.sum("revenue").alias("revenue"))
    )
    j = monthly.join(wh.dim_month.select("invoice_month", "trading_days"), "invoice_month")
    return j.select(
        "invoice_month", dbl("revenue").alias("revenue"), "trading_days", ratio("revenue", "trading_days").alias("revenue_per_day")
    )


@query("join_grain_check", """
SELECT 'duplicate_right_keys' AS "check", (SELECT COUNT(*) FROM (SELECT invoice_month FROM dim_month GROUP BY 1 HAVING COUNT(*) > 1) d) AS value
UNION ALL SELECT 'unmatched_left_rows', (SELECT COUNT(*) FROM sales s WHERE NOT EXISTS (SELECT 1 FROM dim_month m WHERE m.invoice_month = s.invoice_month))
UNION ALL SELECT 'rows_before', (SELECT COUNT(*) FROM sales)
UNION ALL SELECT 'rows_after', (SELECT COUNT(*) FROM sales s JOIN dim_month m USING (invoice_month))""")
def join_grain_check(spark, sf):
    wh = warehouse(spark, sf)
    return quality.join_grain_check(wh.sales.select("invoice_month"), wh.dim_month, "invoice_month")


@query("semi_in_list", """
SELECT country, COUNT(*) AS lines FROM sales s
WHERE s.customer_id IN (SELECT customer_id FROM dim_customer WHERE orders >= 10) GROUP BY country""")
def semi_in_list(spark, sf):
    """Lines of frequent customers: a left-semi join against a key set."""
    wh = warehouse(spark, sf)
    frequent = wh.dim_customer.filter(F.col("orders") >= 10).select("customer_id")
    return wh.sales.join(frequent, "customer_id", "left_semi").groupBy("country").agg(F.count(F.lit(1)).alias("lines"))


@query("anti_missing_keys", """
SELECT DISTINCT o_custkey AS customer_id FROM orders
WHERE o_custkey NOT IN (SELECT customer_id FROM dim_customer)""")
def anti_missing_keys(spark, sf):
    """Customers who placed orders but are absent from the customer table."""
    wh = warehouse(spark, sf)
    asked = read_table(spark, sf, "orders", "o_custkey").select(F.col("o_custkey").alias("customer_id")).distinct()
    return asked.join(wh.dim_customer.select("customer_id"), "customer_id", "left_anti")


# ---- 2.7 set operations ------------------------------------------------------------


@query("set_distinct", "SELECT DISTINCT country, year(invoice_date) AS year FROM sales")
def set_distinct(spark, sf):
    return warehouse(spark, sf).sales.select("country", kpis.year_of().alias("year")).distinct()


@query("set_intersect_invoices", """
SELECT COUNT(*) AS invoices_in_both FROM (SELECT invoice FROM sheet1 INTERSECT SELECT invoice FROM sheet2) t""")
def set_intersect_invoices(spark, sf):
    """Invoices present in both sheets. One pass over the tagged stack: an
    invoice is in the intersection when it carries both sheet tags."""
    from ..sources.invoices import tagged_sheets

    per = tagged_sheets(spark, sf).groupBy("invoice").agg(F.min("sheet").alias("lo"), F.max("sheet").alias("hi"))
    return per.filter((F.col("lo") == 1) & (F.col("hi") == 2)).agg(F.count(F.lit(1)).alias("invoices_in_both"))


@query("set_except_periods", """
WITH requested AS (SELECT strftime(d, '%Y-%m') AS invoice_month
                   FROM range(DATE '1995-01-01', DATE '2002-01-01', INTERVAL 1 MONTH) t(d))
SELECT invoice_month FROM requested EXCEPT SELECT invoice_month FROM dim_month""")
def set_except_periods(spark, sf):
    """Requested periods (every month of 1995-2001) with no evidence."""
    months = spark.sql(
        "SELECT date_format(d, 'yyyy-MM') AS invoice_month "
        "FROM (SELECT explode(sequence(DATE'1995-01-01', DATE'2001-12-01', INTERVAL 1 MONTH)) AS d)"
    )
    return months.exceptAll(warehouse(spark, sf).dim_month.select("invoice_month")).distinct()


@query("set_subset_check", f"""
WITH present AS (SELECT DISTINCT country FROM sales WHERE year(invoice_date) = {Y}),
req AS (SELECT unnest(['{P.COUNTRY_A}', '{P.COUNTRY_B}', 'NATION_99']) AS country),
missing AS (SELECT country FROM req EXCEPT SELECT country FROM present)
SELECT COALESCE((SELECT string_agg(country, ',' ORDER BY country) FROM missing), '') AS missing,
       (SELECT COUNT(*) FROM missing) = 0 AS covered""")
def set_subset_check(spark, sf):
    """Are all requested markets present in the year? ``array_except`` of the
    request against the requested markets seen: the rows are filtered to the
    request first (pushed to the scan), so the set is bounded by the request."""
    wanted = (P.COUNTRY_A, P.COUNTRY_B, "NATION_99")
    seen = kpis.in_year(warehouse(spark, sf).sales, Y).filter(F.col("country").isin(*wanted))
    present = seen.agg(F.collect_set("country").alias("seen"))
    requested = F.array(*[F.lit(c) for c in wanted])
    missing = F.array_sort(F.array_except(requested, F.col("seen")))
    return present.select(F.array_join(missing, ",").alias("missing"), (F.size(missing) == 0).alias("covered"))


# ---- 2.4 summary tables ------------------------------------------------------------


@query("build_dim_month", """
SELECT invoice_month, trading_days, last_day, CAST(net_revenue AS DOUBLE) AS net_revenue,
       CAST(gross_revenue AS DOUBLE) AS gross_revenue, is_complete_month FROM dim_month""")
def build_dim_month(spark, sf):
    dm = marts.dim_month(warehouse(spark, sf).sales)
    return dm.withColumns({"net_revenue": dbl("net_revenue"), "gross_revenue": dbl("gross_revenue")})


@query("build_dim_product", """
SELECT stock_code, description, units_sold, CAST(gross_revenue AS DOUBLE) AS gross_revenue FROM dim_product""")
def build_dim_product(spark, sf):
    dp = marts.dim_product(warehouse(spark, sf).sales)
    return dp.withColumns({"units_sold": F.col("units_sold").cast("bigint"), "gross_revenue": dbl("gross_revenue")})


@query("build_dim_customer", """
SELECT customer_id, country, first_order, last_order, orders, CAST(net_revenue AS DOUBLE) AS net_revenue FROM dim_customer""")
def build_dim_customer(spark, sf):
    return marts.dim_customer(warehouse(spark, sf).sales).withColumn("net_revenue", dbl("net_revenue"))
