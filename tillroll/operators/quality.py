"""Data-quality and result checks, each a small DataFrame of findings.

Checks return rows (never raise inside a plan); callers decide whether a
false ``ok`` stops a publish.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import dbl, pct, sum_if

def not_cancelled() -> Column:
    return ~F.col("is_cancellation")




def smoke_checks(sales: DataFrame, dim_month: DataFrame) -> DataFrame:
    """Per month: the summary table's net revenue equals the same sum taken
    from the facts (KPI 1), and the day counts agree. Both sides are
    per-month aggregates, so the join is small whatever the data size."""
    facts = sales.groupBy("invoice_month").agg(
        sum_if(not_cancelled(), "revenue").alias("sales_net"),
        F.countDistinct("invoice_date").alias("sales_days"),
    )
    summary = dim_month.select(
        "invoice_month", F.col("net_revenue").alias("month_net"), F.col("trading_days").alias("month_days")
    )
    both = facts.join(summary, "invoice_month", "full_outer")
    return both.select(
        "invoice_month",
        dbl("month_net").alias("month_net"),
        dbl("sales_net").alias("sales_net"),
        "month_days",
        (F.col("month_net").eqNullSafe(F.col("sales_net")) & F.col("month_days").eqNullSafe(F.col("sales_days")))
        .alias("ok"),
    )


def summary_checks(sales: DataFrame, dim_product: DataFrame, dim_customer: DataFrame) -> DataFrame:
    """Products' units and revenue and customers' revenue equal the same sums
    taken from the facts, in one pass over them."""
    sold = F.col("quantity") > 0
    facts = sales.agg(
        F.sum(F.when(sold, F.col("quantity"))).alias("units"), F.sum(F.when(sold, F.col("revenue"))).alias("gross"),
        F.sum(F.when(F.col("customer_id").isNotNull(), F.col("revenue"))).alias("net"),
    )
    products = dim_product.agg(F.sum("units_sold").alias("units"), F.sum("gross_revenue").alias("gross"))
    customers = dim_customer.agg(F.sum("net_revenue").alias("net"))
    sides = [
        facts.select(F.lit("facts").alias("side"), *[F.col(c).cast("decimal(38,2)").alias(c) for c in ("units", "gross", "net")]),
        products.select(F.lit("products").alias("side"), *[F.col(c).cast("decimal(38,2)").alias(c) for c in ("units", "gross")]),
        customers.select(F.lit("customers").alias("side"), F.col("net").cast("decimal(38,2)").alias("net")),
    ]
    sums = sides[0].unionByName(sides[1], allowMissingColumns=True).unionByName(sides[2], allowMissingColumns=True)
    by = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    ok = [by("facts", c).eqNullSafe(by(side, c)) for side, c in (("products", "units"), ("products", "gross"), ("customers", "net"))]
    return sums.agg((ok[0] & ok[1] & ok[2]).alias("ok"))


def baseline_figures(sales: DataFrame) -> DataFrame:
    """What a baseline fixes: the number of rows and the gross revenue."""
    return sales.agg(F.count(F.lit(1)).cast("double").alias("rows"), dbl(F.round(F.sum("revenue"), 2)).alias("revenue"))


def baseline_check(sales: DataFrame, expected_rows: int, expected_revenue: float) -> DataFrame:
    """Row count and ``round(sum(revenue), 2)`` against the agreed baseline,
    one row per metric with expected, actual and ok."""
    got = sales.agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        dbl(F.round(F.sum("revenue"), 2)).alias("revenue"),
    )
    stacked = got.select(
        F.explode(
            F.array(
                F.struct(F.lit("rows").alias("metric"), F.lit(float(expected_rows)).alias("expected"), F.col("rows").alias("actual")),
                F.struct(F.lit("revenue").alias("metric"), F.lit(float(expected_revenue)).alias("expected"), F.col("revenue").alias("actual")),
            )
        ).alias("m")
    ).select("m.*")
    return stacked.withColumn("ok", F.col("expected") == F.col("actual"))


def flag_breakdown(sales: DataFrame) -> DataFrame:
    return sales.groupBy("is_cancellation", "is_product", "is_outlier").agg(
        F.count(F.lit(1)).alias("lines"), dbl(F.sum("revenue")).alias("revenue")
    )


def nonproduct_breakdown(sales: DataFrame) -> DataFrame:
    return sales.filter(~F.col("is_product")).groupBy("stock_code").agg(
        F.count(F.lit(1)).alias("lines"), dbl(F.sum("revenue")).alias("revenue")
    )


def quality_profile(sales: DataFrame) -> DataFrame:
    """% of lines that are guests, negative quantity, cancellations,
    non-products, zero/negative price, missing description."""
    n = F.count(F.lit(1))
    share = lambda cond: pct(F.count_if(cond), n)
    return sales.agg(
        n.alias("lines"),
        share(F.col("customer_id").isNull()).alias("guest_pct"),
        share(F.col("quantity") < 0).alias("negative_qty_pct"),
        share(F.col("is_cancellation")).alias("cancellation_pct"),
        share(~F.col("is_product")).alias("non_product_pct"),
        share(F.col("unit_price") <= 0).alias("nonpositive_price_pct"),
        share(F.col("description").isNull()).alias("missing_description_pct"),
    )


def null_counts(df: DataFrame) -> DataFrame:
    """NULL count per column in one pass, unpivoted to (column, nulls)."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "column", "nulls")


def date_range(tagged: DataFrame, sheet_col: str = "sheet") -> DataFrame:
    """First and last timestamp and line count per sheet plus the stacked
    total (sheet NULL), in one pass: ROLLUP over the sheet tag."""
    return tagged.rollup(sheet_col).agg(
        F.min("invoice_ts").alias("first_ts"), F.max("invoice_ts").alias("last_ts"), F.count(F.lit(1)).alias("lines")
    )


def sanity_totals(sales: DataFrame) -> DataFrame:
    """Gross (all lines) vs net (no cancellations) and the difference in %."""
    gross, net = F.sum("revenue"), sum_if(not_cancelled(), "revenue")
    return sales.agg(
        dbl(gross).alias("gross_revenue"),
        dbl(net).alias("net_revenue"),
        dbl(net - gross).alias("cancelled_value"),
        pct(net - gross, net).alias("difference_pct"),
    )


def join_grain_check(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Prove ``left ⋈ right`` on ``key`` keeps the fact grain: the right key is
    unique, every left row finds a partner, and the row count is unchanged.

    Each number is its own aggregate over a shuffle on ``key``; nothing is
    collected and no pair is materialised beyond the join itself.
    """
    dup_keys = right.groupBy(key).count().filter(F.col("count") > 1).agg(F.count(F.lit(1)).alias("n"))
    unmatched = left.join(right.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("n"))
    before = left.agg(F.count(F.lit(1)).alias("n"))
    after = left.join(right, key).agg(F.count(F.lit(1)).alias("n"))
    rows = (
        dup_keys.select(F.lit("duplicate_right_keys").alias("check"), F.col("n").alias("value"))
        .unionByName(unmatched.select(F.lit("unmatched_left_rows").alias("check"), F.col("n").alias("value")))
        .unionByName(before.select(F.lit("rows_before").alias("check"), F.col("n").alias("value")))
        .unionByName(after.select(F.lit("rows_after").alias("check"), F.col("n").alias("value")))
    )
    return rows


def reconcile_two_sources(sales: DataFrame, dim_month: DataFrame, tolerance: float = 0.011) -> DataFrame:
    """Year totals from the facts and from the month summary agree within the
    scorer's tolerance (abs 0.011 or relative 1e-6)."""
    f = sales.filter(not_cancelled()).groupBy(F.substring("invoice_month", 1, 4).alias("year")).agg(
        dbl(F.sum("revenue")).alias("from_sales")
    )
    m = dim_month.groupBy(F.substring("invoice_month", 1, 4).alias("year")).agg(
        dbl(F.sum("net_revenue")).alias("from_months")
    )
    j = f.join(m, "year", "full_outer")
    diff = F.abs(F.col("from_sales") - F.col("from_months"))
    limit = F.greatest(F.lit(tolerance), F.lit(1e-6) * F.greatest(F.abs("from_sales"), F.abs("from_months")))
    return j.select("year", "from_sales", "from_months", F.coalesce(diff <= limit, F.lit(False)).alias("ok"))


def share_breakdown_valid(parts: DataFrame, value_col: str) -> DataFrame:
    """A share (pie) breakdown is valid with >= 2 categories, no negative part
    and a positive total."""
    v = F.col(value_col)
    return parts.agg(
        F.count(F.lit(1)).alias("categories"),
        dbl(F.min(v)).alias("smallest"),
        dbl(F.sum(v)).alias("total"),
    ).withColumn(
        "valid", (F.col("categories") >= 2) & (F.col("smallest") >= 0) & (F.col("total") > 0)
    )


class ResultTooLarge(RuntimeError):
    """A bounded result had more rows than its cap; it is never cut silently."""


def bounded_result(df: DataFrame, cap: int) -> DataFrame:
    """Fetch at most ``cap + 1`` rows; more than ``cap`` is an error.

    Only ``cap + 1`` rows ever reach the driver (a limit, not a collect of
    the whole result), and the result is computed once."""
    rows = df.limit(cap + 1).collect()
    if len(rows) > cap:
        raise ResultTooLarge(f"result has more than {cap} rows")
    return df.sparkSession.createDataFrame(rows, df.schema)


def top_n_short_result(top: DataFrame, population: DataFrame, key: str, asked: int) -> DataFrame:
    """A ranked list must have ``asked`` rows, or every group when there are
    fewer groups than that."""
    return top.sparkSession.sql(
        f"""
        SELECT asked, rows, groups, rows = least(asked, groups) AS complete FROM (
            SELECT CAST({int(asked)} AS BIGINT) AS asked, (SELECT COUNT(*) FROM {{top}}) AS rows,
                   (SELECT COUNT(DISTINCT `{key}`) FROM {{pop}}) AS groups)
        """,
        top=top,
        pop=population,
    )
