"""The three summary tables built from ``sales``.

Each is one ``groupBy`` with map-side partial aggregation, so a hot key (one
month, one product, one customer holding a third of the lines) is reduced to
one row per task before the shuffle. Modal labels are counted per (key, label)
first, so no task holds a map of labels; ties go to the smallest text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import sum_if
from .rankings import totals_with_modal_label


def dim_month(sales: DataFrame) -> DataFrame:
    """Per month: distinct trading days, last day, net (no cancellations) and
    gross revenue, and ``is_complete_month`` = not the latest month in the data.

    The latest month is taken with a window over the month aggregate, whose
    size is bounded by the calendar (one row per month), not by the data.
    """
    per_month = sales.groupBy("invoice_month").agg(
        F.countDistinct("invoice_date").alias("trading_days"),
        F.max("invoice_date").alias("last_day"),
        sum_if(~F.col("is_cancellation"), "revenue").alias("net_revenue"),
        F.sum("revenue").alias("gross_revenue"),
    )
    latest = F.max("invoice_month").over(Window.partitionBy())
    return per_month.withColumn("is_complete_month", F.col("invoice_month") != latest)


def dim_product(sales: DataFrame) -> DataFrame:
    """Per stock code: modal description, units and revenue of positive lines."""
    positive = F.col("quantity") > 0
    return totals_with_modal_label(sales, "stock_code", "description", {
        "units_sold": F.when(positive, F.col("quantity")), "gross_revenue": F.when(positive, F.col("revenue")),
    })


def dim_customer(sales: DataFrame) -> DataFrame:
    """Per identified customer. ``net_revenue`` includes cancellations (as the
    reference's table does, despite the name); ``orders`` counts completed ones.
    Countries are counted per customer first, so no task holds a map of them."""
    lines = sales.filter(F.col("customer_id").isNotNull())
    named = totals_with_modal_label(lines, "customer_id", "country", {"net_revenue": F.col("revenue")})
    orders = lines.groupBy("customer_id").agg(
        F.min("invoice_date").alias("first_order"),
        F.max("invoice_date").alias("last_order"),
        F.countDistinct(F.when(~F.col("is_cancellation"), F.col("invoice_no"))).alias("orders"),
    )
    return named.join(orders, "customer_id").select("customer_id", "country", "first_order", "last_order", "orders", "net_revenue")
