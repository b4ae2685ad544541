"""Exploration analyses: Pareto, order-value distribution, customer cohorts,
returns, time-of-day profiles, outlier order/cancellation pairs, overlap.

Exact quantiles take the two neighbouring ranks of each position from
``rankings.order_statistics`` (a few aggregates, no sort and no single-task
percentile buffer) and interpolate ``lo + (hi - lo) * frac``.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar
from ..functions.money import dbl, pct, ratio
from . import rankings


def product_revenue_positive(sales: DataFrame) -> DataFrame:
    """Revenue per code over positive-quantity lines (the Pareto population)."""
    return sales.filter(F.col("quantity") > 0).groupBy("stock_code").agg(F.sum("revenue").alias("revenue"))


def pareto_cumulative(sales: DataFrame) -> DataFrame:
    ranked = rankings.running_share(product_revenue_positive(sales), "revenue", "stock_code")
    return ranked.select("stock_code", dbl("revenue").alias("revenue"), "rank", "cumulative_share")


def pareto_n80(sales: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Products needed for ``threshold`` of revenue: ``count(share <= t) + 1``."""
    held = product_revenue_positive(sales).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, within = rankings.rows_within_share(held, "revenue", threshold)
    finally:
        held.unpersist()
    row = sales.sparkSession.createDataFrame([(n, within + 1)], "products bigint, products_for_80pct bigint")
    return row.withColumn("pct_of_catalogue", pct("products_for_80pct", "products"))


def exact_quantiles(values: DataFrame, value: str, qs: list[float]) -> DataFrame:
    """Exact linear-interpolation quantiles of ``value`` (one row per q; no
    rows for empty input)."""
    _, found = _with_quantiles(values, value, qs, [])
    rows = [(float(q), v) for q, v in zip(qs, found) if v is not None]
    return values.sparkSession.createDataFrame(rows, "q double, value double")


def _with_quantiles(values: DataFrame, value: str, qs: list[float], others: list[Column]) -> tuple[DataFrame, list[float | None]]:
    """One row of ``others`` (aggregates over the same rows), and the quantiles.

    The 0-based position of q is ``q * (n - 1)``; the values at the ranks on both
    sides of each position come from ``order_statistics`` and are interpolated.
    The rows are kept (in memory, else on disk) while the few aggregates run.
    """
    held = values.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        stats = held.agg(F.count(value).alias("_n"), *others)
        row = stats.first()
        at = [q * float(row["_n"] - 1) for q in map(float, qs)] if row["_n"] else []
        ranks = [f(p) for p in at for f in (math.floor, math.ceil)]
        got = [float(v) for v in rankings.order_statistics(held, value, ranks)]
        found = [got[2 * i] + (got[2 * i + 1] - got[2 * i]) * (p - float(math.floor(p))) for i, p in enumerate(at)]
        one = values.sparkSession.createDataFrame([row], stats.schema).drop("_n")
        return one, found or [None] * len(qs)
    finally:
        held.unpersist()


def order_totals(sales: DataFrame) -> DataFrame:
    """Completed orders and their totals (DECIMAL)."""
    return sales.filter(~F.col("is_cancellation")).groupBy("invoice_no").agg(F.sum("revenue").alias("total"))


def describe(values: DataFrame, value: str) -> DataFrame:
    """count, mean, std (sample), min, 25%, 50%, 75%, max as one row.

    Mean and variance come from exact DECIMAL sums: the variance numerator
    ``n*sum(x^2) - sum(x)^2`` is exact, so the result does not depend on
    the order tasks finish in.
    """
    x = F.col(value)
    stats = [
        F.count(x).alias("count"),
        F.sum(x).alias("sx"),
        F.sum(x * x).alias("sxx"),
        dbl(F.min(x)).alias("min"),
        dbl(F.max(x)).alias("max"),
    ]
    row, (p25, p50, p75) = _with_quantiles(values, value, [0.25, 0.5, 0.75], stats)
    num = F.col("count") * F.col("sxx") - F.col("sx") * F.col("sx")
    den = (F.col("count") * (F.col("count") - 1)).cast("double")
    return row.select(
        "count",
        ratio("sx", "count").alias("mean"),
        F.sqrt(dbl(num) / F.nullif(den, F.lit(0.0))).alias("std"),
        "min",
        "max",
        *[F.lit(v).cast("double").alias(name) for name, v in (("p25", p25), ("p50", p50), ("p75", p75))],
    )


def order_value_describe(sales: DataFrame) -> DataFrame:
    return describe(order_totals(sales), "total")


def known_positive(sales: DataFrame) -> DataFrame:
    """Identified customers' positive-quantity lines (the EDA customer view)."""
    return sales.filter((F.col("quantity") > 0) & F.col("customer_id").isNotNull())


def orders_per_customer_stats(sales: DataFrame) -> DataFrame:
    per = known_positive(sales).groupBy("customer_id").agg(F.countDistinct("invoice_no").alias("orders"))
    counts = [
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("orders") == 1).alias("one_order_customers"),
    ]
    row, (median,) = _with_quantiles(per, "orders", [0.5], counts)
    return row.select(
        "customers", "one_order_customers", pct("one_order_customers", "customers").alias("one_order_pct"), F.lit(median).cast("double").alias("median_orders")
    )


def new_customers_by_month(sales: DataFrame) -> DataFrame:
    first = known_positive(sales).groupBy("customer_id").agg(F.min("invoice_month").alias("first_month"))
    return first.groupBy("first_month").agg(F.count(F.lit(1)).alias("new_customers"))


def top_customer_concentration(sales: DataFrame, n: int = 10) -> DataFrame:
    """Share of revenue earned by the top ``n`` identified customers."""
    per = known_positive(sales).groupBy("customer_id").agg(F.sum("revenue").alias("revenue"))
    top = rankings.top_k(per, "revenue", "customer_id", n).agg(F.sum("revenue").alias("v")).withColumn("kind", F.lit("top"))
    total = per.agg(F.sum("revenue").alias("v")).withColumn("kind", F.lit("all"))
    both = top.unionByName(total)
    return both.agg(
        dbl(F.max(F.when(F.col("kind") == "top", F.col("v")))).alias("top_revenue"),
        dbl(F.max(F.when(F.col("kind") == "all", F.col("v")))).alias("total_revenue"),
        pct(F.max(F.when(F.col("kind") == "top", F.col("v"))), F.max(F.when(F.col("kind") == "all", F.col("v")))).alias(
            "top_share_pct"
        ),
    )


def returns_by_product(sales: DataFrame, year: int, n: int = 5) -> DataFrame:
    """Most returned codes of a year, named by their first description, with
    their share of the year's returned value."""
    ret = sales.filter((F.col("quantity") < 0) & calendar.year_months(year) & (F.year("invoice_date") == year))
    per = ret.groupBy("stock_code").agg((-F.sum("revenue")).alias("returned"))
    top = rankings.top_k(per, "returned", "stock_code", n)
    # ``n`` rows by construction, so their codes are broadcast and only their lines are named.
    lines = sales.join(F.broadcast(top.select("stock_code")), "stock_code", "left_semi")
    names = rankings.first_per_key(lines, "stock_code", "description", ["invoice_ts", "invoice_no"])
    total = ret.agg((-F.sum("revenue")).alias("total"))
    return sales.sparkSession.sql(
        """
        SELECT t.stock_code, nm.description, CAST(t.returned AS DOUBLE) AS returned_value,
               100.0D * CAST(t.returned AS DOUBLE) / NULLIF(CAST((SELECT total FROM {total}) AS DOUBLE), 0.0D) AS share_pct
        FROM {top} t LEFT JOIN {names} nm ON t.stock_code = nm.stock_code
        """,
        top=top,
        names=names,
        total=total,
    )


def revenue_by_hour(events: DataFrame) -> DataFrame:
    """Sum of event value by hour of day (values summed as DECIMAL)."""
    return events.groupBy(F.hour("ts").cast("bigint").alias("hour")).agg(
        dbl(F.sum(F.col("value").cast("decimal(18,2)"))).alias("value")
    )


def revenue_by_weekday(sales: DataFrame) -> DataFrame:
    return sales.groupBy(calendar.weekday_name("invoice_ts").alias("weekday")).agg(dbl(F.sum("revenue")).alias("revenue"))


def day_of_week_evidence(sales: DataFrame, weekday: str) -> DataFrame:
    """The distinct dates behind one weekday group."""
    return sales.filter(calendar.weekday_name("invoice_ts") == weekday).select("invoice_date").distinct()


def rows_for_lookup_label(sales: DataFrame, stock_code: str) -> DataFrame:
    return (
        sales.filter((F.col("stock_code") == stock_code) & F.col("description").isNotNull())
        .groupBy("description")
        .agg(F.count(F.lit(1)).alias("lines"))
    )


def outlier_cancel_pairs(sales: DataFrame, window_days: int, partitions: int | None = None) -> DataFrame:
    """Each order line with its cancellation: the nearest one of the same code
    and the opposite quantity at or after it, at most ``window_days`` later (the
    smallest cancellation number on ties).

    An as-of join over ranges: cancellations are reduced to one a moment, and
    orders and cancellations are laid out by (code, quantity, time from late to
    early), so a popular code is split over as many ranges as it fills. Within a
    range, the last cancellation passed is the nearest one. Only the first code of
    a range can go on from earlier ranges: it takes over their last cancellation,
    from one row a range.
    """
    key = ["stock_code", "qty"]
    at = F.struct(F.col("invoice_ts").alias("ts"), F.col("invoice_no").alias("no"))
    lines = sales.select("invoice_no", "stock_code", F.abs("quantity").alias("qty"), "invoice_ts", "is_cancellation", "quantity")
    orders = lines.filter(~F.col("is_cancellation") & (F.col("quantity") > 0)).select(*key, "invoice_ts", "invoice_no", F.lit(False).alias("_cancel"))
    cancels = lines.filter(F.col("is_cancellation") & (F.col("quantity") < 0)).groupBy(*key, "invoice_ts").agg(F.min("invoice_no").alias("invoice_no"))
    both = orders.unionByName(cancels.withColumn("_cancel", F.lit(True)))
    order = [F.asc("stock_code"), F.asc("qty"), F.desc("invoice_ts"), F.desc("_cancel"), F.asc("invoice_no")]
    rows = rankings.ranged(both, order, partitions).withColumn("_at", F.when(F.col("_cancel"), at))

    passed = Window.partitionBy("_p", *key).orderBy(*order[2:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn("_local", F.last("_at", ignorenulls=True).over(passed)).filter(~F.col("_cancel"))

    # One row a range: its first code, and its last code with the last cancellation.
    per = rows.groupBy("_p", *key).agg(F.min("_at").alias("_at"))
    code = F.struct(*key)
    ends = per.groupBy("_p").agg(F.min(code).alias("first"), F.max(code).alias("last"), F.max_by("_at", code).alias("_at"))
    asks = ends.select("_p", "first.*", F.lit(0).alias("_tail"), F.lit(None).cast(ends.schema["_at"].dataType).alias("_at"))
    tails = ends.select("_p", "last.*", F.lit(1).alias("_tail"), "_at")
    before = Window.partitionBy(*key).orderBy("_p", "_tail").rowsBetween(Window.unboundedPreceding, -1)
    carried = asks.unionByName(tails).withColumn("_carried", F.last("_at", ignorenulls=True).over(before)).filter("_tail = 0")
    met = local.join(F.broadcast(carried.select("_p", *key, "_carried")), ["_p", *key], "left")

    nearest = met.withColumn("_next", F.coalesce("_local", "_carried"))
    within = F.col("_next.ts") <= F.col("invoice_ts") + F.expr(f"INTERVAL {int(window_days)} DAYS")
    return nearest.filter(within).select(
        F.col("invoice_no").alias("order_invoice"),
        F.col("_next.no").alias("cancel_invoice"),
        "stock_code",
        F.col("qty").alias("quantity"),
        F.col("invoice_ts").alias("order_ts"),
        F.col("_next.ts").alias("cancel_ts"),
        F.datediff(F.to_date("_next.ts"), F.to_date("invoice_ts")).cast("bigint").alias("days_apart"),
    )


def overlap_effect(sales_lineage: DataFrame) -> DataFrame:
    """Per month: revenue of the stacked sheets (bad debt removed) vs after
    dedupe, and how much the duplicates overstate it. Read from the published
    table: each row carries ``copies``, the identical raw lines it replaced,
    so the stacked total is ``sum(revenue * copies)``."""
    per = sales_lineage.groupBy("invoice_month").agg(
        F.sum(F.col("revenue") * F.col("copies")).alias("before"), F.sum("revenue").alias("after")
    )
    return per.select(
        "invoice_month",
        dbl("before").alias("before_dedupe"),
        dbl("after").alias("after_dedupe"),
        (F.lit(100.0) * (dbl("before") - dbl("after")) / F.nullif(dbl("after"), F.lit(0.0))).alias("overstatement_pct"),
    )
