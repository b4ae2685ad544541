"""Cleaning chain: stacked sheets -> the ``sales`` line-item fact table.

Order of the reference rules: exact-duplicate removal over every raw column
(identical lines inside one invoice collapse too), drop bad-debt invoices
(prefix ``A``), rename, then derive revenue, flags and calendar columns.
Cancellations, non-products and outliers are flagged, never deleted.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar, money
from ..sources.invoices import RAW_COLUMNS

# Fixed values (the test mapping's counterparts of the reference lists).
# Non-product stock codes: 'P0' through 'P16' (17 codes, case sensitive).
NON_PRODUCT_CODES = tuple(f"P{i}" for i in range(17))
# Order/cancellation pairs too large for returns figures; flagged, not deleted.
OUTLIER_INVOICES = ("1001", "C1001", "2002", "C2002")

RENAMES = {"invoice": "invoice_no", "price": "unit_price"}

SALES_COLUMNS = (
    "invoice_no", "stock_code", "description", "quantity", "invoice_ts", "unit_price",
    "customer_id", "country", "revenue", "is_cancellation", "is_product", "is_outlier",
    "invoice_date", "invoice_month",
)


def _spread(raw: DataFrame, parts: int | None) -> DataFrame:
    """Rows by the hash of all columns in ``parts`` partitions, which is the
    clustering that grouping by all columns needs: no second exchange follows,
    and no task groups more than its part. Nearly all lines differ, so grouping
    them before the exchange would hold them in memory for nothing."""
    return raw.repartition(parts, *raw.columns) if parts else raw


def dedupe_exact(raw: DataFrame, parts: int | None = None) -> DataFrame:
    """Drop rows equal in every column; NULLs compare equal (``distinct``).
    ``parts`` bounds what one task groups over large inputs."""
    return _spread(raw, parts).dropDuplicates()


def _parts_of(ts: Column, parts: Mapping[str, int]) -> Column:
    """The parts of a time's month: looked up by its number in a list of the
    split months, as a map would be searched anew for every line."""
    split = {int(m[:-3]) * 12 + int(m[-2:]): int(n) for m, n in parts.items() if n > 1}
    if not split:
        return F.lit(1)
    low = min(split)
    counts = F.array(*[F.lit(split.get(m, 1)) for m in range(low, max(split) + 1)])
    return F.coalesce(F.get(counts, F.year(ts) * 12 + F.month(ts) - low), F.lit(1))


def dedupe_clustered(raw: DataFrame, parts: Mapping[str, int] | None = None, spread: int | None = None) -> DataFrame:
    """Exact dedupe laid out for a month-partitioned write, in one hash exchange.

    Rows go to (month, hash of the row modulo ``parts[month]``; with ``spread``,
    hash of the invoice, whose rows are dealt into so many lots, so that readers
    combine an invoice's lines before they shuffle), which satisfies
    the clustering that the duplicate-removal aggregate needs, so Spark adds no
    second shuffle, and nothing is sampled before it. A part writes one file, so
    a month has ``parts[month]`` files (1 if it is not in ``parts``), and a hot
    month or invoice is split by giving its month more parts; only rows
    identical in every column stay together, and those collapse. Months that
    are split get two partitions a part, so few parts meet in a task; else the
    number of partitions is settled at run time.
    """
    month = calendar.month_key("invoice_ts")
    count, partitions = F.lit(1), []
    if parts:
        if sum(parts.values()) > 2 * len(parts):
            partitions = [2 * sum(parts.values())]
        count = _parts_of(F.col("invoice_ts"), parts)
    row = F.xxhash64(*RAW_COLUMNS)
    if spread:
        row = F.xxhash64("invoice") if spread == 1 else F.xxhash64(F.col("invoice"), F.pmod(row, F.lit(spread)))
    keyed = raw.withColumn("invoice_month", month)
    keyed = keyed.withColumn("_part", F.pmod(row, count)).repartition(*partitions, "invoice_month", "_part")
    # Grouping on every column is the exact dedupe; the count of identical raw
    # lines is kept as lineage (``copies``) so duplicate effects can be
    # measured later from the published table without re-reading the sources.
    return keyed.groupBy("invoice_month", "_part", *RAW_COLUMNS).agg(F.count(F.lit(1)).alias("copies")).drop("_part")


def dedupe_report(raw: DataFrame, parts: int | None = None) -> DataFrame:
    """rows_before, rows_after, rows_removed in one pass (group, then sum)."""
    groups = _spread(raw, parts).groupBy(*raw.columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.sum("n").cast("bigint").alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
    ).select(
        "rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("rows_removed")
    )


def is_bad_debt(invoice_col: str = "invoice"):
    return F.col(invoice_col).startswith("A")


def drop_bad_debt(df: DataFrame, invoice_col: str = "invoice") -> DataFrame:
    return df.filter(~is_bad_debt(invoice_col))


def bad_debt_lines(df: DataFrame, invoice_col: str = "invoice") -> DataFrame:
    return df.filter(is_bad_debt(invoice_col))


def cast_rename(df: DataFrame) -> DataFrame:
    """Ids as text, reference column names."""
    return df.withColumns(
        {"invoice": F.col("invoice").cast("string"), "stock_code": F.col("stock_code").cast("string")}
    ).withColumnsRenamed(RENAMES)


def derive_revenue(df: DataFrame) -> DataFrame:
    return df.withColumn("revenue", (F.col("quantity") * F.col("unit_price")).cast(money.REVENUE))


def derive_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "is_cancellation": F.col("invoice_no").startswith("C"),
            "is_product": ~F.col("stock_code").isin(*NON_PRODUCT_CODES),
            "is_outlier": F.col("invoice_no").isin(*OUTLIER_INVOICES),
        }
    )


def derive_calendar(df: DataFrame) -> DataFrame:
    """Day and month; a month that the layout has already derived is kept."""
    month = {} if "invoice_month" in df.columns else {"invoice_month": calendar.month_key("invoice_ts")}
    return df.withColumns({"invoice_date": calendar.day("invoice_ts"), **month})


def build_sales(sheets_df: DataFrame, parts: Mapping[str, int] | int | None = None, clustered: bool = True,
                keep_copies: bool = False, spread: int | None = None) -> DataFrame:
    """The whole chain. Bad-debt rows are filtered before the dedupe shuffle:
    the predicate depends on row values only, so dedupe(filter(x)) equals
    filter(dedupe(x)) and less data crosses the network. ``parts`` are those of
    the months, or without ``clustered`` a number for all. ``keep_copies`` adds
    the number of identical raw lines behind each row, ``spread`` keeps an
    invoice's lines in so many lots (clustered path)."""
    kept = drop_bad_debt(sheets_df)
    unique = dedupe_clustered(kept, parts, spread) if clustered else dedupe_exact(kept, parts)
    out = derive_calendar(derive_flags(derive_revenue(cast_rename(unique))))
    extra = ["copies"] if keep_copies and clustered else []
    return out.select(*SALES_COLUMNS, *extra)


def calendar_profile(sales: DataFrame) -> DataFrame:
    """date, month, year, hour, weekday per line (derive_calendar, extended)."""
    return sales.select(
        "invoice_no", "stock_code", "invoice_ts",
        F.col("invoice_date"), F.col("invoice_month"),
        F.year("invoice_ts").alias("year"),
        F.hour("invoice_ts").alias("hour"),
        calendar.weekday_name("invoice_ts").alias("weekday"),
    )
