"""Raw invoice lines shaped like the retailer's two spreadsheet sheets.

The test data is a TPC-H-like star schema. The mapping below turns
``lineitem ⋈ orders ⋈ part ⋈ customer ⋈ nation`` into invoice lines with the
same quirks the cleaning rules exist for: cancellation and bad-debt invoice
prefixes, non-product codes, NULL and variant descriptions, write-offs with a
zero price, guests without a customer id, and two sheets that overlap.

Join order is written out on purpose (Catalyst does not reorder joins unless
CBO is on): the small nation table meets customer first, orders meet the
customer side on ``custkey``, and lineitem — the big side — is shuffled once
on ``orderkey`` and once on ``partkey``. Whether a side is broadcast is left
to Spark's size statistics and AQE; nothing here is broadcast blindly. Over
large inputs the lines are dealt out by order in parts of a fixed size, and the
smaller side of these two joins is hashed, so that the lines are not sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar
from .tables import read_table

# Fixed values of the test mapping (they must match the oracle SQL).
SHEET1_END = "1998-06-10"    # first sheet: invoice_ts <  this day
SHEET2_START = "1998-06-01"  # second sheet: invoice_ts >= this day (nine days twice)
BAD_DEBT_ORDER_EVERY = 50    # 'P' orders whose key is a multiple of this are bad debt
GUEST_CUSTOMER_EVERY = 5     # customers whose key is a multiple of this are guests

# Sizes of the layout; they decide memory and files, not results.
LINES_A_TASK = 250_000    # lines that a task joins to their orders or groups
LINES_A_FILE = 125_000    # lines in a file of a month
ORDER_BUCKETS = 1 << 16   # hash buckets in which the lines of orders are counted
BROADCAST_PARTS = 2_000_000  # more parts than that are hashed by partition

RAW_COLUMNS = (
    "invoice", "stock_code", "description", "quantity",
    "invoice_ts", "price", "customer_id", "country",
)


def _write_off(l_returnflag: Column, l_linenumber: Column, l_quantity: Column) -> Column:
    return (l_returnflag == "N") & (l_linenumber == 5) & (l_quantity < 5)


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All invoice lines before the sheet split (one row per lineitem)."""
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    customer = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_retailprice")
    lineitem = read_table(
        spark, sf_dir, "lineitem",
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag",
    )

    parts = line_parts(spark, sf_dir)
    if parts and part.count() > BROADCAST_PARTS:
        part = part.hint("shuffle_hash")
    buyers = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select("c_custkey", "n_name")
    placed = orders.join(buyers, orders.o_custkey == buyers.c_custkey)
    if parts:
        lineitem, placed = lineitem.repartition(parts, "l_orderkey"), placed.hint("shuffle_hash")
    lines = lineitem.join(placed, lineitem.l_orderkey == placed.o_orderkey).join(
        part, F.col("l_partkey") == part.p_partkey
    )

    l_returnflag, l_linenumber, l_quantity = F.col("l_returnflag"), F.col("l_linenumber"), F.col("l_quantity")
    write_off = _write_off(l_returnflag, l_linenumber, l_quantity)
    prefix = (
        F.when(l_returnflag == "R", F.lit("C"))
        .when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % BAD_DEBT_ORDER_EVERY == 0), F.lit("A"))
        .otherwise(F.lit(""))
    )
    return lines.select(
        F.concat(prefix, F.col("l_orderkey").cast("string")).alias("invoice"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("stock_code"),
        F.when(l_linenumber == 7, F.lit(None).cast("string"))
        .when(l_linenumber == 6, F.upper("p_name"))
        .otherwise(F.col("p_name"))
        .alias("description"),
        F.when((l_returnflag == "R") | write_off, -l_quantity)
        .otherwise(l_quantity)
        .cast("bigint")
        .alias("quantity"),
        F.col("o_orderdate").alias("invoice_ts"),
        F.when(write_off, F.lit(0).cast("decimal(12,2)"))
        .otherwise(F.col("p_retailprice").cast("decimal(12,2)"))
        .alias("price"),
        F.when(F.col("o_custkey") % GUEST_CUSTOMER_EVERY == 0, F.lit(None).cast("bigint"))
        .otherwise(F.col("o_custkey"))
        .alias("customer_id"),
        F.col("n_name").alias("country"),
    )


def line_parts(spark: SparkSession, sf_dir: str) -> int | None:
    """Partitions that keep a task's lines few whatever the input, from the row
    count that the files state; None for inputs that need no more than two a
    core, where Spark settles the number at run time."""
    parts = math.ceil(read_table(spark, sf_dir, "lineitem").count() / LINES_A_TASK)
    return parts if parts > 2 * spark.sparkContext.defaultParallelism else None


def month_parts(spark: SparkSession, sf_dir: str, parts: int | None = None) -> dict[str, int]:
    """How many parts each month's lines are laid out in, by its share of the
    orders (one column is read). ``parts`` in all, or a little more: by default
    as many as keep a part to ``LINES_A_FILE`` lines. The result has a row a month."""
    total = parts or math.ceil(read_table(spark, sf_dir, "lineitem").count() / LINES_A_FILE)
    orders = read_table(spark, sf_dir, "orders", "o_orderdate")
    rows = orders.groupBy(calendar.month_key("o_orderdate").alias("m")).agg(F.count(F.lit(1)).alias("n")).collect()
    every = sum(r["n"] for r in rows)
    return {r["m"]: max(1, math.ceil(total * r["n"] / every)) for r in rows if r["m"] is not None}


def order_spread(spark: SparkSession, sf_dir: str) -> int:
    """Into how many lots the lines of an invoice are dealt, so that a hot one
    fills many files: 1 unless an order may have over ``LINES_A_FILE`` lines. No
    order has more lines than its hash bucket, so only buckets are counted (one
    column is read, a few rows are shuffled)."""
    key = F.col("l_orderkey")
    lines = read_table(spark, sf_dir, "lineitem", "l_orderkey").where(key.isNotNull())
    buckets = lines.groupBy(F.pmod(F.xxhash64(key), F.lit(ORDER_BUCKETS)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return max(1, math.ceil((buckets.agg(F.max("n")).first()[0] or 0) / LINES_A_FILE))


def sheet(raw: DataFrame, which: int) -> DataFrame:
    """One of the two overlapping year sheets."""
    ts = F.col("invoice_ts")
    if which == 1:
        return raw.filter(ts < F.lit(SHEET1_END).cast("timestamp_ntz"))
    if which == 2:
        return raw.filter(ts >= F.lit(SHEET2_START).cast("timestamp_ntz"))
    raise ValueError("sheet is 1 or 2")


def tagged_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sheets stacked, each row tagged with its ``sheet`` (1 or 2).

    Same rows as ``sheet(raw, 1).unionByName(sheet(raw, 2))`` but in a single
    scan and join: each line carries the ids of the sheets it belongs to and
    ``explode`` emits it once per sheet, so lines in the overlap appear twice
    without reading lineitem twice.
    """
    raw = raw_lines(spark, sf_dir)
    ts = F.col("invoice_ts")
    first, second = ts < F.lit(SHEET1_END).cast("timestamp_ntz"), ts >= F.lit(SHEET2_START).cast("timestamp_ntz")
    one, two = F.lit(1), F.lit(2)
    # A line of no sheet has no list, so it gives no row.
    ids = F.when(first & second, F.array(one, two)).when(first, F.array(one)).when(second, F.array(two))
    return raw.select(*RAW_COLUMNS, F.explode(ids).alias("sheet"))


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sheets stacked, duplicates kept (UNION ALL); the input of cleaning."""
    return tagged_sheets(spark, sf_dir).drop("sheet")
