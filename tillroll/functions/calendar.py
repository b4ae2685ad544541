"""Calendar expressions over a TIMESTAMP_NTZ column (session zone pinned to UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def day(ts) -> Column:
    return F.to_date(_c(ts))


def month_key(ts) -> Column:
    """'YYYY-MM'; sorts as text."""
    return F.date_format(_c(ts), "yyyy-MM")


def weekday_name(ts) -> Column:
    return F.date_format(_c(ts), "EEEE")


def month_label_long(month: Column) -> Column:
    """'2011-11' -> 'november 2011'."""
    return F.lower(F.date_format(F.to_date(F.concat(month, F.lit("-01"))), "MMMM yyyy"))


def month_label_short(month: Column) -> Column:
    """'2011-11' -> 'nov 2011'."""
    return F.lower(F.date_format(F.to_date(F.concat(month, F.lit("-01"))), "MMM yyyy"))


def year_months(year: int) -> Column:
    """Partition-pruning form of ``year(invoice_date) = year`` on invoice_month."""
    return F.col("invoice_month").startswith(f"{year:04d}-")
