"""Money and ratio expressions.

Money is DECIMAL end to end so sums are exact and independent of task order;
values become DOUBLE only in the final projection. Ratios cast both sides to
DOUBLE first, then divide, and give NULL for a zero denominator (NULLIF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE = "decimal(12,2)"
REVENUE = "decimal(18,2)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dbl(x) -> Column:
    return _c(x).cast("double")


def ratio(num, den) -> Column:
    """num / den as DOUBLE, NULL when den is 0 or NULL."""
    return dbl(num) / F.nullif(dbl(den), F.lit(0.0))


def pct(num, den) -> Column:
    """100 * num / den as DOUBLE (multiplication first, like the SQL oracle)."""
    return F.lit(100.0) * dbl(num) / F.nullif(dbl(den), F.lit(0.0))


def pct_change(new, old) -> Column:
    """(new - old) / old * 100, NULL when old is 0."""
    return (dbl(new) - dbl(old)) / F.nullif(dbl(old), F.lit(0.0)) * F.lit(100.0)


def sum_if(cond: Column, value) -> Column:
    """SUM(value) FILTER (WHERE cond): NULL when no row qualifies."""
    return F.sum(F.when(cond, _c(value)))


def mean(value, cond: Column | None = None) -> Column:
    """Exact mean of a DECIMAL/BIGINT column as DOUBLE: sum / count, both cast."""
    v = _c(value) if cond is None else F.when(cond, _c(value))
    return ratio(F.sum(v), F.count(v))
