"""Tolerance equality and a bucketed near-equality join.

``near_equal(a, b)``: both finite and ``|a - b| <= max(0.011, 1e-6 * max(|a|, |b|))``
— the scorer's rule (absolute 0.011 for money rounding, relative 1e-6).

``near_join`` finds all pairs within that tolerance without comparing every
pair in a group. Values are mapped to buckets whose width follows the
tolerance itself: linear steps of 0.011 up to |v| = 11,000 (where the absolute
part dominates), then logarithmic steps of the relative part above it, both
widened by 1 %. Any near-equal pair is at most one step apart on that scale
(the slope of the map never exceeds 1/tolerance between the two values), so a
match always lies in the same or a neighbouring bucket. The left side is
exploded into its three candidate buckets, the join is an equi-join, and the
exact test runs on those candidates only. A bucket spans about 1.5 tolerance
windows, so the candidates stay close to the true matches even where values
are dense.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ABS_TOL = 0.011
REL_TOL = 1e-6
SWITCH = ABS_TOL / REL_TOL          # |v| where the relative part takes over
LOG_STEP = -math.log1p(-REL_TOL)    # largest ln(b / a) of a near-equal pair
SLACK = 1.01                        # rounding room between the two regimes


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_finite(x) -> Column:
    v = _c(x)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def near_equal(a, b) -> Column:
    a, b = _c(a), _c(b)
    limit = F.greatest(F.lit(ABS_TOL), F.lit(REL_TOL) * F.greatest(F.abs(a), F.abs(b)))
    return F.coalesce(is_finite(a) & is_finite(b) & (F.abs(a - b) <= limit), F.lit(False))


def bucket(x) -> Column:
    """Signed bucket id: |v| / 0.011 below the switch, logarithmic above it."""
    v = _c(x)
    a = F.abs(v)
    scaled = F.when(a <= F.lit(SWITCH), a / F.lit(ABS_TOL)).otherwise(
        F.lit(SWITCH / ABS_TOL) + F.log(a / F.lit(SWITCH)) / F.lit(LOG_STEP)
    )
    return F.floor(F.signum(v) * scaled / F.lit(SLACK))


def _candidates(left: DataFrame, lval: str, right: DataFrame, rval: str, keys: list[str]):
    lb = left.filter(is_finite(lval)).withColumn(
        "_nb", F.explode(F.array(bucket(lval) - 1, bucket(lval), bucket(lval) + 1))
    )
    rb = right.filter(is_finite(rval)).withColumn("_nb", bucket(rval))
    cond = [lb[k] == rb[k] for k in keys] + [lb["_nb"] == rb["_nb"], near_equal(lb[lval], rb[rval])]
    return lb, rb, cond


def near_join(left: DataFrame, lval: str, right: DataFrame, rval: str, on: list[str] | None = None) -> DataFrame:
    """All pairs (left, right) with ``near_equal(left[lval], right[rval])`` and
    equal ``on`` keys (the right copies of the keys are dropped)."""
    keys = list(on or [])
    lb, rb, cond = _candidates(left, lval, right, rval, keys)
    pairs = lb.join(rb, cond).drop(lb["_nb"]).drop(rb["_nb"])
    for k in keys:
        pairs = pairs.drop(rb[k])
    return pairs


def near_matched(left: DataFrame, lval: str, right: DataFrame, rval: str,
                 on: list[str] | None = None, flag: str = "matched") -> DataFrame:
    """``left`` plus a boolean ``flag``: does any right row lie within
    tolerance (with equal ``on`` keys)?

    The flag depends only on (keys, value), so both sides are reduced to
    their distinct (keys, value) pairs first (map-side, so a value repeated
    in a third of the rows is one row before the shuffle); the flags are then
    joined back on the exact value."""
    keys = list(on or [])
    right = right.select(*keys, rval).distinct()
    values = left.select(*keys, lval).distinct()
    lb, rb, cond = _candidates(values, lval, right, rval, keys)
    hits = lb.join(rb, cond, "left_semi").select(*keys, lval).distinct().withColumn(flag, F.lit(True))
    return left.join(hits, [*keys, lval], "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def near_flagged(left: DataFrame, lval: str, right: DataFrame, rval: str, flag: str = "matched") -> DataFrame:
    """``left`` plus ``flag`` (any right value within tolerance) in one pass
    over ``left``, for a left side that is costly to compute twice (e.g. the
    output of a per-text helper). Each row is exploded into its three
    candidate buckets, left-joined to the distinct right values of those
    buckets under the exact test, and folded back by grouping on all of its
    columns, so rows of ``left`` must be distinct (give them a key)."""
    cols = left.columns
    r = right.select(F.col(rval).alias("_rv")).filter(is_finite("_rv")).distinct().withColumn("_rb", bucket("_rv"))
    b = bucket(lval)
    candidates = F.when(is_finite(lval), F.array(b - 1, b, b + 1)).otherwise(F.array(F.lit(None).cast("bigint")))
    lb = left.withColumn("_lb", F.explode(candidates))
    j = lb.join(r, (F.col("_lb") == F.col("_rb")) & near_equal(F.col(lval), F.col("_rv")), "left")
    return j.groupBy(*cols).agg(F.max(F.col("_rv").isNotNull()).alias(flag))
