"""Top-k lists, extremes that keep ties, ranked lists, per-group winners and
running shares.

* Top-k is ``orderBy(value desc, key asc).limit(k)``: Spark plans it as a
  per-partition top-k plus a k-row merge (TakeOrderedAndProject), never a
  global sort. The key is always the last sort column, so ties are stable.
* Extremes join a one-row aggregate back (its size is one row by
  construction, so it is broadcast) instead of a window over everything.
* Per-group winners use ``max(struct(...))`` — an aggregate with map-side
  combine — so one group holding a third of the rows never lands whole in a
  single task.
* Running shares over a ranked list use a distributed prefix sum: range
  partition by the ranking, sum each partition, add the offsets of the
  earlier partitions. No un-partitioned window.
"""

from __future__ import annotations

import decimal
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import dbl, ratio
from ..session import scratch_path


def top_k(df: DataFrame, value: str, key: str, k: int, ascending: bool = False) -> DataFrame:
    order = F.asc(value) if ascending else F.desc(value)
    return df.orderBy(order, F.asc(key)).limit(k)


def extreme_with_ties(df: DataFrame, value: str, largest: bool = True) -> DataFrame:
    """Every row whose ``value`` equals the max (or min): all tied winners."""
    best = df.agg((F.max(value) if largest else F.min(value)).alias("_best"))
    return df.join(F.broadcast(best), F.col(value) == F.col("_best")).drop("_best")


def ranked_list(top: DataFrame, value: str, key: str) -> DataFrame:
    """Attach 1..n to an already-limited top list (n rows, so one window task
    is bounded by n)."""
    w = Window.orderBy(F.desc(value), F.asc(key))
    return top.withColumn("rank", F.row_number().over(w).cast("bigint"))


def best_per_group(df: DataFrame, group: str, keys: dict[str, Column], pick: str) -> DataFrame:
    """Per ``group``, the row with the greatest ``keys`` tuple, the smallest
    ``pick`` winning ties (strict improvement only), as one aggregate:
    ``max(struct(keys..., -pick, pick))``."""
    packed = F.struct(
        *[c.alias(name) for name, c in keys.items()], (-F.col(pick)).alias("_earliest"), F.col(pick).alias("_pick")
    )
    best = df.groupBy(group).agg(F.max(packed).alias("_b"))
    return best.select(group, F.col("_b._pick").alias(pick), *[F.col(f"_b.{n}").alias(n) for n in keys])


def latest_per_group(df: DataFrame, group: str, order: list[str], value_cols: list[str]) -> DataFrame:
    """Per group, the values of the row with the greatest ``order`` tuple."""
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c).alias(f"_v_{c}") for c in value_cols])
    got = df.groupBy(group).agg(F.max(packed).alias("_m"))
    return got.select(group, *[F.col(f"_m.{c}").alias(c) for c in order if c not in value_cols],
                      *[F.col(f"_m._v_{c}").alias(c) for c in value_cols])


def totals_with_modal_label(df: DataFrame, key: str, label: str, sums: dict[str, Column]) -> DataFrame:
    """Per ``key``: its most frequent non-NULL ``label`` (the smallest on ties)
    and the sums. Rows are first counted per (key, label), combined before the
    shuffle, so no task holds a map of labels."""
    per = df.groupBy(key, label).agg(F.count(label).alias("_n"), *[F.sum(c).alias(n) for n, c in sums.items()])
    named = F.when(F.col(label).isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col(label).alias("v")))
    return per.groupBy(key).agg(F.min(named)["v"].alias(label), *[F.sum(n).alias(n) for n in sums])


def top_with_modal_label(df: DataFrame, key: str, label: str, sums: dict[str, Column], by: str, n: int) -> DataFrame:
    """The ``n`` keys with the greatest sum ``by``, with their most frequent
    label. The ranking comes first: its ``n`` keys (a size by construction) are
    broadcast, and only their lines are counted by label."""
    top = top_k(df.groupBy(key).agg(*[F.sum(c).alias(name) for name, c in sums.items()]), by, key, n)
    lines = df.join(F.broadcast(top.select(key)), key, "left_semi")
    names = totals_with_modal_label(lines, key, label, {"_lines": F.lit(1)}).select(key, label)
    return top_k(top.join(F.broadcast(names), key, "left"), by, key, n).select(key, label, *sums)


def order_statistics(values: DataFrame, value: str, ranks: list[int], buckets: int = 4096, fetched: int = 20_000) -> list:
    """The values at 0-based ``ranks`` in ascending order (NULLs do not count),
    without sorting or moving the rows.

    Each round is one aggregate: the interval that holds a rank is cut into
    ``buckets`` equal parts, whose counts and ends (at most ``buckets`` rows an
    interval) tell the part that holds it. A part with one value gives it; one
    with at most ``fetched`` rows is read as distinct values with counts. Cutting
    goes by DOUBLE, which keeps the order; where it can no longer tell values
    apart, the distinct values of the part are counted and ranked on Spark.
    ``values`` is read once a round, so callers keep it.
    """
    found: dict[int, object] = {}
    rows = values.where(F.col(value).isNotNull())
    x = F.col(value)
    first = rows.agg(F.min(x).alias("low"), F.max(x).alias("high"), F.count(x).alias("n")).first()
    # (low, high) -> rows before it, and the ranks it holds
    open_ = {(first["low"], first["high"]): (0, sorted({r for r in ranks if r < first["n"]}))} if first["n"] else {}
    while open_:
        wanted, open_ = open_, {}
        part = None
        for i, (low, high) in enumerate(wanted):
            a, b = F.lit(low), F.lit(high)
            width = (dbl(b) - dbl(a))
            at = F.when(width > 0, F.least(F.floor((dbl(x) - dbl(a)) / width * buckets), F.lit(buckets - 1))).otherwise(0).cast("long")
            inside, at = (x >= a) & (x <= b), F.lit(i * buckets).cast("long") + at
            part = F.when(inside, at) if part is None else part.when(inside, at)
        cut = rows.withColumn("_part", part).where("_part IS NOT NULL").groupBy("_part")
        parts = sorted(cut.agg(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).collect(), key=lambda r: r["_part"])
        for i, ((low, high), (before, held)) in enumerate(wanted.items()):
            for r in (r for r in parts if r["_part"] // buckets == i):
                mine = [k for k in held if before <= k < before + r["n"]]
                if mine and r["low"] == r["high"]:
                    found.update(dict.fromkeys(mine, r["low"]))
                elif mine and (r["n"] <= fetched or (r["low"], r["high"]) == (low, high)):
                    found.update(_at_ranks(rows, value, r["low"], r["high"], before, mine, r["n"] <= fetched))
                elif mine:
                    open_[r["low"], r["high"]] = (before, mine)
                before += r["n"]
    return [found.get(r) for r in ranks]


def rows_within_share(values: DataFrame, value: str, share: float, buckets: int = 4096, fetched: int = 20_000) -> tuple[int, int]:
    """The number of rows, and how many of the greatest ``value``s add up to at
    most ``share`` of the total: the rows whose running share is within it.

    Rounds as in ``order_statistics``, with sums: the part in which the share is
    passed is cut again. ``value`` must not be negative (DECIMAL or BIGINT, so
    that sums are exact). With a zero total no row counts."""
    x = F.col(value)
    rows = values.where(x.isNotNull())
    sums = [F.count(x).alias("n"), F.sum(x).alias("s"), F.min(x).alias("low"), F.max(x).alias("high")]
    total = rows.agg(*sums).first()
    if not total["n"] or not total["s"]:
        return total["n"], 0
    with decimal.localcontext(prec=80):

        def within(s) -> bool:
            return float(s) / float(total["s"]) <= share

        n, s, low, high = 0, 0, total["low"], total["high"]
        while True:
            a, width = F.lit(low), dbl(F.lit(high)) - dbl(F.lit(low))
            at = F.when(width > 0, F.least(F.floor((dbl(x) - dbl(a)) / width * buckets), F.lit(buckets - 1))).otherwise(0).cast("long")
            parts = rows.where(x.between(a, F.lit(high))).groupBy(at.alias("_part")).agg(*sums).collect()
            passed = None
            for r in sorted(parts, key=lambda r: -r["_part"]):
                if not within(s + r["s"]):
                    passed = r
                    break
                n, s = n + r["n"], s + r["s"]
            if passed is None:
                return total["n"], n
            before, (low, high) = (low, high), (passed["low"], passed["high"])
            if passed["n"] <= fetched or low == high or (low, high) == before:
                break
        inside = rows.where(x.between(F.lit(low), F.lit(high))).groupBy(value).agg(F.count(x).alias("_n")).orderBy(F.desc(value))
        for r in inside.collect() if passed["n"] <= fetched else inside.toLocalIterator():
            if within(s + r["_n"] * r[value]):
                n, s = n + r["_n"], s + r["_n"] * r[value]
                continue
            few, many = 0, r["_n"]  # of equal values, as many as still fit
            while many - few > 1:
                middle = (few + many) // 2
                few, many = (middle, many) if within(s + middle * r[value]) else (few, middle)
            return total["n"], n + few
        return total["n"], n


def _at_ranks(rows: DataFrame, value: str, low, high, before: int, ranks: list[int], few: bool) -> dict[int, object]:
    """Values at the ranks that lie in [low, high], which ``before`` rows precede."""
    part = rows.where(F.col(value).between(F.lit(low), F.lit(high))).groupBy(value).agg(F.count(F.lit(1)).alias("_n")).orderBy(value)
    out = {}
    # Few values come at once; many are sorted on Spark and read partition by partition.
    for r in part.collect() if few else part.toLocalIterator():
        out.update({k: r[value] for k in ranks if before <= k < before + r["_n"]})
        before += r["_n"]
        if len(out) == len(ranks):
            break
    return out


def first_per_key(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """First non-NULL ``value`` per ``key`` in an explicit ``order``."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(key)
        .agg(F.min_by(value, F.struct(*[F.col(c) for c in order], F.col(value))).alias(value))
    )


def ranged(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """``df`` in ranges of ``order``, with the range's number in ``_p``, written once
    to the shared folder: range bounds are sampled, so a plan that ranged the
    rows twice could number them differently. Without a number of ranges, small
    neighbouring ones are joined at run time."""
    by = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    tagged = by.withColumn("_p", F.spark_partition_id())
    path = scratch_path(df.sparkSession, "ranges", uuid.uuid4().hex)
    tagged.write.parquet(path)
    return df.sparkSession.read.schema(tagged.schema).parquet(path)


def running_share(
    df: DataFrame, value: str, key: str, partitions: int | None = None, ascending: bool = False,
    with_total: bool = False,
) -> DataFrame:
    """Running share of ``value`` ordered by value desc (or asc), key asc.

    Distributed prefix sum: rows are range-partitioned in ranking order and
    tagged with their range id; each range gets its local running sum and
    position (a window partitioned by the range id, so every range is sorted
    by its own task), each range's total is computed (one row per range), and
    the offsets of all earlier ranges come from a window over those few rows.
    ``value`` should be exact (DECIMAL/BIGINT) so sums do not depend on the
    partitioning. ``with_total`` adds ``total_count`` (rows in the whole
    ranking), taken from the same per-range counts. The tagged rows are written
    once to the shared folder and both branches read them: range bounds are
    sampled, so a plan that ranged the rows twice could tag them differently.
    """
    order = [F.asc(value) if ascending else F.desc(value), F.asc(key)]
    ranked = ranged(df, order, partitions)
    within = Window.partitionBy("_p").orderBy(*order)
    local = ranked.select(
        *df.columns, "_p",
        F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_local"),
        F.row_number().over(within).alias("_pos"),
    )
    totals = ranked.groupBy("_p").agg(F.sum(value).alias("_tot"), F.count(F.lit(1)).alias("_cnt"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_p",
        F.coalesce(F.sum("_tot").over(before), F.lit(0).cast(totals.schema["_tot"].dataType)).alias("_off"),
        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_offn"),
        F.sum("_tot").over(Window.partitionBy()).alias("_grand"),
        F.sum("_cnt").over(Window.partitionBy()).alias("_n"),
    )
    joined = local.join(F.broadcast(offsets), "_p")
    return joined.select(
        *df.columns,
        (F.col("_offn") + F.col("_pos")).cast("bigint").alias("rank"),
        (F.col("_off") + F.col("_local")).alias("cumulative"),
        ratio(F.col("_off") + F.col("_local"), "_grand").alias("cumulative_share"),
        *([F.col("_n").cast("bigint").alias("total_count")] if with_total else []),
    )
