"""The layout of the cleaning job follows the rows, not the session, and keeps them."""

import datetime as dt

import pytest

from tillroll.operators import clean
from tillroll.sources import invoices


@pytest.fixture
def tables(spark, tmp_path):
    """Orders of three months round the sheets' overlap; order 3 comes twice,
    one has no day, one no buyer; every third line comes twice."""
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    days = [dt.datetime(1998, 5, 20), dt.datetime(1998, 6, 5), dt.datetime(1998, 6, 9, 23, 59), dt.datetime(1998, 6, 10), dt.datetime(1998, 7, 1), None]
    put("nation", [(0, "N0"), (1, "N1")], "n_nationkey int, n_name string")
    put("customer", [(c, c % 2) for c in range(1, 8)], "c_custkey long, c_nationkey int")
    orders = [(k, k % 7 + 1, "P" if k % 2 else "F", days[k % 6]) for k in range(1, 61)]
    put("orders", orders + [orders[2], (99, None, "F", days[0])], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz")
    put("part", [(p, f"part {p}", 1.5 * p) for p in range(5)], "p_partkey long, p_name string, p_retailprice double")
    lines = [(k, (k + n) % 5, n, float(n), "RNA"[n % 3]) for k in range(1, 61) for n in range(1, 8)]
    put("lineitem", lines + lines[::3] + [(None, 1, 1, 1.0, "N")],
        "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string")
    return str(tmp_path)


def _rows(df):
    return sorted(map(repr, df.collect()))


def _small_parts(monkeypatch):
    monkeypatch.setattr(invoices, "LINES_A_TASK", 10, raising=False)
    monkeypatch.setattr(invoices, "LINES_A_FILE", 10, raising=False)
    monkeypatch.setattr(invoices, "BROADCAST_PARTS", 1, raising=False)


def test_large_inputs_keep_every_line(spark, tables, monkeypatch):
    """Hashed joins and lines dealt out in parts give the rows of the plain plan."""
    plain = _rows(invoices.tagged_sheets(spark, tables))
    _small_parts(monkeypatch)
    big = invoices.tagged_sheets(spark, tables)
    assert "ShuffledHashJoin" in big._jdf.queryExecution().executedPlan().toString()
    assert _rows(big) == plain
    raw = invoices.raw_lines(spark, tables)
    both = [_rows(invoices.sheet(raw, n).select("*")) for n in (1, 2)]
    assert len(plain) == sum(map(len, both)) and both[0] and both[1]


def test_duplicate_removal_groups_parts_of_a_fixed_size(spark, tables, monkeypatch):
    """Nothing is grouped before the rows are dealt out by all their columns."""
    plain = clean.dedupe_exact(invoices.sheets(spark, tables))
    report = clean.dedupe_report(invoices.sheets(spark, tables)).first()
    _small_parts(monkeypatch)
    raw = invoices.sheets(spark, tables)
    parts = invoices.line_parts(spark, tables)
    assert parts == 57  # 560 + 1 lines, 10 a part
    once = clean.dedupe_exact(raw, parts)
    plan = once._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange"):]
    assert f", {parts}), REPARTITION_BY_NUM" in below.splitlines()[0] and "HashAggregate" not in below
    assert _rows(once) == _rows(plain) and report["rows_removed"] > 0
    assert clean.dedupe_report(raw, parts).first() == report
    sales = lambda parts, clustered: _rows(clean.build_sales(raw, parts, clustered=clustered))
    assert sales(parts, False) == sales(None, False) == sales(invoices.month_parts(spark, tables), True)


def test_parts_of_months_follow_the_lines(spark, tables, monkeypatch):
    """A session with few shuffle partitions does not make the parts larger."""
    few = invoices.month_parts(spark, tables)
    _small_parts(monkeypatch)
    parts = invoices.month_parts(spark, tables)
    assert set(parts) == set(few) == {"1998-05", "1998-06", "1998-07"} and 50 <= sum(parts.values()) < 60
    laid = clean.dedupe_clustered(invoices.sheets(spark, tables), parts)
    assert laid.rdd.getNumPartitions() == 2 * sum(parts.values())
    assert laid.drop("invoice_month", "copies").count() == clean.dedupe_exact(invoices.sheets(spark, tables)).count()


def test_lines_of_an_invoice_stay_together_unless_it_is_hot(spark, tables, monkeypatch):
    """Ordinary invoices lie in one part; where an order may outgrow a file, its lines are dealt out. Rows stay the same."""
    from pyspark.sql import functions as F

    assert invoices.order_spread(spark, tables) == 1
    monkeypatch.setattr(invoices, "LINES_A_FILE", 4)
    spread = invoices.order_spread(spark, tables)
    assert spread >= 3  # 9 or 10 lines an order at most, and more in a shared bucket
    raw, parts = invoices.sheets(spark, tables), {"1998-05": 9, "1998-06": 9, "1998-07": 9}
    rows = lambda n: clean.dedupe_clustered(raw, parts, n)
    files = lambda n: rows(n).withColumn("p", F.spark_partition_id()).groupBy("invoice").agg(F.countDistinct("p").alias("n")).agg(F.max("n")).first()[0]
    assert files(1) == 1 and files(spread) > 1
    plain = _rows(clean.dedupe_clustered(raw, parts))
    assert _rows(rows(1)) == plain == _rows(rows(spread))


def test_parts_of_a_time_are_those_of_its_month(spark):
    """Split months by their number; other months, and no time, have one part."""
    parts = {"1997-12": 3, "1998-02": 5, "1998-03": 1, "2999-01": 1}
    times = [None, "1997-11-30", "1997-12-31 23:59:59", "1998-01-05", "1998-02-28", "1998-03-01", "2999-01-01", "0001-01-01"]
    df = spark.createDataFrame([(t,) for t in times], "t string").selectExpr("cast(t as timestamp_ntz) t")
    assert [r[0] for r in df.select(clean._parts_of(df.t, parts)).collect()] == [1, 1, 3, 1, 5, 1, 1, 1]
    assert [r[0] for r in df.select(clean._parts_of(df.t, {})).collect()] == [1] * 8
