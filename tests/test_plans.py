"""Physical-plan properties: no cartesian products or nested-loop joins,
partition pruning and column pruning on the published fact table."""

import contextlib
import io

import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()
# Queries whose work includes a file write at plan-construction time are skipped.
WRITES = {"export_csv", "import_csv_checked", "export_json", "import_json", "validated_publish", "publish_versioned"}


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_no_cartesian_or_nested_loop(spark, sf_dir, name):
    text = plan_text(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text, name
    assert "BroadcastNestedLoopJoin" not in text, name


def test_year_filter_prunes_month_partitions_and_columns(spark, sf_dir):
    text = plan_text(QUERIES["country_year_revenue"](spark, sf_dir))
    assert "PartitionFilters: [isnotnull(invoice_month" in text and "StartsWith(invoice_month" in text
    read = [line for line in text.splitlines() if line.startswith("ReadSchema:")]
    assert read and all("description" not in r and "unit_price" not in r for r in read)


def test_dashboard_month_join_is_broadcast(spark, sf_dir):
    df = QUERIES["kpi_dashboard_metrics"](spark, sf_dir)
    df.collect()
    text = plan_text(df)
    assert "BroadcastHashJoin" in text


def test_cleaning_has_one_exchange_after_the_joins(spark, sf_dir):
    """The layout of the month folders neither samples nor shuffles twice."""
    from tillroll.operators import clean
    from tillroll.sources import invoices

    raw = invoices.sheets(spark, sf_dir)
    laid = clean.dedupe_clustered(raw, invoices.month_parts(spark, sf_dir))
    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    plan = laid._jdf.queryExecution().executedPlan().toString()
    assert count(laid) == count(raw) + 1 and "rangepartitioning" not in plan


def test_layout_bounds_the_files_of_a_month(spark, sf_dir, tmp_path):
    from tillroll.operators import clean
    from tillroll.sources import invoices

    parts = invoices.month_parts(spark, sf_dir, 400)
    assert 400 <= sum(parts.values()) <= 400 + len(parts)
    raw = invoices.sheets(spark, sf_dir)
    clean.dedupe_clustered(raw, parts).write.partitionBy("invoice_month").parquet(str(tmp_path / "t"))
    months = {d.name.split("=")[1]: len(list(d.glob("*.parquet"))) for d in (tmp_path / "t").glob("invoice_month=*")}
    assert months and all(n <= parts[m] for m, n in months.items())
    assert spark.read.parquet(str(tmp_path / "t")).count() == clean.dedupe_exact(raw).count()
