"""Two forms of the same question must give the same numbers; dashboard
filters must narrow totals monotonically."""

import math

import __spark_entry__ as entry
from tillroll.operators import kpis
from tillroll.plans import params as P
from tillroll.sources.warehouse import warehouse

Q = entry.queries()


def test_cancellation_rate_two_forms(spark, sf_dir):
    rolled = {r.year: r.cancellation_rate for r in Q["kpi_cancellation_rate"](spark, sf_dir).collect()}
    sub = Q["kpi_cancellation_rate_subq"](spark, sf_dir).collect()[0].cancellation_rate
    assert math.isclose(rolled[P.YEAR], sub, rel_tol=1e-12)


def test_extremes_two_forms(spark, sf_dir):
    a = {r.invoice_month for r in Q["extreme_with_ties"](spark, sf_dir).collect()}
    b = {r.invoice_month for r in Q["join_scalar_subquery"](spark, sf_dir).collect()}
    assert a == b and len(a) >= 1


def test_month_pair_two_forms(spark, sf_dir):
    pivot = Q["month_change_per_day"](spark, sf_dir).collect()[0]
    pair = Q["join_single_row_pair"](spark, sf_dir).collect()[0]
    total = (pair.other_revenue - pair.base_revenue) / pair.base_revenue * 100.0
    assert math.isclose(pivot.total_pct, total, rel_tol=1e-12)


def test_year_revenue_from_facts_and_months(spark, sf_dir):
    checks = Q["reconcile_two_sources"](spark, sf_dir).collect()
    assert checks and all(r.ok for r in checks)


def test_dashboard_filters_narrow_totals(spark, sf_dir):
    wh = warehouse(spark, sf_dir)

    def revenue(**kw):
        return kpis.kpi_dashboard_metrics(kpis.dashboard_filter(wh.sales, wh.dim_month, **kw)).collect()[0]

    everything = revenue()
    year = revenue(year=P.YEAR)
    complete = revenue(year=P.YEAR, complete_only=True)
    market = revenue(year=P.YEAR, complete_only=True, market=P.COUNTRY_A)
    assert everything.lines >= year.lines >= complete.lines >= market.lines > 0
    assert everything.orders >= year.orders >= complete.orders >= market.orders


def test_units_population_excludes_write_offs(spark, sf_dir):
    units = {r.year: r.units for r in Q["kpi_units_sold"](spark, sf_dir).collect()}
    sales = warehouse(spark, sf_dir).sales
    naive = sales.filter("NOT is_cancellation").groupBy().sum("quantity").collect()[0][0]
    assert units[None] >= naive  # write-offs (negative, not cancelled) are excluded from units
