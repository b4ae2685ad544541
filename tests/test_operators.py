"""Operator tests on tiny in-memory frames: ties, NULLs, zero denominators,
empty filters, duplicates, tolerance rules, publish safety."""

import datetime as dt
import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.functions import text as tx
from tillroll.functions.money import pct, ratio
from tillroll.functions.tolerance import near_equal, near_join, near_matched
from tillroll.operators import analysis, clean, evidence, kpis, marts, mentions, quality, rankings, runs, textjobs
from tillroll.sources import files


def _sales(spark, rows):
    schema = (
        "invoice_no string, stock_code string, description string, quantity bigint, invoice_ts timestamp_ntz, "
        "unit_price decimal(12,2), customer_id bigint, country string"
    )
    df = spark.createDataFrame(rows, schema)
    return clean.derive_calendar(clean.derive_flags(clean.derive_revenue(df)))


TS = dt.datetime(2000, 3, 1, 10, 0)


def test_dedupe_collapses_identical_lines_and_nulls(spark):
    rows = [("1", "P1", None, 2, "a"), ("1", "P1", None, 2, "a"), ("1", "P1", "x", 2, "a")]
    df = spark.createDataFrame(rows, "invoice string, stock_code string, description string, quantity bigint, country string")
    assert clean.dedupe_exact(df).count() == 2
    rep = clean.dedupe_report(df).collect()[0]
    assert (rep.rows_before, rep.rows_after, rep.rows_removed) == (3, 2, 1)


def test_bad_debt_removed_cancellations_flagged(spark):
    s = _sales(spark, [("A9", "P20", "x", 1, TS, Decimal("1.00"), 1, "N"), ("C9", "P20", "x", -1, TS, Decimal("1.00"), 1, "N"),
                       ("9", "P3", "x", 1, TS, Decimal("1.00"), 1, "N")])
    kept = clean.drop_bad_debt(s, "invoice_no").orderBy("invoice_no").collect()
    assert [r.invoice_no for r in kept] == ["9", "C9"]
    assert [r.is_cancellation for r in kept] == [False, True]
    assert [r.is_product for r in kept] == [False, True]  # P3 is a non-product code


def test_mode_ties_go_to_smallest_text_and_skip_nulls(spark):
    s = _sales(spark, [
        ("1", "P20", "beta", 1, TS, Decimal("1.00"), 1, "N"),
        ("2", "P20", "alpha", 1, TS, Decimal("1.00"), 1, "N"),
        ("3", "P20", None, 1, TS, Decimal("1.00"), 1, "N"),
        ("4", "P20", None, 1, TS, Decimal("1.00"), 1, "N"),
    ])
    row = marts.dim_product(s).collect()[0]
    assert row.description == "alpha"


def test_dim_month_latest_month_is_incomplete(spark):
    s = _sales(spark, [("1", "P20", "a", 1, TS, Decimal("2.00"), 1, "N"),
                       ("C2", "P20", "a", -1, TS.replace(month=4), Decimal("2.00"), 1, "N")])
    rows = {r.invoice_month: r for r in marts.dim_month(s).collect()}
    assert rows["2000-03"].is_complete_month and not rows["2000-04"].is_complete_month
    assert rows["2000-04"].net_revenue is None  # only a cancellation that month
    assert rows["2000-04"].gross_revenue == Decimal("-2.00")


def test_extremes_keep_every_tie(spark):
    df = spark.createDataFrame([("a", 21), ("b", 24), ("c", 24)], "m string, days int")
    got = sorted(r.m for r in rankings.extreme_with_ties(df, "days").collect())
    assert got == ["b", "c"]


def test_zero_denominators_give_null(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    r = df.select(ratio("a", "b").alias("r"), pct("a", "b").alias("p")).collect()[0]
    assert r.r is None and r.p is None


def test_empty_dashboard_filter_gives_one_zero_row(spark):
    s = _sales(spark, [("1", "P20", "a", 1, TS, Decimal("2.00"), 1, "N")])
    f = kpis.dashboard_filter(s, marts.dim_month(s), year=1990)
    r = kpis.kpi_dashboard_metrics(f).collect()
    assert len(r) == 1 and r[0].revenue == 0.0 and r[0].orders == 0 and r[0].lines == 0


def test_near_equal_rules(spark):
    df = spark.createDataFrame(
        [(100.0, 100.01, True), (100.0, 100.02, False), (1e9, 1e9 + 900, True), (1e9, 1e9 + 1100, False),
         (float("nan"), float("nan"), False), (None, 1.0, False), (float("inf"), float("inf"), False)],
        "a double, b double, want boolean",
    )
    for r in df.select("want", near_equal("a", "b").alias("got")).collect():
        assert r.got == r.want


def test_near_join_equals_brute_force(spark):
    rnd = random.Random(7)
    base = [rnd.choice([0.0, 0.005, 1.0, 99.99, 12345.678, 1e7, -3.2]) for _ in range(60)]
    left = [(i, v + rnd.choice([0, 0.004, 0.02, -0.009, 5.0, v * 5e-7])) for i, v in enumerate(base)]
    right = [(j, rnd.choice(base)) for j in range(80)]
    L = spark.createDataFrame(left, "lid int, lv double")
    R = spark.createDataFrame(right, "rid int, rv double")
    got = {(r.lid, r.rid) for r in near_join(L, "lv", R, "rv").collect()}

    def ok(a, b):
        return abs(a - b) <= max(0.011, 1e-6 * max(abs(a), abs(b)))

    want = {(i, j) for i, a in left for j, b in right if ok(a, b)}
    assert got == want
    flags = {r.lid: r.matched for r in near_matched(L, "lv", R, "rv").collect()}
    assert flags == {i: any(ok(a, b) for _, b in right) for i, a in left}


def test_near_join_edges_equal_brute_force(spark):
    """Pairs at the tolerance edge, across zero and across the switch from the
    absolute to the relative regime (|v| = 11,000), and very large values."""
    rnd = random.Random(11)
    centres = [0.0, 0.006, -0.006, 10999.99, 11000.0, 11000.02, -11000.0, 2.5e4, 1e12, -7.5e9, 1e300]
    left, right = [], []
    for i in range(400):
        c = rnd.choice(centres)
        tol = max(0.011, 1e-6 * abs(c))
        left.append((i, c + tol * rnd.uniform(-2.2, 2.2)))
        right.append((i, c + tol * rnd.choice([-1.0, -0.999, 0.0, 0.5, 0.999, 1.0, 1.001, 2.01])))
    L = spark.createDataFrame(left, "lid int, lv double")
    R = spark.createDataFrame(right, "rid int, rv double")

    def ok(a, b):
        return abs(a - b) <= max(0.011, 1e-6 * max(abs(a), abs(b)))

    got = {(r.lid, r.rid) for r in near_join(L, "lv", R, "rv").collect()}
    want = {(i, j) for i, a in left for j, b in right if ok(a, b)}
    assert want and got == want
    flags = {r.lid: r.matched for r in near_matched(L, "lv", R, "rv").collect()}
    assert flags == {i: any(ok(a, b) for _, b in right) for i, a in left}


def test_running_share_matches_pandas_across_partitions(spark):
    rnd = random.Random(3)
    rows = [(f"k{i:03d}", Decimal(rnd.randint(1, 500)) / 4) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v decimal(12,2)")
    got = {r.k: (r.rank, float(r.cumulative)) for r in rankings.running_share(df, "v", "k", partitions=7).collect()}
    ordered = sorted(rows, key=lambda x: (-x[1], x[0]))
    total = 0
    for i, (k, v) in enumerate(ordered, 1):
        total += v
        assert got[k] == (i, float(total))


def test_exact_quantiles_match_numpy(spark):
    vals = [float(x) for x in np.random.default_rng(1).integers(0, 1000, 101)] + [5.5, 5.5]
    df = spark.createDataFrame([(i, Decimal(str(v))) for i, v in enumerate(vals)], "id int, v decimal(12,2)")
    got = {r.q: r.value for r in analysis.exact_quantiles(df, "v", [0.25, 0.5, 0.75]).collect()}
    for q in (0.25, 0.5, 0.75):
        assert math.isclose(got[q], float(np.percentile(vals, q * 100)), rel_tol=1e-12)


@pytest.mark.parametrize(("buckets", "fetched"), [(2, 1), (3, 5), (4096, 20000)])
def test_order_statistics_by_rounds(spark, buckets, fetched):
    draw = np.random.default_rng(4)
    sets = [
        [Decimal(int(x)).scaleb(-2) for x in draw.integers(-50, 50, 400)], [Decimal(str(10.0**k)).quantize(Decimal("0.01")) for k in range(-2, 14)] * 3,
        [Decimal("5.00")] * 50, [Decimal("99999999999999999999999.01"), Decimal("99999999999999999999999.02")] * 4, [None, Decimal("1.00"), None], [None],
    ]
    for vals in sets:
        df = spark.createDataFrame([(v,) for v in vals], "v decimal(38,2)")
        known = sorted(v for v in vals if v is not None)
        ranks = sorted({0, len(known) // 3, len(known) // 2, max(len(known) - 1, 0)})
        want = [known[r] if r < len(known) else None for r in ranks]
        assert rankings.order_statistics(df, "v", ranks, buckets, fetched) == want


def test_quantiles_do_not_sort_or_move_the_rows(spark, sf_dir):
    from tillroll.sources.warehouse import warehouse

    out = analysis.order_value_describe(warehouse(spark, sf_dir).sales)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "rangepartitioning" not in plan


def test_recompute_operations(spark):
    df = spark.createDataFrame(
        [("pct_change", [120.0, 100.0], 20.0), ("difference", [5.0, 2.0], 3.0), ("ratio", [1.0, 0.0], None),
         ("share", [40.0, 100.0], 40.0), ("sum", [1.25, 2.5], 3.75), ("mean", [1.0, 2.0], 1.5),
         ("median", [1.0], None), ("pct_change", [1.0], None), ("ratio", [1e308, 1e-308], None),
         ("difference", [float("inf"), 1.0], None)],
        "calc string, inputs array<double>, want double",
    )
    for r in df.select("want", evidence.recompute(F.col("calc"), F.col("inputs")).alias("got")).collect():
        assert (r.got is None and r.want is None) or math.isclose(r.got, r.want)


def test_best_attempt_keeps_earliest_on_ties(spark):
    df = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.5), (1, 12, 0.1), (2, 20, 0.2)], "q int, attempt int, s double")
    got = {r.q: r.attempt for r in rankings.best_per_group(df, "q", {"s": F.col("s")}, "attempt").collect()}
    assert got == {1: 10, 2: 20}


def test_number_spans_and_date_context(spark):
    texts = ["Revenue was 120, growth 12%, margin £9, forecast 1.2m in 2011.", "1,200 and −3 and 2.5e3 and 7 bn"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    spans = tx.number_spans(df, "id", "text").orderBy("id", "start").collect()
    assert [s.value for s in spans if s.id == 0] == [120.0, 12.0, 9.0, 1.2e6, 2011.0]
    assert [s.date_context for s in spans if s.id == 0] == [False, False, False, False, True]
    assert [s.value for s in spans if s.id == 1] == [1200.0, -3.0, 2500.0, 7e9]


def test_number_tokens_values(spark):
    text = "Revenue was 1,200, growth 12%, margin £9, forecast 1.2m in 2011-11-05."
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = [r.value for r in textjobs.number_tokens(df, "id", "text").orderBy("pos").collect()]
    assert got == [1200.0, 12.0, 9.0, 1.2e6, 2011.0, 11.0, 5.0]


def test_redaction_replaces_whole_spans(spark):
    docs = spark.createDataFrame([(1, "We sold 1,200 units [call 3] in 2011 and 12 more.")], "id int, text string")
    declared = spark.createDataFrame([(12.0,)], "value double")
    got = textjobs.redact_numbers(docs, "id", "text", declared, "value").collect()[0].text
    assert got == "We sold [unverified] units  in 2011 and 12 more."


def test_findings_text_matches_python_rules(spark):
    texts = ["  [CALL 2] customer_id 12345 bought 3 items [call 7]\u00a0\x1c", "customer_id: 5 stays", None,
             "[call [unverified]] from_call: 1 stays in findings"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.t for r in df.select("id", tx.findings_text(F.col("text")).alias("t")).collect()}
    assert got == {0: "Customer 12345 bought 3 items", 1: "customer_id: 5 stays", 2: None,
                   3: "[call [unverified]] from_call: 1 stays in findings"}


def test_unit_rules_strict_for_status_lenient_for_context(spark):
    df = spark.createDataFrame(
        [("revenue", "GBP"), ("revenue", "£"), ("net_revenue", None), ("trading_days", "Days"), ("trading_days", "days"),
         ("orders", "USD")], "c string, u string")
    got = df.select(evidence.unit_problem(F.col("c"), F.col("u")).alias("p"),
                    evidence.unit_ok(F.col("c"), F.col("u")).alias("ok")).collect()
    assert [r.p for r in got] == [None, "money_unit", "money_unit", "day_unit", None, None]
    assert [r.ok for r in got] == [True, True, False, True, True, True]


def test_routing_rules(spark):
    qs = spark.createDataFrame(
        [(1, "What was our profit margin in 2011?"), (2, "What will our revenue be next quarter?"),
         (3, "How did August 2001 compare with July 2001?"), (4, "What was our total revenue in 2011?"),
         (5, "Tell me something nice")],
        "id int, text string",
    )
    got = {r.id: r.route for r in textjobs.route_questions(qs, ["id"], "text").collect()}
    assert got == {1: "data_gap", 2: "forecast", 3: "incomplete_month", 4: "known_pattern", 5: "free"}


def test_metric_kind(spark):
    labels = spark.createDataFrame([("uk_pct",), ("net_revenue",), ("revenue per day",), ("trading_days",),
                                    ("orders",), ("units",), ("customers",), ("stock_code",)], "l string")
    got = [r.kind for r in textjobs.metric_kinds(labels, "l").collect()]
    assert got == ["percentage", "money", "money_per_day", "days", "orders", "units", "customers", None]


def test_country_mentions_included_and_excluded(spark):
    texts = spark.createDataFrame([(1, "Which country outside the United Kingdom beat France?")], "id int, text string")
    countries = spark.createDataFrame([("United Kingdom",), ("France",), ("Germany",)], "country string")
    r = mentions.country_mentions(texts, "id", "text", countries, "country").collect()[0]
    assert r.included == ["France"] and r.excluded == ["United Kingdom"]


def test_failed_publish_keeps_previous_output(spark, tmp_path):
    target = str(tmp_path / "pub")
    good = spark.createDataFrame([(1,)], "x int")
    ok = lambda t: t["t"].agg((F.count(F.lit(1)) > 0).alias("ok"))
    v1, _ = files.validated_publish(spark, {"t": good}, target, ok)
    bad = spark.createDataFrame([], "x int")
    with pytest.raises(files.PublishError):
        files.validated_publish(spark, {"t": bad}, target, ok)
    assert files.latest_version(spark, target) == v1
    assert spark.read.parquet(f"{target}/version={v1}/t").count() == 1


def test_bounded_result_raises_over_cap(spark):
    df = spark.range(60)
    with pytest.raises(quality.ResultTooLarge):
        quality.bounded_result(df, 50)
    assert quality.bounded_result(spark.range(50), 50).count() == 50


def test_join_grain_check_detects_duplicate_keys(spark):
    left = spark.createDataFrame([("2000-01",), ("2000-02",)], "invoice_month string")
    right = spark.createDataFrame([("2000-01", 1), ("2000-01", 2)], "invoice_month string, d int")
    got = {r.check: r.value for r in quality.join_grain_check(left, right, "invoice_month").collect()}
    assert got == {"duplicate_right_keys": 1, "unmatched_left_rows": 1, "rows_before": 2, "rows_after": 2}


def test_run_summary_has_all_and_route_rows(spark):
    df = spark.createDataFrame(
        [(1, "en", "a", True, 1.0, None, 2, 1, 2, 2, 0, None, 1.0, 0, Decimal("1.000"), Decimal("0"))],
        "case_id int, tier string, route string, answerable boolean, correct double, refusal_correct double, "
        "queries int, sql_successes int, displayed_claims int, displayed_supported int, displayed_unsupported int, "
        "chart_correct double, tool_selection_correct double, retries int, seconds decimal(10,3), api_cost_usd decimal(10,4)",
    )
    got = {r.route: r for r in runs.run_summary(df).collect()}
    assert set(got) == {"all", "a"}
    assert got["all"].accuracy == 1.0 and got["all"].queries_ok == 0.5 and got["all"].chart_correct is None


def test_requested_periods(spark):
    texts = ["Compare March to April 2011", "march sales", None, "How did 2011-10 do vs November 2011?"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.periods for r in textjobs.requested_periods(df, "id", "text").collect()}
    assert got == {0: ["2011-03", "2011-04"], 1: [], 2: [], 3: ["2011-10", "2011-11"]}


def test_running_share_zero_total_gives_null_share(spark):
    df = spark.createDataFrame([("a", Decimal("1.00")), ("b", Decimal("-1.00"))], "k string, v decimal(12,2)")
    got = {r.k: (r.rank, r.cumulative, r.cumulative_share) for r in rankings.running_share(df, "v", "k").collect()}
    assert got == {"a": (1, Decimal("1.00"), None), "b": (2, Decimal("0.00"), None)}


def test_labels_and_row_numbers_tolerate_text_without_digits(spark):
    ids = spark.createDataFrame([("18102",), ("18102.0",), ("P558",), ("1e300",)], "c string")
    got = [r.label for r in textjobs.id_labels(ids, "c", "customer_id").collect()]
    assert got == ["18102", "18102", "P558", "1e300"]
    rows = spark.createDataFrame([("NATION_7",), ("United Kingdom",)], "row string")
    assert [r.k for r in rows.select(evidence._row_number(F.col("row")).alias("k")).collect()] == [7, None]


def test_sums_keep_small_inputs(spark):
    df = spark.createDataFrame([("sum", [0.004] * 10, 0.04), ("sum", [0.004] * 100, 0.4), ("mean", [0.004] * 10, 0.004)], "calc string, inputs array<double>, want double")
    for r in df.select("want", evidence.recompute(F.col("calc"), F.col("inputs")).alias("got")).collect():
        assert abs(r.got - r.want) < 1e-12


def test_running_share_does_not_depend_on_the_plan(spark):
    df = spark.range(40000).select((F.col("id") * 7919 % 40009).cast("decimal(12,0)").alias("v"), F.col("id").cast("string").alias("k"), F.lit("x").alias("extra"))
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        try:
            out = rankings.running_share(df, "v", "k", partitions=7).agg(
                F.countDistinct("rank").alias("n"), F.max("rank").alias("last"), F.max("cumulative").alias("top"), F.sum("v").alias("total")).first()
        finally:
            spark.conf.unset("spark.sql.exchange.reuse")
        assert (out.n, out.last) == (40000, 40000) and out.top == out.total


def test_csv_is_read_by_name_and_keeps_line_breaks(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    rows = [("a\nb", 1.5), ('say "hi", you', 2.0), (None, None)]
    files.export_csv(spark.createDataFrame(rows, "name string, v double").select("v", "name"), path)
    schema = spark.createDataFrame([], "name string, v double").schema
    got = {(r.name, r.v) for r in files.import_csv_checked(spark, path, schema, ["name", "v"]).collect()}
    assert got == set(rows)
    with pytest.raises(Exception):
        files.export_csv(spark.range(3).select(F.raise_error(F.lit("no")).alias("v")), path)
    assert files.import_csv_checked(spark, path, schema, ["name"]).count() == 3


def test_long_ids_are_not_rounded(spark):
    df = spark.createDataFrame([(9007199254740993,)], "id long")
    assert textjobs.id_labels(df, "id", "k").first().label == "9007199254740993"


def test_input_that_only_spark_lists_has_no_stamp():
    from tillroll.sources import warehouse

    assert warehouse._local_fingerprint("/no/such/folder") is None


def test_modal_label_ties_and_nulls(spark):
    rows = [("a", "x", 1), ("a", "y", 2), ("a", None, 4), ("a", None, 8), ("b", None, 3), ("c", "z", None), ("c", "w", 1), ("c", "z", 2)]
    df = spark.createDataFrame(rows, "k string, label string, v bigint")
    got = rankings.totals_with_modal_label(df, "k", "label", {"v": F.col("v")})
    assert sorted(tuple(r) for r in got.collect()) == [("a", "x", 15), ("b", None, 3), ("c", "z", 3)]


def test_each_order_has_its_nearest_cancellation(spark):
    rows = [
        ("o1", "p", 5, "2000-01-01 10:00:00", False),
        ("o2", "p", 5, "2000-01-28 10:00:00", False),
        ("o3", "p", 5, "2000-03-30 10:00:00", False),  # its cancellation is too late
        ("c1", "p", -5, "2000-01-01 10:00:00", True),  # at the same time
        ("c2", "p", -5, "2000-02-02 10:00:00", True),  # in the next bucket
        ("c0", "p", -5, "2000-02-02 10:00:00", True),
        ("c4", "p", -5, "2000-04-29 10:00:01", True),
        ("c5", "q", -5, "2000-01-02 10:00:00", True),
    ]
    df = spark.createDataFrame(rows, "invoice_no string, stock_code string, quantity bigint, ts string, is_cancellation boolean")
    df = df.withColumn("invoice_ts", F.to_timestamp_ntz("ts")).withColumn("invoice_date", F.to_date("ts"))
    got = analysis.outlier_cancel_pairs(df, 30).select("order_invoice", "cancel_invoice").collect()
    assert sorted(map(tuple, got)) == [("o1", "c1"), ("o2", "c0")]


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_cancellations_are_carried_over_ranges(spark, partitions):
    """One code holds most lines, so its orders and cancellations lie in many ranges."""
    import datetime as dt

    draw = np.random.default_rng(8)
    day = lambda n: dt.datetime(2000, 1, 1) + dt.timedelta(days=int(n))
    rows = []
    for i in range(1500):
        code, qty, cancel = ("HOT", 3) if i % 3 else (f"P{draw.integers(0, 40)}", int(draw.integers(1, 4))), None, bool(draw.random() < 0.04)
        (code, qty) = code
        rows.append((("C" if cancel else "") + str(i), code, -qty if cancel else qty, day(draw.integers(0, 700)), cancel))
    df = spark.createDataFrame(rows, "invoice_no string, stock_code string, quantity long, invoice_ts timestamp_ntz, is_cancellation boolean")
    got = sorted((r.order_invoice, r.cancel_invoice, r.days_apart) for r in analysis.outlier_cancel_pairs(df, 30, partitions).collect())
    want = []
    for no, code, qty, ts, cancel in rows:
        if not cancel:
            near = min(((t, c) for c, k, q, t, x in rows if x and k == code and q == -qty and dt.timedelta(0) <= t - ts <= dt.timedelta(days=30)), default=None)
            if near:
                want.append((no, near[1], (near[0] - ts).days))
    assert got == sorted(want)


@pytest.mark.parametrize(("buckets", "fetched"), [(2, 1), (3, 5), (4096, 20000)])
def test_rows_within_a_share(spark, buckets, fetched):
    draw = np.random.default_rng(6)
    sets = [
        [int(x) for x in draw.integers(0, 60, 300)], [5] * 40, [0] * 7, [], [10**k for k in range(12)] * 2 + [0] * 5, [None, 3, 1],
    ]
    for vals in sets:
        df = spark.createDataFrame([(None if v is None else Decimal(v),) for v in vals], "v decimal(20,2)")
        known = sorted((v for v in vals if v is not None), reverse=True)
        for share in (0.0, 0.5, 0.8, 1.0):
            run, count = 0, 0
            for v in known:
                run += v
                count += bool(sum(known)) and run / sum(known) <= share
            assert rankings.rows_within_share(df, "v", share, buckets, fetched) == (len(known), count), (vals[:5], share)
