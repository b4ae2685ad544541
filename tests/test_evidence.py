"""Typed cells, bindings, label-aware matching and conflicts on small answers."""

import pytest

from tillroll.operators import evidence as ev

CELLS = "question long, call long, row string, label_key string, column string, kind string, value double, flag boolean"
CLAIMS = (
    "claim_id string, attempt int, question long, call long, row string, column string, kind string, value double, flag boolean, unit string, "
    "calc string, inputs array<double>, input_cells array<struct<call:bigint,row:string,column:string>>, text string"
)


@pytest.fixture(scope="module")
def cells(spark):
    n = lambda call, row, key, col, v: (1, call, row, key, col, "number", v, None)
    rows = [
        n(10, "Germany", "country", "revenue", 120.0), n(10, "France", "country", "revenue", 100.0), n(10, "France", "country", "orders", 7.0),
        n(20, "2001-07", "invoice_month", "trading_days", 26.0), n(20, "2001-08", "invoice_month", "trading_days", 7.0),
        (1, 20, "2001-07", "invoice_month", "is_complete_month", "boolean", None, True), (1, 20, "2001-08", "invoice_month", "is_complete_month", "boolean", None, False),
        n(30, "18102", "customer_id", "orders", 145.0),
        (2, 40, "Germany", "country", "revenue", "number", 5.0, None),
    ]
    return spark.createDataFrame(rows, CELLS)


def claims(spark, rows):
    base = dict(attempt=1, question=1, call=10, row=None, column=None, kind="number", value=None, flag=None, unit="", calc="none", inputs=None, input_cells=None, text="")
    names = [x.strip().split(" ")[0] for x in CLAIMS.replace("struct<call:bigint,row:string,column:string>", "s").split(",")]
    data = [tuple((base | {"claim_id": f"c{i}"} | r)[n] for n in names) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, CLAIMS)


def status(spark, cells, *rows):
    got = {r.claim_id: (r.status, r.problem) for r in ev.claim_status(claims(spark, rows), cells).collect()}
    return [got[f"c{i}"] for i in range(len(rows))]


OK = ("supported", None)


def test_booleans_need_the_exact_boolean_cell(spark, cells):
    at = dict(call=20, row="2001-08", column="is_complete_month", text="august 2001")
    bad = ("unsupported", "boolean_cell")
    assert status(
        spark, cells,
        dict(at, kind="boolean", flag=False), dict(at, kind="boolean", flag=True), dict(at, kind="number", flag=False), dict(at, kind="number", value=0.0),
        dict(kind="boolean", flag=False, call=20), dict(at, kind="boolean", flag=False, row="2001-09"), dict(at, kind="boolean", flag=False, calc="sum", inputs=[0.0]),
    ) == [OK, bad, bad, ("unsupported", "cell_mismatch"), bad, bad, bad]


def test_cells_units_and_labels(spark, cells):
    rev = dict(row="Germany", column="revenue", value=120.0, unit="GBP", text="Germany made 120")
    assert status(
        spark, cells,
        rev, dict(rev, value=121.0), dict(rev, column="orders"), dict(rev, call=None), dict(rev, unit="USD"), dict(rev, text="made 120"),
        dict(value=100.0, unit="pounds", text="france 100"), dict(value=100.0, unit="USD", text="france 100"), dict(value=100.0, unit="GBP", text="100"),
        dict(value=7.0, call=None, text="France"), dict(value=7.0, call=10, text="France"), dict(value=26.0, call=20, unit="days"), dict(value=26.0, call=20, unit="orders"),
        dict(value=3.0), dict(value=None), dict(value=float("nan"), calc="sum", inputs=[1.0]),
    ) == [
        OK, *[("unsupported", "cell_mismatch")] * 3, ("unsupported", "money_unit"), ("unsupported", "missing_label"),
        OK, ("unsupported", "money_unit"), ("unsupported", "missing_label"),
        ("unsupported", "several_cells"), OK, OK, ("unsupported", "day_unit"),
        ("unsupported", "not_in_result"), ("unsupported", "no_value"), ("unsupported", "no_value"),
    ]


def test_calculations_and_their_input_cells(spark, cells):
    r = dict(calc="ratio", inputs=[100.0, 7.0], value=100 / 7)
    cell = lambda *c: dict(zip(("call", "row", "column"), c))
    good = [cell(10, "France", "revenue"), cell(10, "France", "orders")]
    assert status(
        spark, cells,
        r, dict(r, input_cells=good), dict(r, input_cells=good[::-1]), dict(r, input_cells=good[:1]), dict(r, input_cells=[]), dict(r, value=15.0),
        dict(r, inputs=[100.0, 8.0], value=12.5), dict(r, inputs=[100.0, 0.0]), dict(r, calc="root"), dict(r, inputs=[5.0, 7.0], value=5 / 7), dict(r, inputs=[], value=1.0),
    ) == [
        OK, OK, *[("unsupported", "input_cells")] * 3, ("flagged", "recalculated"),
        ("unsupported", "inputs_unbacked"), ("unsupported", "no_result"), ("unsupported", "no_result"), ("unsupported", "inputs_unbacked"), ("unsupported", "no_result"),
    ]


def test_binding_over_all_calls(spark, cells):
    rows = [
        dict(value=7.0, call=None), dict(value=145.0, call=None), dict(value=7.0, call=20), dict(value=5.0, call=None), dict(value=120.0, row="France", column="revenue"),
        dict(kind="boolean", flag=True, call=None), dict(value=1.0, call=None), dict(value=120.0, column="orders", call=None), dict(value=None, call=None),
    ]
    got = {r.claim_id: (r.binding, r.bound_call, r.bound_row, r.bound_column) for r in ev.claim_bind_unique(claims(spark, rows), cells).collect()}
    assert [got[f"c{i}"] for i in range(len(rows))] == [
        ("ambiguous", None, None, None), ("bound", 30, "18102", "orders"), ("bound", 20, "2001-08", "trading_days"), ("unbound", None, None, None),
        ("cited", 10, "France", "revenue"), ("bound", 20, "2001-07", "is_complete_month"), ("unbound", None, None, None), ("cited", None, None, "orders"), ("unbound", None, None, None),
    ]


def test_a_frequent_value_is_one_row_of_the_join(spark):
    """A value in a third of all cells and claims meets itself once a scope."""
    rows = [(1, 10, f"r{i}", "country", "orders", "number", 5.0 if i % 3 else float(i), None) for i in range(3000)]
    cells = spark.createDataFrame(rows, CELLS)
    many = claims(spark, [dict(value=5.0, call=None if i % 2 else 10) for i in range(2000)] + [dict(value=2997.0)])
    got = ev.claim_bind_unique(many, cells)
    counts = {(r.binding, r.candidates): r["count"] for r in got.groupBy("binding", "candidates").count().collect()}
    assert counts == {("ambiguous", 2000): 2000, ("bound", 1): 1}


def matched(spark, cells, *rows, question=1):
    got = ev.result_match_all(claims(spark, rows), cells).where(f"question = {question}").collect()
    return {r.attempt: (r.facts, r.missing) for r in got}


def test_labels_decide_which_fact_a_claim_states(spark, cells):
    fact = dict(question=2, call=40, unit="GBP", value=5.0)
    two = cells.unionByName(spark.createDataFrame([(2, 40, "France", "country", "revenue", "number", 6.0, None)], CELLS))
    for text, missing in [
        ("Germany 5", 1), ("revenue of GERMANY was 5", 1), ("Germany and France 5", 2), ("France 5", 2),
        ("Germanys 5", 1), ("", 1),  # no label: that of the one cell that holds 5
        ("5 orders in Germany", 2), ("Germany 5 %", 2),
    ]:
        assert matched(spark, two, dict(fact, text=text), question=2) == {1: (2, missing)}, text
    assert matched(spark, two, dict(fact, text="5", unit="orders"), question=2) == {1: (2, 2)}
    assert matched(spark, two, dict(fact, text="5", row="France", column="revenue"), question=2) == {1: (2, 2)}
    assert matched(spark, two, dict(fact, text="Germany 5", row="France", column="revenue"), question=2) == {1: (2, 1)}
    every = [dict(fact, text="Germany 5"), dict(fact, text="France 6", value=6.0), dict(fact, attempt=2, text="France 7", value=7.0)]
    assert matched(spark, two, *every, question=2) == {1: (2, 0), 2: (2, 2)}


def test_ids_and_months_in_every_spelling(spark, cells):
    assert matched(spark, cells, dict(call=None, value=145.0, unit="orders", text="Customer 18102: 145 orders"))[1] == (8, 7)
    assert matched(spark, cells, dict(call=None, value=145.0, unit="orders", text="18102.0 had 145"))[1] == (8, 7)
    assert matched(spark, cells, dict(call=None, value=145.0, unit="orders", text="customer 181024: 145"))[1] == (8, 7)  # no label: the bound cell
    for text, missing in [("Jul 2001: 26", 7), ("July 2001 and Aug 2001: 26", 8), ("2001-07", 7), ("2001-08", 8), ("julia 2001", 7)]:
        assert matched(spark, cells, dict(call=20, value=26.0, unit="days", text=text))[1] == (8, missing), text
    flag = dict(call=20, row="2001-08", column="is_complete_month", flag=False, text="August 2001")
    assert matched(spark, cells, dict(flag, kind="boolean"))[1] == (8, 7)
    assert matched(spark, cells, dict(flag, kind="number"))[1] == (8, 8)


def test_conflicts_by_visible_scope(spark, cells):
    rows = [
        dict(row="Germany", column="revenue", value=120.0, unit="GBP", text="Germany 120"),  # labelled breakdown
        dict(row="Germany", column="revenue", value=120.0, unit="GBP", text="revenue 120"),  # a second, unqualified total
        dict(row="Germany", column="revenue", value=130.0, unit="GBP", text="Germany 130"),
        dict(row="Germany", column="revenue", value=120.0, unit="orders", text="Germany 120"),
        dict(value=3.0, text="nothing"), dict(call=20, row="2001-08", column="is_complete_month", kind="boolean", flag=False),
    ]
    got = {r.claim_id: (r.scope, r.low, r.high, r.reason) for r in ev.claim_conflicting_total(claims(spark, rows), cells).collect()}
    assert got == {"c1": ("*", 100.0, 120.0, "value"), "c2": ("Germany", 120.0, 120.0, "value"), "c3": ("Germany", 120.0, 120.0, "measure")}


def test_only_measurements_become_cells(spark):
    wide = spark.createDataFrame(
        [(1, "a", 12345, 1, 2001, 5.0, True, "text", float("nan"), None)],
        "call int, row string, customer_id long, rank int, invoice_year int, revenue double, is_complete_month boolean, total string, share double, orders long",
    )
    got = [tuple(r) for r in ev.evidence_unpivot(wide, ["call", "row"]).collect()]
    assert sorted(got) == [(1, "a", "is_complete_month", "boolean", None, True), (1, "a", "revenue", "number", 5.0, None)]
    assert ev.evidence_unpivot(wide.select("call", "row", "rank"), ["call", "row"]).count() == 0


def test_units_of_every_measure(spark):
    from pyspark.sql import functions as F

    rows = [("revenue", "GBP"), ("revenue_per_day", "GBP"), ("revenue_share_pct", "%"), ("orders", "customers"), ("units", "units"), ("quantity", "orders"),
            ("trading_days", "days"), ("cancellation_rate", "GBP"), ("other", "GBP"), ("customers", None), ("revenue_per_day", "orders")]
    df = spark.createDataFrame(rows, "c string, u string")
    made = claims(spark, [dict(column=c, unit=u) for c, u in rows])
    got = {r.claim_id: (r.expected_unit, r.unit_ok) for r in ev.claim_unit_check(made).collect()}
    assert [got[f"c{i}"] for i in range(len(rows))] == [
        ("GBP", True), ("GBP per trading day", True), ("%", True), ("orders", False), ("units", True), ("units", False),
        ("days", True), ("%", False), ("", True), ("customers", True), ("GBP per trading day", False),
    ]
    assert df.select(ev.expected_unit(F.col("c")).alias("u")).count() == len(rows)


def test_empty_tables(spark, cells):
    none = claims(spark, [dict(value=1.0)]).limit(0)
    nothing = cells.limit(0)
    for fn in (ev.claim_status, ev.claim_bind_unique, ev.claim_inputs_backed, ev.claim_conflicting_total, ev.result_match_all, ev.claim_cited_cell):
        assert fn(none, cells).count() == 0 and fn(none, nothing).count() == 0, fn.__name__
    one = claims(spark, [dict(value=1.0)])
    assert [r.problem for r in ev.claim_status(one, nothing).collect()] == ["not_in_result"]
