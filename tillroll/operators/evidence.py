"""Evidence checks as batch jobs over two tables.

``evidence(question, call, row, label_key, column, kind, value, flag)`` holds
every measured cell of the query results behind an answer, in long form. Cells
are typed: numbers in ``value``, booleans in ``flag``. Identifiers, ranks and
calendar columns are no measurements and are left out. A question has one or
more results (``call``); ``row`` is the label of a result's row and
``label_key`` says what it names (country, month, customer).

``claims`` holds what an answer states: a typed value, the cell it cites
(``call``, ``row``, ``column``; each may be missing) or the calculation
(``calc``, ``inputs`` and perhaps ``input_cells``) that produced it, a unit and
a text. Every check is a join or aggregate over those tables. Tolerance
matching uses the bucketed near-equality join on distinct values, never a
pairwise comparison inside a group, and labels in texts are found by a join on
words.

The test data has no answer log. ``evidence_from_sales`` measures, per
reporting year (the question), each country's revenue, orders, customers and
average order value, the months of that year, and for the partial month each
customer's revenue and orders. ``claims_from_evidence`` restates them twice:
attempt 1 copies every cell, attempt 2 changes every third. Some claims carry a
wrong unit, no label or a second label, no coordinates, no call, wrong
coordinates, wrong input cells, or a number where a boolean belongs (see
FIXTURES.md).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.money import dbl, ratio
from ..functions.tolerance import is_finite, near_equal, near_join, near_matched
from .mentions import phrase_mentions

# Columns that carry a unit rule, that are no measurements, and
# words of a measurement's name.
MONEY_COLUMNS = ("revenue", "net_revenue", "aov")
DAY_UNITS = ("days", "trading days")
COUNT_UNITS = {"trading_days": "days", "orders": "orders", "customers": "customers", "units": "units", "quantity": "units"}
NOT_MEASURED = ("customer_id", "stock_code", "invoice_no", "year", "month", "invoice_year", "rank", "row_number")
MEASURED_PATTERN = (
    "revenue|orders?|invoices?|customers?|units?|quantity|trading_days|aov|share|percentage|pct|rate|total|count|amount|value|is_complete_month"
)
PERCENT_PATTERN = "pct|percent|cancellation_rate"
DAILY_PATTERN = "per_?(?:trading_?)?day|daily"
CUSTOMER_PREFIX = r"(?i)\bcustomer(?:_id)?\s+\d+\s*[:;,.]?"
CALCS = ("pct_change", "difference", "ratio", "share", "sum", "mean")
COLUMN_INDEX = {"revenue": 0, "orders": 1, "customers": 2, "aov": 3, "trading_days": 4, "net_revenue": 5, "is_complete_month": 6}
MONTH_CALL = 10_000  # the call of a year's months is 10,000 + the year
CELL = "struct<call:bigint,row:string,column:string>"


# ---- building the two tables ---------------------------------------------------------

def results_wide(sales: DataFrame) -> DataFrame:
    """Each country's result of a year, with its rank and year beside the measures."""
    per = sales.filter(~F.col("is_cancellation")).groupBy(
        F.year("invoice_date").cast("bigint").alias("call"), F.col("country").alias("row")
    ).agg(
        F.sum("revenue").alias("rev"),
        F.countDistinct("invoice_no").alias("orders"),
        F.countDistinct("customer_id").alias("customers"),
    )
    return per.select(
        "call",
        "row",
        F.col("call").alias("invoice_year"),
        dbl("rev").alias("revenue"),
        dbl("orders").alias("orders"),
        dbl("customers").alias("customers"),
        ratio("rev", "orders").alias("aov"),
    )


def months_wide(dim_month: DataFrame) -> DataFrame:
    """The months of a year: a count, money and a boolean."""
    year = F.substring("invoice_month", 1, 4).cast("bigint")
    return dim_month.select(
        (F.lit(MONTH_CALL) + year).cast("bigint").alias("call"), F.col("invoice_month").alias("row"),
        F.substring("invoice_month", 6, 2).cast("int").alias("month"),
        dbl("trading_days").alias("trading_days"), dbl("net_revenue").alias("net_revenue"), "is_complete_month",
    )


def customers_wide(sales: DataFrame, month: str) -> DataFrame:
    """Each customer's result of one month; the number of a customer is no measure."""
    lines = sales.filter(~F.col("is_cancellation") & F.col("customer_id").isNotNull() & (F.col("invoice_month") == month))
    per = lines.groupBy("customer_id").agg(dbl(F.sum("revenue")).alias("revenue"), dbl(F.countDistinct("invoice_no")).alias("orders"))
    return per.select(F.lit(int(month.replace("-", ""))).cast("bigint").alias("call"), F.col("customer_id").cast("string").alias("row"), "customer_id", "revenue", "orders")


def evidence_unpivot(wide: DataFrame, id_cols: list[str]) -> DataFrame:
    """Wide results -> one typed row per measured cell (column, kind, value, flag).

    Numbers and booleans whose column is named like a measurement count;
    identifiers, ranks and calendar columns do not. NULL and non-finite cells
    are dropped (nothing to cite)."""
    import re

    cells = []
    for name, kind in wide.dtypes:
        if name in id_cols or name in NOT_MEASURED or not re.search(MEASURED_PATTERN, name):
            continue
        number = kind.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
        if not number and kind != "boolean":
            continue
        cells.append(F.struct(
            F.lit(name).alias("column"), F.lit("number" if number else "boolean").alias("kind"),
            (F.col(name).cast("double") if number else F.lit(None).cast("double")).alias("value"),
            (F.lit(None).cast("boolean") if number else F.col(name)).alias("flag"),
        ))
    if not cells:
        cells = [F.lit(None).cast("struct<column:string,kind:string,value:double,flag:boolean>")]
    long = wide.select(*id_cols, F.inline(F.array(*cells)))
    return long.filter(is_finite("value") | F.col("flag").isNotNull())


def evidence_from_sales(sales: DataFrame, dim_month: DataFrame, month: str) -> DataFrame:
    keys = ["call", "row"]
    parts = [
        (evidence_unpivot(results_wide(sales), keys), F.col("call"), "country"),
        (evidence_unpivot(months_wide(dim_month), keys), F.col("call") - MONTH_CALL, "invoice_month"),
        (evidence_unpivot(customers_wide(sales, month), keys), F.lit(int(month[:4])).cast("bigint"), "customer_id"),
    ]
    out = None
    for cells, question, key in parts:
        cells = cells.select(question.cast("bigint").alias("question"), "call", "row", F.lit(key).alias("label_key"), "column", "kind", "value", "flag")
        out = cells if out is None else out.unionByName(cells)
    return out


def _row_number(row: Column) -> Column:
    """The number at the end of a row label; NULL when it has none."""
    return F.regexp_extract(row, r"([0-9]+)$", 1).try_cast("bigint")


def label_forms(key: Column, row: Column) -> Column:
    """The ways a label is written, lower-cased: ids with and without a decimal
    zero, months as ``YYYY-MM``, 'july 2001' and 'jul 2001'."""
    low = F.lower(F.trim(row))
    month = F.concat(low, F.lit("-01")).try_cast("date")
    as_id = F.when(low.rlike(r"^-?[0-9]+(\.0+)?$"), F.regexp_replace(low, r"\.0+$", ""))
    return F.array_distinct(F.array_compact(F.array(
        low,
        F.when(key.isin("customer_id", "stock_code", "invoice_no"), as_id),
        F.when(key.isin("customer_id", "stock_code", "invoice_no"), F.concat(as_id, F.lit(".0"))),
        F.when((key == "invoice_month") & low.rlike(r"^[0-9]{4}-[0-9]{2}$"), F.lower(F.date_format(month, "MMMM yyyy"))),
        F.when((key == "invoice_month") & low.rlike(r"^[0-9]{4}-[0-9]{2}$"), F.lower(F.date_format(month, "MMM yyyy"))),
    )))


def claims_from_evidence(evidence: DataFrame) -> DataFrame:
    """Two attempts at each question; which cell gets which fault follows from the
    numbers k (end of the row label) and i (index of the column)."""
    k = _row_number(F.col("row"))
    i = F.coalesce(*[F.when(F.col("column") == c, F.lit(n)) for c, n in COLUMN_INDEX.items()])
    cells = evidence.withColumns({"k": k, "s": k + i, "x": (F.col("question") + k + i) % 3 == 0})
    cells = cells.withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2))))
    changed = (F.col("attempt") == 2) & F.col("x")
    said = F.when(changed, ~F.col("flag")).otherwise(F.col("flag"))
    as_number = (F.col("kind") == "boolean") & (F.col("k") % 5 == 0)
    value = F.when(as_number, said.cast("double")).otherwise(F.when(changed, F.col("value") * F.lit(1.001)).otherwise(F.col("value")))
    spoilt = F.col("s") % 5 == 0
    unit = (
        F.when(F.col("column").isin(*MONEY_COLUMNS), F.when(spoilt, "USD").otherwise("GBP"))
        .when(F.col("column") == "trading_days", F.when(spoilt, "orders").otherwise("days"))
        .when(F.col("column") == "is_complete_month", F.lit(""))
        .otherwise(F.col("column"))
    )
    name = F.translate("column", "_", " ")
    label = (
        F.when(F.col("label_key") == "customer_id", F.concat(F.lit("customer "), F.col("row")))
        .when((F.col("label_key") == "invoice_month") & (F.col("k") % 2 == 0), F.element_at(label_forms(F.lit("invoice_month"), F.col("row")), 2))
        .otherwise(F.lower("row"))
    )
    text = (
        F.when(F.col("s") % 7 == 0, F.concat(name, F.lit(" was")))
        .when(F.col("s") % 11 == 3, F.concat(F.lit("like nation_1, "), label, F.lit(" "), name))
        .otherwise(F.concat(label, F.lit(" "), name))
    )
    bare, lost, wrong = F.col("s") % 11 == 1, F.col("s") % 11 == 2, F.col("s") % 11 == 4
    cid = F.concat_ws(":", F.col("attempt").cast("string"), F.col("call").cast("string"), "row", "column")
    cell_claims = cells.select(
        cid.alias("claim_id"), "attempt", "question",
        F.when(~lost, F.col("call")).alias("call"),
        F.when(~bare & ~lost, F.col("row")).alias("row"),
        F.when(wrong, F.lit("orders")).when(~bare & ~lost, F.col("column")).alias("column"),
        F.when(as_number, "number").otherwise(F.col("kind")).alias("kind"), value.alias("value"), F.when(~as_number, said).alias("flag"), unit.alias("unit"),
        F.lit("none").alias("calc"), F.lit(None).cast("array<double>").alias("inputs"), F.lit(None).cast(f"array<{CELL}>").alias("input_cells"), text.alias("text"),
    )

    countries = evidence.filter(F.col("label_key") == "country")
    wide = countries.groupBy("question", "call", "row").agg(
        F.max(F.when(F.col("column") == "revenue", F.col("value"))).alias("revenue"),
        F.max(F.when(F.col("column") == "orders", F.col("value"))).alias("orders"),
    ).filter(F.col("orders") > 0)
    kk = _row_number(F.col("row"))
    cell = lambda c: F.struct("call", "row", F.lit(c).alias("column"))
    refs = (
        F.when(kk % 4 == 1, F.array(cell("revenue"), cell("orders")))
        .when(kk % 4 == 2, F.array(cell("orders"), cell("revenue")))
        .when(kk % 4 == 3, F.array(cell("revenue")))
    )
    ratio_base = wide.select(
        "question", "call", "row", F.array("revenue", "orders").alias("inputs"), refs.alias("input_cells"),
        (F.col("revenue") / F.col("orders")).alias("value"), ((F.col("question") + kk) % 3 == 0).alias("_x"),
    )
    ratio_claims = ratio_base.withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.concat_ws(":", F.col("attempt").cast("string"), F.col("call").cast("string"), "row", F.lit("aov_calc")).alias("claim_id"),
        "attempt", "question", "call", F.lit(None).cast("string").alias("row"), F.lit(None).cast("string").alias("column"), F.lit("number").alias("kind"),
        F.when((F.col("attempt") == 2) & F.col("_x"), F.col("value") * F.lit(1.001)).otherwise(F.col("value")).alias("value"),
        F.lit(None).cast("boolean").alias("flag"), F.lit("GBP").alias("unit"), F.lit("ratio").alias("calc"), "inputs", "input_cells", F.lower("row").alias("text"),
    )

    # One stated total per question; its inputs list is bounded by the number of rows
    # (countries) in one result, not by the data size.
    totals = countries.filter(F.col("column") == "revenue").groupBy("question", "call").agg(
        F.array_sort(F.collect_list("value")).alias("inputs"),
        dbl(F.sum(F.col("value").cast("decimal(38,2)"))).alias("value"),
    )
    total_claims = totals.withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.concat_ws(":", F.col("attempt").cast("string"), F.col("call").cast("string"), F.lit("*"), F.lit("revenue_total")).alias("claim_id"),
        "attempt", "question", "call", F.lit(None).cast("string").alias("row"), F.lit(None).cast("string").alias("column"), F.lit("number").alias("kind"),
        F.when((F.col("attempt") == 2) & (F.col("question") % 2 == 0), F.col("value") * F.lit(1.001)).otherwise(F.col("value")).alias("value"),
        F.lit(None).cast("boolean").alias("flag"), F.lit("GBP").alias("unit"), F.lit("sum").alias("calc"), "inputs",
        F.lit(None).cast(f"array<{CELL}>").alias("input_cells"), F.lit("total revenue").alias("text"),
    )
    return cell_claims.unionByName(ratio_claims).unionByName(total_claims)


# ---- arithmetic ----------------------------------------------------------------------

def recompute(calc: Column, inputs: Column) -> Column:
    """Redo the arithmetic of a calculation claim; NULL for an unknown
    operation, invalid inputs or a non-finite result. Inputs are added as DOUBLE
    in the order of the array, unrounded."""
    x0, x1 = F.element_at(inputs, 1), F.element_at(inputs, 2)
    two = F.size(inputs) == 2
    nz = two & (x1 != 0)
    total = F.aggregate(inputs, F.lit(0.0), lambda acc, x: acc + x)
    some = F.size(inputs) >= 1
    raw = (
        F.when((calc == "pct_change") & nz, (x0 - x1) / x1 * F.lit(100.0))
        .when((calc.isin("difference", "diff")) & two, x0 - x1)
        .when((calc == "ratio") & nz, x0 / x1)
        .when((calc == "share") & nz, x0 / x1 * F.lit(100.0))
        .when((calc == "sum") & some, total)
        .when((calc == "mean") & some, total / F.size(inputs).cast("double"))
    )
    return F.when(is_finite(raw), raw)


def claim_recompute(claims: DataFrame) -> DataFrame:
    c = claims.filter(F.col("calc") != "none")
    expected = recompute(F.col("calc"), F.col("inputs"))
    return c.select(
        "claim_id", "calc", "value", expected.alias("expected"),
        (expected.isNotNull() & ~near_equal("value", expected)).alias("flagged"),
    )


def claim_totals(claims: DataFrame) -> DataFrame:
    """Stated sums against their own inputs. A sum whose inputs cannot be
    added (no result) is not reported as a disagreement."""
    s = claims.filter(F.col("calc") == "sum")
    expected = recompute(F.col("calc"), F.col("inputs"))
    ok = expected.isNull() | near_equal("value", expected)
    return s.select("claim_id", "value", expected.alias("expected"), ok.alias("ok"))


# ---- cells ---------------------------------------------------------------------------

def _cells(evidence: DataFrame) -> DataFrame:
    return evidence.select(
        "call", "row", "column", F.col("kind").alias("cell_kind"), F.col("value").alias("cell_value"), F.col("flag").alias("cell_flag"), F.col("label_key").alias("cell_key")
    )


def same_value(value: Column, flag: Column, other: Column, other_flag: Column) -> Column:
    """Typed equality: booleans only equal booleans, numbers within tolerance."""
    return F.when(flag.isNotNull() | other_flag.isNotNull(), F.coalesce(flag == other_flag, F.lit(False))).otherwise(near_equal(value, other))


def claim_cited_cell(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """The typed cell at the cited (call, row, column) equals the claim."""
    c = claims.filter(F.col("calc") == "none").select("claim_id", "call", "row", "column", "value", "flag")
    j = c.join(_cells(evidence), ["call", "row", "column"], "left")
    return j.select(
        "claim_id", "value", "flag", "cell_value", "cell_flag", F.col("cell_kind").isNotNull().alias("found"),
        same_value(F.col("value"), F.col("flag"), F.col("cell_value"), F.col("cell_flag")).alias("matches"),
    )


def claim_near_equal(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    return claim_cited_cell(claims, evidence).filter("found AND cell_value IS NOT NULL AND value IS NOT NULL").select(
        "claim_id", "value", "cell_value", F.col("matches").alias("near_equal")
    )


def claim_bind_unique(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Bind each copied value without coordinates to the one cell holding it, of
    its call or, where none is cited, of all calls of its question: ``bound``
    (one cell), ``ambiguous`` (several) or ``unbound`` (none). Coordinates that a
    claim states are kept as they are, right or wrong (``cited``).

    Both sides are reduced to the distinct typed values of each scope before they
    meet: a value that a third of all cells or claims hold is one row there, and
    the counts are joined back on the exact value, which Spark can split. The
    scope of a cell is its call and its question, so no claim meets a call of
    another question."""
    number = F.coalesce("value", F.col("flag").cast("double"))
    c = claims.filter(F.col("calc") == "none")
    stated = F.col("row").isNotNull() | F.col("column").isNotNull()
    scope = F.concat(F.when(F.col("flag").isNotNull(), "b").otherwise("n"), F.when(F.col("call").isNotNull(), "c").otherwise("q"), F.coalesce("call", "question").cast("string"))
    open_ = c.filter(~stated).select("claim_id", scope.alias("scope"), number.alias("number"))
    kind = F.when(F.col("kind") == "boolean", "b").otherwise("n")
    scopes = F.array(F.concat(kind, F.lit("c"), F.col("call").cast("string")), F.concat(kind, F.lit("q"), F.col("question").cast("string")))
    cells = evidence.select(F.explode(scopes).alias("scope"), number.alias("cell_number"), F.struct("call", "row", "column").alias("cell"))
    distinct = cells.groupBy("scope", "cell_number").agg(F.count(F.lit(1)).alias("cells"), F.min("cell").alias("cell"))
    pairs = near_join(open_.select("scope", "number").distinct(), "number", distinct, "cell_number", on=["scope"])
    per = pairs.groupBy("scope", "number").agg(F.sum("cells").alias("candidates"), F.min("cell").alias("cell"))
    n = F.coalesce(F.col("candidates"), F.lit(0)).cast("bigint")
    one = F.col("binding") == "bound"
    bound = open_.join(per, ["scope", "number"], "left").select(
        "claim_id", n.alias("candidates"), F.when(n == 0, "unbound").when(n == 1, "bound").otherwise("ambiguous").alias("binding"), "cell"
    ).select(
        "claim_id", "candidates", "binding", F.when(one, F.col("cell.call")).alias("bound_call"),
        F.when(one, F.col("cell.row")).alias("bound_row"), F.when(one, F.col("cell.column")).alias("bound_column"),
    )
    kept = c.filter(stated).select(
        "claim_id", F.lit(None).cast("bigint").alias("candidates"), F.lit("cited").alias("binding"),
        F.col("call").alias("bound_call"), F.col("row").alias("bound_row"), F.col("column").alias("bound_column"),
    )
    return kept.unionByName(bound)


def located(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims with the cell that they cite or are bound to: candidates, binding,
    cell_call, cell_row, cell_column, cell_key, cell_kind, cell_value, cell_flag
    (NULL where there is no such cell)."""
    bind = claim_bind_unique(claims, evidence).withColumnsRenamed({"bound_call": "cell_call", "bound_row": "cell_row", "bound_column": "cell_column"})
    cells = _cells(evidence).withColumnsRenamed({"call": "cell_call", "row": "cell_row", "column": "cell_column"})
    return claims.join(bind, "claim_id", "left").join(cells, ["cell_call", "cell_row", "cell_column"], "left")


def claim_inputs_backed(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every calculation input appears (within tolerance) in the question's
    evidence, and in the cell cited for it where ``input_cells`` are given (as
    many as inputs, in their order)."""
    c = claims.filter(F.col("calc") != "none").select("claim_id", "question", "inputs", "input_cells")
    items = c.select("claim_id", "question", F.posexplode("inputs").alias("pos", "input"), "input_cells")
    items = items.withColumn("ref", F.get("input_cells", F.col("pos"))).drop("input_cells")
    values = evidence.filter(F.col("value").isNotNull()).select("question", F.col("value").alias("ev"))
    flagged = near_matched(items, "input", values, "ev", on=["question"], flag="backed")
    cells = evidence.select(F.col("call").alias("ref_call"), F.col("row").alias("ref_row"), F.col("column").alias("ref_column"), F.col("value").alias("ref_value"))
    at = (F.col("ref.call") == F.col("ref_call")) & (F.col("ref.row") == F.col("ref_row")) & (F.col("ref.column") == F.col("ref_column"))
    per = flagged.join(cells, at, "left").groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("backed")).alias("unbacked"), F.count_if(~near_equal("input", "ref_value")).alias("elsewhere")
    )
    n = F.coalesce(F.col("n"), F.lit(0))
    return c.join(per, "claim_id", "left").select(
        "claim_id",
        n.cast("bigint").alias("inputs"),
        F.coalesce(F.col("unbacked"), F.lit(0)).cast("bigint").alias("unbacked"),
        ((n > 0) & (F.coalesce(F.col("unbacked"), F.lit(0)) == 0)).alias("backed"),
        (F.col("input_cells").isNull() | ((F.size("input_cells") == n) & (F.coalesce(F.col("elsewhere"), F.lit(0)) == 0))).alias("cells_ok"),
    )


# ---- units and labels ----------------------------------------------------------------

def unit_ok(column: Column, unit: Column) -> Column:
    """The lenient unit rule of a copied cell (any case, '£' and 'pounds' too)."""
    u = F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    return (
        F.when(column.isin(*MONEY_COLUMNS), u.isin("gbp", "£", "pounds"))
        .when(column == "trading_days", u.isin(*DAY_UNITS))
        .otherwise(F.lit(True))
    )


def unit_problem(column: Column, unit: Column) -> Column:
    """The strict rule a supported claim must meet: money exactly 'GBP', day
    counts 'days' or 'trading days'. NULL when the unit is acceptable."""
    u = F.coalesce(unit, F.lit(""))
    return (
        F.when(column.isin(*MONEY_COLUMNS) & (u != "GBP"), F.lit("money_unit"))
        .when((column == "trading_days") & ~u.isin(*DAY_UNITS), F.lit("day_unit"))
    )


def expected_unit(column: Column) -> Column:
    """The unit that a known measurement has; empty for others."""
    c = F.lower(column)
    money = (F.contains(c, F.lit("revenue")) & ~c.rlike("share|change|growth")) | c.isin("aov", "average_order_value")
    counts = F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in COUNT_UNITS.items()], F.lit(""))
    return (
        F.when(c.rlike(PERCENT_PATTERN), "%")
        .when(money & c.rlike(DAILY_PATTERN), "GBP per trading day")
        .when(money, "GBP")
        .otherwise(counts)
    )


def kinds_differ(stated: Column, measured: Column) -> Column:
    """Both kinds are known and differ; money is a right label of money per day."""
    daily = (measured == "money_per_day") & (stated == "money")
    return F.coalesce((stated != measured) & ~daily, F.lit(False))


def claim_unit_check(claims: DataFrame) -> DataFrame:
    """The unit each claim's column has, and whether the stated one agrees: money
    and days by name, and every other kind (percentages, orders, customers,
    units, per-day amounts) not contradicted by the unit's own kind."""
    ok = unit_ok(F.col("column"), F.col("unit")) & ~kinds_differ(tx.metric_kind(F.col("unit")), tx.metric_kind(F.col("column")))
    return claims.filter(F.col("column").isNotNull()).select(
        "claim_id", "column", "unit", expected_unit(F.col("column")).alias("expected_unit"), ok.alias("unit_ok")
    )


def label_ok(text: Column, row: Column) -> Column:
    return row.isNull() | F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(row))


def claim_label_check(claims: DataFrame) -> DataFrame:
    return claims.filter(F.col("row").isNotNull()).select(
        "claim_id", "row", "text", label_ok(F.col("text"), F.col("row")).alias("label_ok")
    )


def labels(evidence: DataFrame) -> DataFrame:
    """(question, label_key, row, phrase): every way to write every row label."""
    rows = evidence.select("question", "label_key", "row").where("row IS NOT NULL").distinct()
    return rows.select("*", F.explode(label_forms(F.col("label_key"), F.col("row"))).alias("phrase"))


def named_labels(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, question, label_key, row): labels of the question's results that
    a claim's text names, by an inverted index of the label's words."""
    known = labels(evidence)
    texts = claims.select("claim_id", F.lower("text").alias("text"))
    found = phrase_mentions(texts, "claim_id", "text", known.select("phrase"), "phrase").select("claim_id", "phrase").distinct()
    return found.join(claims.select("claim_id", "question"), "claim_id").join(known, ["question", "phrase"]).select("claim_id", "question", "label_key", "row").distinct()


# ---- verdicts ------------------------------------------------------------------------

def claim_status(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """supported / flagged / unsupported with the first failing rule.

    A boolean fact needs the exact boolean cell. A cited cell must hold the
    value. Without coordinates the value must be in one cell only. Units and
    country labels must fit the cell. Calculations need inputs in the evidence,
    in their cited cells, and the right result. ``problem``: boolean_cell,
    cell_mismatch, money_unit, day_unit, several_cells, missing_label, no_value,
    input_cells, no_result, inputs_unbacked, recalculated, not_in_result."""
    backed = claim_inputs_backed(claims, evidence).select("claim_id", "backed", "cells_ok")
    j = located(claims, evidence).join(backed, "claim_id", "left").withColumn("expected", recompute(F.col("calc"), F.col("inputs")))
    none = F.col("calc") == "none"
    stated = F.col("row").isNotNull() | F.col("column").isNotNull()
    boolean = (F.col("kind") == "boolean") | F.col("flag").isNotNull()
    exact = F.coalesce((F.col("kind") == "boolean") & none & stated & (F.col("cell_kind") == "boolean") & (F.col("flag") == F.col("cell_flag")), F.lit(False))
    matches = near_equal("value", "cell_value")
    bound = none & matches
    cell_unit = F.when(~unit_ok(F.col("cell_column"), F.col("unit")), F.when(F.col("cell_column") == "trading_days", "day_unit").otherwise("money_unit"))
    problem = (
        F.when(boolean, F.when(~exact, "boolean_cell"))
        .when(stated & ~matches, "cell_mismatch")
        .when(unit_problem(F.col("column"), F.col("unit")).isNotNull(), unit_problem(F.col("column"), F.col("unit")))
        .when(none & (F.col("candidates") > 1), "several_cells")
        .when(bound & cell_unit.isNotNull(), cell_unit)
        .when(bound & (F.col("cell_key") == "country") & ~label_ok(F.col("text"), F.col("cell_row")), "missing_label")
        .when(~is_finite("value"), "no_value")
        .when(~none & ~F.coalesce(F.col("cells_ok"), F.lit(False)), "input_cells")
        .when(~none & F.col("expected").isNull(), "no_result")
        .when(~none & ~F.coalesce(F.col("backed"), F.lit(False)), "inputs_unbacked")
        .when(~none & ~near_equal("value", "expected"), "recalculated")
        .when(none & ~matches, "not_in_result")
    )
    status = F.when(problem.isNull(), "supported").when(problem == "recalculated", "flagged").otherwise("unsupported")
    return j.select("claim_id", "attempt", "question", status.alias("status"), problem.alias("problem"))


def claim_coverage(status: DataFrame) -> DataFrame:
    per = status.groupBy("attempt", "question").agg(
        F.count(F.lit(1)).alias("claims"),
        F.count_if(F.col("status") == "supported").alias("supported"),
        F.count_if(F.col("status") == "flagged").alias("flagged"),
    )
    return per.select(
        "*",
        (F.col("claims") - F.col("supported")).alias("unsupported"),
        ratio("supported", "claims").alias("evidence_coverage"),
        ratio(F.col("claims") - F.col("supported"), F.col("claims")).alias("unsupported_rate"),
    )


def _visible_text(text: Column) -> Column:
    """A claim's text without an identifier at its start ('customer 18102: ...')."""
    return F.regexp_replace(text, tx.jvm_pattern(CUSTOMER_PREFIX), "")


def measure_differs(unit: Column, text: Column, column: Column) -> Column:
    """The unit or the text speak of another kind of measure than the column."""
    kind = tx.metric_kind(column)
    return kinds_differ(tx.metric_kind(unit), kind) | kinds_differ(tx.metric_kind(_visible_text(text)), kind)


def claim_conflicting_total(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims on a cell of their question that contradict its facts: they name
    another kind of measure, or their value differs from a fact of the same
    measure in the same visible scope.

    A claim whose text names its row's label is compared with the facts of that
    row, so a labelled breakdown is allowed; one that names none is compared
    with all facts of the measure, so an unqualified second total is not. Low
    and high of each scope decide (aggregates, no pairs)."""
    facts = evidence.filter(F.col("value").isNotNull()).withColumn("metric", tx.metric_kind(F.col("column"))).where("metric IS NOT NULL")
    low_high = [F.min("value").alias("low"), F.max("value").alias("high")]
    by_row = facts.groupBy("question", "metric", F.col("label_key").alias("scope_key"), F.col("row").alias("scope")).agg(*low_high)
    overall = facts.groupBy("question", "metric").agg(*low_high).withColumns({"scope_key": F.lit("*"), "scope": F.lit("*")})
    c = located(claims, evidence).filter(F.col("cell_kind") == "number").withColumn("metric", tx.metric_kind(F.col("cell_column")))
    named = named_labels(claims, evidence).select("claim_id", F.col("label_key").alias("cell_key"), F.col("row").alias("cell_row"), F.lit(True).alias("visible"))
    c = c.join(named, ["claim_id", "cell_key", "cell_row"], "left").withColumn("visible", F.coalesce("visible", F.lit(False)))
    c = c.withColumns({"scope_key": F.when(F.col("visible"), F.col("cell_key")).otherwise("*"), "scope": F.when(F.col("visible"), F.col("cell_row")).otherwise("*")})
    j = c.join(by_row.unionByName(overall), ["question", "metric", "scope_key", "scope"])
    measure = measure_differs(F.col("unit"), F.col("text"), F.col("cell_column"))
    value = ~near_equal("value", "low") | ~near_equal("value", "high")
    reason = F.when(measure, "measure").when(value, "value")
    return j.select("claim_id", "scope", "metric", "low", "high", reason.alias("reason")).where("reason IS NOT NULL")


def result_match_all(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per attempt and question: every fact (measured cell of the question's
    results) has a claim of the same typed value, measure and row label.

    A claim stands for the one label of a kind that its text names, and for none
    if it names several: a pointer does not excuse a contradicting label. Where
    the text names none, the label of its cited or bound cell counts. So claims
    and facts meet by an equality join on the label, never by value. A fact
    without any claim counts as missing; a boolean fact needs a boolean claim."""
    facts = evidence.select("question", "label_key", "row", "column", F.col("value").alias("fact"), F.col("flag").alias("fact_flag"))
    c = located(claims, evidence).select("claim_id", "attempt", "question", "kind", "value", "flag", "unit", "text", "cell_key", "cell_row", "cell_kind")
    named = named_labels(claims, evidence).groupBy("claim_id", "label_key").agg(F.collect_set("row").alias("rows"))
    keys = evidence.select("question", "label_key").distinct()
    stands = c.join(keys, "question").join(named, ["claim_id", "label_key"], "left")
    pointed = F.when((F.col("cell_key") == F.col("label_key")) & F.col("cell_kind").isNotNull(), F.col("cell_row"))
    label = F.when(F.col("rows").isNull(), pointed).when(F.size("rows") == 1, F.get("rows", F.lit(0)))
    stands = stands.withColumn("row", label).where("row IS NOT NULL").drop("rows", "cell_key", "cell_row", "cell_kind")
    met = stands.join(facts, ["question", "label_key", "row"])
    right = same_value(F.col("value"), F.col("flag"), F.col("fact"), F.col("fact_flag")) & (F.col("fact_flag").isNull() | (F.col("kind") == "boolean"))
    hits = met.where(right & ~measure_differs(F.col("unit"), F.col("text"), F.col("column"))).select("attempt", "question", "label_key", "row", "column").distinct()
    asked = claims.select("attempt", "question").distinct().join(facts, "question")
    cells = asked.join(hits.withColumn("hit", F.lit(True)), ["attempt", "question", "label_key", "row", "column"], "left")
    matched = cells.groupBy("attempt", "question").agg(F.count(F.lit(1)).alias("facts"), F.count_if(F.col("hit").isNotNull()).alias("matched"))
    return matched.select(
        "attempt", "question", "facts", (F.col("facts") - F.col("matched")).alias("missing"),
        (F.col("facts") == F.col("matched")).alias("all_matched"),
    )


def best_rows_covered(status: DataFrame, claims: DataFrame, evidence: DataFrame, column: str = "revenue") -> DataFrame:
    """Per attempt and call, the tied winners of ``column`` and whether the
    attempt states each of them with a supported claim on that cell."""
    cells = evidence.filter((F.col("column") == column) & F.col("value").isNotNull())
    best = cells.groupBy("call").agg(F.max("value").alias("best"))
    winners = cells.join(best, "call").filter(F.col("value") == F.col("best")).select("question", "call", "row")
    winners = claims.select("attempt", "question").distinct().join(winners, "question")
    stated = located(claims, evidence).filter((F.col("cell_column") == column) & (F.col("calc") == "none") & F.col("cell_kind").isNotNull())
    ok = (
        stated.join(status.filter(F.col("status") == "supported").select("claim_id"), "claim_id")
        .select("attempt", F.col("cell_call").alias("call"), F.col("cell_row").alias("row"))
        .distinct()
        .withColumn("covered", F.lit(True))
    )
    w = winners.join(ok, ["attempt", "call", "row"], "left")
    return w.groupBy("attempt", "call").agg(
        F.count(F.lit(1)).alias("winners"),
        F.count_if(F.coalesce(F.col("covered"), F.lit(False))).alias("covered"),
    ).withColumn("all_covered", F.col("winners") == F.col("covered"))
