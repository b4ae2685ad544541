"""Evidence checks over claims and long-form evidence."""

from __future__ import annotations

from ..operators import evidence as ev
from ..functions import text as tx
from ..sources.warehouse import warehouse
from . import params as P
from .catalog import query


def evidence_table(spark, sf):
    """The evidence log, derived once per session from the published tables."""
    return warehouse(spark, sf).derived("evidence", lambda wh: ev.evidence_from_sales(wh.sales, wh.dim_month, P.MONTH_PARTIAL))


def claims_table(spark, sf):
    return warehouse(spark, sf).derived("claims", lambda wh: ev.claims_from_evidence(evidence_table(spark, sf)))


def _tables(spark, sf):
    return evidence_table(spark, sf), claims_table(spark, sf)


def near_sql(a: str, b: str) -> str:
    return (f"COALESCE(isfinite({a}) AND isfinite({b}) AND abs({a} - {b}) <= "
            f"greatest(0.011, 1e-6 * greatest(abs({a}), abs({b}))), FALSE)")


_RECOMPUTE_RAW = """CASE
  WHEN calc = 'pct_change' AND len(inputs) = 2 AND inputs[2] <> 0 THEN (inputs[1] - inputs[2]) / inputs[2] * 100.0
  WHEN calc IN ('difference', 'diff') AND len(inputs) = 2 THEN inputs[1] - inputs[2]
  WHEN calc = 'ratio' AND len(inputs) = 2 AND inputs[2] <> 0 THEN inputs[1] / inputs[2]
  WHEN calc = 'share' AND len(inputs) = 2 AND inputs[2] <> 0 THEN inputs[1] / inputs[2] * 100.0
  WHEN calc = 'sum' AND len(inputs) >= 1
    THEN list_reduce(inputs, lambda a, b: a + b)
  WHEN calc = 'mean' AND len(inputs) >= 1
    THEN list_reduce(inputs, lambda a, b: a + b) / CAST(len(inputs) AS DOUBLE)
END"""
# A non-finite result counts as no result.
RECOMPUTE_SQL = f"CASE WHEN isfinite({_RECOMPUTE_RAW}) THEN {_RECOMPUTE_RAW} END"

def unit_ok_sql(column: str, unit: str) -> str:
    return f"""CASE WHEN {column} IN ('revenue', 'net_revenue', 'aov') THEN lower(trim(COALESCE({unit}, ''))) IN ('gbp', '£', 'pounds')
     WHEN {column} = 'trading_days' THEN lower(trim(COALESCE({unit}, ''))) IN ('days', 'trading days')
     ELSE TRUE END"""


def kind_sql(label: str) -> str:
    """The kind of measure a label names, for RE2 (whose word edges are ASCII)."""
    t = f"trim(replace(lower({label}), '_', ' '))"
    cases = []
    for kind, rx in tx.METRIC_RULES:
        then = f"CASE WHEN regexp_matches({t}, '{tx.PER_DAY}') THEN 'money_per_day' ELSE 'money' END" if kind == "money" else f"'{kind}'"
        cases.append(f"WHEN regexp_matches({t}, '{rx}') THEN {then}")
    return f"CASE {' '.join(cases)} END"


def differ_sql(stated: str, measured: str) -> str:
    return f"COALESCE({stated} <> {measured} AND NOT ({measured} = 'money_per_day' AND {stated} = 'money'), FALSE)"


VISIBLE_SQL = "regexp_replace(text, '(?i)\\bcustomer(?:_id)?\\s+\\d+\\s*[:;,.]?', '', 'g')"


def measure_differs_sql(claim: str, kind: str) -> str:
    return f"({differ_sql(claim + '.unit_kind', kind)} OR {differ_sql(claim + '.text_kind', kind)})"


LABEL_OK_SQL = """("row" IS NULL OR contains(lower(COALESCE(text, '')), lower("row")))"""

SAME_SQL = ("CASE WHEN {v}.flag IS NOT NULL OR {w}.flag IS NOT NULL THEN COALESCE({v}.flag = {w}.flag, FALSE) ELSE " + near_sql("{v}.value", "{w}.value") + " END")

EVIDENCE_CTES = """
wide AS (
  SELECT year(invoice_date) AS call, country AS "row",
         CAST(SUM(revenue) AS DOUBLE) AS revenue,
         CAST(COUNT(DISTINCT invoice_no) AS DOUBLE) AS orders,
         CAST(COUNT(DISTINCT customer_id) AS DOUBLE) AS customers,
         CAST(SUM(revenue) AS DOUBLE) / NULLIF(CAST(COUNT(DISTINCT invoice_no) AS DOUBLE), 0) AS aov
  FROM sales WHERE NOT is_cancellation GROUP BY 1, 2),
buyers AS (
  SELECT CAST(customer_id AS VARCHAR) AS "row", CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(COUNT(DISTINCT invoice_no) AS DOUBLE) AS orders
  FROM sales WHERE NOT is_cancellation AND customer_id IS NOT NULL AND invoice_month = '2001-08' GROUP BY customer_id),
months AS (SELECT CAST(left(invoice_month, 4) AS BIGINT) AS y, * FROM dim_month),
evidence AS MATERIALIZED (
  SELECT * FROM (
    SELECT call AS question, call, "row", 'country' AS label_key, 'revenue' AS "column", 'number' AS kind, revenue AS value, CAST(NULL AS BOOLEAN) AS flag FROM wide
    UNION ALL SELECT call, call, "row", 'country', 'orders', 'number', orders, NULL FROM wide
    UNION ALL SELECT call, call, "row", 'country', 'customers', 'number', customers, NULL FROM wide
    UNION ALL SELECT call, call, "row", 'country', 'aov', 'number', aov, NULL FROM wide
    UNION ALL SELECT y, 10000 + y, invoice_month, 'invoice_month', 'trading_days', 'number', CAST(trading_days AS DOUBLE), NULL FROM months
    UNION ALL SELECT y, 10000 + y, invoice_month, 'invoice_month', 'net_revenue', 'number', CAST(net_revenue AS DOUBLE), NULL FROM months
    UNION ALL SELECT y, 10000 + y, invoice_month, 'invoice_month', 'is_complete_month', 'boolean', NULL, is_complete_month FROM months
    UNION ALL SELECT 2001, 200108, "row", 'customer_id', 'revenue', 'number', revenue, NULL FROM buyers
    UNION ALL SELECT 2001, 200108, "row", 'customer_id', 'orders', 'number', orders, NULL FROM buyers) u
  WHERE isfinite(value) OR flag IS NOT NULL),
att AS (SELECT 1 AS attempt UNION ALL SELECT 2),
cells AS (
  SELECT e.*, a.attempt, k, k + ci AS s, a.attempt = 2 AND (e.question + k + ci) % 3 = 0 AS changed, e.kind = 'boolean' AND k % 5 = 0 AS as_number,
         replace("column", '_', ' ') AS name,
         CASE WHEN label_key = 'customer_id' THEN 'customer ' || "row"
              WHEN label_key = 'invoice_month' AND k % 2 = 0 THEN lower(strftime(CAST("row" || '-01' AS DATE), '%B %Y')) ELSE lower("row") END AS label
  FROM (SELECT *, TRY_CAST(regexp_extract("row", '([0-9]+)$', 1) AS BIGINT) AS k,
          CASE "column" WHEN 'revenue' THEN 0 WHEN 'orders' THEN 1 WHEN 'customers' THEN 2 WHEN 'aov' THEN 3 WHEN 'trading_days' THEN 4 WHEN 'net_revenue' THEN 5 ELSE 6 END AS ci
        FROM evidence) e, att a),
cell_claims AS (
  SELECT CAST(attempt AS VARCHAR) || ':' || CAST(call AS VARCHAR) || ':' || "row" || ':' || "column" AS claim_id, attempt, question,
         CASE WHEN s % 11 <> 2 THEN call END AS call,
         CASE WHEN s % 11 NOT IN (1, 2) THEN "row" END AS "row",
         CASE WHEN s % 11 = 4 THEN 'orders' WHEN s % 11 NOT IN (1, 2) THEN "column" END AS "column",
         CASE WHEN as_number THEN 'number' ELSE kind END AS kind,
         CASE WHEN as_number THEN CASE WHEN flag <> changed THEN 1.0 ELSE 0.0 END WHEN changed THEN value * 1.001 ELSE value END AS value,
         CASE WHEN NOT as_number THEN flag <> changed END AS flag,
         CASE WHEN "column" IN ('revenue', 'net_revenue', 'aov') THEN CASE WHEN s % 5 = 0 THEN 'USD' ELSE 'GBP' END
              WHEN "column" = 'trading_days' THEN CASE WHEN s % 5 = 0 THEN 'orders' ELSE 'days' END
              WHEN "column" = 'is_complete_month' THEN '' ELSE "column" END AS unit,
         'none' AS calc, CAST(NULL AS DOUBLE[]) AS inputs, CAST(NULL AS STRUCT(call BIGINT, "row" VARCHAR, "column" VARCHAR)[]) AS input_cells,
         CASE WHEN s % 7 = 0 THEN name || ' was' WHEN s % 11 = 3 THEN 'like nation_1, ' || label || ' ' || name ELSE label || ' ' || name END AS text
  FROM cells),
rw AS (
  SELECT question, call, "row", MAX(CASE WHEN "column" = 'revenue' THEN value END) AS revenue,
         MAX(CASE WHEN "column" = 'orders' THEN value END) AS orders, TRY_CAST(regexp_extract("row", '([0-9]+)$', 1) AS BIGINT) AS k
  FROM evidence WHERE label_key = 'country' GROUP BY question, call, "row"),
ratio_claims AS (
  SELECT CAST(a.attempt AS VARCHAR) || ':' || CAST(r.call AS VARCHAR) || ':' || r."row" || ':aov_calc' AS claim_id, a.attempt, r.question, r.call,
         CAST(NULL AS VARCHAR) AS "row", CAST(NULL AS VARCHAR) AS "column", 'number' AS kind,
         CASE WHEN a.attempt = 2 AND (r.question + k) % 3 = 0 THEN (r.revenue / r.orders) * 1.001 ELSE r.revenue / r.orders END AS value,
         CAST(NULL AS BOOLEAN) AS flag, 'GBP' AS unit, 'ratio' AS calc, [r.revenue, r.orders] AS inputs,
         CASE k % 4 WHEN 1 THEN [{'call': r.call, 'row': r."row", 'column': 'revenue'}, {'call': r.call, 'row': r."row", 'column': 'orders'}]
                    WHEN 2 THEN [{'call': r.call, 'row': r."row", 'column': 'orders'}, {'call': r.call, 'row': r."row", 'column': 'revenue'}]
                    WHEN 3 THEN [{'call': r.call, 'row': r."row", 'column': 'revenue'}] END AS input_cells,
         lower(r."row") AS text
  FROM rw r, att a WHERE r.orders > 0),
tot AS (
  SELECT question, call, list_sort(list(value)) AS inputs, CAST(SUM(CAST(value AS DECIMAL(38,2))) AS DOUBLE) AS value
  FROM evidence WHERE "column" = 'revenue' AND label_key = 'country' GROUP BY question, call),
total_claims AS (
  SELECT CAST(a.attempt AS VARCHAR) || ':' || CAST(t.call AS VARCHAR) || ':*:revenue_total' AS claim_id, a.attempt, t.question, t.call,
         CAST(NULL AS VARCHAR) AS "row", CAST(NULL AS VARCHAR) AS "column", 'number' AS kind,
         CASE WHEN a.attempt = 2 AND t.question % 2 = 0 THEN t.value * 1.001 ELSE t.value END AS value,
         CAST(NULL AS BOOLEAN) AS flag, 'GBP' AS unit, 'sum' AS calc, t.inputs, NULL AS input_cells, 'total revenue' AS text
  FROM tot t, att a),
claims AS MATERIALIZED (SELECT * FROM cell_claims UNION ALL SELECT * FROM ratio_claims UNION ALL SELECT * FROM total_claims),
cited AS (
  SELECT c.claim_id, c.value, c.flag, e.value AS cell_value, e.flag AS cell_flag, e.kind IS NOT NULL AS found,
         """ + SAME_SQL.format(v="c", w="e") + """ AS matches
  FROM claims c LEFT JOIN evidence e ON c.call = e.call AND c."row" = e."row" AND c."column" = e."column"
  WHERE c.calc = 'none'),
holding AS (
  SELECT c.claim_id, e.call, e."row", e."column" FROM claims c JOIN evidence e ON e.question = c.question AND (c.call IS NULL OR c.call = e.call)
    AND (c.flag IS NOT NULL) = (e.kind = 'boolean') AND """ + SAME_SQL.format(v="c", w="e") + """
  WHERE c.calc = 'none' AND c."row" IS NULL AND c."column" IS NULL),
bind AS (
  SELECT c.claim_id, CAST(NULL AS BIGINT) AS candidates, 'cited' AS binding, c.call AS bound_call, c."row" AS bound_row, c."column" AS bound_column
  FROM claims c WHERE c.calc = 'none' AND (c."row" IS NOT NULL OR c."column" IS NOT NULL)
  UNION ALL
  SELECT c.claim_id, COUNT(h.call), CASE COUNT(h.call) WHEN 0 THEN 'unbound' WHEN 1 THEN 'bound' ELSE 'ambiguous' END,
         CASE WHEN COUNT(h.call) = 1 THEN MIN(h.call) END, CASE WHEN COUNT(h.call) = 1 THEN MIN(h."row") END, CASE WHEN COUNT(h.call) = 1 THEN MIN(h."column") END
  FROM claims c LEFT JOIN holding h ON h.claim_id = c.claim_id
  WHERE c.calc = 'none' AND c."row" IS NULL AND c."column" IS NULL GROUP BY c.claim_id),
located AS MATERIALIZED (
  SELECT c.*, b.candidates, e.call AS cell_call, e."row" AS cell_row, e."column" AS cell_column, e.label_key AS cell_key, e.kind AS cell_kind, e.value AS cell_value, e.flag AS cell_flag,
         b.bound_column, b.bound_row
  FROM claims c LEFT JOIN bind b ON b.claim_id = c.claim_id
    LEFT JOIN evidence e ON e.call = b.bound_call AND e."row" = b.bound_row AND e."column" = b.bound_column),
recal AS (SELECT claim_id, calc, value, """ + RECOMPUTE_SQL + """ AS expected FROM claims WHERE calc <> 'none'),
items AS (
  SELECT claim_id, question, unnest(inputs) AS input, unnest(range(1, len(inputs) + 1)) AS pos, input_cells FROM claims WHERE calc <> 'none'),
item_flags AS (
  SELECT i.claim_id, EXISTS (SELECT 1 FROM evidence e WHERE e.question = i.question AND """ + near_sql("i.input", "e.value") + """) AS backed,
         EXISTS (SELECT 1 FROM evidence e WHERE e.call = input_cells[i.pos].call AND e."row" = input_cells[i.pos]."row" AND e."column" = input_cells[i.pos]."column"
                 AND """ + near_sql("i.input", "e.value") + """) AS there
  FROM items i),
backed AS (
  SELECT c.claim_id, COUNT(f.claim_id) AS inputs, COUNT(f.claim_id) FILTER (WHERE NOT f.backed) AS unbacked,
         c.input_cells IS NULL OR len(c.input_cells) = COUNT(f.claim_id) AND COUNT(f.claim_id) FILTER (WHERE NOT f.there) = 0 AS cells_ok
  FROM claims c LEFT JOIN item_flags f ON c.claim_id = f.claim_id WHERE c.calc <> 'none' GROUP BY c.claim_id, c.input_cells),
status AS (
  SELECT claim_id, attempt, question, problem,
         CASE WHEN problem IS NULL THEN 'supported' WHEN problem = 'recalculated' THEN 'flagged' ELSE 'unsupported' END AS status
  FROM (
    SELECT c.claim_id, c.attempt, c.question,
      CASE WHEN c.kind = 'boolean' OR c.flag IS NOT NULL
             THEN CASE WHEN NOT COALESCE(c.kind = 'boolean' AND c.calc = 'none' AND (c."row" IS NOT NULL OR c."column" IS NOT NULL) AND c.cell_kind = 'boolean' AND c.flag = c.cell_flag, FALSE)
                       THEN 'boolean_cell' END
           WHEN (c."row" IS NOT NULL OR c."column" IS NOT NULL) AND NOT """ + near_sql("c.value", "c.cell_value") + """ THEN 'cell_mismatch'
           WHEN c."column" IN ('revenue', 'net_revenue', 'aov') AND COALESCE(c.unit, '') <> 'GBP' THEN 'money_unit'
           WHEN c."column" = 'trading_days' AND COALESCE(c.unit, '') NOT IN ('days', 'trading days') THEN 'day_unit'
           WHEN c.calc = 'none' AND c.candidates > 1 THEN 'several_cells'
           WHEN c.calc = 'none' AND """ + near_sql("c.value", "c.cell_value") + """ AND NOT (""" + unit_ok_sql("c.cell_column", "c.unit") + """)
             THEN CASE WHEN c.cell_column = 'trading_days' THEN 'day_unit' ELSE 'money_unit' END
           WHEN c.calc = 'none' AND """ + near_sql("c.value", "c.cell_value") + """ AND c.cell_key = 'country' AND NOT contains(lower(COALESCE(c.text, '')), lower(c.cell_row)) THEN 'missing_label'
           WHEN c.value IS NULL OR NOT isfinite(c.value) THEN 'no_value'
           WHEN c.calc <> 'none' AND NOT COALESCE(b.cells_ok, FALSE) THEN 'input_cells'
           WHEN c.calc <> 'none' AND r.expected IS NULL THEN 'no_result'
           WHEN c.calc <> 'none' AND NOT COALESCE(b.inputs > 0 AND b.unbacked = 0, FALSE) THEN 'inputs_unbacked'
           WHEN c.calc <> 'none' AND NOT """ + near_sql("c.value", "r.expected") + """ THEN 'recalculated'
           WHEN c.calc = 'none' AND NOT """ + near_sql("c.value", "c.cell_value") + """ THEN 'not_in_result'
      END AS problem
    FROM located c LEFT JOIN recal r ON c.claim_id = r.claim_id LEFT JOIN backed b ON c.claim_id = b.claim_id)),
label_rows AS (SELECT DISTINCT question, label_key, "row" FROM evidence),
label_forms AS (
  SELECT question, label_key, "row", lower("row") AS form FROM label_rows
  UNION SELECT question, label_key, "row", "row" || '.0' FROM label_rows WHERE label_key = 'customer_id'
  UNION SELECT question, label_key, "row", lower(strftime(CAST("row" || '-01' AS DATE), '%B %Y')) FROM label_rows WHERE label_key = 'invoice_month'
  UNION SELECT question, label_key, "row", lower(strftime(CAST("row" || '-01' AS DATE), '%b %Y')) FROM label_rows WHERE label_key = 'invoice_month'),
named AS MATERIALIZED (
  SELECT DISTINCT c.claim_id, c.question, f.label_key, f."row" FROM claims c JOIN label_forms f ON f.question = c.question
    AND contains(lower(c.text), f.form) AND regexp_matches(lower(c.text), '(^|[^\\pL\\pN_])' || regexp_escape(f.form) || '([^\\pL\\pN_]|$)'))"""


@query("evidence_unpivot", 'SELECT question, call, "row", label_key, "column", kind, value, flag FROM evidence', ctes=EVIDENCE_CTES)
def evidence_unpivot(spark, sf):
    """Wide results (countries, months, customers) as one typed row per measured cell."""
    wh = warehouse(spark, sf)
    return ev.evidence_from_sales(wh.sales, wh.dim_month, P.MONTH_PARTIAL)


@query("claim_near_equal", "SELECT claim_id, value, cell_value, matches AS near_equal FROM cited WHERE cell_value IS NOT NULL AND value IS NOT NULL",
       ctes=EVIDENCE_CTES)
def claim_near_equal(spark, sf):
    e, c = _tables(spark, sf)
    return ev.claim_near_equal(c, e)


@query("claim_cited_cell", "SELECT claim_id, value, flag, cell_value, cell_flag, found, matches FROM cited", ctes=EVIDENCE_CTES)
def claim_cited_cell(spark, sf):
    e, c = _tables(spark, sf)
    return ev.claim_cited_cell(c, e)


@query("claim_bind_unique", "SELECT * FROM bind", ctes=EVIDENCE_CTES)
def claim_bind_unique(spark, sf):
    e, c = _tables(spark, sf)
    return ev.claim_bind_unique(c, e)


@query("claim_recompute", f"""
SELECT claim_id, calc, value, expected, expected IS NOT NULL AND NOT {near_sql('value', 'expected')} AS flagged FROM recal""",
       ctes=EVIDENCE_CTES)
def claim_recompute(spark, sf):
    _, c = _tables(spark, sf)
    return ev.claim_recompute(c)


@query("claim_inputs_backed", """
SELECT claim_id, inputs, unbacked, inputs > 0 AND unbacked = 0 AS backed, cells_ok FROM backed""", ctes=EVIDENCE_CTES)
def claim_inputs_backed(spark, sf):
    e, c = _tables(spark, sf)
    return ev.claim_inputs_backed(c, e)


UNIT_SQL = f"""
SELECT claim_id, "column", unit,
       CASE WHEN regexp_matches("column", 'pct|percent|cancellation_rate') THEN '%'
            WHEN contains("column", 'revenue') AND NOT regexp_matches("column", 'share|change|growth') OR "column" IN ('aov', 'average_order_value')
              THEN CASE WHEN regexp_matches("column", 'per_?(trading_?)?day|daily') THEN 'GBP per trading day' ELSE 'GBP' END
            ELSE CASE "column" WHEN 'trading_days' THEN 'days' WHEN 'orders' THEN 'orders' WHEN 'customers' THEN 'customers' WHEN 'units' THEN 'units' WHEN 'quantity' THEN 'units' ELSE '' END
       END AS expected_unit,
       {unit_ok_sql('"column"', "unit")} AND NOT {differ_sql(kind_sql("unit"), kind_sql('"column"'))} AS unit_ok
FROM claims WHERE "column" IS NOT NULL"""


@query("claim_unit_check", UNIT_SQL, ctes=EVIDENCE_CTES)
def claim_unit_check(spark, sf):
    _, c = _tables(spark, sf)
    return ev.claim_unit_check(c)


@query("claim_label_check", f'SELECT claim_id, "row", text, {LABEL_OK_SQL} AS label_ok FROM claims WHERE "row" IS NOT NULL',
       ctes=EVIDENCE_CTES)
def claim_label_check(spark, sf):
    _, c = _tables(spark, sf)
    return ev.claim_label_check(c)


@query("claim_status", "SELECT claim_id, attempt, question, status, problem FROM status", ctes=EVIDENCE_CTES)
def claim_status(spark, sf):
    e, c = _tables(spark, sf)
    return ev.claim_status(c, e)


@query("claim_totals", f"""
SELECT claim_id, value, expected, expected IS NULL OR {near_sql('value', 'expected')} AS ok
FROM recal WHERE calc = 'sum'""", ctes=EVIDENCE_CTES)
def claim_totals(spark, sf):
    _, c = _tables(spark, sf)
    return ev.claim_totals(c)


@query("claim_coverage", """
SELECT attempt, question, COUNT(*) AS claims, COUNT(*) FILTER (WHERE status = 'supported') AS supported,
       COUNT(*) FILTER (WHERE status = 'flagged') AS flagged,
       COUNT(*) - COUNT(*) FILTER (WHERE status = 'supported') AS unsupported,
       CAST(COUNT(*) FILTER (WHERE status = 'supported') AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0) AS evidence_coverage,
       CAST(COUNT(*) - COUNT(*) FILTER (WHERE status = 'supported') AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0) AS unsupported_rate
FROM status GROUP BY attempt, question""", ctes=EVIDENCE_CTES)
def claim_coverage(spark, sf):
    e, c = _tables(spark, sf)
    return ev.claim_coverage(ev.claim_status(c, e))


KINDS_CTES = f"""
kinds AS MATERIALIZED (SELECT *, {kind_sql("unit")} AS unit_kind, {kind_sql(VISIBLE_SQL)} AS text_kind, {kind_sql("cell_column")} AS metric FROM located),
facts AS MATERIALIZED (SELECT *, {kind_sql('"column"')} AS metric FROM evidence)"""


@query("claim_conflicting_total", f"""
WITH {KINDS_CTES},
scoped AS (
  SELECT k.*, n."row" IS NOT NULL AS visible
  FROM kinds k LEFT JOIN named n ON n.claim_id = k.claim_id AND n.label_key = k.cell_key AND n."row" = k.cell_row WHERE cell_kind = 'number'),
judged AS (
  SELECT s.claim_id, CASE WHEN visible THEN cell_row ELSE '*' END AS scope, s.metric,
         {measure_differs_sql("s", "s.metric")} AS measure,
         bool_or(NOT {near_sql("s.value", "f.value")}) AS differs, MIN(f.value) AS low, MAX(f.value) AS high
  FROM scoped s JOIN facts f ON f.question = s.question AND f.metric = s.metric AND f.value IS NOT NULL
    AND (NOT visible OR f.label_key = s.cell_key AND f."row" = s.cell_row)
  GROUP BY ALL)
SELECT claim_id, scope, metric, low, high, CASE WHEN measure THEN 'measure' ELSE 'value' END AS reason FROM judged WHERE measure OR differs""", ctes=EVIDENCE_CTES)
def claim_conflicting_total(spark, sf):
    e, c = _tables(spark, sf)
    return ev.claim_conflicting_total(c, e)


@query("result_match_all", f"""
WITH {KINDS_CTES},
asked AS (SELECT DISTINCT attempt, question FROM claims),
rival AS MATERIALIZED (SELECT claim_id, label_key, list(DISTINCT "row") AS rows FROM named GROUP BY claim_id, label_key),
pairs AS (
  SELECT c.attempt, e.question, e.label_key, e."row", e."column"
  FROM kinds c JOIN facts e ON e.question = c.question AND {SAME_SQL.format(v="c", w="e")} AND (e.kind <> 'boolean' OR c.kind = 'boolean')
    AND NOT {measure_differs_sql("c", "e.metric")}
  LEFT JOIN rival r ON r.claim_id = c.claim_id AND r.label_key = e.label_key
  WHERE CASE WHEN r.rows IS NULL THEN COALESCE(c.cell_key = e.label_key AND c.cell_row = e."row", FALSE) ELSE r.rows = [e."row"] END),
hits AS (
  SELECT a.attempt, e.question, p."row" IS NOT NULL AS hit
  FROM asked a JOIN facts e ON e.question = a.question
  LEFT JOIN (SELECT DISTINCT * FROM pairs) p ON p.attempt = a.attempt AND p.question = e.question AND p.label_key = e.label_key AND p."row" = e."row" AND p."column" = e."column")
SELECT attempt, question, COUNT(*) AS facts, COUNT(*) FILTER (WHERE NOT hit) AS missing, bool_and(hit) AS all_matched
FROM hits GROUP BY attempt, question""", ctes=EVIDENCE_CTES)
def result_match_all(spark, sf):
    """Facts of each question that an attempt states under the right label."""
    e, c = _tables(spark, sf)
    return ev.result_match_all(c, e)


@query("best_rows_covered", """
WITH rev_cells AS (SELECT * FROM evidence WHERE "column" = 'revenue'),
winners AS (SELECT DISTINCT cl.attempt, c.call, c."row" FROM rev_cells c JOIN claims cl ON cl.question = c.question
            WHERE c.value = (SELECT MAX(value) FROM rev_cells x WHERE x.call = c.call)),
ok AS (SELECT DISTINCT l.attempt, l.cell_call AS call, l.cell_row AS "row" FROM located l JOIN status s ON l.claim_id = s.claim_id
       WHERE l.cell_column = 'revenue' AND l.calc = 'none' AND s.status = 'supported')
SELECT w.attempt, w.call, COUNT(*) AS winners, COUNT(ok.call) AS covered, COUNT(*) = COUNT(ok.call) AS all_covered
FROM winners w LEFT JOIN ok ON w.attempt = ok.attempt AND w.call = ok.call AND w."row" = ok."row"
GROUP BY w.attempt, w.call""", ctes=EVIDENCE_CTES)
def best_rows_covered(spark, sf):
    e, c = _tables(spark, sf)
    return ev.best_rows_covered(ev.claim_status(c, e), c, e)
