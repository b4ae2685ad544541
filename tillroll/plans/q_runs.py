"""Run scoring and summaries over runs derived from documents ⋈ labels
and over calls taken from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis, runs
from ..sources.tables import read_table
from .catalog import query

RUNS_CTE = """
runs AS (
  SELECT d.doc_id AS case_id, d.lang AS tier, d.source AS route,
         CASE WHEN l.toxic = 1 THEN 'trick' WHEN d.n_chars < 1000 THEN 'easy'
              WHEN d.n_chars < 5000 THEN 'medium' ELSE 'hard' END AS difficulty,
         l.toxic = 0 AS answerable,
         CASE WHEN l.toxic = 0 THEN CAST(l.quality AS DOUBLE) END AS correct,
         CASE WHEN l.toxic <> 0 THEN CAST(l.quality AS DOUBLE) END AS refusal_correct,
         (l.toxic = 1 AND l.quality = 1) OR (l.toxic = 0 AND d.doc_id % 7 = 0) AS refused,
         d.n_chars % 4 AS queries, least(d.n_chars % 4, d.n_chars % 3) AS sql_successes,
         d.n_chars % 5 AS displayed_claims, least(d.n_chars % 5, d.doc_id % 4) AS displayed_supported,
         d.n_chars % 5 - least(d.n_chars % 5, d.doc_id % 4) AS displayed_unsupported,
         CASE WHEN d.doc_id % 3 = 0 THEN CAST(l.quality AS DOUBLE) END AS chart_correct,
         CASE WHEN l.toxic = 0 THEN CAST(d.n_chars % 2 AS DOUBLE) END AS tool_selection_correct,
         d.doc_id % 3 AS retries,
         CAST(d.n_chars AS DECIMAL(18,0)) * CAST(0.001 AS DECIMAL(4,3)) AS seconds,
         CAST(0 AS DECIMAL(10,4)) AS api_cost_usd,
         l.quality = 1 AS required_ok, d.n_chars % 11 = 0 AS failed,
         CAST(d.n_chars % 13 = 0 AS BIGINT) AS contradicted, CAST(d.doc_id % 17 = 0 AS BIGINT) AS unassessed,
         CAST(d.n_chars % 19 = 0 AS BIGINT) AS undeclared,
         regexp_extract(d.text, '([0-9][0-9.,]*)', 1) AS answer_text,
         CAST(d.n_chars AS DOUBLE) AS gt_value
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def _runs(spark, sf):
    return runs.runs_from_documents(
        read_table(spark, sf, "documents", "doc_id", "lang", "source", "n_chars", "text"),
        read_table(spark, sf, "labels", "doc_id", "quality", "toxic"),
    )


def _mean(x: str) -> str:
    return f"CAST(SUM({x}) AS DOUBLE) / NULLIF(CAST(COUNT({x}) AS DOUBLE), 0)"


SUMMARY_SQL = f"""
SELECT tier, CASE WHEN GROUPING(route) = 1 THEN 'all' ELSE route END AS route,
       COUNT(*) AS cases, COUNT(*) FILTER (WHERE answerable) AS answerable_cases,
       SUM(CASE WHEN answerable THEN correct END) AS correct_answers,
       {_mean('CASE WHEN answerable THEN correct END')} AS accuracy,
       COUNT(*) FILTER (WHERE NOT answerable) AS refusal_cases,
       SUM(CASE WHEN NOT answerable THEN refusal_correct END) AS refused_tricks,
       CAST(SUM(queries) AS BIGINT) AS sql_attempts, CAST(SUM(sql_successes) AS BIGINT) AS sql_successes,
       CAST(SUM(sql_successes) AS DOUBLE) / NULLIF(CAST(NULLIF(SUM(queries), 0) AS DOUBLE), 0) AS queries_ok,
       CAST(SUM(displayed_claims) AS BIGINT) AS displayed_claims, CAST(SUM(displayed_supported) AS BIGINT) AS displayed_supported,
       CAST(SUM(displayed_supported) AS DOUBLE) / NULLIF(CAST(NULLIF(SUM(displayed_claims), 0) AS DOUBLE), 0) AS evidence_coverage,
       CAST(SUM(displayed_unsupported) AS DOUBLE) / NULLIF(CAST(NULLIF(SUM(displayed_claims), 0) AS DOUBLE), 0) AS unsupported_rate,
       COUNT(chart_correct) AS required_charts, {_mean('chart_correct')} AS chart_correct,
       {_mean('tool_selection_correct')} AS tool_selection, {_mean('retries')} AS avg_retries,
       {_mean('seconds')} AS avg_seconds, CAST(SUM(api_cost_usd) AS DOUBLE) AS api_cost_usd
FROM runs GROUP BY GROUPING SETS ((tier), (tier, route))"""


@query("run_summary", SUMMARY_SQL, ctes=RUNS_CTE)
def run_summary(spark, sf):
    return runs.run_summary(_runs(spark, sf))


@query("run_pivot_accuracy", f"""
SELECT difficulty, tier, {_mean('correct')} AS correct
FROM runs GROUP BY difficulty, tier""", ctes=RUNS_CTE)
def run_pivot_accuracy(spark, sf):
    return runs.pivot_mean(_runs(spark, sf), "difficulty", "tier", "correct")


@query("run_pivot_refusals", f"""
SELECT route, tier, {_mean('refusal_correct')} AS refusal_correct
FROM runs WHERE NOT answerable GROUP BY route, tier""", ctes=RUNS_CTE)
def run_pivot_refusals(spark, sf):
    return runs.pivot_mean(_runs(spark, sf).filter(~F.col("answerable")), "route", "tier", "refusal_correct")


@query("run_accuracy_by_tier", f"""
SELECT tier, {_mean('correct')} AS accuracy, {_mean('seconds')} AS avg_seconds FROM runs WHERE answerable GROUP BY tier""",
       ctes=RUNS_CTE)
def run_accuracy_by_tier(spark, sf):
    return runs.accuracy_by_tier(_runs(spark, sf))


@query("run_error_table", """
SELECT case_id, gt_value, TRY_CAST(replace(answer_text, ',', '') AS DOUBLE) AS answer,
       100.0 * (TRY_CAST(replace(answer_text, ',', '') AS DOUBLE) - gt_value) / NULLIF(gt_value, 0) AS error_pct
FROM runs WHERE answerable AND correct = 0""", ctes=RUNS_CTE)
def run_error_table(spark, sf):
    return runs.error_table(_runs(spark, sf))


FLAGS_CTE = RUNS_CTE + """,
flags AS (
  SELECT case_id, tier, seconds, retries, sql_successes > 0 AS execution_ok,
         COALESCE(tool_selection_correct = 1, TRUE) AS tools_ok, queries > 0 AS sql_rules_ok,
         displayed_unsupported = 0 AS claims_ok, COALESCE(correct = 1, refusal_correct = 1) AS answer_ok
  FROM runs),
flagged AS (SELECT *, execution_ok AND tools_ok AND sql_rules_ok AND claims_ok AND answer_ok AS overall_pass FROM flags)"""


@query("run_overall_pass", """
SELECT case_id, tier, CAST(seconds AS DOUBLE) AS seconds, retries, execution_ok, tools_ok, sql_rules_ok, claims_ok,
       answer_ok, overall_pass FROM flagged""", ctes=FLAGS_CTE)
def run_overall_pass(spark, sf):
    return runs.pass_flags(_runs(spark, sf)).withColumn("seconds", F.col("seconds").cast("double"))


def _pct_true(c: str) -> str:
    return f"100.0 * (CAST(COUNT(*) FILTER (WHERE {c}) AS DOUBLE) / NULLIF(CAST(COUNT({c}) AS DOUBLE), 0)) AS {c}_pct"


@query("run_pass_rates", f"""
SELECT COUNT(*) AS runs, {', '.join(_pct_true(c) for c in ('execution_ok', 'tools_ok', 'sql_rules_ok', 'claims_ok', 'answer_ok', 'overall_pass'))},
       {_mean('seconds')} AS mean_seconds, CAST(MIN(seconds) AS DOUBLE) AS min_seconds,
       CAST(MAX(seconds) AS DOUBLE) AS max_seconds, COUNT(*) FILTER (WHERE retries > 0) AS repaired_runs,
       (SELECT lo.v + (hi.v - lo.v) * (pos.p - floor(pos.p))
        FROM (SELECT 0.5 * CAST(COUNT(*) - 1 AS DOUBLE) AS p FROM flagged) pos,
             (SELECT CAST(seconds AS DOUBLE) AS v, ROW_NUMBER() OVER (ORDER BY seconds, case_id) AS r FROM flagged) lo,
             (SELECT CAST(seconds AS DOUBLE) AS v, ROW_NUMBER() OVER (ORDER BY seconds, case_id) AS r FROM flagged) hi
        WHERE lo.r = CAST(floor(pos.p) AS BIGINT) + 1 AND hi.r = CAST(ceil(pos.p) AS BIGINT) + 1) AS median_seconds
FROM flagged""", ctes=FLAGS_CTE)
def run_pass_rates(spark, sf):
    flags = runs.pass_flags(_runs(spark, sf))
    rates = runs.pass_rates(flags)
    med = analysis.exact_quantiles(flags.select("seconds"), "seconds", [0.5])
    return spark.sql("SELECT r.*, (SELECT value FROM {m}) AS median_seconds FROM {r} r", r=rates, m=med)


@query("run_correct_flag", """
SELECT case_id, CASE WHEN answerable THEN CAST(required_ok AND NOT failed AND NOT refused AND contradicted = 0
                                              AND unassessed = 0 AND undeclared = 0 AS DOUBLE) END AS correct
FROM runs""", ctes=RUNS_CTE)
def run_correct_flag(spark, sf):
    return runs.correct_flag(_runs(spark, sf))


@query("run_refusal_flag", """
SELECT conv_id, BOOL_AND(conv_id % 3 = 0) AS refused, BOOL_AND(role <> 'user' OR turn > 0) AS all_supported,
       BOOL_AND(conv_id % 3 = 0) AND BOOL_AND(role <> 'user' OR turn > 0) AS refusal_ok
FROM conversations GROUP BY conv_id""")
def run_refusal_flag(spark, sf):
    """Conversations as answers and their turns as shown claims: refused when
    the case is a refusal, supported unless a user turn opens it."""
    conv = read_table(spark, sf, "conversations", "conv_id", "turn", "role")
    return runs.refusal_flag(
        conv, "conv_id", F.col("conv_id") % 3 == 0, (F.col("role") != "user") | (F.col("turn") > 0)
    )


@query("run_tool_match", """
SELECT user_id, list_has_all(list(DISTINCT event_type), ['click', 'purchase']) AS required_used,
       NOT list_has_any(list(DISTINCT event_type), ['error']) AS no_forbidden,
       list_has_all(list(DISTINCT event_type), ['click', 'purchase']) AND NOT list_has_any(list(DISTINCT event_type), ['error'])
         AS tool_match
FROM events GROUP BY user_id""")
def run_tool_match(spark, sf):
    """Event types as the tools a run used: clicks and purchases required, errors forbidden."""
    ev = read_table(spark, sf, "events", "user_id", "event_type")
    return runs.tool_match(ev, "user_id", "event_type", ["click", "purchase"], ["error"])


@query("run_terms_present", """
SELECT doc_id, contains(lower(text), 'de') AND contains(lower(text), 'la') AS terms_ok FROM documents""")
def run_terms_present(spark, sf):
    docs = read_table(spark, sf, "documents", "doc_id", "text")
    return runs.terms_present(docs, "doc_id", "text", ["de", "la"])


@query("run_repair_used", """
SELECT user_id, COUNT(*) AS calls, BOOL_OR(event_type = 'error') AS any_failed, BOOL_OR(event_type <> 'error') AS any_ok,
       COUNT(*) >= 2 AND BOOL_OR(event_type = 'error') AND BOOL_OR(event_type <> 'error') AS repair_used
FROM events GROUP BY user_id""")
def run_repair_used(spark, sf):
    ev = read_table(spark, sf, "events", "user_id", "event_type")
    return runs.repair_used(ev, "user_id", F.col("event_type") != "error")


@query("run_review_coverage", """
SELECT COUNT(*) AS questions, COUNT(*) FILTER (WHERE l.toxic = 0) AS answerable,
       COUNT(*) FILTER (WHERE l.toxic IS NOT NULL) AS reviewed
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def run_review_coverage(spark, sf):
    return runs.review_coverage(
        read_table(spark, sf, "documents", "doc_id"), read_table(spark, sf, "labels", "doc_id", "toxic")
    )


@query("run_query_success", """
SELECT user_id, COUNT(*) AS attempted, COUNT(*) FILTER (WHERE event_type <> 'error') AS successful,
       CAST(COUNT(*) FILTER (WHERE event_type <> 'error') AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0) AS success_rate
FROM events GROUP BY ROLLUP (user_id)""")
def run_query_success(spark, sf):
    ev = read_table(spark, sf, "events", "user_id", "event_type")
    return runs.query_success(ev, "user_id", F.col("event_type") != "error")
