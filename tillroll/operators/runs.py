"""Run scoring and summaries over a table of evaluation runs.

A run row carries the per-(question, tier) scores; summaries are grouping
sets, pivots and conditional means over it. Means skip NULLs (a metric that
does not apply is NULL) and are computed as ``sum / count`` in DOUBLE;
ratios of sums give NULL when the denominator is 0.

The test data has no evaluation log, so ``runs_from_documents`` derives one
deterministically from ``documents ⋈ labels``: tier = language, route =
source, correct = quality, refusal = toxic (see FIXTURES.md).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import dbl, ratio


def runs_from_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    d = documents.select("doc_id", "lang", "source", "n_chars", "text")
    j = d.join(labels.select("doc_id", "quality", "toxic"), "doc_id")
    n, doc, q, tox = F.col("n_chars"), F.col("doc_id"), F.col("quality"), F.col("toxic")
    answerable = tox == 0
    return j.select(
        doc.alias("case_id"),
        F.col("lang").alias("tier"),
        F.col("source").alias("route"),
        F.when(tox == 1, "trick").when(n < 1000, "easy").when(n < 5000, "medium").otherwise("hard").alias("difficulty"),
        answerable.alias("answerable"),
        F.when(answerable, q.cast("double")).alias("correct"),
        F.when(~answerable, q.cast("double")).alias("refusal_correct"),
        (((tox == 1) & (q == 1)) | ((tox == 0) & (doc % 7 == 0))).alias("refused"),
        (n % 4).alias("queries"),
        F.least(n % 4, n % 3).alias("sql_successes"),
        (n % 5).alias("displayed_claims"),
        F.least(n % 5, doc % 4).alias("displayed_supported"),
        (n % 5 - F.least(n % 5, doc % 4)).alias("displayed_unsupported"),
        F.when(doc % 3 == 0, q.cast("double")).alias("chart_correct"),
        F.when(answerable, (n % 2).cast("double")).alias("tool_selection_correct"),
        (doc % 3).alias("retries"),
        (n.cast("decimal(18,0)") * F.lit(0.001).cast("decimal(4,3)")).alias("seconds"),
        F.lit(0).cast("decimal(10,4)").alias("api_cost_usd"),
        (q == 1).alias("required_ok"),
        (n % 11 == 0).alias("failed"),
        (n % 13 == 0).cast("bigint").alias("contradicted"),
        (doc % 17 == 0).cast("bigint").alias("unassessed"),
        (n % 19 == 0).cast("bigint").alias("undeclared"),
        F.regexp_extract("text", r"([0-9][0-9.,]*)", 1).alias("answer_text"),
        n.cast("double").alias("gt_value"),
    )


def _mean(c: Column) -> Column:
    return ratio(F.sum(c), F.count(c))


def summary_metrics(answerable: Column | None = None) -> list[Column]:
    """The 21 per-group metrics of the run summary."""
    ans = F.col("answerable")
    sql_calls = F.sum("queries")
    claims = F.sum("displayed_claims")
    return [
        F.count(F.lit(1)).alias("cases"),
        F.count_if(ans).alias("answerable_cases"),
        F.sum(F.when(ans, F.col("correct"))).alias("correct_answers"),
        _mean(F.when(ans, F.col("correct"))).alias("accuracy"),
        F.count_if(~ans).alias("refusal_cases"),
        F.sum(F.when(~ans, F.col("refusal_correct"))).alias("refused_tricks"),
        sql_calls.alias("sql_attempts"),
        F.sum("sql_successes").alias("sql_successes"),
        ratio(F.sum("sql_successes"), F.nullif(sql_calls, F.lit(0))).alias("queries_ok"),
        claims.alias("displayed_claims"),
        F.sum("displayed_supported").alias("displayed_supported"),
        ratio(F.sum("displayed_supported"), F.nullif(claims, F.lit(0))).alias("evidence_coverage"),
        ratio(F.sum("displayed_unsupported"), F.nullif(claims, F.lit(0))).alias("unsupported_rate"),
        F.count("chart_correct").alias("required_charts"),
        _mean(F.col("chart_correct")).alias("chart_correct"),
        _mean(F.col("tool_selection_correct")).alias("tool_selection"),
        _mean(F.col("retries")).alias("avg_retries"),
        _mean(F.col("seconds")).alias("avg_seconds"),
        dbl(F.sum("api_cost_usd")).alias("api_cost_usd"),
    ]


def run_summary(runs: DataFrame) -> DataFrame:
    """Per tier: one 'all' row and one row per route, in one grouping-sets pass."""
    g = runs.groupingSets([["tier"], ["tier", "route"]], "tier", "route").agg(
        F.grouping("route").alias("_all"), *summary_metrics()
    )
    return g.withColumn("route", F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col("route"))).drop("_all")


def pivot_mean(runs: DataFrame, rows: str, cols: str, metric: str) -> DataFrame:
    """rows x cols table of the mean of ``metric`` in long form, so that every
    value of ``cols`` in the data is there and the schema does not depend on it."""
    return runs.groupBy(rows, cols).agg(_mean(F.col(metric)).alias(metric))


def accuracy_by_tier(runs: DataFrame) -> DataFrame:
    return (
        runs.filter("answerable")
        .groupBy("tier")
        .agg(_mean(F.col("correct")).alias("accuracy"), _mean(F.col("seconds")).alias("avg_seconds"))
    )


def error_table(runs: DataFrame) -> DataFrame:
    """Signed % error of wrong numeric answers; unparsable answers give NULL."""
    answer = F.expr("try_cast(replace(answer_text, ',', '') AS DOUBLE)")
    wrong = runs.filter(F.col("answerable") & (F.col("correct") == 0))
    return wrong.select(
        "case_id",
        "gt_value",
        answer.alias("answer"),
        (F.lit(100.0) * (answer - F.col("gt_value")) / F.nullif(F.col("gt_value"), F.lit(0.0))).alias("error_pct"),
    )


def pass_flags(runs: DataFrame) -> DataFrame:
    """Five component pass flags and the overall pass (all of them)."""
    flags = runs.select(
        "case_id",
        "tier",
        "seconds",
        "retries",
        (F.col("sql_successes") > 0).alias("execution_ok"),
        F.coalesce(F.col("tool_selection_correct") == 1, F.lit(True)).alias("tools_ok"),
        (F.col("queries") > 0).alias("sql_rules_ok"),
        (F.col("displayed_unsupported") == 0).alias("claims_ok"),
        F.coalesce(F.col("correct") == 1, F.col("refusal_correct") == 1).alias("answer_ok"),
    )
    return flags.withColumn(
        "overall_pass",
        F.col("execution_ok") & F.col("tools_ok") & F.col("sql_rules_ok") & F.col("claims_ok") & F.col("answer_ok"),
    )


def pass_rates(flags: DataFrame) -> DataFrame:
    """% true per flag, latency mean/min/max, runs that needed repairs."""
    pct_true = lambda c: F.lit(100.0) * ratio(F.count_if(F.col(c)), F.count(F.col(c)))
    return flags.agg(
        F.count(F.lit(1)).alias("runs"),
        *[pct_true(c).alias(f"{c}_pct") for c in
          ("execution_ok", "tools_ok", "sql_rules_ok", "claims_ok", "answer_ok", "overall_pass")],
        _mean(F.col("seconds")).alias("mean_seconds"),
        dbl(F.min("seconds")).alias("min_seconds"),
        dbl(F.max("seconds")).alias("max_seconds"),
        F.count_if(F.col("retries") > 0).alias("repaired_runs"),
    )


def correct_flag(runs: DataFrame) -> DataFrame:
    ok = (
        F.col("required_ok")
        & ~F.col("failed")
        & ~F.col("refused")
        & (F.col("contradicted") == 0)
        & (F.col("unassessed") == 0)
        & (F.col("undeclared") == 0)
    )
    return runs.select("case_id", F.when(F.col("answerable"), ok.cast("double")).alias("correct"))


def refusal_flag(claims: DataFrame, case: str, refused: Column, supported: Column) -> DataFrame:
    """A refusal counts only if the case refused and every shown claim is
    supported: ``bool_and`` per case (partial aggregation, skew-safe)."""
    per = claims.groupBy(case).agg(F.bool_and(refused).alias("refused"), F.bool_and(supported).alias("all_supported"))
    return per.withColumn("refusal_ok", F.col("refused") & F.col("all_supported"))


def tool_match(calls: DataFrame, case: str, tool: str, required: list[str], forbidden: list[str]) -> DataFrame:
    """Required tools all used and no forbidden tool used, per case. The set
    of tools per case is bounded by the tool catalogue."""
    used = calls.groupBy(case).agg(F.array_sort(F.collect_set(tool)).alias("used"))
    req = F.array(*[F.lit(t) for t in required])
    forb = F.array(*[F.lit(t) for t in forbidden])
    return used.select(
        case,
        (F.size(F.array_except(req, F.col("used"))) == 0).alias("required_used"),
        (~F.arrays_overlap(F.col("used"), forb)).alias("no_forbidden"),
    ).withColumn("tool_match", F.col("required_used") & F.col("no_forbidden"))


def terms_present(texts: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    low = F.lower(F.col(text))
    arr = F.array(*[F.lit(t) for t in terms])
    return texts.select(key, F.forall(arr, lambda t: F.contains(low, t)).alias("terms_ok"))


def repair_used(calls: DataFrame, case: str, ok: Column) -> DataFrame:
    """Cases with two or more queries, at least one failed and one successful."""
    per = calls.groupBy(case).agg(
        F.count(F.lit(1)).alias("calls"), F.bool_or(~ok).alias("any_failed"), F.bool_or(ok).alias("any_ok")
    )
    return per.withColumn("repair_used", (F.col("calls") >= 2) & F.col("any_failed") & F.col("any_ok"))


def review_coverage(documents: DataFrame, labels: DataFrame) -> DataFrame:
    j = documents.select("doc_id").join(labels.select("doc_id", "toxic"), "doc_id", "left")
    return j.agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if(F.col("toxic") == 0).alias("answerable"),
        F.count_if(F.col("toxic").isNotNull()).alias("reviewed"),
    )


def query_success(calls: DataFrame, case: str, ok: Column) -> DataFrame:
    """Successful / attempted calls per case and over all (ROLLUP)."""
    return calls.rollup(case).agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(ok).alias("successful"),
        ratio(F.count_if(ok), F.count(F.lit(1))).alias("success_rate"),
    )
