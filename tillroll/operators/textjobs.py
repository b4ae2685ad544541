"""Text jobs over text tables: number extraction, undeclared numbers,
redaction, trace stripping, period extraction, question routing, metric
kinds and label normalisation.

Each works on whole texts. Offsets come from expressions in
``functions.text``; support checks are joins (bucketed tolerance join
against declared values), and redaction rebuilds each text from its sorted
spans with a higher-order ``aggregate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.tolerance import near_flagged
from .mentions import phrase_mentions

# ---- fixed values -------------------------------------------------------------------
# Re-pointed vocabulary: the latest, partial month of the test data.
PARTIAL_MONTH_MENTIONS = ("august 2001", "aug 2001", "2001-08")
YEAR = r"(19|20)\d{2}"
COUNT = r"(\d+|one|two|three|four|five|six|seven|eight|nine|ten)"
MONTH = "(" + "|".join(tx.MONTHS) + ")"
# Known question templates, the reference's recognised wordings (full match
# after normalisation; the home-market name is re-pointed).
KNOWN_PATTERNS = [
    rf"^(what was (our |the )?(total )?revenue|(total )?revenue) in {YEAR}$",
    rf"^how many customers (bought from us|purchased) in {YEAR}$",
    rf"^how many orders did we (take|receive) in {YEAR}$",
    rf"^how many units did we sell in {YEAR}$",
    rf"^what was (our |the )?average order value in {YEAR}$",
    rf"^what was (our |the )?cancellation rate in {YEAR}$",
    rf"^list the {COUNT} products that generated the most revenue in {YEAR},? with the revenue for each$",
    rf"^top {COUNT} products (by revenue )?in {YEAR}$",
    rf"^which {COUNT} products generated the most revenue in {YEAR}$",
    rf"^which {COUNT} products sold the most units in {YEAR}$",
    rf"^which country outside (the )?(uk|united kingdom|home market) generated the most revenue in {YEAR},? and how much was it$",
    rf"^is {MONTH} {YEAR} (a )?complete month( in the dataset)?$",
    rf"^did {MONTH} {YEAR} beat {MONTH} {YEAR} on revenue,? and by what percentage$",
]


def number_tokens(texts: DataFrame, key: str, text: str) -> DataFrame:
    toks = texts.select(key, F.posexplode(tx.number_tokens(F.col(text))).alias("pos", "token"))
    return toks.select(key, F.col("pos").cast("bigint").alias("pos"), "token", tx.token_value(F.col("token")).alias("value"))


# An identifier that is only digits counts as a label where its kind is named before it.
ID_PREFIXES = {"customer_id": r"(?i)(?<!\w)customer(?:[ _]id)?\s+\z", "stock_code": r"(?i)(?<!\w)(?:stock|product) code\s+\z"}


def label_spans(texts: DataFrame, key: str, text: str, labels: DataFrame) -> DataFrame:
    """(key, start, end, is_id): where texts name a label of ``labels`` (label_key,
    row), found by a join on words. A label without a letter or hyphen must be an
    identifier introduced by its kind ('customer 18102'), and then covers its
    digits and a decimal zero after them (``is_id``)."""
    known = labels.select("label_key", F.lower("row").alias("phrase")).where("phrase IS NOT NULL").distinct()
    known = known.withColumn("digits", F.col("phrase").rlike(r"^[0-9]+$"))
    known = known.where(F.when(F.col("label_key").isin(*ID_PREFIXES), F.lit(True)).otherwise(F.col("phrase").rlike("[A-Za-z-]")))
    low = texts.select(key, tx.lower_in_place(F.col(text)).alias("_low"))
    found = phrase_mentions(low, key, "_low", known, "phrase").join(known, "phrase")
    introduced = F.coalesce(*[F.when(F.col("label_key") == k, F.col("before").rlike(tx.jvm_pattern(p))) for k, p in ID_PREFIXES.items()], F.lit(False))
    return found.where(~F.col("digits") | introduced).select(key, "start", "end", F.col("digits").alias("is_id")).distinct()


def within_labels(spans: DataFrame, key: str, labelled: DataFrame) -> DataFrame:
    """``spans`` (key, start, end, token, ...) plus ``label``: lies inside a label.

    Spans and labels of a text are put in one order by their start; a span is
    inside a label if the furthest end of the labels so far is not before its
    own. So no span meets every label of its text."""
    columns = spans.columns
    plain_end = F.when(F.col("token").rlike(r"^[0-9]+\.0+$"), F.col("start") + F.char_length(F.regexp_extract("token", r"^[0-9]+", 0))).otherwise(F.col("end"))
    mine = spans.select(F.struct(*columns).alias("span"), F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"), plain_end.alias("_p"))
    theirs = labelled.select(
        F.col(key).alias("_k"), F.col("start").alias("_s"), F.when(~F.col("is_id"), F.col("end")).alias("_label"), F.when(F.col("is_id"), F.col("end")).alias("_id")
    )
    so_far = Window.partitionBy("_k").orderBy("_s", F.col("span").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = mine.unionByName(theirs, allowMissingColumns=True)
    inside = (F.max("_label").over(so_far) >= F.col("_e")) | (F.max("_id").over(so_far) >= F.col("_p"))
    return both.select("span", F.coalesce(inside, F.lit(False)).alias("label")).where("span IS NOT NULL").select("span.*", "label")


def supported_spans(
    prose: DataFrame, key: str, text: str, declared: DataFrame, declared_value: str, labels: DataFrame | None
) -> DataFrame:
    """Number spans marked as dates, inside labels, or near-equal to some declared value."""
    sp = tx.number_spans(prose, key, text)
    if labels is not None:
        # Only texts with numbers are searched for labels.
        numbered = prose.filter(F.col(text).rlike(r"\p{Nd}"))
        sp = within_labels(sp, key, label_spans(numbered, key, text, labels))
    else:
        sp = sp.withColumn("label", F.lit(False))
    # One pass over the spans: the patterns behind them are not run twice.
    marked = near_flagged(sp, "value", declared, declared_value, flag="declared")
    return marked.withColumn("supported", F.col("date_context") | F.col("label") | F.col("declared"))


def undeclared_numbers(
    texts: DataFrame, key: str, text: str, declared: DataFrame, declared_value: str, labels: DataFrame | None = None
) -> DataFrame:
    """Numbers in prose (``[call n]`` markers removed; offsets refer to that
    text) that are neither calendar context nor part of a result's label nor
    near a declared value. ``key`` must name the texts."""
    prose = texts.select(key, tx.drop_call_markers(F.col(text)).alias(text))
    sp = supported_spans(prose, key, text, declared, declared_value, labels)
    return sp.filter(~F.col("supported")).select(key, "start", "token", "value")


def redact_numbers(
    texts: DataFrame, key: str, text: str, declared: DataFrame, declared_value: str, labels: DataFrame | None = None
) -> DataFrame:
    """Replace every unsupported number span by ``[unverified]`` (whole spans,
    so hiding 12 never alters 1,200) in the findings text: call markers
    removed, ends trimmed, customer ids labelled."""
    clean = texts.select(key, tx.findings_text(F.col(text)).alias("clean"))
    sp = supported_spans(clean, key, "clean", declared, declared_value, labels)
    bad = sp.filter(~F.col("supported")).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts")
    )
    j = clean.join(bad, key, "left")
    rebuilt = F.expr(
        "aggregate(coalesce(cuts, array()), named_struct('pos', 0, 'acc', ''), "
        "(s, x) -> named_struct('pos', x.end, 'acc', concat(s.acc, substring(clean, s.pos + 1, x.start - s.pos), '[unverified]')), "
        "s -> concat(s.acc, substring(clean, s.pos + 1, length(clean) + 1)))"
    )
    return j.select(key, rebuilt.alias("text"))


def strip_trace(texts: DataFrame, key: str, text: str) -> DataFrame:
    return texts.select(key, tx.strip_trace(F.col(text)).alias("text"))


def requested_periods(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Ordered distinct ``YYYY-MM`` periods each text asks about."""
    return texts.select(key, tx.requested_periods(F.col(text)).alias("periods"))


def normalise_question(text: Column) -> Column:
    t = F.trim(F.regexp_replace(F.lower(text), tx.SPACE + "+", " "))
    return F.regexp_replace(t, r"[?.]+$", "")


def route(low: Column, template: Column) -> Column:
    """data_gap / forecast / incomplete_month / known_pattern / free, in order.
    Scope words are looked up in the lower-cased question as written; only the
    known templates compare against the whitespace-normalised form."""
    partial = None
    for m in PARTIAL_MONTH_MENTIONS:
        partial = F.contains(low, F.lit(m)) if partial is None else partial | F.contains(low, F.lit(m))
    per_day = F.contains(low, F.lit("per trading day")) | F.contains(low, F.lit("per day"))
    known = None
    for p in map(tx.jvm_pattern, KNOWN_PATTERNS):
        known = template.rlike(p) if known is None else known | template.rlike(p)
    return (
        F.when(low.rlike(tx.words_regex(tx.MISSING_DATA_PATTERN)), "data_gap")
        .when(low.rlike(tx.words_regex(tx.FORECAST_PATTERN)), "forecast")
        .when(partial & low.rlike(tx.words_regex(tx.COMPARISON_PATTERN)) & ~per_day, "incomplete_month")
        .when(known, "known_pattern")
        .otherwise("free")
    )


def route_questions(questions: DataFrame, keys: list[str], text: str) -> DataFrame:
    # Both forms are columns of their own, so that the many patterns share them.
    forms = questions.select(*keys, F.lower(F.col(text)).alias("_low"), normalise_question(F.col(text)).alias("_template"))
    return forms.select(*keys, route(F.col("_low"), F.col("_template")).alias("route"))


def metric_kinds(labels: DataFrame, label: str) -> DataFrame:
    return labels.select(label, tx.metric_kind(F.col(label)).alias("kind"))


def month_labels(months: DataFrame, month: str) -> DataFrame:
    d = F.to_date(F.concat(F.col(month), F.lit("-01")))
    return months.select(
        F.lit("invoice_month").alias("kind"),
        F.col(month).alias("label"),
        F.lower(F.date_format(d, "MMMM yyyy")).alias("long_label"),
        F.lower(F.date_format(d, "MMM yyyy")).alias("short_label"),
    )


def id_labels(ids: DataFrame, col: str, kind: str) -> DataFrame:
    """Integer-looking ids as plain integers ('18102.0' -> '18102')."""
    if ids.schema[col].dataType.typeName() in ("byte", "short", "integer", "long"):
        as_int = F.col(col).cast("string")  # never through DOUBLE, which rounds above 2^53
    else:
        v = F.col(col).try_cast("double")
        as_int = F.when(v == F.floor(v), v.try_cast("bigint").cast("string"))
    label = F.coalesce(as_int, F.col(col).cast("string"))
    return ids.select(
        F.lit(kind).alias("kind"), label.alias("label"),
        F.lit(None).cast("string").alias("long_label"), F.lit(None).cast("string").alias("short_label"),
    )
