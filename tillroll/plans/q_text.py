"""Text jobs over the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evidence as ev
from ..operators import mentions, textjobs
from ..sources.tables import read_table
from ..sources.warehouse import warehouse
from .catalog import query
from .q_evidence import EVIDENCE_CTES, claims_table, evidence_table, kind_sql, near_sql


def _docs(spark, sf):
    return read_table(spark, sf, "documents", "doc_id", "text")


def _prose(spark, sf):
    """The texts whose numbers are checked: documents and the claims' own texts."""
    docs = _docs(spark, sf).select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("text_id"), "text")
    claims = claims_table(spark, sf).select(F.concat(F.lit("claim:"), F.col("claim_id")).alias("text_id"), "text")
    return docs.unionByName(claims)


def _declared(spark, sf):
    """Declared values: every number an answer states (the claims table)."""
    return claims_table(spark, sf).select("value").where("value IS NOT NULL")


def _supported(spark, sf):
    """Values that count as support: those of claims that passed their checks."""
    claims = claims_table(spark, sf)
    status = ev.claim_status(claims, evidence_table(spark, sf)).filter(F.col("status") == "supported")
    return claims.join(status.select("claim_id"), "claim_id", "left_semi").select("value").where("value IS NOT NULL")


def _labels(spark, sf):
    """Row labels of the results: digits inside them are no quantities."""
    return evidence_table(spark, sf).select("label_key", "row").distinct()


def _number_sql() -> str:
    """RE2 has no look-behind: the character before a token is a group of its own
    (a token ends in a word character, so no two tokens need the same one)."""
    number = tx.NUMBER_PATTERN.replace(r"(?<![\w.])", "").replace(r"\d", r"\p{Nd}").replace(r"\s", tx.SPACE)
    scale = "CASE lower(regexp_extract(token, '[A-Za-z]+$')) " + " ".join(f"WHEN '{w}' THEN {v:.1f}" for w, v in tx.SCALES.items()) + " ELSE 1.0 END"
    return rf"""
WITH found AS (SELECT doc_id, regexp_extract_all(text, '(^|[^\pL\pN_.])({number})', 2) AS tokens FROM documents),
numbered AS (SELECT doc_id, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token FROM found)
SELECT doc_id, pos, token,
       TRY_CAST(replace(replace(regexp_replace(token, '{tx.SPACE}*[A-Za-z]+$', ''), ',', ''), '−', '-') AS DOUBLE) * CAST({scale} AS DOUBLE) AS value
FROM numbered"""


@query("text_number_tokens", _number_sql())
def text_number_tokens(spark, sf):
    """Every number in every document, with sign, separators, exponent and scale."""
    return textjobs.number_tokens(_docs(spark, sf), "doc_id", "text")


# Number spans for RE2: the character before a token belongs to the match, so the
# text between matches and the matches themselves add up to the offsets.
_RE2_NUMBER = "(^|[^\\pL\\pN_.])(" + tx.NUMBER_PATTERN.replace(r"(?<![\w.])", "").replace(r"\d", r"\p{Nd}").replace(r"\s", tx.SPACE) + ")"
_YEAR_AT_END = r"(?i)(in|during|for|year|" + "|".join(tx.MONTHS) + r")\s*$"


def spans_ctes(prose: str) -> str:
    """CTEs for the number spans of ``prose`` (text_id, t), with what supports them."""
    scale = "CASE lower(regexp_extract(token, '[A-Za-z]+$')) " + " ".join(f"WHEN '{w}' THEN {v:.1f}" for w, v in tx.SCALES.items()) + " ELSE 1.0 END"
    return rf"""
prose AS ({prose}),
cut AS (
  SELECT text_id, t, regexp_extract_all(t, '{_RE2_NUMBER}', 0) AS whole, regexp_extract_all(t, '{_RE2_NUMBER}', 2) AS tokens, string_split_regex(t, '{_RE2_NUMBER}') AS gaps
  FROM prose WHERE t IS NOT NULL),
parts AS (
  SELECT text_id, t, unnest(range(1, len(tokens) + 1)) AS i, unnest(tokens) AS token, unnest(whole) AS w, unnest(gaps[:len(tokens)]) AS gap FROM cut),
placed AS (
  SELECT text_id, t, token, SUM(len(gap) + len(w)) OVER (PARTITION BY text_id ORDER BY i) - len(token) AS start FROM parts),
around AS (
  SELECT *, CAST(start AS BIGINT) + len(token) AS stop, substr(t, 1, CAST(start AS BIGINT)) AS head, substr(t, CAST(start AS BIGINT) + len(token) + 1) AS tail,
         TRY_CAST(replace(replace(regexp_replace(token, '{tx.SPACE}*[A-Za-z]+$', ''), ',', ''), '−', '-') AS DOUBLE) * CAST({scale} AS DOUBLE) AS value
  FROM placed),
label_words AS (SELECT DISTINCT label_key, lower("row") AS label FROM evidence),
named_ids AS (SELECT label FROM label_words WHERE label_key = 'customer_id'),
label_places AS (
  SELECT text_id, unnest(range(1, len(t) - len(label) + 2)) AS i, t, label FROM prose, label_words
  WHERE regexp_matches(t, '\p{{Nd}}') AND label_key <> 'customer_id' AND contains(lower(t), label)),
label_found AS (
  SELECT text_id, i - 1 AS s, i - 1 + len(label) AS e FROM label_places
  WHERE lower(substr(t, i, len(label))) = label AND NOT regexp_matches(CASE WHEN i = 1 THEN '' ELSE substr(t, i - 1, 1) END, '[\pL\pN_]')
    AND NOT regexp_matches(substr(t, i + len(label), 1), '[\pL\pN_]')),
spans AS (
  SELECT a.text_id, CAST(start AS BIGINT) AS start, stop, token, value, t,
    (regexp_full_match(token, '(19|20)\d{{2}}') AND (
        regexp_matches(tail, '^-\d{{2}}([^\pL\pN_]|$)') OR regexp_matches(head, '{_YEAR_AT_END}')
        OR regexp_matches(head, '(?i)(our|the|its|their)\s*$') AND regexp_matches(tail, '(?i)^\s+(revenue|sales|financial results|reporting period)([^\pL\pN_]|$)'))
     OR regexp_full_match(token, '\d{{2}}') AND regexp_matches(head, '(^|[^\pL\pN_])(19|20)\d{{2}}-(\d{{2}}-)?$')
    ) AS date_context,
    EXISTS (SELECT 1 FROM label_found l WHERE l.text_id = a.text_id AND l.s <= a.start AND a.stop <= l.e)
      OR regexp_matches(head, '(?i)(^|[^\pL\pN_])customer([ _]id)?\s+$') AND regexp_replace(token, '\.0+$', '') IN (SELECT label FROM named_ids) AS label
  FROM around a WHERE value IS NOT NULL)"""


def _near_any(values: str) -> str:
    return f"EXISTS (SELECT 1 FROM {values} d WHERE {near_sql('s.value', 'd.value')})"


UNDECLARED_SQL = f"""
WITH {spans_ctes(
    r"SELECT 'doc:' || CAST(doc_id AS VARCHAR) AS text_id, regexp_replace(text, '(?i)\[call\s+\d+\]', '', 'g') AS t FROM documents "
    r"UNION ALL SELECT 'claim:' || claim_id, regexp_replace(text, '(?i)\[call\s+\d+\]', '', 'g') FROM claims")}
SELECT text_id, start, token, value FROM spans s WHERE NOT date_context AND NOT label AND NOT {_near_any('claims')}"""

_FINDINGS = rf"""regexp_replace(regexp_replace(regexp_replace(text, '(?i)\[call\s+\d+\]', '', 'g'), '^{tx.SPACE}+|{tx.SPACE}+$', '', 'g'),
  '(?i)\bcustomer_id(\s+\d)', 'Customer\1', 'g')"""

REDACT_SQL = f"""
WITH passed AS (SELECT c.value FROM claims c JOIN status st ON st.claim_id = c.claim_id WHERE st.status = 'supported'),
{spans_ctes(f"SELECT 'doc:' || CAST(doc_id AS VARCHAR) AS text_id, {_FINDINGS} AS t FROM documents UNION ALL SELECT 'claim:' || claim_id, {_FINDINGS} FROM claims")},
bad AS (
  SELECT text_id, t, start, stop, coalesce(lag(stop) OVER (PARTITION BY text_id ORDER BY start), 0) AS since
  FROM spans s WHERE NOT date_context AND NOT label AND NOT {_near_any('passed')}),
rebuilt AS (
  SELECT text_id, string_agg(substr(t, since + 1, start - since) || '[unverified]', '' ORDER BY start) || substr(any_value(t), max(stop) + 1) AS redacted FROM bad GROUP BY text_id)
SELECT p.text_id, coalesce(r.redacted, p.t) AS text FROM prose p LEFT JOIN rebuilt r ON r.text_id = p.text_id"""


@query("text_undeclared_numbers", UNDECLARED_SQL, ctes=EVIDENCE_CTES)
def text_undeclared_numbers(spark, sf):
    """Numbers of documents and claim texts that no claim declares."""
    return textjobs.undeclared_numbers(_prose(spark, sf), "text_id", "text", _declared(spark, sf), "value", _labels(spark, sf))


@query("text_redact_numbers", REDACT_SQL, ctes=EVIDENCE_CTES)
def text_redact_numbers(spark, sf):
    """Documents and claim texts without the numbers that no supported claim states."""
    return textjobs.redact_numbers(_prose(spark, sf), "text_id", "text", _supported(spark, sf), "value", _labels(spark, sf))


@query("text_strip_trace", rf"""
SELECT doc_id,
       regexp_replace(
         regexp_replace(regexp_replace(text, '(?i)\[call\s+(?:\d+|\[unverified\])\]', '', 'g'),
                        '(?is)\b(?:from_call\s*:|from[_ ]run_sql\b).*', '', 'g'),
         '^{tx.SPACE}+|{tx.SPACE}+$', '', 'g') AS text
FROM documents""")
def text_strip_trace(spark, sf):
    return textjobs.strip_trace(_docs(spark, sf), "doc_id", "text")


def _periods_sql() -> str:
    """Periods by the places of years and months; edges are looked at one by one."""
    edge, months = r"(^|[^\pL\pN_])", "|".join(tx.MONTHS)
    number = " ".join(f"WHEN '{m}' THEN '-{i + 1:02d}'" for i, m in enumerate(tx.MONTHS))

    def places(name: str, pattern: str) -> str:
        match = f"'{edge}({pattern})'"
        return rf"""
{name}_cut AS (
  SELECT doc_id, t, regexp_extract_all(t, {match}, 0) AS whole, regexp_extract_all(t, {match}, 2) AS tokens, string_split_regex(t, {match}) AS gaps FROM low),
{name}_parts AS (
  SELECT doc_id, t, unnest(range(1, len(tokens) + 1)) AS i, unnest(tokens) AS token, unnest(whole) AS w, unnest(gaps[:len(tokens)]) AS gap FROM {name}_cut),
{name}_all AS (SELECT doc_id, t, token, CAST(SUM(len(gap) + len(w)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS stop FROM {name}_parts),
{name} AS (SELECT * FROM {name}_all WHERE NOT regexp_matches(substr(t, stop + 1, 1), '[\pL\pN_]'))"""

    return rf"""
WITH low AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),{places("yr", r"(?:19|20)\d{2}")},{places("iso", r"(?:19|20)\d{2}-\d{2}")},{places("mon", months)},
only_year AS (SELECT doc_id, CASE WHEN COUNT(DISTINCT token) = 1 THEN MIN(token) END AS year FROM yr GROUP BY doc_id),
own AS (SELECT *, regexp_extract(substr(t, stop + 1), '^\s+((?:19|20)\d{{2}})([^\pL\pN_]|$)', 1) AS year FROM mon),
pairs AS (
  SELECT *, lead(stop - len(token)) OVER w AS next_start, lead(year) OVER w AS next_year FROM own WINDOW w AS (PARTITION BY doc_id ORDER BY stop)),
named AS (
  SELECT p.doc_id, stop, CASE token {number} END AS mm,
         coalesce(nullif(p.year, ''), CASE WHEN regexp_matches(substr(t, stop + 1, next_start - stop), '^[\s,]*((to|and|with|versus|vs)[\s,]*)?$') THEN nullif(next_year, '') END, o.year) AS year
  FROM pairs p LEFT JOIN only_year o ON o.doc_id = p.doc_id),
found AS (
  SELECT doc_id, 0 AS part, stop, token AS period FROM iso UNION ALL SELECT doc_id, 1, stop, year || mm FROM named WHERE year IS NOT NULL),
firsts AS (SELECT doc_id, period, MIN((part, stop)) AS place FROM found GROUP BY doc_id, period)
SELECT d.doc_id, coalesce(list(f.period ORDER BY f.place) FILTER (WHERE f.period IS NOT NULL), []) AS periods
FROM documents d LEFT JOIN firsts f ON f.doc_id = d.doc_id GROUP BY d.doc_id"""


@query("text_requested_periods", _periods_sql())
def text_requested_periods(spark, sf):
    return textjobs.requested_periods(_docs(spark, sf), "doc_id", "text")


def _words_sql(pattern: str) -> str:
    return tx.words_regex(pattern).replace("'", "''")


def _route_sql() -> str:
    t = f"regexp_replace(trim(regexp_replace(lower(text), '{tx.SPACE}+', ' ', 'g')), '[?.]+$', '')"
    partial = " OR ".join(f"contains(l, '{m}')" for m in textjobs.PARTIAL_MONTH_MENTIONS)
    # Python's \d is any decimal digit: \p{Nd} in RE2.
    known = " OR ".join(f"regexp_matches(t, '{p}')" for p in (k.replace(r"\d", r"\p{Nd}") for k in textjobs.KNOWN_PATTERNS))
    return f"""
WITH q AS (SELECT conv_id, turn, lower(text) AS l, {t} AS t FROM conversations)
SELECT conv_id, turn,
  CASE WHEN regexp_matches(l, '{_words_sql(tx.MISSING_DATA_PATTERN)}') THEN 'data_gap'
       WHEN regexp_matches(l, '{_words_sql(tx.FORECAST_PATTERN)}') THEN 'forecast'
       WHEN ({partial}) AND regexp_matches(l, '{_words_sql(tx.COMPARISON_PATTERN)}')
            AND NOT (contains(l, 'per trading day') OR contains(l, 'per day')) THEN 'incomplete_month'
       WHEN {known} THEN 'known_pattern'
       ELSE 'free' END AS route
FROM q"""


@query("text_route_questions", _route_sql())
def text_route_questions(spark, sf):
    """Label every turn: data gap, forecast, incomplete month, known pattern, free."""
    conv = read_table(spark, sf, "conversations", "conv_id", "turn", "text")
    return textjobs.route_questions(conv, ["conv_id", "turn"], "text")


def _metric_sql() -> str:
    return f"SELECT text, {kind_sql('text')} AS kind FROM (SELECT DISTINCT text FROM claims)"


@query("text_metric_kind", _metric_sql(), ctes=EVIDENCE_CTES)
def text_metric_kind(spark, sf):
    labels = claims_table(spark, sf).select("text").distinct()
    return textjobs.metric_kinds(labels, "text")


_EXCLUDING = tx.EXCLUSION_PREFIX.replace(r"\s", tx.SPACE)

COUNTRY_SQL = rf"""
WITH texts AS (
  SELECT claim_id AS key, lower(text) AS t FROM claims
  UNION ALL SELECT 'conv:' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR), lower(text) FROM conversations),
own AS (SELECT DISTINCT country, lower(country) AS name FROM dim_customer WHERE country IS NOT NULL),
names AS (SELECT * FROM own UNION ALL SELECT o.country, a.alias FROM own o
  JOIN (VALUES {", ".join(f"('{a}', '{c.lower()}')" for a, c in tx.COUNTRY_ALIASES.items())}) a(alias, name) ON a.name = o.name),
listed AS (SELECT string_agg(DISTINCT regexp_escape(name), '|' ORDER BY regexp_escape(name) DESC) AS any_name FROM names),
places AS (
  SELECT key, t, country, name, unnest(range(1, len(t) - len(name) + 2)) AS i FROM texts, names WHERE contains(t, name)),
found AS (
  SELECT key, country, substr(t, 1, i - 1) AS prefix FROM places
  WHERE substr(t, i, len(name)) = name AND NOT regexp_matches(substr(t, i - 1, CASE WHEN i = 1 THEN 0 ELSE 1 END), '[\pL\pN_]')
    AND NOT regexp_matches(substr(t, i + len(name), 1), '[\pL\pN_]')),
judged AS (
  SELECT key, country, regexp_matches(prefix, '{_EXCLUDING}(?:(?:' || any_name || '){tx.SPACE}*(?:,|and|or){tx.SPACE}*)*$') AS no FROM found, listed)
SELECT key, list_sort(coalesce(list(DISTINCT country) FILTER (WHERE NOT no), [])) AS included,
       list_sort(coalesce(list(DISTINCT country) FILTER (WHERE no), [])) AS excluded
FROM judged GROUP BY key"""


@query("text_country_mentions", COUNTRY_SQL, ctes=EVIDENCE_CTES)
def text_country_mentions(spark, sf):
    """Countries named by each claim text and turn, included or excluded."""
    wh = warehouse(spark, sf)
    claims = claims_table(spark, sf).select(F.col("claim_id").alias("key"), "text")
    turns = read_table(spark, sf, "conversations", "conv_id", "turn", "text").select(
        F.concat_ws(":", F.lit("conv"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), "text"
    )
    return mentions.country_mentions(claims.unionByName(turns), "key", "text", wh.dim_customer, "country")


@query("label_normalise", """
SELECT 'invoice_month' AS kind, invoice_month AS label,
       lower(strftime(CAST(invoice_month || '-01' AS DATE), '%B %Y')) AS long_label,
       lower(strftime(CAST(invoice_month || '-01' AS DATE), '%b %Y')) AS short_label
FROM dim_month
UNION ALL
SELECT 'customer_id', CAST(customer_id AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM dim_customer""")
def label_normalise(spark, sf):
    wh = warehouse(spark, sf)
    return textjobs.month_labels(wh.dim_month, "invoice_month").unionByName(
        textjobs.id_labels(wh.dim_customer, "customer_id", "customer_id")
    )
