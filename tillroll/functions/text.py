"""Text expressions.

Number spans, periods and labels are column expressions (regexp on the JVM):
offsets are running sums over the tokens and the text between them, and what
surrounds a match is captured by zero-width groups of the same pattern.
Dictionary phrases are found by joins (``operators.mentions``).

The reference's patterns are kept in Python's ``re`` form. For the JVM, ``jvm_pattern`` rewrites Python's ``\\w``,
``\\d``, ``\\s`` and ``\\b`` as explicit Unicode classes, because the JVM's own
Unicode classes differ from Python's (combining marks, superscripts,
information separators). Word lists in the routing rules use the same
letters-digits-underscore edge (``[^\\pL\\pN_]``), which SQL engines read
alike.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference's vocabulary) -----------------------------
# Numbers in prose: optional sign, thousands separators or plain digits, decimals,
# exponent, and an optional scale word.
NUMBER_PATTERN = (
    r"(?<![\w.])[-+−]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:[eE][+-]?\d+)?"
    r"(?:\s*(?:billion|million|thousand|bn|[kKmM])\b)?"
)
SCALE_PATTERN = r"\s*(billion|million|thousand|bn|[kKmM])$"
SCALES = {"billion": 1e9, "bn": 1e9, "million": 1e6, "m": 1e6, "thousand": 1e3, "k": 1e3}
YEAR_PATTERN = r"(?:19|20)\d{2}"
MONTHS = ["january", "february", "march", "april", "may", "june", "july",
          "august", "september", "october", "november", "december"]
NAMED_YEAR_PREFIX = r"(?:in|during|for|year|" + "|".join(MONTHS) + r")\s*$"
REPORTING_PREFIX = r"(?:our|the|its|their)\s*$"
REPORTING_SUFFIX = r"\s+(?:revenue|sales|financial results|reporting period)\b"
# Words of questions that the data cannot answer, of forecasts and of comparisons.
MISSING_DATA_PATTERN = (
    "profit|profits|margin|margins|cost|costs|cogs|discounts?|promotions?|campaigns?|marketing|"
    "demographics?|competitors?|customer age|web traffic|website traffic"
)
FORECAST_PATTERN = "forecast|predict|prediction|next quarter|next year|next month"
COMPARISON_PATTERN = "compare|compared|comparison|versus|vs|beat|change|growth|decline|increase|decrease|difference|drop"
# Short forms that name a country, used only when that country is in the list.
COUNTRY_ALIASES = {"uk": "United Kingdom", "u.k.": "United Kingdom"}
EXCLUSION_PREFIX = r"(?:outside(?:\s+of)?|excluding|except(?:\s+for)?|other\s+than|not\s+(?:from|in))\s+(?:the\s+)?"
METRIC_RULES = [
    ("percentage", r"%|\bpct\b|percent|percentage|\bshare\b|\brate\b|\bratio\b"),
    ("money", r"average order value|\baov\b|revenue|\bgbp\b|£|\bpounds?\b"),
    ("days", r"trading days?|\bdays?\b"),
    ("orders", r"\borders?\b|\binvoices?\b"),
    ("units", r"\bunits?\b|\bquantity\b"),
    ("customers", r"\bcustomers?\b|\bbuyers?\b"),
]
PER_DAY = r"per\s+(?:trading\s+)?day|/\s*day|\bdaily\b"
TRACE_CALL = r"(?i)\[call\s+(?:\d+|\[unverified\])\]"
TRACE_TAIL = r"(?is)\b(?:from_call\s*:|from[_ ]run_sql\b).*"
# Prose checked for numbers: '[call n]' markers are removed first, and the
# redacted findings are trimmed and show 'customer_id 123' as 'Customer 123'.
# ``SPACE`` is the whitespace set of Python's str.isspace, written out so the
# JVM and RE2 (the SQL oracle) read it the same way: ASCII controls \t-\r,
# the four information separators, NEL, every space separator, and the line
# and paragraph separators.
_SPACE_SET = r"\t\n\x0b\x0c\r\x1c-\x1f\x85\p{Zs}\x{2028}\x{2029}"
SPACE = f"[{_SPACE_SET}]"
# The same set as characters, for trimming without a regex (none lies above U+3000).
SPACE_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# The two patterns as Python writes them; ``jvm_pattern`` translates them.
CALL_MARKER = r"(?i)\[call\s+\d+\]"
CUSTOMER_ID_LABEL = r"(?i)\bcustomer_id(?=\s+\d)"


def words_regex(pattern: str) -> str:
    """``pattern`` as whole words of lower-cased text: not preceded or followed
    by a letter, digit or ``_`` of any script."""
    return r"(^|[^\pL\pN_])(" + pattern + r")([^\pL\pN_]|$)"


def strip_ends(c: Column) -> Column:
    """Python's strip(): leading and trailing whitespace (``SPACE_CHARS``)
    removed by a character-set trim, which scans only the two ends."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def strip_trace(text: Column) -> Column:
    """Remove ``[call n]`` markers and everything from a ``from_call:`` tail."""
    no_calls = F.regexp_replace(text, jvm_pattern(TRACE_CALL), "")
    return strip_ends(F.regexp_replace(no_calls, jvm_pattern(TRACE_TAIL), ""))


# Python's ``re`` classes on text, as explicit JVM classes: a word character
# is a letter, a number or '_' (str.isalnum), a digit is a decimal digit, and
# whitespace is the str.isspace set. The JVM's own Unicode \w counts
# combining marks as word characters and Python does not, so the shared
# patterns are translated rather than run with (?U).
_PY_WORD = r"\p{L}\p{N}_"
_PY_CLASSES = {"w": (_PY_WORD, f"[{_PY_WORD}]"), "d": (r"\p{Nd}", r"\p{Nd}"),
               "s": (_SPACE_SET, SPACE)}
_PY_BOUNDARY = f"(?:(?<=[{_PY_WORD}])(?![{_PY_WORD}])|(?<![{_PY_WORD}])(?=[{_PY_WORD}]))"


def _word(c: str) -> bool:
    return bool(c) and (c.isalnum() or c == "_")


def _starts_with_word(pattern: str, j: int) -> bool:
    """Does the pattern at ``j`` always begin with a literal word character:
    either one, or a ``(?:...)`` group whose top-level alternatives all do?"""
    if _word(pattern[j:j + 1]):
        return True
    if not pattern.startswith("(?:", j):
        return False
    depth, k, starts = 0, j + 3, [j + 3]
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 2
            continue
        if c == "(":
            depth += 1
        elif c == ")":
            if depth == 0:
                return all(_word(pattern[s:s + 1]) for s in starts)
            depth -= 1
        elif c == "|" and depth == 0:
            starts.append(k + 1)
        k += 1
    return False


def jvm_pattern(pattern: str) -> str:
    """A Python ``re`` pattern rewritten so the JVM matches the same text:
    \\w, \\d, \\s and \\b become explicit Unicode classes (inside or outside
    a character class); everything else is kept as written."""
    out, i, in_class = ["(?U)"], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            e = pattern[i + 1]
            if e in _PY_CLASSES:
                out.append(_PY_CLASSES[e][0 if in_class else 1])
            elif e == "b" and not in_class:
                # Next to a literal word character a boundary only needs the
                # other side to be a non-word character: one cheap check.
                prev = pattern[i - 1:i] if i else ""
                if _starts_with_word(pattern, i + 2):
                    out.append(f"(?<![{_PY_WORD}])")
                elif _word(prev) and pattern[i - 2:i - 1] != "\\":
                    out.append(f"(?![{_PY_WORD}])")
                else:
                    out.append(_PY_BOUNDARY)
            else:
                out.append(c + e)
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class:
            in_class = False
        out.append(c)
        i += 1
    return "".join(out)


def drop_call_markers(text: Column) -> Column:
    return F.regexp_replace(text, jvm_pattern(CALL_MARKER), "")


def findings_text(text: Column) -> Column:
    """The prose that redaction rewrites: call markers removed, ends trimmed,
    customer ids labelled ``Customer``."""
    trimmed = strip_ends(drop_call_markers(text))
    return F.regexp_replace(trimmed, jvm_pattern(CUSTOMER_ID_LABEL), "Customer")


def lower_in_place(text: Column) -> Column:
    """Lower case with the same number of code points: only a dotted capital I
    would become two, so it is replaced first."""
    return F.lower(F.translate(text, "\u0130", "i"))


def number_tokens(text: Column) -> Column:
    """All number tokens of a text, in order (JVM regex, Unicode classes)."""
    return F.regexp_extract_all(text, F.lit(jvm_pattern(NUMBER_PATTERN)), 0)


_DIGITS = "".join(c for c in map(chr, range(128, 0x110000)) if unicodedata.category(c) == "Nd")


def token_value(token: Column) -> Column:
    """Parse one token: drop separators, map the minus sign and every script's
    decimal digits, apply the scale."""
    t = F.translate(token, "−" + _DIGITS + ",", "-" + "".join(str(unicodedata.decimal(c)) for c in _DIGITS))
    scale_word = F.lower(F.regexp_extract(t, jvm_pattern(SCALE_PATTERN), 1))
    number = F.regexp_replace(t, jvm_pattern(SCALE_PATTERN), "")
    scale = F.coalesce(*[F.when(scale_word == k, F.lit(v)) for k, v in SCALES.items()], F.lit(1.0))
    return number.try_cast("double") * scale


# ---- number spans ------------------------------------------------------------------------

# A number token with what its neighbourhood says about dates, all zero-width:
# group 1 is the month that follows a year, group 2 the date that ends here.
DATED_NUMBER = (
    NUMBER_PATTERN
    + rf"(?:(?=(-\d{{2}}\b))|)(?:(?<=(\b{YEAR_PATTERN}-\d{{2}}(?:-\d{{2}})?))\b|)"
)
# Token lengths are summed in runs of this many, so that appending an offset
# copies a short array however many numbers a text holds.
_RUN = 512


def _starts(gaps: Column, tokens: Column) -> Column:
    """Code point offset of each token; ``gaps[i]`` is the text before token i."""
    sizes = F.transform(tokens, lambda t, i: F.struct(F.char_length(F.get(gaps, i)).alias("gap"), F.char_length(t).alias("len")))

    def run(at: Column, c: Column) -> Column:
        zero = F.struct(at.alias("at"), F.array().cast("array<int>").alias("starts"))
        return F.aggregate(
            F.slice(sizes, c * _RUN + 1, F.lit(_RUN)), zero,
            lambda r, x: F.struct((r["at"] + x["gap"] + x["len"]).alias("at"), F.array_append(r["starts"], r["at"] + x["gap"]).alias("starts")),
        )

    def join(s: Column, c: Column) -> Column:
        done = F.transform(F.array(run(s["at"], c)), lambda r: F.struct(r["at"].alias("at"), F.array_append(s["runs"], r["starts"]).alias("runs")))
        return F.get(done, F.lit(0))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("runs"))
    runs = F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / _RUN).cast("int"))
    return F.when(F.size(tokens) > 0, F.flatten(F.aggregate(runs, zero, join)["runs"]))


def number_spans(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, end, token, value, date_context): the number spans of each
    text, 0-based [start, end) in code points.

    A number is calendar context as part of a ``YYYY-MM[-DD]`` date, or as a
    bare year after a month name or a word such as 'in', or between 'our' and
    'revenue' and their like. The words are looked for in the whole text
    between a number and its neighbours, not in a window of characters."""
    pattern = F.lit(jvm_pattern(DATED_NUMBER))
    found = texts.filter(F.col(text).rlike(r"\p{Nd}")).select(
        key,
        F.split(F.col(text), jvm_pattern(NUMBER_PATTERN), -1).alias("gaps"),
        *[F.regexp_extract_all(F.col(text), pattern, F.lit(g)).alias(n) for g, n in enumerate(["tokens", "months", "dates"])],
    )
    rows = found.withColumn("starts", _starts(F.col("gaps"), F.col("tokens"))).select(
        key,
        F.explode(F.transform("tokens", lambda t, i: F.struct(
            F.get("starts", i).alias("start"), t.alias("token"), F.get("gaps", i).alias("before"), F.get("gaps", i + 1).alias("after"),
            (F.get("months", i) != "").alias("month_follows"), (F.get("dates", i) != "").alias("ends_date"),
        ))).alias("s"),
    ).select(key, "s.*")
    year = F.col("token").rlike(jvm_pattern(f"^{YEAR_PATTERN}$"))
    named = F.col("before").rlike(jvm_pattern("(?i)" + NAMED_YEAR_PREFIX))
    reported = F.col("before").rlike(jvm_pattern("(?i)" + REPORTING_PREFIX)) & F.col("after").rlike(jvm_pattern("(?i)^" + REPORTING_SUFFIX))
    day_or_month = F.col("token").rlike(r"^\p{Nd}{2}$")
    return rows.select(
        key, "start", (F.col("start") + F.char_length("token")).alias("end"), "token", token_value(F.col("token")).alias("value"),
        ((year & (F.col("month_follows") | named | reported)) | (day_or_month & F.col("ends_date"))).alias("date_context"),
    ).filter("value IS NOT NULL")


# ---- periods -----------------------------------------------------------------------------

_MONTH = "(" + "|".join(MONTHS) + ")"
# A month, its own year, and the year of the month that it is listed with.
MONTH_PHRASE = (
    rf"\b{_MONTH}(?:\s+({YEAR_PATTERN}))?\b"
    rf"(?:(?=[\s,]*(?:(?:to|and|with|versus|vs)[\s,]*)?\b(?:{'|'.join(MONTHS)})\s+({YEAR_PATTERN})\b)|)"
)


def requested_periods(text: Column) -> Column:
    """Distinct periods a text names: ``YYYY-MM`` first, then months with their
    own year, else the year of the month they are listed with, else the only
    year of the text. A null text names none."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def every(pattern: str, group: int = 0) -> Column:
        return F.regexp_extract_all(low, F.lit(jvm_pattern(pattern)), F.lit(group))

    years = F.array_distinct(every(rf"\b{YEAR_PATTERN}\b"))
    only = F.when(F.size(years) == 1, F.get(years, F.lit(0)))
    number = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, f"-{i + 1:02d}")])
    named = F.transform(
        F.arrays_zip(*[every(MONTH_PHRASE, g).alias(n) for g, n in ((1, "month"), (2, "own"), (3, "listed"))]),
        lambda x: F.concat(F.coalesce(F.nullif(x["own"], F.lit("")), F.nullif(x["listed"], F.lit("")), only), F.element_at(number, x["month"])),
    )
    found = F.array_distinct(F.concat(every(rf"\b{YEAR_PATTERN}-\d{{2}}\b"), F.array_compact(named)))
    # Every period needs a year, and two plain searches are far cheaper than the patterns.
    return F.when(F.contains(text, F.lit("19")) | F.contains(text, F.lit("20")), found).otherwise(F.array().cast("array<string>"))


# ---- measure labels ------------------------------------------------------------------------

def metric_kind(label: Column) -> Column:
    """Classify a measure label: percentage, money, money_per_day, days, orders,
    units, customers (NULL when unknown). Labels are lower-cased, '_' -> ' '."""
    t = strip_ends(F.regexp_replace(F.lower(label), "_", " "))
    per_day = jvm_pattern(PER_DAY)
    out = None
    for kind, rx in METRIC_RULES:
        value = F.when(t.rlike(per_day), F.lit("money_per_day")).otherwise(F.lit("money")) if kind == "money" else F.lit(kind)
        rx = jvm_pattern(rx)
        out = F.when(t.rlike(rx), value) if out is None else out.when(t.rlike(rx), value)
    return out
