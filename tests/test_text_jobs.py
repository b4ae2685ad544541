"""The text jobs with look-behind patterns and character offsets, checked whole
against a brute force over the same small fixture:
every text is collected and processed in plain Python, with Python's own
regex engine standing in for the JVM expressions, and the near-equality
support check done pair by pair."""

import re

import pytest

import __spark_entry__ as entry
from tillroll.functions import text as tx
from tillroll.operators import textjobs
from tillroll.sources.tables import read_table

QUERIES = entry.queries()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents", "doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in rows]


@pytest.fixture(scope="module")
def declared(spark, sf_dir):
    from tillroll.plans.q_evidence import claims_table

    return sorted({r.value for r in claims_table(spark, sf_dir).select("value").collect() if r.value is not None})


@pytest.fixture(scope="module")
def supported(spark, sf_dir, duck):
    """Values of the claims that pass their checks, by the oracle's status."""
    from tillroll.plans.q_evidence import claims_table

    rows = duck.execute(entry.oracle_sql()["claim_status"]).df()
    ids = set(rows[rows.status == "supported"].claim_id)
    every = claims_table(spark, sf_dir).select("claim_id", "value").collect()
    assert 0 < len(ids) < len(every)
    return sorted({r.value for r in every if r.claim_id in ids and r.value is not None})


def _near(a, b):
    return abs(a - b) <= max(0.011, 1e-6 * max(abs(a), abs(b)))


def _declared_hit(value, declared):
    # Brute force over every declared value (the fixture is small).
    return any(_near(value, d) for d in declared)


def _drop_calls(text):
    return re.sub(r"\[call\s+\d+\]", "", text, flags=re.I)


def _findings(text):
    # call markers out, Python's strip(), then the customer id label
    return re.sub(r"\bcustomer_id(?=\s+\d)", "Customer", _drop_calls(text).strip(), flags=re.I)


def _value(token):
    number, word = re.fullmatch(r"(.*?)\s*([A-Za-z]{2,}|[kKmM])?", token).groups()
    scale = {None: 1.0, "k": 1e3, "thousand": 1e3, "m": 1e6, "million": 1e6, "bn": 1e9, "billion": 1e9}
    return float(number.replace(",", "").replace("\u2212", "-")) * scale[word and word.lower()]


def _spans(text):
    """Number spans by marking the characters that dates cover."""
    dated = {k for m in re.finditer(r"\b(?:19|20)\d\d-\d\d(?:-\d\d)?\b", text) for k in range(*m.span())}
    out = []
    for m in re.finditer(tx.NUMBER_PATTERN, text):
        calendar = dated.issuperset(range(*m.span()))
        if re.fullmatch(r"(?:19|20)\d\d", m[0]):
            head, tail = text[: m.start()].lower().rstrip(), text[m.end():].lower()
            named = head.endswith(("in", "during", "for", "year", *tx.MONTHS))
            reported = head.endswith(("our", "the", "its", "their")) and re.match(
                r"\s+(revenue|sales|financial results|reporting period)\b", tail)
            calendar = calendar or named or bool(reported)
        out.append({"start": m.start(), "end": m.end(), "token": m[0], "value": _value(m[0]), "date_context": calendar})
    return out


def _periods(text):
    """Periods word by word: months wait for a year while only list words follow."""
    low = (text or "").lower()
    found = re.findall(r"\b(?:19|20)\d\d-\d\d\b", low)
    years = set(re.findall(r"\b(?:19|20)\d\d\b", low))
    months = list(re.finditer(r"\b(" + "|".join(tx.MONTHS) + r")\b", low))
    for k, m in enumerate(months):
        at, year = k, None
        while at < len(months):
            own = re.match(r"\s+((?:19|20)\d\d)\b", low[months[at].end():])
            if own:
                year = own[1]
                break
            if at > k or at + 1 == len(months):
                break
            words = re.split(r"[\s,]+", low[months[at].end():months[at + 1].start()])
            if [w for w in words if w] not in ([], ["to"], ["and"], ["with"], ["versus"], ["vs"]):
                break
            at += 1
        year = year or (min(years) if len(years) == 1 else None)
        if year:
            found.append(f"{year}-{tx.MONTHS.index(m[0]) + 1:02d}")
    return list(dict.fromkeys(found))


EDGES = [
    "Revenue was 120, growth 12%, margin £9, forecast 1.2m in 2011.", "1,200 and −3 and 2.5e3 and 7 bn",
    "2011-10-05 and 2011-10, 2011-10.5 but 3.2011-10 and -2011-10 x-2011-10", "2011-2012-10 1999-20-2010-11 2011-10k 2011-10 k",
    "our 2012 revenue, the 2012 salesman, MAY   2013 and begin 2014", "٢٠١١-١٠ and ٣٤٥ units, 5 km, 5 ké, x7 y.8 9_", "", None, "no digits",
    "12 " * 1300 + "in 2001", "😀 12 😀 in 2011", "2011-10-2012-10 2011-10-055 2011-10-05-06",
]


def test_number_spans_at_the_edges(spark):
    df = spark.createDataFrame(list(enumerate(EDGES)), "id int, text string")
    got = sorted(tuple(r) for r in tx.number_spans(df, "id", "text").collect())
    assert got == sorted((i, *s.values()) for i, t in enumerate(EDGES) if t for s in _spans(t))


def test_periods_at_the_edges(spark):
    texts = EDGES + ["Compare March to April 2011", "March, and April 2011 vs May 2012", "March or April 2011 or May 2012", "march sales",
                     "march toapril 2011 may 2012", "How did 2011-10 do vs November 2011?", "March, April, May 2011 and June 2012"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.periods for r in textjobs.requested_periods(df, "id", "text").collect()}
    assert got == {i: _periods(t) for i, t in enumerate(texts)}


def test_number_tokens_whole_job(spark, sf_dir, docs):
    got = sorted(
        (r.doc_id, r.pos, r.token, r.value) for r in QUERIES["text_number_tokens"](spark, sf_dir).collect()
    )
    want = sorted(
        (d, i, m.group(), _value(m.group()))
        for d, t in docs if t
        for i, m in enumerate(re.finditer(tx.NUMBER_PATTERN, t))
    )
    assert want and got == want


@pytest.fixture(scope="module")
def prose(spark, sf_dir, docs):
    from tillroll.plans.q_evidence import claims_table

    claims = claims_table(spark, sf_dir).select("claim_id", "text").collect()
    return [(f"doc:{d}", t) for d, t in docs] + [(f"claim:{r.claim_id}", r.text) for r in claims]


@pytest.fixture(scope="module")
def label_pattern(spark, sf_dir):
    from tillroll.plans.q_evidence import evidence_table

    parts = []
    for r in evidence_table(spark, sf_dir).select("label_key", "row").distinct().collect():
        name = re.escape(r.row)
        parts.append(rf"customer(?:[ _]id)?\s+{name}(?:\.0+)?" if r.label_key == "customer_id" else name)
    return re.compile(r"(?<!\w)(?:" + "|".join(sorted(parts, key=len, reverse=True)) + r")(?!\w)", re.I)


def _unsupported(text, values, label_pattern):
    inside = [m.span() for m in label_pattern.finditer(text)]
    return [
        s for s in _spans(text)
        if not s["date_context"] and not any(a <= s["start"] and s["end"] <= b for a, b in inside) and not _declared_hit(s["value"], values)
    ]


def test_undeclared_numbers_whole_job(spark, sf_dir, prose, declared, label_pattern):
    got = sorted(
        (r.text_id, r.start, r.token, r.value) for r in QUERIES["text_undeclared_numbers"](spark, sf_dir).collect()
    )
    want = sorted(
        (d, s["start"], s["token"], s["value"])
        for d, t in prose if t
        for s in _unsupported(_drop_calls(t), declared, label_pattern)
    )
    assert want and got == want


def test_redact_numbers_whole_job(spark, sf_dir, prose, supported, label_pattern):
    got = {r.text_id: r.text for r in QUERIES["text_redact_numbers"](spark, sf_dir).collect()}
    want = {}
    for d, t in prose:
        if t is None:
            want[d] = None
            continue
        clean = _findings(t)
        out, pos = [], 0
        for s in _unsupported(clean, supported, label_pattern):
            out.append(clean[pos:s["start"]] + "[unverified]")
            pos = s["end"]
        want[d] = "".join(out) + clean[pos:]
    assert got == want


def test_numbers_inside_labels(spark):
    labels = spark.createDataFrame(
        [("country", "Route 66"), ("country", "66"), ("invoice_month", "2001-07"), ("customer_id", "18102"), ("stock_code", "85123A"), ("stock_code", "22423"), ("country", None)],
        "label_key string, row string",
    )
    texts = [
        "Route 66 made 66", "ROUTE 66 and route 666", "customer 18102 and 18102", "Customer_ID  18102.0 but 18102.5", "customer id 18102.00, customers 18102",
        "code 85123A", "stock code 22423, product code 22423, 22423", "\u0130 customer 18102 x 7", "2001-07 and 7", "", None, "Route 66 " * 3000 + "12",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    none = spark.createDataFrame([], "value double")
    got = {}
    for r in textjobs.undeclared_numbers(df, "id", "text", none, "value", labels).collect():
        got.setdefault(r.id, []).append((r.start, r.token))
    assert {k: [t for _, t in sorted(v)] for k, v in got.items()} == {
        0: ["66"], 1: ["666"], 2: ["18102"], 3: ["18102.5"], 4: ["18102"], 6: ["22423"], 7: ["7"], 8: ["7"], 11: ["12"],
    }


def test_requested_periods_whole_job(spark, sf_dir, docs):
    got = {r.doc_id: list(r.periods) for r in QUERIES["text_requested_periods"](spark, sf_dir).collect()}
    assert got == {d: _periods(t) for d, t in docs}


def _reference_route(question):
    """The routing order with Python's own word boundaries: scope words on
    the lower-cased question, templates on its normalised form."""
    from tillroll.operators import textjobs

    low = question.lower()

    def words(pattern):
        return re.search(rf"\b({pattern})\b", low)

    if words(tx.MISSING_DATA_PATTERN):
        return "data_gap"
    if words(tx.FORECAST_PATTERN):
        return "forecast"
    partial = any(m in low for m in textjobs.PARTIAL_MONTH_MENTIONS)
    per_day = "per trading day" in low or "per day" in low
    if partial and words(tx.COMPARISON_PATTERN) and not per_day:
        return "incomplete_month"
    t = re.sub(r"\s+", " ", low).strip().rstrip("?.")
    if any(re.search(p, t) for p in textjobs.KNOWN_PATTERNS):
        return "known_pattern"
    return "free"


def test_route_questions_whole_job(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").collect()
    want = {(r.conv_id, r.turn): _reference_route(r.text) for r in turns if r.role == "user" and r.text is not None}
    got = {(r.conv_id, r.turn): r.route for r in QUERIES["text_route_questions"](spark, sf_dir).collect()}
    assert want and {k: got[k] for k in want} == want


def test_route_word_boundaries_follow_python(spark):
    from tillroll.operators import textjobs

    qs = ["¿Cuánto costó el envío?", "What is our profit?", "customer  age split", "next\tquarter sales",
          "Revenue in 2000", "Revenue  in 2000?", "Revenue\u2003in 2000?\u00a0", "\x1cwhat was our revenue in 2000",
          "What was our revenue in 20\u0660\u0660?", "Top \u0663 products in 2000"]
    df = spark.createDataFrame(list(enumerate(qs)), "id int, text string")
    got = {r.id: r.route for r in textjobs.route_questions(df, ["id"], "text").collect()}
    assert got == {i: _reference_route(q) for i, q in enumerate(qs)}
