"""Property-based checks of the distributed operators against plain Python:
the bucketed near-equality join, the prefix-sum running share and the exact
quantiles, on random inputs with ties, negatives, values around the
tolerance regime switch and different partition counts."""

from decimal import Decimal

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tillroll.functions.tolerance import near_flagged, near_join, near_matched
from tillroll.operators import analysis, rankings

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def _near(a, b):
    return abs(a - b) <= max(0.011, 1e-6 * max(abs(a), abs(b)))


# Values cluster around a few centres, offset by multiples of the local
# tolerance, so near-equal and just-not-near pairs are common.
centres = st.sampled_from([0.0, 0.004, -0.02, 1.0, 99.995, 10999.995, 11000.0, -11000.01, 2.5e6, 1e15])
offsets = st.floats(min_value=-3.0, max_value=3.0, allow_nan=False)
values = st.builds(lambda c, k: c + k * max(0.011, 1e-6 * abs(c)), centres, offsets)


@SETTINGS
@given(left=st.lists(values, min_size=1, max_size=40), right=st.lists(values, min_size=1, max_size=40))
def test_near_join_is_the_brute_force_pair_set(spark, left, right):
    L = spark.createDataFrame(list(enumerate(left)), "lid int, lv double")
    R = spark.createDataFrame(list(enumerate(right)), "rid int, rv double")
    got = {(r.lid, r.rid) for r in near_join(L, "lv", R, "rv").collect()}
    assert got == {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if _near(a, b)}
    want_flags = [(i, any(_near(a, b) for b in right)) for i, a in enumerate(left)]
    assert sorted((r.lid, r.matched) for r in near_matched(L, "lv", R, "rv").collect()) == want_flags
    assert sorted((r.lid, r.matched) for r in near_flagged(L, "lv", R, "rv").collect()) == want_flags


money = st.integers(min_value=-500, max_value=5000).map(lambda c: Decimal(c) / 4)


@SETTINGS
@given(vals=st.lists(money, min_size=1, max_size=80), parts=st.integers(min_value=1, max_value=9),
       ascending=st.booleans())
def test_running_share_is_the_sorted_prefix_sum(spark, vals, parts, ascending):
    rows = [(f"k{i:03d}", v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "k string, v decimal(12,2)")
    got = {r.k: (r.rank, r.cumulative) for r in
           rankings.running_share(df, "v", "k", partitions=parts, ascending=ascending).collect()}
    ordered = sorted(rows, key=lambda x: ((x[1] if ascending else -x[1]), x[0]))
    total = Decimal(0)
    for i, (k, v) in enumerate(ordered, 1):
        total += v
        assert got[k] == (i, total)


@SETTINGS
@given(vals=st.lists(money, min_size=1, max_size=80), qs=st.lists(
    st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]), min_size=1, max_size=4, unique=True))
def test_exact_quantiles_match_numpy_linear(spark, vals, qs):
    df = spark.createDataFrame([(f"k{i:03d}", v) for i, v in enumerate(vals)], "k string, v decimal(12,2)")
    got = {r.q: r.value for r in analysis.exact_quantiles(df, "v", qs).collect()}
    want = {q: float(np.quantile(np.array([float(v) for v in vals]), q, method="linear")) for q in qs}
    assert set(got) == set(want)
    for q in qs:
        assert abs(got[q] - want[q]) <= 1e-9 * max(1.0, abs(want[q]))


# Texts over an alphabet that stresses the number pattern: digits of other
# scripts, superscripts, combining marks, separators, signs, scale words and
# whitespace outside ASCII.
PIECES = ["1", "23", "4,567", "0.5", "1e3", "2E-2", "k", "m", "bn", "million", " thousand", "-", "+", "−",
          ".", ",", " ", " ", "\x1c", "a", "é", "é", "_", "²", "٣", "Ⅷ", "x", "£", "%", "\n"]
texts = st.lists(st.sampled_from(PIECES), min_size=0, max_size=25).map("".join)


@SETTINGS
@given(batch=st.lists(texts, min_size=1, max_size=30))
def test_number_tokens_follow_python_regex(spark, batch):
    import re

    from tillroll.functions import text as tx
    from tillroll.operators import textjobs

    df = spark.createDataFrame(list(enumerate(batch)), "id int, text string")
    got = sorted((r.id, r.pos, r.token) for r in textjobs.number_tokens(df, "id", "text").collect())
    want = sorted((i, p, m.group()) for i, t in enumerate(batch) for p, m in enumerate(re.finditer(tx.NUMBER_PATTERN, t)))
    assert got == want


FINDING_PIECES = ["[call 3]", "[CALL 12]", "[call x]", "customer_id", "Customer_ID", " ", " ", "\x1c", "\n",
                  "5", "٣", "é", "é", "_", "x", ":"]
findings = st.lists(st.sampled_from(FINDING_PIECES), min_size=0, max_size=14).map("".join)


@SETTINGS
@given(batch=st.lists(findings, min_size=1, max_size=30))
def test_findings_text_follows_python_steps(spark, batch):
    import re

    from pyspark.sql import functions as F

    from tillroll.functions import text as tx

    def reference_steps(t):
        t = re.sub(r"\[call\s+\d+\]", "", t, flags=re.I).strip()
        return re.sub(r"\bcustomer_id(?=\s+\d)", "Customer", t, flags=re.I)

    df = spark.createDataFrame(list(enumerate(batch)), "id int, text string")
    got = sorted((r.id, r.t) for r in df.select("id", tx.findings_text(F.col("text")).alias("t")).collect())
    assert got == [(i, reference_steps(t)) for i, t in enumerate(batch)]


LABEL_PIECES = ["revenue", "rate", "share", "_", " ", " ", "per", "trading", "day", "days", "daily", "/",
                "orders", "invoice", "units", "quantity", "customers", "buyers", "aov", "£", "%", "pct",
                "é", "é", "x", "2", "\x1c"]
labels = st.lists(st.sampled_from(LABEL_PIECES), min_size=0, max_size=8).map("".join)


@SETTINGS
@given(batch=st.lists(labels, min_size=1, max_size=30))
def test_metric_kind_follows_python_rules(spark, batch):
    import re

    from pyspark.sql import functions as F

    from tillroll.functions import text as tx

    def reference_kind(value):
        text = str(value or "").lower().replace("_", " ").strip()
        for kind, rx in tx.METRIC_RULES:
            if re.search(rx, text):
                if kind == "money" and re.search(tx.PER_DAY, text):
                    return "money_per_day"
                return kind
        return None

    df = spark.createDataFrame(list(enumerate(batch)), "id int, label string")
    got = sorted((r.id, r.kind) for r in df.select("id", tx.metric_kind(F.col("label")).alias("kind")).collect())
    assert got == [(i, reference_kind(t)) for i, t in enumerate(batch)]


TRACE_PIECES = ["[call 3]", "[call [unverified]]", "[CALL ٣]", "from_call:", "from_call :", "from run_sql",
                "from_run_sqlx", "from", " ", "\n", " ", "é", "é", "x", "_", "text", ":"]
traces = st.lists(st.sampled_from(TRACE_PIECES), min_size=0, max_size=12).map("".join)


@SETTINGS
@given(batch=st.lists(traces, min_size=1, max_size=30))
def test_strip_trace_follows_python_rules(spark, batch):
    import re

    from pyspark.sql import functions as F

    from tillroll.functions import text as tx

    def reference_display(value):
        text = re.sub(tx.TRACE_CALL, "", str(value or ""))
        text = re.sub(tx.TRACE_TAIL, "", text)
        return text.strip()

    df = spark.createDataFrame(list(enumerate(batch)), "id int, text string")
    got = sorted((r.id, r.t) for r in df.select("id", tx.strip_trace(F.col("text")).alias("t")).collect())
    assert got == [(i, reference_display(t)) for i, t in enumerate(batch)]


def test_space_set_and_characters_agree_with_python(spark):
    from pyspark.sql import functions as F

    from tillroll.functions import text as tx

    chars = [chr(c) for c in range(0x3001) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    by_class = {r.c for r in df.filter(F.col("c").rlike("^" + tx.SPACE + "$")).collect()}
    assert by_class == set(tx.SPACE_CHARS) == {c for c in chars if c.isspace()}
    got = df.select("c", tx.strip_ends(F.concat(F.col("c"), F.lit("x"), F.col("c"))).alias("s")).collect()
    assert all(r.s == (r.c + "x" + r.c).strip() for r in got)
