"""Phrases against plain counting of all n-grams."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tillroll.llm import phrases

SCHEMA = "doc_id long, text string, lang string, n int, fp string, doc string, phrase int, count int"


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def brute_counts(rows, longest=5):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return f, total


def brute(rows, least, top):
    f, total = brute_counts(rows)
    outer = defaultdict(int)
    cand = {k: a for k, a in f.items() if len(k[1]) >= 2 and a >= least}
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                outer[lang, w[i : i + k]] = max(a, outer[lang, w[i : i + k]])
    by = defaultdict(list)
    for (lang, w), a in cand.items():
        if 100 * outer[lang, w] >= 100 * a:
            continue
        score, k = min((1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        by[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    out = []
    for lang, found in by.items():
        for i, (s, a, w, left, right) in enumerate(sorted(found)[:top]):
            out.append((lang, i + 1, w.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def corpus():
    draw = random.Random(6)
    vocabulary = ["The", "of", "a", "new", "york", "city", "état", "ß", "x" * 300, "don't", "日本", "ÀB", "é e", "no", "un"]
    rows = []
    for _ in range(250):
        w = []
        for _ in range(draw.randint(0, 25)):
            w += draw.choice([[draw.choice(vocabulary)], ["new", "York", "City"], ["of", "the"], ["un", "deux", "trois", "quatre", "cinq", "six"], [f"r{draw.randint(0, 999)}"]])
            w.append(draw.choice(["", "", "", "", ".", ",", "\n", " \t", "!", "\x0b", "\r\n"]))
        rows.append((draw.choice([" ", "  ", "\t"]).join(w), draw.choice(["en", "en", "fr", None, "und", ""])))
    rows += [(None, "en"), ("", "de"), (" . ", None), ("a " * 20000, "en"), ("of the " * 50, "xx")] + [("same words in all of the copies", "en")] * 40
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, g, 1, "f", "d", 2, 3) for i, (t, g) in enumerate(corpus())], SCHEMA).repartition(5)


@pytest.mark.parametrize(
    "p",
    [
        phrases.Params(least=8),
        phrases.Params(least=8, filter_bits=8, held=50, slice_bytes=3000, top=7),  # full bitmaps, small slices
        phrases.Params(least=8, fingerprint_bits=9, slice_bytes=3000),  # most fingerprints are shared
        phrases.Params(least=8, fingerprint_bits=13, held=200),
    ],
)
def test_matches_plain_counting(docs, p):
    rows = corpus()
    got = sorted(tuple(r) for r in phrases.collocations(docs, p, "test").collect())
    assert got == brute(rows, p.least, p.top)
    if p.fingerprint_bits < 64:
        f, _ = brute_counts(rows)
        counts = phrases.phrase_counts(docs, p, "test")
        got = {(r.lang, tuple(r.phrase.split(" "))): r["count"] for r in counts.collect()}
        assert got == {k: a for k, a in f.items() if a >= p.least}


def test_phrases_whose_part_was_split_otherwise_are_read_anywhere(docs, monkeypatch):
    p = phrases.Params(least=8)
    rows = corpus()
    owned = phrases._owned
    monkeypatch.setattr(phrases, "_owned", lambda prints, part: owned(prints, part + 1000))
    assert sorted(tuple(r) for r in phrases.collocations(docs, p, "test").collect()) == brute(rows, p.least, p.top)


def test_empty_and_small(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA), label="test").count() == 0
    few = spark.createDataFrame([(1, "one two", None, 1, "f", "d", 2, 3)], SCHEMA)
    assert phrases.collocations(few, label="test").count() == 0
    got = phrases.collocations(few, phrases.Params(least=1), "test").collect()
    assert [tuple(r) for r in got] == [("und", 1, "one two", 1, 1, 1, 2, 2000)]


def test_products_over_64_bits_are_exact(spark):
    """Counts are multiplied as decimals; the quotient is the integer one."""
    a, n, x, y = 10**12 + 7, 10**13 + 1, 10**12 + 9, 10**12 + 11
    df = spark.createDataFrame([(a, n, x, y)], "a long, total long, l long, r long")
    exact = "(CAST(a AS DECIMAL(18,0)) * CAST(total AS DECIMAL(18,0)) * 1000BD) div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))"
    assert df.selectExpr(f"{exact} AS s").first().s == 1000 * a * n // (x * y)
