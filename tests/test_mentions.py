"""Dictionary phrases and country lists against plain searches of each text."""

import random
import re

from tillroll.operators import mentions

PHRASES = ["new york", "york", "new", "new york city", "u.k.", "uk", "(x) y", "año 1", "a a", "£", "nation_7", "x-y/z", "123", "日本", "_"]


def brute(text, phrase):
    """Starts of a phrase at word edges, occurrence by occurrence."""
    if not re.search(r"\w", phrase):
        return
    for i in range(len(text) - len(phrase) + 1):
        j = i + len(phrase)
        if text[i:j] == phrase and not re.match(r"\w", text[i - 1 : i] or " ") and not re.match(r"\w", text[j : j + 1] or " "):
            yield i, j


def texts():
    draw = random.Random(3)
    parts = [*PHRASES, "New", "yorker", "a", "of", "1234", "12", "nation_77", "é", "😀", "u.k", "(x)", "y"]
    seps = [" ", "  ", "", ",", "-", ". ", "\n", " ", "_"]
    rows = [None, "", "   ", "u.k.", ".u.k.", "u.k..", "xu.k.", "(x) y", "((x) y)", "a a a", "new york city york", "word " * 20000 + "new york"]
    for _ in range(300):
        rows.append("".join(draw.choice(parts) + draw.choice(seps) for _ in range(draw.randint(1, 12))))
    return rows


def test_phrases_at_word_edges(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "p", 0) for i, t in rows], "id int, text string, phrase string, start int")
    listed = spark.createDataFrame([(p, 1) for p in [*PHRASES, None, "uk"]], "name string, size int")
    got = sorted((r.id, r.phrase, r.start, r.end) for r in mentions.phrase_mentions(df, "id", "text", listed, "name").collect())
    assert got == sorted((i, p, a, b) for i, t in rows if t for p in PHRASES for a, b in brute(t, p))


def test_context_is_the_text_before(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "id int, text string")
    listed = spark.createDataFrame([(p,) for p in PHRASES], "name string")
    kept = dict(rows)
    for r in mentions.phrase_mentions(df, "id", "text", listed, "name").collect():
        head = kept[r.id][: r.start]
        words = list(re.finditer(r"\w+", head))
        first = words[-mentions.CONTEXT_WORDS].start() if len(words) > mentions.CONTEXT_WORDS else words[0].start() if words else 0
        assert r.before == head[first:], (kept[r.id][:60], r)


def test_no_phrases_and_no_texts(spark):
    df = spark.createDataFrame([(1, "new york")], "id int, text string")
    none = spark.createDataFrame([], "name string")
    assert mentions.phrase_mentions(df, "id", "text", none, "name").count() == 0
    assert mentions.phrase_mentions(df.limit(0), "id", "text", none, "name").count() == 0


COUNTRIES = ["Germany", "France", "United Kingdom", "Ireland", "Northern Ireland", "Guinea", "Guinea Bissau", "Spain", None, "Trinidad and Tobago"]
NO = r"(?:outside(?:\s+of)?|excluding|except(?:\s+for)?|other\s+than|not\s+(?:from|in))\s+(?:the\s+)?"


def brute_countries(text):
    names = {c.lower(): c for c in COUNTRIES if c} | {"uk": "United Kingdom", "u.k.": "United Kingdom"}
    low = text.lower()
    listed = "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True))
    inc, exc = set(), set()
    for name, country in names.items():
        for a, _ in brute(low, name):
            no = re.search(NO + rf"(?:(?:{listed})\s*(?:,|and|or)\s*)*$", low[:a])
            (exc if no else inc).add(country)
    return sorted(inc), sorted(exc)


def test_countries_and_their_exclusions(spark):
    rows = [
        "Sales outside the UK", "Sales outside of germany, France and spain but not in Ireland", "germany and france", "Other   than the u.k. or Spain, and Ireland.",
        "outside germany. france", "outside Northern Ireland and France", "not from guinea bissau, guinea", "excluding spain", "except for the Germany ,\n France", "",
        "outside " + "germany, " * 60 + "spain", "outside the UK and in the UK", "Germanyland, ukulele", "xoutside spain", "not in Trinidad and Tobago or Spain", "excluding germany" + " " * 400 + "and spain",
    ]
    draw = random.Random(9)
    words = ["Germany", "FRANCE", "uk", "U.K.", "Northern Ireland", "Ireland", "Guinea", "Guinea Bissau", "Spain", "outside", "the", "and", "or", ",", "of", "other than", "except", "in", "x"]
    rows += [" ".join(draw.choice(words) for _ in range(draw.randint(1, 14))) for _ in range(300)]
    rows = list(enumerate(rows)) + [(9999, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    countries = spark.createDataFrame([(c, 0) for c in [*COUNTRIES, "Spain"]], "country string, id int")
    got = {r.id: (list(r.included), list(r.excluded)) for r in mentions.country_mentions(df, "id", "text", countries, "country").collect()}
    want = {i: brute_countries(t) for i, t in rows if t and any(brute_countries(t))}
    assert got == want
