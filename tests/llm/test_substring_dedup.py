"""Repeated passages against a search over all windows of all texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tillroll.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string, kept string, n_words int, row long, start int, anchor string, factors string"


def words(text):
    return re.findall(r"[^ \t\n\x0b\f\r]+", text or "")


def brute(rows, n):
    first = {}
    for d, x in rows:
        w = words(x)
        for i in range(len(w) - n + 1):
            if d is not None:
                first[tuple(w[i : i + n])] = min(d, first.get(tuple(w[i : i + n]), d))
    out = []
    for d, x in rows:
        w, gone = words(x), set()
        for i in range(len(w) - n + 1):
            if d is not None and first[tuple(w[i : i + n])] < d:
                gone |= set(range(i, i + n))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def corpus():
    draw = random.Random(4)
    word = lambda k: [f"w{draw.randint(0, 400)}é" for _ in range(k)]
    passages = [word(draw.choice([8, 9, 11, 20, 60])) for _ in range(12)]
    rows = []
    for d in range(80):
        w = []
        for _ in range(draw.randint(0, 4)):
            p = draw.choice(passages)
            a = draw.randint(0, 6)
            w += word(draw.randint(0, 12)) + p[a : len(p) - draw.randint(0, 3)]
        rows.append((d, draw.choice([" ", "  ", "\n", "\t"]).join(w)))
    rows += [(90, rows[5][1]), (90, rows[6][1]), (3, rows[7][1]), rows[8], rows[8], (None, rows[9][1]), (None, None), (91, ""), (92, None), (93, " \n ")]
    rows += [(94, "x " * 300), (95, "x " * 280 + "y"), (96, "y " + "x " * 20), (97, " ".join(word(30000))), (98, rows[-1][1])]
    return rows


@pytest.mark.parametrize(("window", "gram"), [(8, 4), (8, 1), (8, 8), (10, 5)])
def test_matches_all_windows(spark, window, gram):
    rows = corpus()
    df = spark.createDataFrame([(d, x, "k", 1, 2, 3, "a", "f") for d, x in rows], SCHEMA)
    out = sd.remove_repeats(df, sd.Params(window, gram), "test")
    got = out.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(rows, window)
    assert {(r.row, r.start, r.anchor) for r in got} == {(2, 3, "a")} and set(df.columns) <= set(out.columns)
    # Each factor stands where it says, in a smaller document.
    texts = {}
    for d, x in rows:
        texts.setdefault(d, []).append(words(x))
    for r in got:
        w = words(r.text)
        for f in r.factors:
            assert f.words >= window and f.ref_doc < r.doc_id
            piece = w[f.start : f.start + f.words]
            assert any(x[f.ref_start : f.ref_start + f.words] == piece for x in texts[f.ref_doc])


def test_planted_passages_of_50_words_go_and_clean_texts_stay(spark):
    draw = random.Random(8)
    word = lambda k: " ".join(f"u{draw.randint(0, 10**6)}" for _ in range(k))
    passage = word(50)
    rows = [(i, f"{word(80)} {passage} {word(7)}") for i in range(30)] + [(i, word(200)) for i in range(30, 60)]
    rows += [(60, passage.rsplit(" ", 1)[0] + " other"), (61, passage.lower() + " " + passage)]
    got = {r.doc_id: r for r in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), label="test").collect()}
    assert got[0].n_removed == 0 and all(got[i].n_removed == 50 for i in range(1, 30)) and all(got[i].n_removed == 0 for i in range(30, 61))
    assert got[61].n_removed == 100 and got[61].kept == ""


def test_hot_passage_is_not_cut_for_every_copy(spark):
    """Thousands of copies leave one block a place to look up by windows."""
    same = " ".join(f"w{i}" for i in range(200))
    rows = [(i, same) for i in range(2000)]
    found = sd.factors(spark.createDataFrame(rows, "doc_id long, text string"), label="test")
    assert found.where("ref_doc <> 0").count() == 0
    assert found.groupBy("doc_id").agg(F.sum(F.col("last") - F.col("start") + 1).alias("n")).where("n = 151").count() == 1999


def test_empty_table_and_other_types_of_id(spark):
    assert sd.remove_repeats(spark.createDataFrame([], SCHEMA), label="test").count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    got = {r.doc_id: r.n_removed for r in sd.remove_repeats(spark.createDataFrame([("b", text), ("a", text)], "doc_id string, text string"), label="test").collect()}
    assert got == {"a": 0, "b": 60}
