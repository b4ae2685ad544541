"""Every operator on nulls, empty and long texts, ties, repeated rows, empty
tables and clashing extra columns, against brute force where SQL has no words."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tillroll.llm import (
    fingerprints,
    jaccard_join,
    language_id,
    line_dedup,
    packing,
    pii,
    quality,
    sampled_pieces,
    sharding,
    vector_dedup,
)
from tillroll.llm.common import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, n int, buckets string, component_id string"
LONG = " ".join(f"word{i % 997} of {i}" for i in range(30000))
BASE = "the quick brown fox jumps over the lazy dog while seven wise owls look down from the old oak tree and sing"
TEXTS = [
    None, "", "   ", "\n\n\n", "a", "Ünïcödé ▁ text <|endoftext|> 　 日本語のテキスト", LONG, "x" * 120000,
    BASE, BASE, BASE + " again", "mail bob@example.com or +1 (555) 123-4567 now", "ip 10.0.0.1 and 999.1.1.1 card 4111 1111 1111 1111",
    "line one is here\nline two is here\nline three is here\nlast", "other\nline one is here\nline two is here\nline three is here\nend",
    "😀 emoji\r\n\ttabs\x0b", "+" * 500 + "1" * 500, "@" * 300, "ça va bien, n'est-ce pas ? I'll don't we've",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 4 == 0 else "en", None, None if t is None else len(t), 1.0, 3, 1, "b", "c") for i, t in enumerate(TEXTS)]
    rows += [rows[8], rows[8]]  # repeated rows
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(None,) * 10, (None, "some text with words in it", *(None,) * 8)], SCHEMA)


def rows_of(df, *keys):
    return [tuple(r[k] for k in keys) for r in df.collect()]


def brute_shingles(text, k):
    words = re.findall(r"[^ \t\n\x0b\f\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute_classes(texts, k, num, den):
    sets = {i: brute_shingles(t, k) for i, t in texts.items()}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_jaccard_edges(docs, empty, nulls):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(docs).collect()}
    want = brute_classes(dict(enumerate(TEXTS)), 5, 80, 100)
    assert got == {(i, n, c) for i, (n, c) in want.items()}
    assert jaccard_join.jaccard_classes(docs).count() == docs.count()
    assert jaccard_join.jaccard_classes(empty).count() == 0
    assert {r.component_id for r in jaccard_join.jaccard_classes(nulls).collect()} == {None}


@pytest.mark.parametrize("block", [4, 256])
def test_jaccard_families(spark, block):
    draw = np.random.default_rng(3)
    texts = {}
    for f in range(4):
        base = [f"w{x}" for x in draw.integers(0, 400, 60)]
        for _ in range(25):
            words = list(base)
            for at in draw.integers(0, 60, draw.integers(0, 4)):
                words[at] = f"v{draw.integers(0, 50)}"
            texts[len(texts)] = " ".join(words[: draw.integers(50, 61)])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for k, num in ((4, 85), (5, 80), (2, 60)):
        p = jaccard_join.Params(words=k, num=num, block=block, local=2)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(df, p).collect()}
        assert got == brute_classes(texts, k, num, 100)


def test_line_dedup_edges(docs, empty, nulls):
    out = line_dedup.remove_repeated_chunks(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == docs.count() and set(docs.columns) < set(out.columns)
    assert got[0].text is None and got[0].n_lines == 0 and got[1].text == "" and got[1].n_lines == 1
    assert got[13].text == TEXTS[13]
    assert line_dedup.remove_repeated_chunks(empty).count() == 0
    assert line_dedup.remove_repeated_chunks(nulls).count() == 2


def test_line_dedup_removes_long_passage_once(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"own start {i}\n{passage}\nown end {i}") for i in range(5)]
    got = dict(rows_of(line_dedup.remove_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "text"))
    assert got[0] == rows[0][1]
    assert all(got[i] == f"own start {i}\nown end {i}" for i in range(1, 5))


def test_repeated_passages_of_short_lines_go_whole(spark):
    for size in (5, 6, 8, 10, 20):  # from 30 words on
        gap = [""] if size % 2 else []
        passage = [x for j in range(size) for x in [f"short line {j} of passage {size}", *gap]]  # six words a line
        passage = passage[: len(passage) - len(gap)]
        rows = [(i, "\n".join([f"own start {i}", *passage, f"own end {i}"])) for i in range(4)]
        rows += [(4, f"own start 4\n{passage[0]}\nown end 4"), (5, None), (6, "")]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = dict(rows_of(corpus_pipeline.lines(spark, df, ""), "doc_id", "text"))
        assert got[0] == rows[0][1] and got[4] == rows[4][1] and got[5] is None and got[6] == ""
        assert all(got[i] == f"own start {i}\nown end {i}" for i in (1, 2, 3)), size


def test_common_short_lines_of_clean_texts_stay(spark):
    code = "int main() {\n  while (1) {\n    b();\n  }\n}\nq?\n- Yes.\n- No.\nend"
    other = "void f() {\n  for (;;) {\n    c();\n  }\n}\nr?\n- Yes.\n- No.\nlast"
    verse = "first verse of it\nla la la\nla la la la\n\nsecond verse of it\nla la la\nla la la la"
    rows = [(0, code), (1, other), (2, code.replace("b()", "d()")), (3, verse), (4, verse.replace("verse of", "part of")), (5, "* a\n* b\n* c"), (6, "* a\n* b\n* c")]
    got = dict(rows_of(corpus_pipeline.lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), ""), "doc_id", "text"))
    assert got == dict(rows)


def test_line_dedup_with_clashing_names_and_many_cuts(spark):
    long = [" ".join(f"w{i}x{j}" for j in range(45)) for i in range(400)]
    own = [f"own line {i} of the second text" for i in range(400)]
    rows = [(0, "\n".join(long), 1, 2, 3), (1, "\n".join(x for pair in zip(own, long) for x in pair), 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cuts int, lines int, chunk int")
    got = {r.doc_id: r for r in line_dedup.remove_repeated_chunks(df).collect()}
    assert got[0].text == rows[0][1] and got[1].text == "\n".join(own)
    assert (got[1].cuts, got[1].lines, got[1].chunk, got[1].chunks_removed, got[1].lines_removed) == (1, 2, 3, 400, 400)


def test_jaccard_with_repeated_doc_ids(spark):
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words), " ".join(words[::-1])
    rows = [(1, a), (5, a), (5, b), (9, b + " more"), (9, "alone in here with some words"), (12, "alone in here with some words"), (13, b), (5, b), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in jaccard_join.jaccard_classes(df).collect())
    assert got == sorted((d, 1) for d, _ in rows)
    draw = np.random.default_rng(5)
    texts = [" ".join(f"v{x}" for x in draw.integers(0, 30, 40)) for _ in range(12)]
    near = [" ".join([*x.split(" ")[:39], f"z{i}"]) for i, x in enumerate(texts)]
    rows = [(int(draw.integers(0, 40)), x) for x in [*texts, *near, *texts[:4]]]
    up = {d: d for d, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for d, x in rows:
        for e, y in rows:
            s, r = brute_shingles(x, 5), brute_shingles(y, 5)
            if 100 * len(s & r) >= 80 * len(s | r) and root(d) != root(e):
                up[max(root(d), root(e))] = min(root(d), root(e))
    got = {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(d, root(d)) for d, _ in rows}


def test_packing_round_trip(docs, empty, nulls):
    from tokenizers import Tokenizer

    p = packing.Params(vocabulary("word_bpe_49k.json"), with_ids=True, length=256, group_rows=8)
    rows = packing.pack(docs, p).collect()
    direct = Tokenizer.from_file(p.vocabulary)
    for i, text in enumerate(TEXTS):
        ids = direct.encode(text or "", add_special_tokens=False).ids + [1]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        if i != 8:
            assert [x for r in mine for x in r.ids] == ids
        assert all(r.doc_tokens == len(ids) and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in mine)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(empty, p).count() == 0
    assert packing.pack(nulls, p).count() == 2


def test_first_fit_decreasing_matches_a_plain_scan():
    draw = np.random.default_rng(1)
    lengths = draw.integers(1, 101, 300)
    where, offset = packing.first_fit_decreasing(lengths, 100)
    room: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        if k == len(room):
            room.append(100)
        assert where[i] == k and offset[i] == 100 - room[k]
        room[k] -= lengths[i]


def test_language_edges(docs, empty, nulls):
    model = language_id.learn(docs)
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    assert got[0][1:] == ("und", 0.0) and got[2][1] == "und" and got[8][1] == "en"
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == got[i][0] for i in got)
    none = language_id.learn(empty)
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0
    assert [r.held_out for r in language_id.predict(nulls, model).collect()] == [False, False]


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = language_id.predict(docs, language_id.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)


def test_quality_edges(spark, docs, empty, nulls, sf_dir):
    labels = spark.createDataFrame([(8, 1, 0), (7, 0, 0), (7, None, 0), (None, 1, 1), (3, 0, 0), (12, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality_scores(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(empty, labels).count() == 0
    assert quality.quality_scores(nulls, labels).count() == 2
    every, marks = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = quality.quality_scores(every, marks).join(marks, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in held) >= 0.9 * len(held)


def test_pii_base_spans_match_plain_patterns():
    def plain(t):
        out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if max(map(int, m[0].split("."))) <= 255]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = [int(c) for c in m[0] if c.isdigit()]
            odd = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
            if 12 <= len(d) <= 19 and odd % 10 == 0:
                out.append((m.start(), m.end(), "card"))
        out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))

    draw = np.random.default_rng(5)
    for alphabet in ("a@.-", "01. -", "+1 (0).-", "a1@. +-"):
        for _ in range(3000):
            t = "".join(draw.choice(list(alphabet), draw.integers(0, 40)))
            assert pii.base_spans(t) == plain(t), t
    assert pii.base_spans("a.b@c.d@e.f g@h.i") == plain("a.b@c.d@e.f g@h.i")


def test_pii_bootstrap_finds_unseen_and_redacts(spark, docs, empty, nulls):
    rows = [(i, f"please call me at +1 (555) 010-{1000 + i} before noon today") for i in range(12)]
    rows += [(50, "please call me at 5550109999 before noon today"), (51, "the year 2019 was fine and 5550109998 is a number of atoms")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in pii.report(df).collect()}
    assert out[0].n_phone == 1 and out[50].n_phone == 0
    assert out[50].spans == "phone:18:28" and out[50].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[51].spans == "" and out[51].n_added == 0
    clean = dict(rows_of(pii.redact(df), "doc_id", "text"))
    assert clean[50] == "please call me at <phone> before noon today" and clean[51] == rows[-1][1]
    red = pii.redact(docs)
    assert red.count() == docs.count() and red.columns == docs.columns
    assert "<email>" in {r.doc_id: r.text for r in red.collect()}[11]
    assert pii.report(empty).count() == 0 and pii.redact(nulls).count() == 2 and pii.report(nulls).count() == 2


def test_pii_finds_unseen_values_with_blanks(spark):
    luhn = ["4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 009", "6011 0000 0000 0004", "3000 0000 0000 04"]
    rows = [(i, f"please call me at +1 (555) 010-{1000 + i} before noon today") for i in range(12)]
    rows += [(20 + i, f"you may charge card {c} for the order") for i, c in enumerate(luhn)]
    calls = ["555 010 1111", "(555) 010-1112", "555.010 1113", "( 555 ) 010 - 1114", "555 010 1115 555 010 1116"]
    rows += [(50 + i, f"please call me at {c} before noon today") for i, c in enumerate(calls)]
    rows += [(60, "you may charge card 4111 1111 1111 1112 for the order"), (61, "we counted 555 010 1117 atoms in 2019 2020 and so on")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = dict(rows_of(pii.redact(df), "doc_id", "text"))
    assert [clean[50 + i] for i in range(3)] == ["please call me at <phone> before noon today"] * 3
    assert clean[53] in ("please call me at <phone> before noon today", "please call me at ( <phone> before noon today")
    assert not re.search("[0-9]", clean[54]) and clean[60] == "you may charge card <card> for the order"
    assert clean[61] == rows[-1][1]
    out = {r.doc_id: r for r in pii.report(df).collect()}
    assert out[51].spans == "phone:18:32" and out[51].n_added == 1 and out[60].n_added == 1 and out[60].n_card == 0


def test_pii_follows_long_chains_of_patterns(spark):
    # Each step's numbers share their left words with the step before and have right words of their own.
    words = [f"{a} {b}" for a, b in zip("apple birch cedar daisy elder fern grass hazel".split(), "iris jade kelp lily moss nut oak pine".split())]
    rows = [(i, f"zero{i} {words[0]} +1 (555) 010-{1000 + i} own{i} tail{i}") for i in range(40)]
    for step in range(7):
        rows += [(len(rows) + i, f"{words[step]} 555{step}00{1000 + i} {words[step + 1]}") for i in range(6)]
        rows += [(len(rows) + i, f"{words[step + 1]} 555{step}00{1000 + i} own{step}{i} tail{step}{i}") for i in range(6)]
    last = rows[-1][0]
    out = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[last].n_added == 1


def test_pii_contexts_are_whole_words():
    long = "w" * 5000
    (place,) = pii.occurrences(f"{long} at 5550109999{' ' * 900}before {long}", [])
    assert len(place[4]) == 3 and place[4][1] == "m at before"
    other = pii.occurrences(f"v{long} at 5550109999 before {long}", [])[0]
    assert other[4][0] != place[4][0] and other[4][1:] == place[4][1:]


def test_sampled_pieces_lossless_and_reproducible(spark, docs, empty, nulls):
    p = sampled_pieces.Params(vocabulary("piece_bpe_32k.model"))
    out = sampled_pieces.encode(docs, p)
    first = {r.doc_id: r for r in out.collect()}
    assert first[0].ids is None and all(first[i].lossless for i in first if i)
    again = {r.doc_id: r.ids for r in sampled_pieces.encode(docs.repartition(5), p).collect()}
    assert again == {i: r.ids for i, r in first.items()}
    texts = dict(rows_of(out.select("doc_id", sampled_pieces.decode("ids", p).alias("text")), "doc_id", "text"))
    assert texts == dict(enumerate(TEXTS))
    assert sampled_pieces.encode(empty, p).count() == 0 and sampled_pieces.encode(nulls, p).count() == 2


def test_sampled_pieces_follow_the_path_weights():
    p = sampled_pieces.Params(vocabulary("piece_bpe_32k.model"), alpha=0.2)
    worker = sampled_pieces.Lattices(p)
    v = worker.words
    ranks = {b: (i, r) for n, (i, r) in enumerate(zip(v.piece, v.rank)) if i >= 0 for b in [v.bytes[int(i)]]}
    weight = Counter()

    def walk(rest, ids, w):
        if not rest:
            weight[tuple(ids)] += w
        for k in range(1, len(rest) + 1):
            if rest[:k].encode() in ranks:
                i, r = ranks[rest[:k].encode()]
                walk(rest[k:], [*ids, int(i)], w * (r + 2) ** -0.2)

    walk(" the", [], 1.0)
    n = 20000
    drawn = Counter(tuple(x.tolist()) for x in worker.sample(["the"] * n, np.arange(n)))
    total = sum(weight.values())
    assert set(drawn) <= set(weight)
    for path, w in weight.items():
        share = w / total
        assert abs(drawn[path] / n - share) < 5 * np.sqrt(share / n) + 1e-3


@pytest.mark.parametrize("text", ["-" * 79 + "日本", "a" * 70 + "=" * 30, " " * 66 + "the"])
def test_sampled_pieces_of_long_segments_follow_the_path_weights(text):
    p = sampled_pieces.Params(vocabulary("piece_bpe_32k.model"), alpha=0.2)
    worker = sampled_pieces.Lattices(p)
    v = worker.words
    ranks = {v.bytes[int(i)]: r for i, r in zip(v.piece, v.rank) if i >= 0}
    whole = " " + text

    def sums(s):
        total = [1.0] + [0.0] * len(s)
        for g in range(1, len(s) + 1):
            for k in range(max(0, g - 20), g):
                r = ranks.get(s[k:g].encode(), v.ranks if g - k == 1 else None)
                total[g] += 0.0 if r is None else total[k] * (r + 2) ** -0.2
        return total

    before = sums(whole)
    back = [0.0] * len(whole) + [1.0]
    for k in range(len(whole) - 1, -1, -1):
        for g in range(k + 1, min(len(whole), k + 20) + 1):
            r = ranks.get(whole[k:g].encode(), v.ranks if g - k == 1 else None)
            back[k] += 0.0 if r is None else back[g] * (r + 2) ** -0.2
    n = 3000
    drawn = worker.sample([text] * n, np.arange(n))
    at = Counter()
    for ids in drawn:
        assert sampled_pieces.decode_ids(ids, v.bytes) == text
        place = np.cumsum([len(v.bytes[int(i)]) for i in ids])
        at.update(place.tolist())
    for g in range(1, len(whole)):
        share = min(1.0, before[g] * back[g] / before[-1])
        assert abs(at[len(whole[:g].encode())] / n - share) < 5 * np.sqrt(share * (1 - share) / n) + 2e-3, g


def test_sampled_pieces_keep_long_and_short_segments_in_order(monkeypatch):
    worker = sampled_pieces.Lattices(sampled_pieces.Params(vocabulary("piece_bpe_32k.model")))
    texts = ["a bc " + "x" * 100 + " de " + "é" * 90 + "日" * 90, "", "short", "=" * 3000 + "\nend", "z" * 65]
    keys = np.arange(len(texts))
    whole = [x.tolist() for x in worker.sample(texts, keys)]
    assert [sampled_pieces.decode_ids(np.array(x), worker.words.bytes) for x in whole] == texts
    monkeypatch.setattr(sampled_pieces, "BLOCK", 37)
    assert [x.tolist() for x in worker.sample(texts, keys)] == whole


def test_sampled_pieces_remember_the_segments_of_the_next_batch(monkeypatch):
    """A full table forgets only what the next batch does not need; draws stay the same."""
    p = sampled_pieces.Params(vocabulary("piece_bpe_32k.model"), remembered=1)
    worker, fresh = sampled_pieces.Lattices(p), sampled_pieces.Lattices(p)
    first, second = ["one two 日\U0001f600 three"], ["three 日\U0001f600 four one"] * 5
    worker.sample(first, np.arange(1))
    learned = []
    learn = worker.learn
    monkeypatch.setattr(worker, "learn", lambda new: (learned.extend(new), learn(new)))
    got = worker.sample(second, np.arange(5))
    assert learned == [" four"]
    assert set(worker.end) == {" one", " four", " 日\U0001f600", " three"}
    assert [x.tolist() for x in got] == [x.tolist() for x in fresh.sample(second, np.arange(5))]
    assert {sampled_pieces.decode_ids(x, worker.words.bytes) for x in got} == set(second)


def test_sampled_pieces_trie_is_the_vocabulary():
    v = sampled_pieces.Vocabulary(vocabulary("piece_bpe_32k.model"))
    ids = [i for i, b in enumerate(v.bytes) if b and i not in set(v.byte_id.tolist())]
    node = {i: 0 for i in ids}
    surface = {i: v.bytes[i].decode() for i in ids}
    for k in range(v.longest):
        live = [i for i in ids if len(surface[i]) > k]
        step = v.step(np.array([node[i] for i in live]), np.array([ord(surface[i][k]) for i in live]))
        node.update(zip(live, step.tolist()))
    assert [int(v.piece[node[i]]) for i in ids] == ids
    assert v.step(np.array([0, 0]), np.array([0x10FFFF, 0])).tolist() == [-1, -1]


def test_sharding_edges(docs, empty, nulls):
    out = sharding.shard(docs).collect()
    assert len(out) == docs.count()
    for k in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))
    assert len({r.shard for r in out if r.doc_id in (8, 9)}) == 1
    assert {r.doc_id: r.size for r in out}[0] == 1
    assert sharding.shard(empty).count() == 0 and sharding.shard(nulls).count() == 2
    placed = sharding.longest_first([(5, "a"), (4, "b"), (3, "c"), (3, "d")], 2)
    assert placed == {"a": 0, "b": 1, "c": 1, "d": 0}


@pytest.mark.parametrize("part_rows", [3, 4000])
def test_fingerprints_edges(docs, empty, nulls, part_rows):
    p = fingerprints.Params(part_rows=part_rows)
    out = fingerprints.neighbours(docs, p).collect()
    assert len(out) == docs.count()
    order = sorted((i, t or "") for i, t in rows_of(docs, "doc_id", "text"))
    got = sorted(out, key=lambda r: r.doc_id)
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        n = len(text) // 4
        changed = text[: len(text) - n] + after[:n]
        r = got[k]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (i, len(text), hashlib.sha256(changed.encode()).hexdigest())
        a, b, c = (fingerprints.fingerprint(x) for x in (text, changed, after))
        assert r.fingerprint == fingerprints.written(a) and r.edited_fingerprint == fingerprints.written(b), i
        assert r.near_edited == fingerprints.likeness(a, b) and r.near_next == fingerprints.likeness(a, c)
    assert fingerprints.neighbours(empty, p).count() == 0 and fingerprints.neighbours(nulls, p).count() == 2


def test_vector_edges(spark):
    draw = np.random.default_rng(2)
    base = draw.standard_normal((6, 16))
    rows = [(i, [float(x) for x in base[i % 6] + 0.15 * draw.standard_normal(16)]) for i in range(90)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, None), (103, []), (104, [0.0] * 16), (105, [float("nan")] * 16), (106, [1.0] * 15 + [None]), (107, [1.0, 0.0]), (108, [1e200, 0.0]), (None, rows[1][1]), (109, [float("inf")] * 16)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, kept string, n int")
    good = {i: np.array(v) / np.abs(v).max() for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {i: {j for j in good if i != j and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= 0.9} for i in good}
    for block in (8, 512):
        out = {r.vec_id: r for r in vector_dedup.near_vectors(df, vector_dedup.Params(block=block)).collect()}
        assert len(out) == len(rows)
        seen = {}
        for i in sorted(good):
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen[x] = i
                    todo += links[x]
        for i, _ in rows:
            if i is not None:
                assert out[i].n_links == len(links.get(i, ())) and out[i].component_id == seen.get(i, i), i
                assert out[i].kept == (out[i].component_id == i)
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0


def test_pipeline_stages_keep_columns(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packed":
            assert docs.columns == columns and docs.count() >= 0.8 * before
    last = spark.read.parquet(str(tmp_path / "private"))
    assert docs.select("doc_id").distinct().count() == last.count()
    assert last.where(F.col("text").rlike(r"[a-z]@[a-z0-9]+\.com")).count() == 0
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_pipeline_edges(spark, docs, empty, nulls, tmp_path):
    for part in (docs, empty, nulls):
        now = part
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, "")
            if name != "packed":
                assert now.columns == part.columns
            now = now.cache()
            now.count()


def test_word_ids_equal_direct_encoding():
    """With so few words held that most are forgotten and learned again."""
    texts = ["The cat, the CAT... it's I'm don't", "", " a\x1cb  c", "<|startoftext|> x<|endoftext|>y", "Straße ÀÉ ÿ× 12a3 a_b ~z~ !!"]
    texts += [" ".join(f"w{chr(97 + i % 26)}{chr(97 + k % 26)}{'!' * (k % 3)}" for k in range(40)) for i in range(60)]
    encode = packing.WordIds(vocabulary("word_bpe_49k.json"), 64)
    want = encode.tokenizer.encode_batch(texts, add_special_tokens=False)
    for _ in range(2):
        assert [x for t in texts for x in encode([t])[0].tolist()] == [x for e in want for x in e.ids]
    assert [x.tolist() for x in encode(texts)] == [e.ids for e in want]
