"""Phrase collocation mining with Rabin-Karp fingerprints.

Texts are read as bytes: A-Z in lower case, pieces between ``[.,;:!?]`` and line
ends, words between spaces and tabs. Prefix polynomials over the bytes hash
every word, and prefix polynomials over the word hashes every n-gram of up to
five words inside a piece, language included.

The n-grams are counted length by length. Tasks count equal fingerprints, and
the shuffle adds them up, with a second fingerprint and two occurrence pointers
(the first and the last part of the input that holds one). What is frequent
prunes the next length, because a frequent phrase holds only frequent ones, by
a bitmap of fixed size (``2 ** filter_bits`` bits, whatever the input): a bit set
by chance lets a rare n-gram through, and none is lost. Shuffle files of a
length are removed when it is counted, so the disk holds one length.

A last pass follows the pointers: each part reads the text of the frequent
phrases that point to it, and no other text is written. Both texts and all
second fingerprints of a phrase must agree; else two phrases share a
fingerprint, and these (few) phrases are counted again by their text. So
counts are exact. A phrase whose part holds it no more (the input was split
otherwise) is read from any part.

A phrase's score is the least ratio of its count to what its two parts predict,
``floor(1000 a n / (l r))`` in decimals of 38 digits, over all cuts. Phrases
that never occur outside one longer candidate are dropped.

Defined results: a null text has no words, a null lang is ``und``; lang values
are compared as they are; a phrase's words are joined by one space; rows that
are equal count as often as they occur; an empty table has no phrases; other
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, as_long, freed_shuffles, materialise, mix
from .rolling import ngram_hashes, span_hashes

_SECOND = 0xC2B2AE3D27D4EB4F  # odd; the base of the second fingerprint
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_KIND = np.zeros(256, np.int8)  # 0 word, 1 blank, 2 end of a piece
_KIND[[9, 32]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = 2


@dataclass(frozen=True)
class Params:
    longest: int = 5  # words of a phrase
    least: int = 100  # occurrences of a candidate
    top: int = 2000  # phrases returned for a language
    filter_bits: int = 26  # the pruning bitmaps have 2 ** filter_bits bits (8 MB)
    fingerprint_bits: int = 64  # fewer only in tests, to force collisions
    slice_bytes: int = 1 << 19  # texts hashed at once
    held: int = 1 << 20  # counts a task holds before it combines them


# ---------------------------------------------------------------- in a task


class Slice:
    """The words of some texts of one language, and their n-gram fingerprints."""

    def __init__(self, lang: str, texts: list[bytes], p: Params) -> None:
        self.p = p
        name = np.frombuffer(lang.encode() + b"\0", np.uint8)
        self.seed = span_hashes(name, np.array([0]), np.array([len(name)]))[0]
        self.data = _FOLD[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        kind = _KIND[self.data]
        edge = np.diff((kind == 0).astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.lo, self.hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.lo]
        self.words = span_hashes(self.data, self.lo, self.hi)
        self.often: dict[int, np.ndarray] = {}

    def whole(self, n: int) -> np.ndarray:
        """Whether the n words from each word on are in one piece."""
        if len(self.lo) < n:
            return np.empty(0, bool)
        return self.piece[n - 1 :] == self.piece[: len(self.piece) - n + 1]

    def prints(self, n: int) -> np.ndarray:
        """Fingerprints of the n words from each word on; n and language belong to them."""
        with np.errstate(over="ignore"):
            out = mix(ngram_hashes(self.words, n) + self.seed * U64(2 * n + 1))
        return out & U64((1 << self.p.fingerprint_bits) - 1)

    def seconds(self, lengths: range) -> dict[int, np.ndarray]:
        """Fingerprints of 31 bits from other hashes of the bytes and words."""
        words = span_hashes(self.data, self.lo, self.hi, _SECOND)
        with np.errstate(over="ignore"):
            return {n: (mix(ngram_hashes(words, n, _SECOND) + self.seed * U64(2 * n + 1)) >> U64(33)).astype(np.int32) for n in lengths}

    def able(self, n: int, known: dict[int, Bitmap]) -> np.ndarray:
        """Whether the n words from each word on may be a frequent phrase: they are
        in one piece, and all shorter phrases in them that are known are frequent."""
        on = self.whole(n).copy()
        for k in sorted(known):
            if k < n and len(on):
                if k not in self.often:
                    self.often[k] = known[k].has(self.prints(k))
                for i in range(n - k + 1):
                    on &= self.often[k][i : i + len(on)]
        return on

    def text(self, i: int, n: int) -> bytes:
        return b" ".join(self.data[self.lo[i] : self.hi[i + n - 1]].tobytes().split())


class Bitmap:
    """Membership of fingerprints in a set; may hold more, never less."""

    def __init__(self, words: np.ndarray, bits: int) -> None:
        self.words, self.bits = words, bits

    def has(self, prints: np.ndarray) -> np.ndarray:
        at = mix(prints) >> U64(64 - self.bits)
        return (self.words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1


def _slices(frames: Iterable[pd.DataFrame], p: Params) -> Iterator[tuple[str, Slice]]:
    """Texts of one language, as many as fit a slice."""
    for frame in frames:
        for lang, part in frame.groupby("lang", sort=False):
            texts, size = [], 0
            for text in part["text"]:
                data = text.encode()
                if texts and size + len(data) > p.slice_bytes:
                    yield lang, Slice(lang, texts, p)
                    texts, size = [], 0
                texts.append(data)
                size += len(data) + 1
            if texts:
                yield lang, Slice(lang, texts, p)


_COUNTS = "fp long, count long, check int, part int"


def _summed(prints: np.ndarray, counts: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal fingerprints; those with two checks keep a row for each."""
    order = np.argsort(prints)
    prints, counts, checks = prints[order], counts[order], checks[order]
    new = np.ones(len(prints), bool)
    new[1:] = (prints[1:] != prints[:-1]) | (checks[1:] != checks[:-1])
    at = np.flatnonzero(new)
    return prints[at], np.add.reduceat(counts, at), checks[at]


def _counter(p: Params, lengths: range, filters: Callable[[], dict[int, Bitmap]]):
    """Fingerprints of the n-grams that may be frequent, counted in the task."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, known, part = [], 0, filters(), TaskContext.get().partitionId()

        def frame(x) -> pd.DataFrame:
            return pd.DataFrame({"fp": as_long(x[0]), "count": x[1], "check": x[2], "part": np.int32(part)})

        for _, s in _slices(frames, p):
            checks = s.seconds(lengths)
            for n in lengths:
                at = np.flatnonzero(s.able(n, known))
                if len(at):
                    held.append(_summed(s.prints(n)[at], np.ones(len(at), np.int64), checks[n][at]))
                    size += len(held[-1][0])
            if size > p.held:
                held = [_summed(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                if size > p.held // 2:
                    yield frame(held[0])
                    held, size = [], 0
        if held:
            yield frame(_summed(*map(np.concatenate, zip(*held))))

    return run


def _totals(p: Params):
    """(lang, total): the words of each language."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for lang, s in _slices(frames, p):
            found[lang] += len(s.lo)
        yield pd.DataFrame({"lang": list(found), "total": list(found.values())}).astype({"lang": object, "total": np.int64})

    return run


def _owned(prints: np.ndarray, part: int) -> np.ndarray:
    """Fingerprints of (phrase, part), for the bitmap of pointers."""
    with np.errstate(over="ignore"):
        return mix(prints + mix(np.array([part], U64))[0])


def _reader(p: Params, filters: Callable[[], dict[int, Bitmap]], anywhere: bool):
    """(lang, n, fp, phrase) of the phrases that point to this part, once each."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, part, done = filters(), TaskContext.get().partitionId(), set()
        wanted = known.pop(0)
        for lang, s in _slices(frames, p):
            rows = []
            for n in range(1, p.longest + 1):
                prints = s.prints(n)
                at = np.flatnonzero(s.able(n, known))
                at = at[wanted.has(prints[at] if anywhere else _owned(prints[at], part))]
                fps, first = np.unique(prints[at], return_index=True)
                for fp, i in zip(as_long(fps).tolist(), at[first].tolist()):
                    if (fp, min(n, 4)) not in done:
                        done.add((fp, min(n, 4)))
                        rows.append((lang, n, fp, s.text(i, n).decode()))
            if rows:
                yield pd.DataFrame(rows, columns=["lang", "n", "fp", "phrase"])

    return run


def _by_text(p: Params, filters: Callable[[], dict[int, Bitmap]]):
    """(lang, n, fp, phrase, count) of n-grams with a given fingerprint, by text."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = filters()
        for lang, s in _slices(frames, p):
            found: Counter = Counter()
            for n in range(1, p.longest + 1):
                prints = s.prints(n)
                for i in np.flatnonzero(s.whole(n) & known[0].has(prints)) if len(prints) else ():
                    found[n, int(prints[i]), s.text(i, n)] += 1
            if found:
                keys = list(found)
                fp = np.array([k[1] for k in keys], U64)
                yield pd.DataFrame({"lang": lang, "n": [k[0] for k in keys], "fp": as_long(fp), "phrase": [k[2].decode() for k in keys], "count": list(found.values())})

    return run


# ---------------------------------------------------------------- on Spark


def _bitmap(prints: DataFrame, p: Params, owned: bool = False):
    """A broadcast bitmap of the fingerprints in column ``fp`` (with their ``part``,
    if ``owned``): 2 ** filter_bits bits."""
    spark, width = prints.sparkSession, p.filter_bits

    def places(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fp = frame["fp"].to_numpy(np.int64).view(U64)
            if owned:
                fp = mix(fp + mix(frame["part"].to_numpy(np.int64).view(U64)))
            at = mix(fp) >> U64(64 - width)
            yield pd.DataFrame({"word": (at >> U64(6)).astype(np.int64), "bit": as_long(U64(1) << (at & U64(63)))})

    prints = prints.select("fp", F.col("part").cast("long").alias("part")) if owned else prints.select("fp")
    with freed_shuffles(spark):
        rows = prints.mapInPandas(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (width - 6), U64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(U64)
    return spark.sparkContext.broadcast(words)


def _filters(p: Params, shared: dict) -> Callable[[], dict[int, Bitmap]]:
    return lambda: {n: Bitmap(b.value, p.filter_bits) for n, b in shared.items()}


def phrase_counts(docs: DataFrame, p: Params = Params(), label: str = "phrases") -> DataFrame:
    """(lang, n, phrase, count) of all phrases with ``least`` occurrences."""
    texts = _texts(docs)
    known, levels = {}, []
    for lengths in [range(n, n + 1) for n in range(1, min(p.longest, 3) + 1)] + [range(4, p.longest + 1)]:
        if not len(lengths):
            continue
        counted = texts.mapInPandas(_counter(p, lengths, _filters(p, dict(known))), _COUNTS)
        sums = counted.groupBy("fp").agg(
            F.sum("count").alias("count"), F.min("check").alias("low"), F.max("check").alias("high"), F.min("part").alias("part"), F.max("part").alias("last")
        )
        with freed_shuffles(docs.sparkSession):
            levels.append(materialise(sums.where(F.col("count") >= p.least).withColumn("level", F.lit(lengths[0])), f"{label}-{lengths[0]}"))
        known[lengths[0]] = _bitmap(levels[-1], p)
    frequent = levels[0]
    for level in levels[1:]:
        frequent = frequent.unionByName(level)

    # Follow the pointers; a phrase that its part holds no more is read anywhere.
    key = ["fp", "level"]
    pointers = frequent.select("fp", F.explode(F.array_distinct(F.array("part", "last"))).alias("part"))

    def of_level(mapper, schema: str) -> DataFrame:
        return texts.mapInPandas(mapper, schema).withColumn("level", F.least("n", F.lit(4)))

    read_schema = "lang string, n int, fp long, phrase string"
    read = of_level(_reader(p, _filters(p, known | {0: _bitmap(pointers, p, owned=True)}), False), read_schema)
    read = materialise(read.join(frequent.select(key), key, "left_semi"), f"{label}-read")
    lost = frequent.join(read, key, "left_anti").select(key)
    if not lost.isEmpty():
        more = of_level(_reader(p, _filters(p, known | {0: _bitmap(lost, p)}), True), read_schema)
        read = read.unionByName(more.join(lost, key, "left_semi"))

    same = (F.col("low") == F.col("high")) & (F.col("phrase") == F.col("other")) & (F.col("forms") == 1)
    read = read.groupBy(key).agg(
        F.min("lang").alias("lang"), F.min("n").alias("n"), F.min("phrase").alias("phrase"), F.max("phrase").alias("other"),
        F.count_distinct(F.struct("lang", "n")).alias("forms"),
    )
    checked = materialise(frequent.join(read, key).select(*key, "lang", "n", "phrase", "count", same.alias("right")), f"{label}-checked")
    counts = checked.where("right").select("lang", "n", "phrase", "count")
    shared = checked.where("NOT right").select(key)
    if not shared.isEmpty():
        again = of_level(_by_text(p, _filters(p, {0: _bitmap(shared, p)})), "lang string, n int, fp long, phrase string, count long")
        again = again.join(shared, key, "left_semi").groupBy("lang", "n", "phrase").agg(F.sum("count").alias("count"))
        counts = counts.unionByName(again.where(F.col("count") >= p.least))
    return materialise(counts, f"{label}-counts")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text IS NOT NULL")


def _part(first: Column, words: Column) -> Column:
    return F.array_join(F.slice("words", first, words), " ")


def collocations(docs: DataFrame, p: Params = Params(), label: str = "phrases") -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    counts = phrase_counts(docs, p, label)
    totals = _texts(docs).mapInPandas(_totals(p), "lang string, total long").groupBy("lang").agg(F.sum("total").alias("total"))
    phrases = counts.where("n > 1").select("lang", F.col("n").alias("size"), "phrase", F.col("count").alias("a"), F.split("phrase", " ").alias("words"))

    # Longer phrases that a phrase never occurs without.
    inner = phrases.where("size > 2").select("lang", "a", "words", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k"), "size")
    inner = inner.select("lang", "a", "words", "k", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)).alias("first"))
    inner = inner.select("lang", _part(F.col("first"), F.col("k")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    left = phrases.join(inner, ["lang", "phrase"], "left").where("outer IS NULL OR 100 * outer < 100 * a")

    cuts = left.select("lang", "phrase", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("head"), _part(F.col("k") + 1, F.col("size")).alias("tail"))
    count_of = lambda key, name: counts.select("lang", F.col("phrase").alias(key), F.col("count").alias(name))
    cuts = cuts.join(count_of("head", "l"), ["lang", "head"]).join(count_of("tail", "r"), ["lang", "tail"]).join(totals, "lang")
    exact = lambda c: f"CAST({c} AS DECIMAL(18,0))"
    score = F.expr(f"({exact('a')} * {exact('total')} * 1000BD) div ({exact('l')} * {exact('r')})")
    cuts = cuts.withColumn("score", score.cast("long"))
    best = cuts.groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", F.col("total").alias("n"), "b.score")

    # A part of each language is cut to its first rows before the whole is ranked.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= p.top)
    best = ranked(best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))), "lang", "part").drop("rank", "part")
    return ranked(best, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same counts and scores for DuckDB.
ORACLE = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), words AS (
    SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces
), grams AS (
    SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 6) s(k) WHERE len(w) >= k
), f AS (
    SELECT lang, k, list_slice(w, i, i + k - 1) AS p, count(*)::HUGEINT AS c FROM grams GROUP BY ALL
), totals AS (
    SELECT lang, sum(c)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang
), cand AS (
    SELECT * FROM f WHERE k >= 2 AND c >= 100
), inner_ AS (
    SELECT lang, k, c, p, m, unnest(range(1, k - m + 2)) AS i FROM cand, range(2, 5) t(m) WHERE m < k
), outers AS (
    SELECT lang, list_slice(p, i, i + m - 1) AS p, max(c) AS c FROM inner_ GROUP BY ALL
), left_ AS (
    SELECT cand.* FROM cand LEFT JOIN outers o ON o.lang = cand.lang AND o.p = cand.p WHERE o.c IS NULL OR 100 * o.c < 100 * cand.c
), cuts AS (
    SELECT x.lang, x.p, x.c AS a, h.c AS l, t.c AS r, n, cut, (1000 * x.c * n) // (h.c * t.c) AS score
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM left_) x
    JOIN f h ON h.lang = x.lang AND h.p = list_slice(x.p, 1, cut) JOIN f t ON t.lang = x.lang AND t.p = list_slice(x.p, cut + 1, x.k)
    JOIN totals ON totals.lang = x.lang
), best AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1
), ranked AS (
    SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM best
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
