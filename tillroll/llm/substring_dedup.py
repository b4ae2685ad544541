"""Substring dedup by relative Lempel-Ziv parsing.

Every document is parsed against the documents with a smaller doc_id. The
reference is indexed in content-defined blocks: of every ``window`` (50) words
the least of the 26 hashes of 25 words is their anchor (leftmost of equal
ones), and the neighbouring windows with one anchor form a block. Equal windows
have equal anchors at equal places, so they are found whatever surrounds them.

A document takes a block as one factor if the block's words stand whole in an
earlier document. A block that stands there only in part, as at the ends of a
copied passage, is a factor boundary: its windows are looked up one by one in
the index of the windows of all distinct blocks with that anchor. Factors that
follow each other both in the document and in the reference are joined. Every
word of a factor is removed; each factor is at least one window long.

Hashes of 64 bits only nominate anchors. Blocks and windows are compared by a
BLAKE2 digest (128 bits) of their words' bytes.

On Spark: occurrences of one anchor are never paired. They are reduced to
minima by anchor, by (anchor, block) and by window, all combined before the
shuffle, and joined back by plain joins that Spark can split. Only the first
copy of each distinct block is cut in windows, so thousands of copies cost one.

Defined results: words are runs of other bytes than space, tab, line feed,
vertical tab, form feed and carriage return; a null or short text loses nothing;
rows with one doc_id never remove each other's words, and a row without doc_id
is neither compared nor a reference; rows with equal doc_id and text have equal
results; windows are judged on the input texts; other columns are kept, but
those named like the result's give way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_long, materialise, mix
from .rolling import ngram_hashes, word_spans, words_of


@dataclass(frozen=True)
class Params:
    window: int = 50  # words; a factor has at least as many
    gram: int = 25  # words hashed for an anchor


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least of each ``width`` neighbouring hashes."""
    value, at, have = h, np.arange(len(h)), 1
    while have < width:
        step = min(have, width - have)
        a, b = value[:-step], value[step:]
        right = b < a
        at = np.where(right, at[step:], at[:-step])
        value = np.where(right, b, a)
        have += step
    return at


def blocks(words: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, last window) of the blocks of a text."""
    if len(words) < p.window:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = mix(ngram_hashes(words, p.gram))
    at = _least(h, p.window - p.gram + 1)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at)) - 1
    return h[at[first]], first, last


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def _occurrences(p: Params):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts, digests = [], []
            for row, text in zip(frame["row"].tolist(), frame["text"]):
                data, words = words_of(text)
                anchors, first, last = blocks(words, p)
                if len(anchors):
                    lo, hi = word_spans(data)
                    digests += [_digest(data[a:b]) for a, b in zip(lo[first].tolist(), hi[last + p.window - 1].tolist())]
                    parts.append((np.full(len(anchors), row), as_long(anchors), first, last))
            if parts:
                row, anchor, first, last = map(np.concatenate, zip(*parts))
                halves = _halves(digests)
                yield pd.DataFrame({"row": row, "anchor": anchor, "c1": halves[:, 0], "c2": halves[:, 1], "start": first.astype(np.int32), "last": last.astype(np.int32)})

    return run


def _windows(p: Params):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, places, digests = [], [], []
            for row, text, starts, lasts in zip(frame["row"].tolist(), frame["text"], frame["starts"], frame["lasts"]):
                data = words_of(text, hashes=False)[0]
                lo, hi = word_spans(data)
                at = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(starts, lasts)]))
                digests += [_digest(data[a:b]) for a, b in zip(lo[at].tolist(), hi[at + p.window - 1].tolist())]
                rows.append(np.full(len(at), row))
                places.append(at.astype(np.int32))
            if rows:
                halves = _halves(digests)
                yield pd.DataFrame({"row": np.concatenate(rows), "c1": halves[:, 0], "c2": halves[:, 1], "start": np.concatenate(places)})

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with the key of a row: equal rows share it."""
    return docs.withColumn("__row", F.xxhash64("doc_id", "text"))


def factors(docs: DataFrame, p: Params = Params(), label: str = "repeats") -> DataFrame:
    """(doc_id, row, start, last, ref_doc, ref_start): windows start..last of a row
    that stand in document ref_doc from window ref_start on."""
    texts = _keyed(docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")).withColumnRenamed("__row", "row")
    # The row key leads back to the doc_id, so Python sees neither its type nor other columns.
    ids = texts.select("row", "doc_id").distinct()
    found = texts.select("row", "text").mapInPandas(_occurrences(p), "row long, anchor long, c1 long, c2 long, start int, last int")
    occ = materialise(found, f"{label}-blocks")
    least = occ.groupBy("anchor").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("row", "c1", "c2") for f in (F.min, F.max)))
    least = least.where("min_row <> max_row").select("anchor", F.expr("min_c1 <> max_c1 OR min_c2 <> max_c2").alias("mixed"))
    # The minima are written first, and no grouping by anchor follows the join: so
    # it reads two plain shuffles, and Spark can split a frequent anchor.
    least = materialise(least, f"{label}-anchors")
    kept = materialise(occ.join(least, "anchor").join(ids, "row"), f"{label}-repeated")

    first = kept.groupBy("anchor", "c1", "c2").agg(F.min("doc_id").alias("ref_doc"), F.min_by("start", "doc_id").alias("ref_start"))
    first = materialise(first, f"{label}-first")
    parsed = materialise(kept.join(first, ["anchor", "c1", "c2"]).select("row", "doc_id", "start", "last", "mixed", "ref_doc", "ref_start"), f"{label}-parsed")
    whole = parsed.where("doc_id > ref_doc").drop("mixed")

    # Factor boundaries: the windows of blocks that no earlier document holds whole.
    open_ = parsed.where("doc_id = ref_doc AND mixed").groupBy("row").agg(F.collect_set(F.struct("start", "last")).alias("s"))
    open_ = open_.select("row", F.col("s.start").alias("starts"), F.col("s.last").alias("lasts"))
    texts = texts.select("row", "text").join(open_, "row").mapInPandas(_windows(p), "row long, c1 long, c2 long, start int")
    windows = materialise(texts.distinct().join(ids, "row"), f"{label}-windows")
    index = windows.groupBy("c1", "c2").agg(F.min("doc_id").alias("ref_doc"), F.max("doc_id").alias("most"), F.min_by("start", "doc_id").alias("ref_start")).where("ref_doc < most")
    index = materialise(index, f"{label}-index")
    part = windows.join(index, ["c1", "c2"]).where("doc_id > ref_doc").select("row", "doc_id", "start", F.col("start").alias("last"), "ref_doc", "ref_start")
    return whole.unionByName(part)


_CLEAN = "kept string, n_words long, n_removed long, joined array<int>"


def _cleaner(p: Params):
    def clean(text: pd.Series, starts: pd.Series, lasts: pd.Series, refs: pd.Series, ref_starts: pd.Series) -> pd.DataFrame:
        out = []
        for x, a, b, r, s in zip(text, starts, lasts, refs, ref_starts):
            words = (x or "").encode().split()
            if a is None or not len(a):
                out.append((b" ".join(words).decode(), len(words), 0, []))
                continue
            depth = np.zeros(len(words) + 1, np.int64)
            np.add.at(depth, a, 1)
            np.add.at(depth, np.asarray(b) + p.window, -1)
            gone = np.cumsum(depth)[:-1] > 0
            left = [words[i] for i in np.flatnonzero(~gone)]
            # A factor goes on where the text and the reference both do.
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != b[:-1] + 1) | (r[1:] != r[:-1]) | (s[1:] - s[:-1] != a[1:] - a[:-1])
            out.append((b" ".join(left).decode(), len(words), int(gone.sum()), np.flatnonzero(new).tolist()))
        return pd.DataFrame(out, columns=["kept", "n_words", "n_removed", "joined"])

    return F.pandas_udf(clean, _CLEAN)


def remove_repeats(docs: DataFrame, p: Params = Params(), label: str = "repeats") -> DataFrame:
    """``docs`` plus kept (words left, joined by one space), n_words, n_removed and
    factors (start and number of words, reference document and its first word)."""
    # A set: equal rows found the same.
    parts = F.sort_array(F.collect_set(F.struct("start", "last", "ref_doc", "ref_start")))
    spans = factors(docs, p, label).groupBy("doc_id", "row").agg(parts.alias("__parts"))
    spans = spans.withColumnsRenamed({"doc_id": "__d", "row": "__r"})
    base = _keyed(docs.drop("kept", "n_words", "n_removed", "factors"))
    out = base.join(spans, (F.col("doc_id") == F.col("__d")) & (F.col("__row") == F.col("__r")), "left")
    refs = F.transform("__parts.ref_doc", lambda d: F.xxhash64(d))
    out = out.withColumn("__c", _cleaner(p)("text", "__parts.start", "__parts.last", refs, "__parts.ref_start"))

    def factor(at, k):
        a = F.element_at("__parts", at + 1)
        end = F.when(k + 1 < F.size("__c.joined"), F.element_at("__c.joined", F.least(k + 2, F.size("__c.joined")))).otherwise(F.size("__parts"))
        words = F.element_at("__parts", end)["last"] - a["start"] + p.window
        return F.struct(a["start"].alias("start"), words.alias("words"), a["ref_doc"].alias("ref_doc"), a["ref_start"].alias("ref_start"))

    out = out.withColumn("factors", F.transform("__c.joined", factor))
    return out.select(*(c for c in base.columns if c != "__row"), "__c.kept", "__c.n_words", "__c.n_removed", "factors")


#: Every window of every text, by its words, for DuckDB.
ORACLE = r"""
WITH w AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents
), wins AS (
    SELECT r, doc_id, i, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) AS h
    FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)
), least AS (
    SELECT h, min(doc_id) AS d FROM wins GROUP BY h
), gone AS (
    SELECT DISTINCT r, i + k AS i FROM wins JOIN least USING (h), range(50) t(k) WHERE doc_id > d
), words AS (
    SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w
), kept AS (
    SELECT words.r, string_agg(word, ' ' ORDER BY words.i) FILTER (WHERE gone.i IS NULL) AS kept, count(gone.i) AS n_removed
    FROM words LEFT JOIN gone ON gone.r = words.r AND gone.i = words.i GROUP BY words.r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""
