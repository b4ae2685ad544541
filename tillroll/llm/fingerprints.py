"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases (LZ78 over words; words of more than
32 characters are read in pieces of 8): each phrase is the longest known one
plus one word. The set of phrase hashes is summarised by ``size`` minimum
hashes; the likeness of two texts is the share of equal minima, which estimates
the overlap of their phrase dictionaries.

``neighbours`` also edits each text with the head of the next document in
doc_id order. Rows are dealt to parts by ranges of doc_id and streamed in
order; the first row of a part also goes, as a ghost, to the part before it (of
the first part: to the last), so each row meets its successor in its own part
and no task holds more than a batch.

Defined results: null and empty texts are equal (no phrase; likeness 1 to each
other, 0 to others); null doc_ids come first; rows with equal doc_id are in
text order; a single row follows itself; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, word_hashes


@dataclass(frozen=True)
class Params:
    size: int = 64  # minimum hashes of a fingerprint
    part_rows: int = 4000  # rows of a part, up to ``parts`` parts
    parts: int = 20000


_LONG = re.compile(r"\S{33,}")
_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15


def _words(text: str) -> str:
    return _LONG.sub(lambda m: " ".join(m[0][i : i + 8] for i in range(0, len(m[0]), 8)), text)


class Phrases:
    """An LZ78 dictionary; a phrase is known by the rolling hash of its words."""

    __slots__ = ("known", "at")

    def __init__(self, known=(), at: int = 0) -> None:
        self.known, self.at = set(known), at

    def read(self, words: list[int]) -> "Phrases":
        known, at = self.known, self.at
        for w in words:
            at = (at * _STEP + w) & _MASK
            if at not in known:
                known.add(at)
                at = 0
        self.at = at
        return self


def minima(phrases: Phrases, size: int) -> np.ndarray:
    """Minimum hashes of the phrase set (all ones for none)."""
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    known = np.fromiter(phrases.known, U64, len(phrases.known))
    if not len(known) and phrases.at:
        known = np.array([phrases.at], U64)
    known = mix(known)
    turns = mix(np.arange(1, size + 1, dtype=U64)) | U64(1)
    with np.errstate(over="ignore"):
        for k in range(0, len(known), 4096):
            out = np.minimum(out, ((known[k : k + 4096, None] * turns) >> U64(32)).min(axis=0).astype(np.uint32))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprint(text: str | None, size: int = Params.size) -> np.ndarray:
    words = next(iter(word_hashes([_words(text or "")])))
    return minima(Phrases().read(words.tolist()), size)


def written(a: np.ndarray) -> str:
    return a.astype("<u4").tobytes().hex()


def edited(text: str, after: str) -> tuple[str, int]:
    """The text with its last quarter replaced by the head of ``after``, and where that begins."""
    n = len(text) // 4
    cut = len(text) - n
    return text[:cut] + after[:n], cut


def _fingerprints(texts: list[str], nexts: list[str], size: int):
    """Per row: fingerprint of the text and of its edit, and the edit's digest.

    The words before the last blank at or before the cut are common to both,
    so their phrases are parsed once."""
    parts, digests = [], []
    for text, after in zip(texts, nexts):
        changed, cut = edited(text, after)
        blank = max(text.rfind(" ", 0, cut), text.rfind("\n", 0, cut), 0)
        parts += [_words(text[:blank]), _words(text[blank:]), _words(changed[blank:])]
        digests.append(hashlib.sha256(changed.encode()).hexdigest())
    hashes = word_hashes(parts)
    for digest in digests:
        head, tail, other = (next(hashes).tolist() for _ in range(3))
        own = Phrases().read(head)
        yet = Phrases(own.known, own.at).read(other)
        yield minima(own.read(tail), size), minima(yet, size), digest


def neighbours(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Fingerprints of each text and its edit, and the likeness to the edit and the next document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("place", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n = docs.count()
    parts = max(1, min(p.parts, n // p.part_rows))
    marks = docs.agg(F.percentile_approx("place", [k / parts for k in range(1, parts)] or [0.5], 10 * parts + 1000).alias("q")).first()["q"] or []
    bounds = np.unique(np.array(marks if parts > 1 else [], np.int64))

    @F.pandas_udf("long")
    def part_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, place.to_numpy(), side="right"))

    firsts = docs.select("place", part_of("place").alias("part")).groupBy("part").agg(F.min("place").alias("place")).collect()
    firsts = sorted((r["part"], r["place"]) for r in firsts)
    ghost = {place: firsts[k - 1][0] for k, (_, place) in enumerate(firsts)}

    @F.pandas_udf("long")
    def ghost_of(place: pd.Series) -> pd.Series:
        return pd.Series([ghost.get(x, -1) for x in place.tolist()], dtype="int64")

    rows = docs.withColumn("part", part_of("place")).withColumn("to", ghost_of("place"))
    own = F.struct(F.col("part"), F.lit(False).alias("ghost"))
    also = F.struct(F.col("to").alias("part"), F.lit(True).alias("ghost"))
    rows = rows.withColumn("x", F.explode(F.when(F.col("to") >= 0, F.array(own, also)).otherwise(F.array(own))))
    rows = rows.select("x.part", "x.ghost", "place", "doc_id", "text")
    order = ["part", "ghost", "place", "text"]

    def run(frames):
        held = None  # last row and, once known, its fingerprints wait for the next one
        for frame in frames:
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            if len(frame):
                yield _stream(frame, p.size)
                held = frame.iloc[-1:]

    shape = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.repartition("part").sortWithinPartitions(*order).mapInPandas(run, shape)


def _stream(frame: pd.DataFrame, size: int) -> pd.DataFrame:
    """Results of all rows but the last (which is a ghost or comes again)."""
    ids, texts = frame["doc_id"].astype("Int64"), frame["text"].tolist()
    ghost = frame["ghost"].to_numpy(bool)
    made = list(_fingerprints(texts, texts[1:] + texts[-1:], size))
    out = []
    for k in np.flatnonzero(~ghost[:-1]):
        own, other, digest = made[k]
        out.append((ids[k], len(texts[k]), digest, written(own), written(other), likeness(own, other), likeness(own, made[k + 1][0])))
    result = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
    result["doc_id"] = result["doc_id"].astype("Int64")
    return result
