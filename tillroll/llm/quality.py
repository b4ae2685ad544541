"""Quality by Bradley-Terry ranking: pairwise preferences, then a score quantile.

A text is described by shares of character kinds, repetition and lengths
(``describe``). A pair of a good and a bad document is a preference; the
Bradley-Terry score w.x is learned by the logistic loss on the difference of
the two feature vectors, side by side in shards of a bounded sample of labelled
rows, and the weights are averaged. The threshold is the quantile of the scores
of all labelled training rows at the share of bad labels.

Labels are learned only from rows whose crc32(doc_id as text) mod ``folds`` is
not ``held``; a score reads the text alone.

Defined results: null and empty texts are described as all zeros and scored;
without labels of both kinds every score is 0.5 (predicted 1); a null label
teaches nothing; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise


@dataclass(frozen=True)
class Params:
    folds: int = 3
    held: int = 1
    sample: int = 20000  # bound of the labelled rows that weights are learned on
    shards: int = 8
    opponents: int = 8  # preference pairs drawn for each document of the rarer label
    steps: int = 400
    l2: float = 1e-3


SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
KINDS = ["upper", "lower", "other letter", "digit", "blank", "newline", "other"]
EXTRA = ["chars", "words", "distinct words", "repeated next word", "word length", "line length", "distinct lines", "long words", "capital words", "sign-ended words"]
SIZE = len(SIGNS) + len(KINDS) + 2 * len(EXTRA)


@lru_cache(1)
def _kinds() -> np.ndarray:
    out = np.full(0x110000, len(SIGNS) + KINDS.index("other"), np.uint8)
    for c in range(0x110000):
        x = chr(c)
        kind = None
        if x in SIGNS:
            out[c] = SIGNS.index(x)
        elif x.isalpha():
            kind = "lower" if x.islower() else "upper" if x.isupper() else "other letter"
        elif x.isdigit():
            kind = "digit"
        elif x == "\n":
            kind = "newline"
        elif x.isspace():
            kind = "blank"
        if kind:
            out[c] = len(SIGNS) + KINDS.index(kind)
    return out


def describe(text: str | None) -> np.ndarray:
    """The feature vector of a text."""
    out = np.zeros(SIZE)
    if not text:
        return out
    n = len(text)
    shares = np.bincount(_kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=len(SIGNS) + len(KINDS)) / n
    out[: len(shares)] = np.sqrt(shares)
    words = text.split()
    w = max(1, len(words))
    lines = text.split("\n")
    extra = np.array([
        np.log1p(n) / 10,
        np.log1p(len(words)) / 10,
        len(set(words)) / w ** 0.8,
        sum(a == b for a, b in zip(words, words[1:])) / w,
        sum(map(len, words)) / w / 10,
        np.log1p(n / len(lines)) / 10,
        len(set(lines)) / len(lines),
        sum(len(x) > 20 for x in words) / w,
        sum(x[0].isupper() for x in words) / w,
        sum(not x[-1].isalnum() for x in words) / w,
    ])
    out[len(shares) :] = np.concatenate([extra, np.minimum(1, np.abs(extra)) ** 0.5])
    return out


def in_held_fold(p: Params) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % p.folds == p.held, F.lit(False))


def bradley_terry(good: np.ndarray, bad: np.ndarray, p: Params) -> np.ndarray:
    """Weights that give each preferred document the larger score."""
    if not len(good) or not len(bad):
        return np.zeros(SIZE)
    draw = np.random.default_rng(0)
    n = p.opponents * min(len(good), len(bad))
    n = max(n, len(good), len(bad))
    d = good[draw.permutation(n) % len(good)] - bad[draw.permutation(n) % len(bad)]
    w, moment, size = np.zeros(SIZE), np.zeros(SIZE), np.zeros(SIZE)
    for k in range(1, p.steps + 1):
        g = -(d * (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))[:, None]).mean(axis=0) + p.l2 * w
        moment, size = 0.9 * moment + 0.1 * g, 0.99 * size + 0.01 * g * g
        w = w - 0.05 * (moment / (1 - 0.9**k)) / (np.sqrt(size / (1 - 0.99**k)) + 1e-8)
    return w


def _frame(rows: DataFrame) -> DataFrame:
    def run(frames):
        for frame in frames:
            made = frame.drop(columns="text")
            made["x"] = [describe(t) for t in frame["text"]]
            yield made

    return rows.mapInPandas(run, "doc_id long, held_out boolean, x array<double>")


def quality_scores(docs: DataFrame, labels: DataFrame, p: Params = Params(), label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", in_held_fold(p)).select("doc_id", "held_out", "text")
    described = materialise(_frame(rows), f"{label}-features")
    marks = labels.where("quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    known = described.where("NOT held_out").join(marks, "doc_id")

    totals = known.agg(F.count("*").alias("n"), F.sum(1 - F.col("quality")).alias("bad")).first()
    n, bad = totals["n"], totals["bad"] or 0
    if not n or bad in (0, n):
        return described.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))

    spread = known.select(F.posexplode("x")).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).collect()
    mean, scale = np.zeros(SIZE), np.ones(SIZE)
    for r in spread:
        mean[r["pos"]], scale[r["pos"]] = r["m"], max(r["s"], 1e-3)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id")
        x, y = (np.stack(frame["x"].to_numpy()) - mean) / scale, frame["quality"].to_numpy()
        return pd.DataFrame({"pos": np.arange(SIZE), "w": bradley_terry(x[y == 1], x[y == 0], p)})

    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.where(place < p.sample / n).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(p.shards)))
    weights = np.zeros(SIZE)
    for r in drawn.groupBy("shard").applyInPandas(fit, "pos int, w double").groupBy("pos").agg(F.avg("w").alias("w")).collect():
        weights[r["pos"]] = r["w"]
    weights = weights / scale
    offset = float(mean @ weights)

    @F.pandas_udf("double")
    def strength(x: pd.Series) -> pd.Series:
        return pd.Series((np.stack(x.to_numpy()) * weights).sum(axis=1) - offset if len(x) else [], dtype="float64")

    scored = known.select(strength("x").alias("s"))
    share = float(bad) / float(n)
    cut, low, high = scored.agg(F.percentile_approx("s", [share, share / 2, (1 + share) / 2], 100000).alias("q")).first()["q"]
    unit = max((high - low) / 6, 1e-9)
    out = described.select("doc_id", "held_out", (1 / (1 + F.exp(-(strength("x") - F.lit(cut)) / F.lit(unit)))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
