"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1-, 2- and 3-grams of the lower-cased letters (anything else is one
space) are hashed to ``features`` slots. Document frequencies are counted over
all training documents. Weights are learned by follow-the-regularised-leader
(per-coordinate rates, L1 and L2) on a bounded sample of labelled rows, dealt
to shards that learn side by side and whose weights are averaged; a second part
of the sample sets the temperature that calibrates the probabilities.

Only text and lang of training rows are learned from: those whose
crc32(doc_id as text) mod ``folds`` is not 0 and whose lang is not null. A
prediction reads the text alone.

Defined results: a null text or one without a letter is ``und`` with score 0;
without any training row every text is ``und``; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"


@dataclass(frozen=True)
class Params:
    folds: int = 5
    features: int = 1 << 14
    sample: int = 8000  # bound of the labelled rows that weights are learned on
    calibration: int = 4000  # bound of the labelled rows that set the temperature
    shards: int = 8
    shard_rows: int = 500  # a shard has at least so many rows (or all)
    updates: int = 2000  # a shard learns from at least so many rows, over and over
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1


@dataclass(frozen=True)
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray = field(repr=False)  # features + 1 (bias) rows, a column a class
    temperature: float = 1.0


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point -> its lower case, or a space for what is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            out[c] = ord(x.lower()[0])
    return out


def counts(text: str, size: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Slots and counts of a text's n-grams; None without a letter."""
    c = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not (c != 32).any():
        return None
    c = np.concatenate([[32], c, [32]]).astype(np.uint32)
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    two = c[:-1] * np.uint32(0x9E3779B1) ^ c[1:]
    three = two[:-1] * np.uint32(0x85EBCA77) ^ c[2:]
    shift = np.uint32(32 - (size.bit_length() - 1))
    total = np.zeros(size, np.int64)
    for n, grams in enumerate((c, two, three)):
        total += np.bincount(((grams + np.uint32(n)) * np.uint32(0xC2B2AE3D)) >> shift, minlength=size)
    at = np.flatnonzero(total)
    return at, total[at]


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Sparse unit TF-IDF vector, with the bias slot last."""
    found = counts(text, len(idf)) if text else None
    if found is None:
        return None
    at, n = found
    x = (1 + np.log(n)) * idf[at]
    return np.append(at, len(idf)), np.append(x / np.sqrt((x * x).sum()), 1.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, p: Params) -> np.ndarray:
    """Weights after the passes of follow-the-regularised-leader."""
    z = np.zeros((p.features + 1, classes))
    n = np.zeros_like(z)

    def weights(zi, ni):
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - p.l1, 0)
        return -shrunk / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2)

    for epoch in range(max(2, -(-p.updates // max(1, len(rows))))):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at, x, y = rows[k]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            error = softmax(x @ w)
            error[y] -= 1
            g = x[:, None] * error
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / p.alpha * w
            n[at] = grown
    return weights(z, n)


def held_out(folds: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))


def learn(docs: DataFrame, p: Params = Params()) -> Model:
    rows = docs.where(F.crc32(F.col("doc_id").cast("string")) % p.folds != 0).where("lang IS NOT NULL").select("doc_id", "text", "lang")
    size = p.features

    def frequencies(frames):
        total, docs_seen = np.zeros(size, np.int64), 0
        for frame in frames:
            for text in frame["text"]:
                found = counts(text, size) if text else None
                if found is not None:
                    total[found[0]] += 1
                    docs_seen += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"slot": np.append(at, size), "n": np.append(total[at], docs_seen)})

    seen = np.zeros(size + 1)
    for r in rows.select("text").mapInPandas(frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        seen[r["slot"]] = r["n"]
    by_lang = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    classes = sorted(by_lang)
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1
    if not classes or not seen[-1]:
        return Model([], idf, np.zeros((size + 1, 0)))

    # Rows are drawn by a hash of doc_id; the share falls as the table grows.
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    share, more = (min(1.0, n / sum(by_lang.values())) for n in (p.sample, p.sample + p.calibration))
    share = min(share, 0.75)  # a small table still leaves rows to calibrate on
    index = {c: i for i, c in enumerate(classes)}

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        made = [(v, index[y]) for t, y in zip(frame["text"], frame["lang"]) if (v := vector(t, idf)) is not None]
        w = ftrl([(at, x, y) for (at, x), y in made], len(classes), p)
        at, c = np.nonzero(w)
        return pd.DataFrame({"slot": at, "class": c, "w": w[at, c]})

    parts = max(1, min(p.shards, int(share * sum(by_lang.values())) // p.shard_rows))
    drawn = rows.where(place < share).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    shards = max(1, drawn.select("shard").distinct().count())
    parts = drawn.groupBy("shard").applyInPandas(fit, "slot long, class long, w double").groupBy("slot", "class").agg(F.sum("w").alias("w")).collect()
    weights = np.zeros((size + 1, len(classes)))
    for r in parts:
        weights[r["slot"], r["class"]] = r["w"] / shards

    grid = np.exp(np.linspace(np.log(0.02), np.log(5), 56))

    def losses(frames):
        total = np.zeros(len(grid))
        for frame in frames:
            for text, lang in zip(frame["text"], frame["lang"]):
                v = vector(text, idf)
                if v is not None:
                    logits = (v[1] @ weights[v[0]])[None, :] / grid[:, None]
                    top = logits.max(axis=1)
                    total += np.log(np.exp(logits - top[:, None]).sum(axis=1)) + top - logits[:, index[lang]]
        yield pd.DataFrame({"k": np.arange(len(grid)), "loss": total})

    held = rows.where((place >= share) & (place < max(more, min(1.0, share + 0.25))))
    sums = held.mapInPandas(losses, "k long, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).collect()
    best = min(sums, key=lambda r: (r["loss"], r["k"]), default=None)
    return Model(classes, idf, weights, float(grid[best["k"]]) if best and best["loss"] > 0 else 1.0)


def predictor(model: Model):
    """A function of the text column: struct of lang_pred and score."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            v = vector(text, model.idf) if model.classes and text else None
            if v is None:
                out.append((UNKNOWN, 0.0))
                continue
            chance = softmax((v[1] @ model.weights[v[0]]) / model.temperature)
            best = int(chance.argmax())
            out.append((model.classes[best], float(chance[best])))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    return predict


def predict(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    rows = docs.select("doc_id", held_out(p.folds).alias("held_out"), predictor(model)(F.col("text")).alias("x"))
    return rows.select("doc_id", "held_out", "x.lang_pred", "x.score")
