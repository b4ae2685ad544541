"""N-gram Jaccard join by signature trees.

Two documents link when the Jaccard similarity of their word-shingle sets is at
least ``num / den`` (compared in whole numbers). The result has one row per
document row: doc_id, n_shingles, component_id.

Steps, all as Spark jobs over the whole table:

1. Each text becomes its set of 64-bit shingle hashes; its bitmap signature and
   its *prefix* (the first n - ceil(t n) + 1 tokens in one global order) are
   kept. Two sets that link share a prefix token, whatever the order. The order
   puts the corpus's very frequent tokens last, which only makes groups small.
2. Equal sets collapse to one representative.
3. Representatives that share a prefix token with any other are the only ones
   that can link; their texts are written once.
4. *Min-token groups*: under a few random orders, documents with the same first
   token form a group. Groups are split into block pairs; each unit builds
   signature trees (OR-combined bitmaps and size ranges), traverses node pairs,
   and checks the pairs that are left on the exact sets. Pairs already joined
   through others are skipped, so a group of copies costs about its size.
5. *Prefix groups*: tokens whose documents are still in two or more components
   get the same dual traversal on the bitmaps; pairs that were not compared in
   step 4 are checked exactly. This step makes the result whole.
6. Components by large-star / small-star steps.

Defined results: null, empty or blank texts have no set (n_shingles 0) and are
a component of their own; rows with one doc_id are one document, with the links
of all their texts; a null doc_id
links with nothing and has a null component; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sigtree
from .common import U64, Sets, as_long, blocked, components, group_starts, grouped, materialise, mix, shingles, word_hashes


@dataclass(frozen=True)
class Params:
    words: int = 5
    num: int = 80
    den: int = 100
    orders: int = 3  # random token orders of step 4
    frequent: int = 65536  # length of the "last" list of the global order
    local: int = 8  # a token is reported as frequent from this count in a batch
    block: int = 256  # documents of a block

    @property
    def threshold(self) -> sigtree.Threshold:
        return sigtree.Threshold(self.num, self.den)


def _sets(texts: Iterable[str | None], p: Params) -> Iterator[np.ndarray]:
    for words in word_hashes(texts):
        yield shingles(words, p.words)


def _profiles(docs: DataFrame, p: Params) -> DataFrame:
    """Size and fingerprint of each set; a batch's locally frequent tokens ride on its first row."""

    def run(frames):
        for frame in frames:
            sets = list(_sets(frame["text"], p))
            made = pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "hash": frame["hash"], "n_shingles": [len(s) for s in sets]})
            with np.errstate(over="ignore"):
                made["sum_a"] = as_long(np.array([s.sum(dtype=U64) for s in sets], U64))
                made["sum_b"] = as_long(np.array([mix(s).sum(dtype=U64) for s in sets], U64))
            tokens = np.concatenate(sets) if sets else np.empty(0, U64)
            slot = (tokens >> U64(44)).astype(np.int64)
            tokens = tokens[np.bincount(slot, minlength=1 << 20)[slot] >= p.local]
            tokens, n = np.unique(tokens, return_counts=True)
            keep = n >= p.local
            made["tokens"] = None
            made["counts"] = None
            if len(made) and keep.any():
                made.at[made.index[0], "tokens"] = as_long(tokens[keep])
                made.at[made.index[0], "counts"] = n[keep]
            yield made

    shape = "doc_id long, hash long, n_shingles long, sum_a long, sum_b long, tokens array<long>, counts array<long>"
    return docs.mapInPandas(run, shape)


def _frequent_tokens(profiles: DataFrame, p: Params) -> np.ndarray:
    """Tokens to put last in the global order, the most frequent at the very end.

    Only an order: any order gives the same result, so the fixed length of the
    list (which bounds what the driver and the tasks hold) drops nothing.
    """
    rows = (
        profiles.where("tokens IS NOT NULL")
        .select(F.explode(F.arrays_zip("tokens", "counts")).alias("x"))
        .groupBy(F.col("x.tokens").alias("token"))
        .agg(F.sum("x.counts").alias("n"))
        .orderBy(F.desc("n"), "token")
        .limit(p.frequent)
        .collect()
    )
    return np.array([r["token"] for r in rows], np.int64).view(U64)


def _features(docs: DataFrame, last: np.ndarray, p: Params) -> DataFrame:
    """Prefix, first tokens under the random orders, and bitmap of each set."""
    rank = np.arange(len(last), 0, -1)
    by = np.argsort(last)
    last, rank = last[by], rank[by]
    t = p.threshold
    seeds = [U64(mix(np.array([i + 1], U64))[0]) for i in range(p.orders)]

    def prefix(s: np.ndarray) -> np.ndarray:
        size = len(s) - t.own(len(s)) + 1
        if not len(last):
            return s[:size]
        at = np.minimum(np.searchsorted(last, s), len(last) - 1)
        hot = last[at] == s
        tail = s[hot][np.argsort(rank[at[hot]], kind="stable")]
        return np.concatenate([s[~hot], tail])[:size]

    def run(frames):
        for frame in frames:
            out = []
            for doc, s in zip(frame["doc_id"], _sets(frame["text"], p)):
                if not len(s):
                    continue
                keys = np.array([mix(s ^ seed).min() for seed in seeds], U64)
                bits = sigtree.bitmap(s, sigtree.width_of(len(s)))
                out.append((doc, len(s), as_long(prefix(s)), as_long(keys), bits.tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "prefix", "keys", "bits"])

    return docs.mapInPandas(run, "doc_id long, n_shingles long, prefix array<long>, keys array<long>, bits binary")


def _bits(frame: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(b, U64) for b in frame["bits"]]


def _spans(frame: pd.DataFrame, keys: list[str]):
    starts = group_starts(frame, keys)
    return zip(starts, np.append(starts[1:], len(frame)))


def _verified_units(rows: DataFrame, p: Params) -> DataFrame:
    """Step 4: exact links inside each unit, as (a, b) with b the smallest of a's set."""
    keys = ["slot", "key", "lo", "hi"]
    t = p.threshold

    def links(ids, own, lo, hi, sets, bits) -> list[tuple[int, int]]:
        sizes = np.array([len(s) for s in sets], np.int64)
        joined = Sets(len(ids))
        side = None if lo == hi else own == hi
        for i, j in sigtree.candidate_pairs(bits, sizes, side, t):
            for a, b in zip(i.tolist(), j.tolist()):
                if joined.root(a) != joined.root(b):
                    same = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    if t.holds(same, int(sizes[a] + sizes[b])):
                        joined.join(a, b)
        roots = [joined.root(k) for k in range(len(ids))]
        return [(int(ids[k]), int(ids[r])) for k, r in enumerate(roots) if r != k]

    def run(frames):
        for frame in grouped(frames, keys):
            out: list[tuple[int, int]] = []
            ids, own, lo, hi = (frame[c].to_numpy() for c in ("doc_id", "own", "lo", "hi"))
            bits, texts = _bits(frame), frame["text"].to_numpy()
            for x, y in _spans(frame, keys):
                if y - x > 1:
                    sets = list(_sets(texts[x:y], p))
                    out += links(ids[x:y], own[x:y], lo[x], hi[x], sets, bits[x:y])
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(run, "a long, b long")


def _candidates(rows: DataFrame, p: Params) -> DataFrame:
    """Step 5: pairs of different components that the trees leave."""
    keys = ["token", "bucket", "lo", "hi"]
    t = p.threshold

    def run(frames):
        for frame in grouped(frames, keys):
            left, right = [], []
            ids, own, lo, hi, part, sizes = (frame[c].to_numpy() for c in ("doc_id", "own", "lo", "hi", "component", "n_shingles"))
            bits, firsts = _bits(frame), np.stack(frame["keys"].to_numpy()) if len(frame) else None
            for x, y in _spans(frame, keys):
                if y - x < 2 or (part[x:y] == part[x]).all():
                    continue
                side = None if lo[x] == hi[x] else own[x:y] == hi[x]
                for i, j in sigtree.candidate_pairs(bits[x:y], sizes[x:y], side, t):
                    i, j = i + x, j + x
                    new = (part[i] != part[j]) & ~(firsts[i] == firsts[j]).any(axis=1)
                    left.append(np.minimum(ids[i], ids[j])[new])
                    right.append(np.maximum(ids[i], ids[j])[new])
            if left:
                yield pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(run, "a long, b long").distinct()


def _checked(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    t = p.threshold

    def run(frames):
        for frame in frames:
            keep = []
            for s, r in zip(_sets(frame["text_a"], p), _sets(frame["text_b"], p)):
                keep.append(t.holds(len(np.intersect1d(s, r, assume_unique=True)), len(s) + len(r)))
            yield frame.loc[np.array(keep, bool), ["a", "b"]]

    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").mapInPandas(run, "a long, b long")


def jaccard_classes(docs: DataFrame, p: Params = Params(), label: str = "jaccard") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    profiles = materialise(_profiles(docs, p), f"{label}-profiles")

    # A node is a text of a doc_id: rows that repeat a doc_id with other texts are
    # compared on their own and meet again when links are written.
    same = ["n_shingles", "sum_a", "sum_b"]
    nodes = profiles.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "hash", *same).distinct()
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), f"{label}-nodes")
    first = nodes.groupBy(*same).agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("other"), F.min_by("node", "doc_id").alias("node"))
    first = materialise(first, f"{label}-first-of-set")
    copies = nodes.drop("node").join(first.where("b <> other").drop("node"), same).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()
    copies = materialise(copies, f"{label}-copies")

    # From here on, ``doc_id`` is the node of the first text of each set.
    chosen = nodes.join(first.select("node"), "node", "left_semi").select("doc_id", "hash", "node")
    texts_of = lambda some: docs.join(some, ["doc_id", "hash"]).drop("doc_id", "hash").withColumnRenamed("node", "doc_id")
    features = materialise(_features(texts_of(chosen), _frequent_tokens(profiles, p), p), f"{label}-features")

    # Prefix tokens that two documents of near sizes share.
    step = float(np.log(p.den / p.num)) * 1.0001  # linked sizes are at most one bucket apart
    tokens = features.select("doc_id", "n_shingles", F.explode("prefix").alias("token"))
    shared = tokens.groupBy("token").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y")
    bucket = F.floor(F.log("n_shingles") / F.lit(step)).cast("int")
    tokens = tokens.join(shared.select("token"), "token").withColumn("bucket", F.explode(F.array(bucket, bucket + 1))).drop("n_shingles")
    tokens = materialise(tokens, f"{label}-shared")
    near = tokens.groupBy("token", "bucket").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y")
    tokens = materialise(tokens.join(near.select("token", "bucket"), ["token", "bucket"]), f"{label}-tokens")
    needed = features.join(tokens.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "n_shingles", "keys", "bits")
    needed = needed.dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "node")
    texts = materialise(texts_of(chosen.join(needed, "node")), f"{label}-texts")

    firsts = texts.select("doc_id", F.posexplode("keys").alias("slot", "key"))
    groups = firsts.groupBy("slot", "key").agg(F.count("*").alias("members")).where("members > 1")
    units = blocked(firsts.join(groups, ["slot", "key"]), "members", p.block, "doc_id")
    units = units.join(texts.select("doc_id", "text", "bits"), "doc_id")
    links = materialise(_verified_units(units, p), f"{label}-links")

    parts = components(links, f"{label}-first").withColumnRenamed("node", "doc_id")
    rest = tokens.join(parts, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    keys = ["token", "bucket"]
    still = rest.groupBy(*keys).agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members")).where("x < y")
    rows = blocked(rest.join(still.select(*keys, "members"), keys), "members", p.block, "doc_id")
    rows = rows.join(texts.select("doc_id", "n_shingles", "keys", "bits"), "doc_id")
    pairs = materialise(_candidates(rows, p), f"{label}-pairs")
    more = _checked(pairs, texts.select("doc_id", "text"), p)

    name = lambda end: nodes.select(F.col("node").alias(end), F.col("doc_id").alias(f"{end}_doc"))
    linked = links.unionByName(more).join(name("a"), "a").join(name("b"), "b").select(F.col("a_doc").alias("a"), F.col("b_doc").alias("b"))
    every = components(linked.unionByName(copies), label).withColumnRenamed("node", "doc_id")
    every = every.withColumnRenamed("component", "component_id")
    return profiles.select("doc_id", "n_shingles").join(every, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
