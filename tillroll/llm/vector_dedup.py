"""Embedding near-dedup by Euclidean p-stable hashing.

Unit vectors at cosine c are at distance sqrt(2 - 2c). In each of ``tables``
hash tables a vector's bucket is made of ``projections`` quantised random
projections floor((a.x + b) / width); close vectors often share all of them.
Vectors that share a bucket are compared by cosine in double precision. With
the defaults a pair at cosine 0.9 is found with probability 0.9994 (0.8 ^ 10 is
the chance of one table), and closer pairs almost surely.

Equal vectors collapse to one with a weight. A bucket of many vectors is split
into block pairs, so a unit holds at most about two blocks. A linked pair is
counted in the first table whose bucket both share; units return a count and
the smallest linked vec_id for each vector, never pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing (n_links 0, component their own id); vectors of
different lengths never link; rows that repeat a vec_id are one vector (the
greatest array of them), with a result row each; a null vec_id links with
nothing; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Sets, blocked, components, group_starts, grouped, materialise, mix


@dataclass(frozen=True)
class Params:
    cosine: float = 0.9
    tables: int = 50
    projections: int = 10  # raise with the logarithm of the number of vectors
    width: float = 2.0
    block: int = 512
    seed: int = 17


@lru_cache(8)
def _lines(dim: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng((p.seed, dim))
    n = p.tables * p.projections
    return draw.standard_normal((dim, n)), draw.uniform(0, p.width, n)


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def buckets(units: np.ndarray, p: Params) -> np.ndarray:
    """A 64-bit bucket of each row in each table."""
    a, b = _lines(units.shape[1], p)
    cells = np.floor((units @ a + b) / p.width).astype(np.int64).view(U64).reshape(len(units), p.tables, p.projections)
    out = np.full((len(units), p.tables), U64(units.shape[1]))
    with np.errstate(over="ignore"):
        for k in range(p.projections):
            out = mix(out * U64(0x9E3779B97F4A7C15) + cells[:, :, k])
    return out


def _hashed(vectors: DataFrame, p: Params) -> DataFrame:
    def run(frames):
        for frame in frames:
            lens = frame["vector"].map(len).to_numpy()
            for dim in np.unique(lens):
                part = frame[lens == dim]
                for k in range(0, len(part), 1024):
                    some = part.iloc[k : k + 1024]
                    hashed = buckets(unit(np.stack(some["vector"].to_numpy()).astype(np.float64)), p)
                    yield pd.DataFrame({"vec_id": some["vec_id"].to_numpy(), "buckets": list(hashed.view(np.int64))})

    return vectors.mapInPandas(run, "vec_id long, buckets array<long>")


def _links(rows: DataFrame, p: Params) -> DataFrame:
    keys = ["slot", "bucket", "lo", "hi"]

    def unit_links(slot, own, lo, hi, ids, weight, vectors, out):
        x = unit(vectors)
        if lo == hi:
            i, j = np.nonzero(np.triu(x @ x.T >= p.cosine, 1))
        else:
            left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            i, j = np.nonzero(x[left] @ x[right].T >= p.cosine)
            i, j = left[i], right[j]
        if not len(i):
            return
        linked = np.unique(np.concatenate([i, j]))
        earlier = np.zeros((len(x), p.tables), U64)
        earlier[linked] = buckets(x[linked], p)
        new = np.ones(len(i), bool)
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            new[k : k + (1 << 16)] = ~(earlier[a, :slot] == earlier[b, :slot]).any(axis=1)
        n = np.bincount(i[new], weight[j[new]], len(x)) + np.bincount(j[new], weight[i[new]], len(x))
        joined = Sets(len(x))
        order = np.argsort(ids)
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        for a, b in zip(place[i].tolist(), place[j].tolist()):
            joined.join(a, b)
        for v in linked.tolist():
            root = int(ids[order[joined.root(int(place[v]))]])
            if n[v] or root != ids[v]:
                out.append((int(ids[v]), int(n[v]), root))

    def run(frames):
        for frame in grouped(frames, keys):
            out: list[tuple[int, int, int]] = []
            slot, own, lo, hi, ids, weight, dim = (frame[c].to_numpy() for c in ("slot", "own", "lo", "hi", "vec_id", "weight", "dim"))
            vectors = frame["vector"].to_numpy()
            starts = group_starts(frame, keys)
            for x, y in zip(starts, np.append(starts[1:], len(frame))):
                if y - x > 1 and (dim[x:y] == dim[x]).all():
                    unit_links(slot[x], own[x:y], lo[x], hi[x], ids[x:y], weight[x:y], np.stack(vectors[x:y]).astype(np.float64), out)
            yield pd.DataFrame(out, columns=["vec_id", "n", "root"], dtype="int64")

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "vec_id long, n long, root long")


def near_vectors(rows: DataFrame, p: Params = Params(), label: str = "vectors") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``rows``."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    valid = F.col("vec_id").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", odd) & F.exists("vector", lambda x: x != 0)
    given = rows.where(valid).groupBy("vec_id").agg(F.max("vector").alias("vector"))
    members = materialise(given.withColumn("same", F.xxhash64("vector")), f"{label}-given")
    chosen = members.groupBy("same", "vector").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"))
    chosen = materialise(chosen.withColumn("dim", F.size("vector")), f"{label}-distinct")

    places = materialise(_hashed(chosen.select("vec_id", "vector"), p), f"{label}-buckets").select("vec_id", F.posexplode("buckets").alias("slot", "bucket"))
    many = places.groupBy("slot", "bucket").agg(F.count("*").alias("members")).where("members > 1")
    units = blocked(places.join(many, ["slot", "bucket"]), "members", p.block, "vec_id")
    units = units.join(chosen.drop("same"), "vec_id")
    links = materialise(_links(units, p), f"{label}-links")

    copies = members.join(chosen.select("same", "vector", F.col("vec_id").alias("rep"), "weight").where("weight > 1"), ["same", "vector"])
    copies = materialise(copies.select("vec_id", "rep", "weight"), f"{label}-copies")
    edges = links.select(F.col("vec_id").alias("a"), F.col("root").alias("b")).unionByName(copies.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    parts = components(edges, label).withColumnRenamed("node", "vec_id").withColumnRenamed("component", "part")
    degree = links.groupBy(F.col("vec_id").alias("rep")).agg(F.sum("n").alias("n"))
    of = rows.select("vec_id").join(copies, "vec_id", "left").withColumn("rep", F.coalesce("rep", "vec_id"))
    of = of.join(degree, "rep", "left").join(parts, "vec_id", "left")
    out = of.select("vec_id", (F.coalesce("n", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).alias("n_links"), F.coalesce("part", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
