"""Shared helpers: tables, written intermediates, word hashes, blocks, components.

Intermediates are Parquet tables in the shared folder that the session names in
``spark.checkpoint.dir``, so a lost executor never loses a finished step.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts the lineage)."""
    path = scratch_path(df.sparkSession, "llm", f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries run inside drop their shuffle files when they end.

    For steps whose result is written or collected at once: their files would
    otherwise stay until the driver's garbage is collected.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


# ---------------------------------------------------------------- hashing

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(1, 257, dtype=U64)
_FOLD[65:91] += U64(32)
_BASE = U64(0x9E3779B97F4A7C15)
#: Bytes hashed at once; keeps the working arrays small whatever the batch.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that close inputs spread evenly."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _hash_buffer(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and 64-bit hashes of the words of a byte buffer."""
    inside = ~_SPACE[buf]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, np.empty(0, U64)
    lens = np.flatnonzero(edge == -1) - starts
    first = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(lens.max()), _BASE, U64))
        value = _FOLD[buf[inside]] * power[place]
        return starts, mix(np.add.reduceat(value, first) + lens.astype(U64) * U64(0xD6E8FEB86659FD93))


def _pieces(data: bytes) -> Iterator[bytes]:
    """A long text in pieces that end at white space (a word is never cut)."""
    at = 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def word_hashes(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The hashes of each text's words (A-Z lower-cased, split at ASCII white space)."""
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        buf = np.frombuffer(b" ".join(held) + b" ", np.uint8)
        starts, hashes = _hash_buffer(buf)
        ends = np.cumsum([len(x) + 1 for x in held])
        cuts = np.searchsorted(starts, ends)
        yield from np.split(hashes, cuts[:-1])

    for text in texts:
        data = (text or "").encode()
        if held and size + len(data) > SLICE:
            yield from flush()
            held, size = [], 0
        if len(data) > SLICE:
            parts = [_hash_buffer(np.frombuffer(x, np.uint8))[1] for x in _pieces(data)]
            yield np.concatenate(parts)
            continue
        held.append(data)
        size += len(data) + 1
    if held:
        yield from flush()


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words make one shingle."""
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        if len(words) < k:
            whole = U64(len(words))
            for w in words:
                whole = whole * _BASE + w
            return mix(np.array([whole], U64))
        n = len(words) - k + 1
        out = np.zeros(n, U64)
        for j in range(k):
            out = out * _BASE + words[j : j + n]
    return np.unique(mix(out))


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ---------------------------------------------------------------- groups


def grouped(frames: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames cut so that each holds whole groups (the input is sorted by ``keys``)."""
    held: pd.DataFrame | None = None
    for frame in frames:
        if held is not None and len(held):
            frame = pd.concat([held, frame], ignore_index=True)
        starts = group_starts(frame, keys)
        if not len(starts):
            continue
        yield frame.iloc[: starts[-1]].reset_index(drop=True)
        held = frame.iloc[starts[-1] :].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def group_starts(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    if not len(frame):
        return np.empty(0, np.int64)
    new = np.zeros(len(frame), bool)
    new[0] = True
    for k in keys:
        v = frame[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def blocked(rows: DataFrame, members: str, block: int, by: str) -> DataFrame:
    """Split groups into blocks and deal each pair of blocks to a unit of its own.

    A group of m rows has ceil(m / block) blocks. A row goes to every unit
    (lo, hi) that holds its block, so any two rows of a group meet in exactly
    one unit (lo = hi for two rows of one block), and no unit has more than
    about two blocks of rows however large the group is.
    """
    parts = F.ceil(F.col(members) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(F.col(by)), F.col("parts")).cast("int")
    return (
        rows.withColumn("parts", parts)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("lo", F.least("own", "other"))
        .withColumn("hi", F.greatest("own", "other"))
        .drop("parts", "other")
    )


class Sets:
    """Disjoint sets over 0..n-1 whose root is the smallest member."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


# ---------------------------------------------------------------- components


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component): the smallest node that links reach; only linked nodes.

    ``edges`` has long columns a and b. Alternates large-star and small-star
    steps: every step is a minimum by node (combined before the shuffle) and a
    join back, which Spark can split for a node with very many links. Each
    round is written, and the loop ends when a round changes nothing.
    """
    now = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        f"{label}-edges",
    )
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] == 0 or mark == before:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, f"{label}-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        across = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(across.unionByName(low.withColumnRenamed("m", "v")).distinct(), f"{label}-small")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
