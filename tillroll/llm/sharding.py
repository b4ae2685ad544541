"""Sharding by longest-processing-time scheduling.

Documents with equal texts stay together. Groups are sorted by size and go, the
largest first, to the shard with the least bytes so far, through a heap. To
keep the heap's input bounded, only groups of at least 1 / ``items`` of all
bytes (at most ``items`` of them) are scheduled one by one; smaller groups are
bundled by a hash of their key into ``items`` bundles, which are scheduled in
the same order. The heap so handles at most 2 x ``items`` entries at any scale,
and the shards differ by at most about the smallest bundles. The law that holds
is ``bytes``.

Slots are numbered without a window over a whole shard: rows are counted by
(shard, bucket), the counts give each bucket its first slot, and rows are
numbered inside their bucket.

Defined results: a null text has size 1 and crc32 0 and forms one group with
the other null texts; an empty text is another group; repeated rows get a slot
each; other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    shards: int = 8
    items: int = 1 << 14
    bucket_rows: int = 10000


def longest_first(sizes: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Shard of each item: largest first, to the least loaded shard (lowest number on ties)."""
    heap = [(0, k) for k in range(shards)]
    out = {}
    for size, key in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, k = heapq.heappop(heap)
        out[key] = k
        heapq.heappush(heap, (load + size, k))
    return out


def shard(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row a row."""
    spark = docs.sparkSession
    key = F.coalesce(F.sha2("text", 256), F.lit("null"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        key.alias("key"),
    )
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"))
    totals = rows.agg(F.sum("size").alias("all"), F.count("*").alias("n")).first()
    least = max(1, -(-(totals["all"] or 0) // p.items))
    bundle = F.concat(F.lit("#"), F.pmod(F.xxhash64("key"), F.lit(p.items)).cast("string"))
    # Bounded: at most ``items`` large groups and ``items`` bundles.
    large = groups.where(F.col("size") >= least)
    small = groups.where(F.col("size") < least).groupBy(bundle.alias("key")).agg(F.sum("size").alias("size"))
    items = [(r["size"], r["key"]) for r in large.unionByName(small).collect()]
    placed = longest_first(items, p.shards)
    table = spark.createDataFrame(pd.DataFrame({"item": pd.Series(list(placed), dtype="object"), "shard": pd.Series(list(placed.values()), dtype="int32")}), "item string, shard int")
    alone = table.where("item NOT LIKE '#%'").select(F.col("item").alias("key"), F.col("shard").alias("alone"))
    bundles = table.where("item LIKE '#%'").select("item", F.col("shard").alias("bundled"))
    rows = rows.join(F.broadcast(alone), "key", "left").withColumn("item", bundle).join(F.broadcast(bundles), "item", "left")
    rows = rows.withColumn("shard", F.coalesce("alone", "bundled"))

    buckets = max(1, -(-totals["n"] // p.bucket_rows))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("long"))
    rows = rows.select("doc_id", "size", "text_crc32", "shard", "bucket")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")
    rows = rows.withColumn("rank", F.row_number().over(inside)).join(offsets, ["shard", "bucket"])
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
