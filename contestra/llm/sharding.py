"""Sharding by longest processing time: whole groups, largest first, to the least-loaded shard through a heap.

A group never splits. The driver sees how many groups there are of each size, never the groups: as different sizes add up
to all bytes, there are at most sqrt(2 * bytes) of them. Groups of one size are interchangeable, so a heap deals a size's
groups to shards by number, in bulk where there are many, exactly as if they came one after another; a group then takes
its place by its rank among those of its size.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, staged, unstage

#: Rows that one numbering task sorts, about.
CELL_ROWS = 512
#: Groups with more than one row in HEAVY are at most HEAVY and broadcast; sizes up to FEW are broadcast as well.
HEAVY, FEW = 1000, 200_000


def longest_first(sizes: list[tuple[int, int]], shards: int) -> dict[int, list[int]]:
    """size -> how many groups of it each shard gets, for (size, number of groups) pairs.

    The outcome of taking all groups one by one, largest first, to the least-loaded shard, the lower of equally loaded ones.
    """
    loads, out = np.zeros(shards, np.int64), {}
    heap = [(0, s) for s in range(shards)]
    for size, n in sorted(sizes, reverse=True):
        got = [0] * shards
        if n <= 8 * shards or size == 0:
            if size == 0:
                got[heap[0][1]] = n
            else:
                for _ in range(n):
                    load, s = heap[0]
                    got[s] += 1
                    heapq.heapreplace(heap, (load + size, s))
        else:
            # Shard s would take groups at loads[s], loads[s] + size, ...: the n smallest of all those are taken.
            loads = np.array([load for load, _ in sorted(heap, key=lambda x: x[1])], np.int64)
            below = lambda t: int(np.maximum(-(-(t - loads) // size), 0).sum())  # noqa: E731  taken at loads under t
            lo, hi = int(loads.min()), int(loads.max()) + size * (n + 1)
            while lo < hi:  # the largest t with below(t) <= n
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if below(mid) <= n else (lo, mid - 1)
            took = np.maximum(-(-(lo - loads) // size), 0)
            at = [s for s in range(shards) if lo >= loads[s] and (lo - loads[s]) % size == 0]
            took[at[: n - int(took.sum())]] += 1
            got = took.tolist()
            heap = [(int(x), s) for s, x in enumerate(loads + took * size)]
            heapq.heapify(heap)
        out[size] = got
    return out


def _ranked(groups: DataFrame) -> DataFrame:
    """groups(__h, __bytes, __n, __of) with `__rank` from 0 among the __of groups of one size; no size is sorted whole."""
    cells = groups.withColumn("__cell", F.pmod("__h", F.ceil(F.col("__of") / CELL_ROWS)))
    before = Window.partitionBy("__bytes").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = cells.groupBy("__bytes", "__cell").agg(F.count("*").alias("__c")).withColumn("__from", F.coalesce(F.sum("__c").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("__bytes", "__cell").orderBy("__h")) - 1
    return cells.withColumn("__r", inside).join(counts, ["__bytes", "__cell"]).withColumn("__rank", F.col("__from") + F.col("__r"))


def shard_by_group(rows: DataFrame, group: Column, size: Column, shards: int, order: list[Column]) -> DataFrame:
    """rows with `shard` (0..shards-1) and `slot` (gapless from 0 in each shard).

    group: rows with equal values stay together (null is one group). size: bytes, null counts as 0. order: decides
    slots; rows equal in all of it take slots in any order. Output columns replace `shard` and `slot` of the input. Of
    groups of one size, which goes where follows a hash of their value. An empty table gives an empty one.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = rows.sparkSession
    keep = [c for c in rows.columns if c not in ("shard", "slot")]
    base = rows.select(*keep, F.xxhash64(group, F.lit("unit")).alias("__h"), F.coalesce(size, F.lit(0)).cast("long").alias("__size"), F.xxhash64(*order).alias("__mix"))
    # Groups go by a hash of their value. Should two values share one, their rows stay together too.
    groups = staged(base.groupBy("__h").agg(F.sum("__size").alias("__bytes"), F.count("*").alias("__n")), "groups")
    sizes = groups.groupBy("__bytes").agg(F.count("*").alias("n"), F.sum("__n").alias("rows")).toPandas()
    total = int(sizes["rows"].sum())
    dealt = longest_first(list(zip(sizes["__bytes"].tolist(), sizes["n"].tolist(), strict=True)), shards)
    plan = pd.DataFrame(
        {
            "__bytes": list(dealt),
            "__of": [sum(v) for v in dealt.values()],
            "__shards": [[s for s, n in enumerate(v) if n] for v in dealt.values()],
            "__ends": [np.cumsum([n for n in v if n]).tolist() for v in dealt.values()],
        }
    )
    plan = spark.createDataFrame(plan, "__bytes long, __of long, __shards array<int>, __ends array<long>")
    known = groups.join(F.broadcast(plan) if len(dealt) <= FEW else plan, "__bytes")
    at = F.size(F.filter("__ends", lambda e: e <= F.col("__rank"))) + 1
    placed = staged(_ranked(known).select("__h", "__n", F.element_at("__shards", at).alias("shard")), "placed")
    heavy = F.col("__n") > total // HEAVY
    few = F.broadcast(placed.where(heavy).select("__h", F.col("shard").alias("__few")))  # at most HEAVY rows
    base = base.join(few, "__h", "left")
    light = base.where("__few is null").join(placed.where(~heavy).select("__h", "shard"), "__h")
    out = light.drop("__few").unionByName(base.where("__few is not null").withColumnRenamed("__few", "shard"))
    out = out.withColumn("__cell", F.pmod("__mix", F.lit(max(1, -(-total // (shards * CELL_ROWS))))))
    cells = out.groupBy("shard", "__cell").agg(F.count("*").alias("__c"))
    before = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("shard", "__cell", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__from"))
    out = out.withColumn("__r", F.row_number().over(Window.partitionBy("shard", "__cell").orderBy(*order)))
    unstage(groups)
    return out.join(cells, ["shard", "__cell"]).select(*keep, "shard", (F.col("__from") + F.col("__r") - 1).alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 24 shards of near equal bytes, equal texts together. A null text is its own group, of size 8."""
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.md5(F.col("text").cast("binary")).alias("digest"),
    )
    out = shard_by_group(staged(docs, "sizes"), F.col("digest"), F.col("size"), 24, [F.col("doc_id"), F.col("text_crc32")])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
