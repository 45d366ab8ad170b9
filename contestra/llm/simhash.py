"""SimHash near-duplicates by multi-index hashing, for Hamming distances of at most 2.

A 64-bit fingerprint is split into two 32-bit segments, each indexed by its exact value. Fingerprints at most two bits
apart either agree in the second segment, or differ there in one bit and in the first in at most one, or agree in the
first: so each probes the first table with the ball of radius 1 around its segment (33 keys) and the second with its
own (1 key), fetches what the tables hold there and verifies the whole distance. A key under which too many meet is
not paired out: its fingerprints enumerate their full ball of radius 1 and hang on the least fingerprint with the same
ball element, which links the same ones (two within 2 bits always share such an element, and sharing it puts them
within 2 bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, by_merge, connected_components, read_table, staged

#: Candidate pairs under one key beyond which it counts as hot.
HOT_PAIRS = 1024
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACE = (np.arange(8, dtype=np.uint16) * 256)[None, :]


def majority(hashes: bytes) -> int:
    """Bits set in over half of the 64-bit hashes (big-endian); 0 for none."""
    table = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    counts = np.bincount((table + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits((counts * 2 > len(table)).ravel()).tobytes(), "big")


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Bits set in over half the XXH64 of the text's shingles; 0 for null, empty and word-free texts."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_digest
    if n == 1:
        hashes = digest(b" ".join(words), seed)
    else:
        hashes = b"".join([digest(b" ".join(s), seed) for s in zip(*(words[i:] for i in range(width)), strict=False)])
    return majority(hashes)


def with_fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the 64-bit fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint(t, width, seed) for t in pdf["text"]], dtype=np.uint64).astype(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fp})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, fp long")


def near_links(prints: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Edges (u, v) that connect exactly those distinct prints.fp that chains of distances up to 2 connect."""
    high, low = F.shiftrightunsigned("fp", 32).cast("long"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    first, second = F.lit(1 << 40), F.lit(2 << 40)  # the tables' keys are kept apart above the 32 bits
    ball = F.concat(F.array(high), *[F.array(*[high.bitwiseXOR(F.lit(1 << b)) for b in range(32)])])
    table = prints.select("fp", F.explode(F.array(high + first, low + second)).alias("key"))
    probes = prints.select("fp", F.explode(F.concat(F.transform(ball, lambda k: k + first), F.array(low + second))).alias("key"))
    # Keys with more than one fingerprint of the index or probed by several are few; the rest meet only themselves.
    held = table.groupBy("key").agg(F.count("*").alias("held"))
    # A probe of the first table finds something only if that key is held.
    found = by_merge(probes).join(held, "key")
    load = found.groupBy("key").agg(F.count("*").alias("asked"), F.first("held").alias("held")).where("asked > 1")
    load = staged(load.select("key", (F.col("asked") * F.col("held") > hot_pairs).alias("hot")), "keys")
    busy = staged(by_merge(probes).join(load, "key"), "probes")
    cold = busy.where("not hot").select("key", F.col("fp").alias("a"))
    other = by_merge(table).join(load.where("not hot"), "key").select("key", F.col("fp").alias("b"))
    pairs = by_merge(cold).join(other, "key").where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select(F.col("a").alias("u"), F.col("b").alias("v"))
    crowd = busy.where("hot").select("fp").distinct()
    whole = F.concat(F.array("fp"), F.array(*[F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(64)]))
    spread = crowd.select("fp", F.explode(whole).alias("key"))
    hubs = spread.groupBy("key").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("key", "v")
    stars = by_merge(spread).join(hubs, "key").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs(doc_id, text).

    component_id is the smallest doc_id of the row's component, its own included; null doc_ids join components but
    never name one unless nothing else is in it. Equal texts, repeated rows and all word-free texts share a
    fingerprint and so a component. An empty table gives an empty one.
    """
    rows = staged(with_fingerprints(docs), "fingerprints")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(near_links(prints.select("fp"), hot_pairs))
    prints = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = prints.groupBy("root").agg(F.min("least").alias("component_id"))
    named = prints.join(named, "root").select(F.col("fp"), "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint in 16 hex digits and their component."""
    out = near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
