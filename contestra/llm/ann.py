"""Nearest neighbours by multi-index hashing of learned rotated binary codes, reranked by exact inner products.

Vectors get one more coordinate that makes all lengths equal, so that the largest inner product is the smallest angle.
Iterative quantization learns rotations on a bounded sample (FIT_ROWS vectors); signs of the rotated coordinates are the
code, of 64 bits for each rotation. Every row is indexed: a block of rows holds a table for each 16-bit substring of its
codes. By the pigeonhole principle a code within radius r of a query's agrees with it in one of the m substrings up to
r // m bits, so probing those balls finds every code within r. Each query has one radius for all blocks: the one within
which a bounded sample of codes (RADIUS_ROWS) expects POOL * sqrt(rows) codes, so that what is reranked grows with the
root of the table. Where the balls hold more entries than the block has rows, as on vectors without near neighbours,
probing can't leave anything out and the block's codes are compared directly; both ways give the same rows. What lies
within is reranked in double precision. Queries meet all rows block by block; neither side is ever held whole.
"""

from __future__ import annotations

from math import comb, isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, staged

ROTATIONS, SUB = 4, 16
FIT_ROWS, FIT_ROUNDS, RADIUS_ROWS = 8000, 12, 32_768
ROW_BLOCK, QUERY_BLOCK = 16_384, 8192
#: Rows that a query reranks, over all blocks: about POOL * sqrt(rows), and POOL_LEAST at least. More raise recall.
POOL, POOL_LEAST = 8, 400
#: Queries whose distances to a block are held at once.
TOGETHER = 64


def usable(vector: Column) -> Column:
    """Whether a vector is there, has a length above zero and no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def hashed_sample(rows: DataFrame, key: str, n: int, wanted: int) -> DataFrame:
    """About `wanted` of n rows, never more than twice that, chosen by a hash of the key; all rows if n is no more."""
    grain = 1 << 24
    share = -(-grain * wanted // max(n, 1))
    return rows.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(grain)) < share).limit(2 * wanted) if share < grain else rows


def learn_rotations(sample: np.ndarray, rotations: int = ROTATIONS, rounds: int = FIT_ROUNDS, seed: int = 3) -> np.ndarray:
    """(rotations, dimensions, 64): orthogonal maps under which signs lose little of the sample's directions."""
    r, d, out = np.random.default_rng(seed), sample.shape[1], []
    unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-30)
    for _ in range(rotations):
        q = np.linalg.qr(r.standard_normal((max(d, 64), max(d, 64))))[0][:d]
        for _ in range(rounds if d <= 256 and len(unit) > d else 0):
            u, _, v = np.linalg.svd(unit.T @ np.sign(unit @ q), full_matrices=False)
            q = u @ v
        out.append(q[:, :64])
    return np.stack(out)


def codes(x: np.ndarray, maps: np.ndarray) -> np.ndarray:
    """uint64 words of each row, one a rotation."""
    return np.concatenate([np.packbits(x @ q > 0, axis=1).view(np.uint64) for q in maps], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of all codes a to all codes b."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


_BALLS = np.array(sorted(range(1 << SUB), key=lambda x: (int(x).bit_count(), x)), np.int64)
_BALL_END = np.cumsum([comb(SUB, s) for s in range(SUB + 1)])


class MultiIndex:
    """A table for each 16-bit substring of codes."""

    def __init__(self, words: np.ndarray):
        self.words, self.parts, self._tables = words, words.view(np.uint16).shape[1], None

    @property
    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows in the order of the substring, where each substring's rows begin), made at the first probe."""
        if self._tables is None:
            self._tables, parts = [], self.words.view(np.uint16)
            for j in range(self.parts):
                order = np.argsort(parts[:, j], kind="stable")
                self._tables.append((order, np.searchsorted(parts[order, j], np.arange((1 << SUB) + 1))))
        return self._tables

    def probing_pays(self, radius: int) -> bool:
        """Whether the balls of that radius are expected to hold fewer entries than there are rows."""
        return self.parts * _BALL_END[radius // self.parts] < 1 << SUB

    def probe(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row at most `radius` bits from the code."""
        hit, s = np.zeros(len(self.words), bool), radius // self.parts
        for (order, starts), part in zip(self.tables, code.view(np.uint16), strict=True):
            keys = _BALLS[: _BALL_END[min(s, SUB)]] ^ int(part)
            lo, n = starts[keys], starts[keys + 1] - starts[keys]
            lo, n = lo[n > 0], n[n > 0]
            if len(n):
                hit[order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]] = True
        found = np.nonzero(hit)[0]
        return found[np.bitwise_count(self.words[found] ^ code).sum(1) <= radius]


def radii(probes: np.ndarray, sample: np.ndarray, rows: int) -> np.ndarray:
    """For each probe the radius within which a table of so many rows is expected to hold the pool."""
    pool = max(POOL_LEAST, POOL * isqrt(rows))
    at = min(len(sample) - 1, -(-len(sample) * pool // max(rows, 1)))
    out = np.empty(len(probes), np.int64)
    for i in range(0, len(probes), TOGETHER):
        out[i : i + TOGETHER] = np.partition(distances(probes[i : i + TOGETHER], sample), at, axis=1)[:, at]
    return out


def search_block(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, maps: np.ndarray, longest: float, k: int, radius_of) -> list[tuple]:
    """(query, row, score) of each query's k best rows of this block, none of which is the query's own.

    radius_of gives each probe's radius; where fewer than k + 1 rows lie within, the k + 1 nearest codes count.
    """
    rest = np.sqrt(np.maximum(longest**2 - (rows * rows).sum(1), 0))
    index = MultiIndex(codes(np.hstack([rows, rest[:, None]]), maps))
    probes = codes(np.hstack([queries, np.zeros((len(queries), 1))]), maps)
    radius, out = radius_of(probes), []
    for i in range(0, len(probes), TOGETHER):
        far = None
        for j in range(i, min(len(probes), i + TOGETHER)):
            if index.probing_pays(radius[j]):
                found = index.probe(probes[j], radius[j])
            else:
                far = distances(probes[i : i + TOGETHER], index.words) if far is None else far
                found = np.nonzero(far[j - i] <= radius[j])[0]
            if len(found) <= k:
                near = distances(probes[j : j + 1], index.words)[0]
                found = np.nonzero(near <= np.partition(near, min(k, len(near) - 1))[min(k, len(near) - 1)])[0]
            found = found[ids[found] != query_ids[j]]
            score = (rows[found] * queries[j]).sum(1)
            best = np.lexsort((ids[found], -score))[:k]
            out += zip([query_ids[j]] * len(best), ids[found[best]].tolist(), score[best].tolist(), strict=True)
    return out


def nearest(table: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k found nearest of table(vec_id, embedding) to each query row.

    Ties go to the smaller vec_id. Null ids and unusable vectors take no part; of rows with the same id the one whose
    vector is smallest in the order of arrays counts, alone; shorter vectors are padded with zeros. Fewer candidates
    than k are all returned. An empty table gives an empty one.
    """
    rows = table.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), is_query.alias("q"))
    rows = staged(rows.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("q").alias("q")), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, nq, dim, longest = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("q").cast("int")), F.lit(0)), F.coalesce(F.max(F.size("v")), F.lit(1)), F.coalesce(F.sqrt(F.max(square)), F.lit(1.0))).first()
    schema = "query_id long, vec_id long, score double"

    def matrix(v) -> np.ndarray:
        out = np.zeros((len(v), dim))
        for i, x in enumerate(v):
            out[i, : len(x)] = x
        return out

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))[:, None]])

    sample = matrix(hashed_sample(rows, "vec_id", n, FIT_ROWS).toPandas().sort_values("vec_id")["v"])
    maps = learn_rotations(lifted(sample))
    spark = table.sparkSession
    fitted = spark.sparkContext.broadcast(maps)

    def encode(batches):
        for pdf in batches:
            yield pd.DataFrame({"code": [c.tobytes() for c in codes(lifted(matrix(pdf["v"])), fitted.value)]})

    known = hashed_sample(rows, "vec_id", n, RADIUS_ROWS).mapInPandas(encode, "code binary").toPandas()["code"]  # at most 2 * RADIUS_ROWS codes
    shared = spark.sparkContext.broadcast(np.frombuffer(b"".join(map(bytes, known)), np.uint64).reshape(-1, ROTATIONS))
    blocks, parts = max(1, -(-n // ROW_BLOCK)), max(1, -(-nq // QUERY_BLOCK))
    h = F.xxhash64("vec_id")
    held = rows.select("vec_id", "v", F.pmod(h, F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    asked = rows.where("q").select("vec_id", "v", F.pmod(h, F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = search_block(matrix(a["v"]), a["vec_id"].to_numpy(), matrix(b["v"]), b["vec_id"].to_numpy(), fitted.value, longest, k, lambda p: radii(p, shared.value, n)) if len(a) and len(b) else []
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    found = held.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(cell, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(table: DataFrame, found: DataFrame, k: int = 20, most: int = 200) -> float:
    """Share of the true k nearest, by brute force over all rows of table(vec_id, embedding), that found holds, for up to
    `most` of its queries chosen by hash."""
    asked = found.select("query_id").distinct().orderBy(F.xxhash64("query_id")).limit(most)
    rows = table.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", "embedding")
    x = rows.join(F.broadcast(asked.withColumnRenamed("query_id", "vec_id")), "vec_id").toPandas().drop_duplicates("vec_id")
    if not len(x):
        return 1.0
    shared = table.sparkSession.sparkContext.broadcast((x["vec_id"].to_numpy(), np.stack(x["embedding"]).astype(float)))

    def best(batches):
        ids, q = shared.value
        for pdf in batches:
            if len(pdf):
                own, y = pdf["vec_id"].to_numpy(), np.stack(pdf["embedding"]).astype(float)
                score = q @ y.T
                score[ids[:, None] == own[None]] = -np.inf
                top = np.argsort(-score, axis=1)[:, :k]
                yield pd.DataFrame({"query_id": np.repeat(ids, top.shape[1]), "vec_id": own[top].ravel(), "score": np.take_along_axis(score, top, 1).ravel()})

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = rows.mapInPandas(best, "query_id long, vec_id long, score double").where("score > double('-inf')").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    total = true.count()
    return true.join(found.select("query_id", "vec_id").distinct(), ["query_id", "vec_id"]).count() / total if total else 1.0


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all embeddings to every one whose vec_id is divisible by 20."""
    return nearest(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
