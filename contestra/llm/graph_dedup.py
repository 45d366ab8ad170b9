"""Embedding near-duplicates over a robust-pruned flat graph.

Vectors of one label are dealt to overlapping shards (the nearest of learned centroids and those almost as near), and a
shard with too many vectors to cells that hold every two of its blocks together. Each cell builds a flat graph: of a
vector's nearest candidates robust pruning keeps those that no kept neighbour already covers. The adjacency lists of all
cells are then united by vector, and in each cell every vector searches the united graph greedily from the cell's
medoid and expands what lies in range. A cell holds two blocks at most, so the search is audited there against the
whole block product, which adds what the graph doesn't reach. Pairs are verified in double precision. Pairs without a
common shard are audited on sampled vectors against all rows; a label that falls short is searched again as one shard,
whose cells hold every two blocks together. A pair that several cells hold
counts in the first only, and cells return counts and spanning trees, so pairs are never listed. Equal vectors are one
node with a weight.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import hashed_sample, usable
from .common import connected_components, read_table, staged

#: Vectors a centroid is meant for, most centroids of a label, most shards of a vector, and how much less near a
#: centroid may be than the nearest.
PER_SHARD, MOST_SHARDS, OVERLAP, SLACK = 1500, 512, 4, 0.12
#: Vectors in a block of a cell; a cell has two blocks at most.
BLOCK = 2000
#: Vectors that are compared with all rows after the search.
AUDITED = 2000
FIT_ROWS = 20_000
CANDIDATES, DEGREE, ALPHA, BEAM = 48, 24, 1.2, 24
#: Expansion passes through vectors this much below the threshold.
REACH = 0.1


def flat_graph(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Neighbours of each row of unit vectors x after robust pruning of its nearest candidates."""
    n = len(x)
    c = min(CANDIDATES, n - 1)
    if c < 1:
        return [np.zeros(0, np.int64)] * n
    near = x @ x.T
    np.fill_diagonal(near, -2)
    cand = np.argpartition(-near, c - 1, axis=1)[:, :c] if c < n - 1 else np.argsort(-near, axis=1)[:, :c]
    cand = np.take_along_axis(cand, np.argsort(-np.take_along_axis(near, cand, 1), axis=1), 1)
    far = 1 - np.take_along_axis(near, cand, 1)  # cosine distance, nearest first
    alive, kept, count = np.ones(cand.shape, bool), np.zeros(cand.shape, bool), np.zeros(n, int)
    for t in range(c):
        take = alive[:, t] & (count < degree)
        kept[:, t], count = take, count + take
        between = 1 - near[cand[:, t, None], cand[:, t + 1 :]]
        alive[:, t + 1 :] &= ~(take[:, None] & (alpha * between <= far[:, t + 1 :]))
    return [row[k] for row, k in zip(cand, kept, strict=True)]


def _spread(starts, lists, nodes):
    """(position in nodes, neighbour) for each neighbour of each node of a compressed adjacency."""
    n = starts[nodes + 1] - starts[nodes]
    at = np.repeat(starts[nodes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.repeat(np.arange(len(nodes)), n), lists[at]


def range_search(x: np.ndarray, starts: np.ndarray, lists: np.ndarray, threshold: float, beam: int = BEAM, chunk: int = 256):
    """Yields (rows, rows) at `threshold` or nearer: every row searches from the medoid, then expands; an exact product
    of its chunk with all rows adds what that missed."""
    n, x32 = len(x), x.astype(np.float32)
    medoid = int(np.argmax(x @ x.mean(0)))
    for lo in range(0, n, chunk):
        q = np.arange(lo, min(n, lo + chunk))
        near = np.full((len(q), n), -2, np.float32)
        open_ = np.zeros((len(q), n), bool)

        def visit(rows, nodes):
            new = near[rows, nodes] < -1.5
            rows, nodes = rows[new], nodes[new]
            near[rows, nodes] = np.einsum("ij,ij->i", x32[q[rows]], x32[nodes])
            open_[rows, nodes] = True
            return rows, nodes

        every = np.arange(len(q))
        visit(every, np.full(len(q), medoid))
        for _ in range(beam):
            score = np.where(open_, near, -2)
            best = score.argmax(1)
            rows = every[score[every, best] > -1.5]
            if not len(rows):
                break
            open_[rows, best[rows]] = False
            at, nb = _spread(starts, lists, best[rows])
            visit(rows[at], nb)
        at, nb = _spread(starts, lists, q)  # a row is a node itself: what is in range links up with it
        visit(at, nb)
        rows, nodes = np.nonzero(open_ & (near >= threshold - REACH))
        while len(rows):
            open_[rows, nodes] = False
            at, nb = _spread(starts, lists, nodes)
            visit(rows[at], nb)
            rows, nodes = np.nonzero(open_ & (near >= threshold - REACH))
        np.maximum(near, x32[q] @ x32.T, out=near)  # the audit: tight groups are islands in the graph
        rows, nodes = np.nonzero(near >= threshold - 1e-4)
        for i in range(0, len(rows), 200_000):
            a, b = q[rows[i : i + 200_000]], nodes[i : i + 200_000]
            good = (a != b) & ((x[a] * x[b]).sum(1) >= threshold)
            yield a[good], b[good]


def centroids_of(sample: pd.DataFrame, sizes: dict, per_shard: int, most: int, seed: int = 11) -> dict:
    """label -> unit centroids after a few rounds of spherical k-means over the label's sampled vectors."""
    out, r = {}, np.random.default_rng(seed)
    for label, n in sizes.items():
        x = np.stack(sample.loc[sample["label"] == label, "v"].to_list()) if (sample["label"] == label).any() else None
        k = max(1, min(most, -(-n // per_shard)))
        if x is None or k == 1:
            out[label] = None
            continue
        c = x[r.permutation(len(x))[: min(k, len(x))]]
        for _ in range(5):
            own = (x @ c.T).argmax(1)
            c = np.stack([x[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-30)
        out[label] = c
    return out


def near_vectors(table: DataFrame, threshold: float = 0.93, per_shard: int = PER_SHARD, whole: frozenset = frozenset()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of table(vec_id, label, embedding).

    Rows link when their labels are equal and their cosine is at least threshold. Null labels, null ids and unusable
    vectors link with nothing; their component is their own id. Shorter vectors are padded with zeros. Rows with
    equal vectors link with each other, repeated rows included. Labels in `whole` are one shard each, so that no pair
    of theirs is missed. An empty table gives an empty one.
    """
    spark = table.sparkSession
    ok = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    base = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding", ok.alias("ok"))
    rows = base.withColumn("digest", F.when(F.col("ok"), F.md5(F.to_json(F.struct("label", "embedding")).cast("binary"))))
    groups = rows.where("ok").groupBy("digest").agg(F.min("vec_id").alias("node"), F.count("*").alias("w"), F.first("label").alias("label"), F.first(F.col("embedding").cast("array<double>")).alias("v"))
    groups = staged(groups, "vectors")
    sizes = {r["label"]: r["n"] for r in groups.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row a label
    dim = groups.agg(F.coalesce(F.max(F.size("v")), F.lit(1))).first()[0]

    def unit(v) -> np.ndarray:
        out = np.zeros((len(v), dim))
        for i, x in enumerate(v):
            x = np.asarray(x)
            out[i, : len(x)] = x / np.abs(x).max()
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    sample = hashed_sample(groups, "digest", sum(sizes.values()), FIT_ROWS).select("digest", "label", "v").toPandas().sort_values("digest", ignore_index=True)
    sample["v"] = list(unit(sample["v"]))
    shared = spark.sparkContext.broadcast(centroids_of(sample, sizes, per_shard, MOST_SHARDS) | dict.fromkeys(whole))

    def deal(batches):
        for pdf in batches:
            x, out = unit(pdf["v"]), []
            for label, part in pdf.groupby("label", sort=False).indices.items():
                c = shared.value.get(label)
                if c is None:
                    out += [(i, [0]) for i in part]
                    continue
                near = x[part] @ c.T
                order = np.argsort(-near, axis=1)[:, :OVERLAP]
                top = np.take_along_axis(near, order, 1)
                good = (top >= top[:, :1] - SLACK) | (np.arange(order.shape[1]) < 2)
                out += [(i, sorted(o[g].tolist())) for i, o, g in zip(part, order, good, strict=True)]
            out.sort(key=lambda t: t[0])
            yield pd.DataFrame({"node": pdf["node"], "w": pdf["w"], "label": pdf["label"], "v": list(x), "shards": [s for _, s in out]})

    schema = "node long, w long, label long, v array<double>, shards array<long>"
    dealt = staged(groups.select("node", "w", "label", "v").mapInPandas(deal, schema), "dealt")
    member = dealt.withColumn("shard", F.explode("shards"))
    load = staged(member.groupBy("label", "shard").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK)).where("n > 1"), "shards")
    # At most labels * MOST_SHARDS rows. Of a shard with several blocks, a vector goes to each cell that pairs its own.
    member = member.join(load.select("label", "shard", "blocks"), ["label", "shard"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array_except(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), F.array("block"))))
    cells = member.withColumn("other", other).select("node", "w", "label", "v", "shards", "shard", "blocks", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    key = ["label", "shard", "i", "j"]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["node"].to_numpy()
        return pd.DataFrame({"node": ids, "near": [ids[k] for k in flat_graph(np.stack(pdf["v"]))]})

    graph = cells.select("node", "v", *key).groupBy(*key).applyInPandas(build, "node long, near array<long>")
    # Of a vector a list of at most DEGREE for each cell it is in.
    graph = graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        ids, w, x = pdf["node"].to_numpy(), pdf["w"].to_numpy(), np.stack(pdf["v"])
        n, block = len(ids), pdf["block"].to_numpy()
        src = np.repeat(np.arange(n), [len(a) for a in pdf["near"]])
        to = np.concatenate([np.asarray(a, np.int64) for a in pdf["near"]]) if n else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(ids, to), n - 1)
        here = ids[at] == to
        both = np.unique(np.concatenate([src[here] * n + at[here], at[here] * n + src[here]]))
        starts = np.searchsorted(both, np.arange(n + 1) * n)
        shards = np.full((n, OVERLAP), -1)
        for i, s in enumerate(pdf["shards"]):
            shards[i, : len(s)] = s
        here, blocks, i0, j0 = pdf["shard"].iloc[0], pdf["blocks"].iloc[0], pdf["i"].iloc[0], pdf["j"].iloc[0]
        links, root = np.zeros(n, np.int64), np.arange(n)

        def find(k):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for a, b in range_search(x, starts, both % n, threshold):
            for p, q in set(zip(root[a].tolist(), root[b].tolist(), strict=True)):
                p, q = find(p), find(q)
                root[max(p, q)] = min(p, q)
            common = np.where((shards[a][:, :, None] == shards[b][:, None, :]) & (shards[a][:, :, None] >= 0), shards[a][:, :, None], 1 << 60).min((1, 2))
            mine = common == here
            if blocks > 1:  # pairs of one block belong to the cell with the next block, or the one before the last
                first = np.where(block[a] < blocks - 1, block[a], blocks - 2)
                mine &= (block[a] != block[b]) | ((first == i0) & (first + 1 == j0))
            links += np.bincount(a[mine], weights=w[b[mine]], minlength=n).astype(np.int64)
        top = np.array([find(k) for k in range(n)], np.int64)
        return pd.DataFrame({"node": ids, "links": links, "root": ids[top] if n else ids})

    found = cells.join(graph, "node").groupBy(*key).applyInPandas(search, "node long, links long, root long")
    found = staged(found, "links")
    roots = connected_components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = groups.select("digest", "node", "w").join(links, "node", "left").join(roots.withColumnRenamed("root", "top"), "node", "left")
    nodes = nodes.select("digest", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("top", "node").alias("component_id"))
    linked = rows.where("ok").select("vec_id", "digest").join(nodes, "digest").select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def audit_recall(table: DataFrame, result: DataFrame, threshold: float = 0.93, most: int = 500) -> float:
    """Share of true links found for up to `most` vectors chosen by hash, compared with all rows block by block."""
    valid = table.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    chosen = valid.orderBy(F.xxhash64("id")).limit(most).toPandas()
    mine = np.stack(chosen["v"]) if len(chosen) else np.zeros((0, 1))
    mine = mine / np.linalg.norm(mine, axis=1, keepdims=True)
    shared = table.sparkSession.sparkContext.broadcast((chosen["id"].to_numpy(), chosen["label"].to_numpy(), mine))

    def count(batches):
        ids, labels, x = shared.value
        for pdf in batches:
            y = np.stack(pdf["v"])
            near = x @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T >= threshold
            near &= (labels[:, None] == pdf["label"].to_numpy()) & (ids[:, None] != pdf["id"].to_numpy())
            yield pd.DataFrame({"vec_id": ids, "n": near.sum(1)})

    true = valid.mapInPandas(count, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    got = true.join(result.select("vec_id", "n_links"), "vec_id").agg(F.sum("n"), F.sum("n_links")).first()
    return (got[1] or 0) / got[0] if got[0] else 1.0


def short_labels(table: DataFrame, result: DataFrame, threshold: float = 0.93, most: int = AUDITED) -> frozenset:
    """Labels in which a vector, of up to `most` chosen by hash, has more true links among all rows than were found."""
    ok = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    valid = table.where(ok).select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    dim = valid.agg(F.coalesce(F.max(F.size("v")), F.lit(1))).first()[0]

    def unit(v) -> np.ndarray:
        out = np.zeros((len(v), dim))
        for i, x in enumerate(v):
            out[i, : len(x)] = x / np.abs(x).max()
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    chosen = valid.orderBy(F.xxhash64("id"), "id").limit(most).toPandas().drop_duplicates("id")
    shared = table.sparkSession.sparkContext.broadcast((chosen["id"].to_numpy(), chosen["label"].to_numpy(), unit(chosen["v"])))

    def count(batches):
        ids, labels, x = shared.value
        for pdf in batches:
            y, of, own = unit(pdf["v"]), pdf["label"].to_numpy(), pdf["id"].to_numpy()
            for label in np.unique(of):
                a, b = np.nonzero(labels == label)[0], of == label
                near = (x[a] @ y[b].T >= threshold) & (ids[a][:, None] != own[b])
                yield pd.DataFrame({"vec_id": ids[a], "label": label, "n": near.sum(1)})

    true = valid.mapInPandas(count, "vec_id long, label long, n long").groupBy("vec_id", "label").agg(F.sum("n").alias("n"))
    got = result.groupBy("vec_id").agg(F.max("n_links").alias("n_links"))
    return frozenset(r["label"] for r in true.join(got, "vec_id").where("n > n_links").select("label").distinct().collect())


def audited_vectors(table: DataFrame, threshold: float = 0.93, per_shard: int = PER_SHARD) -> DataFrame:
    """near_vectors, again with whole labels where the audit finds a link missing."""
    out = staged(near_vectors(table, threshold, per_shard), "found")
    short = short_labels(table, out, threshold)
    return near_vectors(table, threshold, per_shard, short) if short else out


def op10_graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings with their links at cosine 0.93 within a label and their component."""
    return audited_vectors(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
