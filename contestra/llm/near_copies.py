"""Near copies: SimHash links, and an exact set-similarity join on word shingles for what fingerprints don't hold.

Texts whose sets of WIDTH-word shingles have a Jaccard similarity of at least SIMILAR (4/5) link. Two such sets differ in
about 10 of 64 fingerprint bits, more than a multi-index can probe, so candidates come in two ways: sets whose
fingerprints meet in the SimHash index, and sets that share a key. Of a set of n shingles in one global order the first
n // 5 + 1 are its keys: sets that similar share a key, whatever the order. The order puts shingles that a sample of
texts shows to be common last, which keeps few sets under a key; no result depends on it. Candidates are verified on the
whole sets, once the sizes of the sets' BUCKETS parts allow it (the difference of two sets is at least the sum of the
differences in size of their parts), and then the parities of finer parts, whose number grows with the set (it is at
least the number of parts in which one set has an odd size and the other an even one). Sizes tell texts of over about
3,000 words apart no more, parities do at any length. Under a key all sets first pair with a hub; the other pairs are verified only if
their ends are then still in different components, so no pair that could join two is left out, and a group of near
copies costs about one verification a member. Under a crowded key such pairs are compared by sketch in blocks, and only
those that pass are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, staged, unstage
from .simhash import majority, near_links

WIDTH = 5
#: Sets under one key whose pairs are all listed, and hubs of a larger group.
LISTED, HUBS = 24, 3
#: Sets of one block of a crowded key; two blocks are compared in one task.
CELL = 2048
#: Texts that show which shingles are common, at least, and the part of all texts from which on more do; most shingles
#: that count as common.
SAMPLE, PART, COMMON = 4000, 16, 1_000_000
BUCKETS = 128
#: Sets of one block when pairs are verified; a task holds two blocks at a time.
BLOCK = 64
#: Ids that may be broadcast; more are joined.
FEW_IDS = 1_000_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
FIRST, LATER, CROWD = 0, 1, 2


def shingles(text: str | None, seen: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; a text of fewer words has one, a word-free one none."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(seen) > 500_000:
        seen.clear()
    out = []
    for w in words:
        h = seen.get(w)
        if h is None:
            h = seen[w] = xxhash.xxh64_intdigest(w, 42)
        out.append(h)
    h = np.array(out, np.uint64)
    n = max(1, len(h) - WIDTH + 1)
    s = np.zeros(n, np.uint64)
    for i in range(min(WIDTH, len(h))):
        s += h[i : i + n] * _MIX[i]
    s = (s ^ (s >> np.uint64(31))) * _MIX[1]
    return np.unique(s ^ (s >> np.uint64(29)))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a similarity of 4/5 at least, in whole numbers."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def sketch(s: np.ndarray) -> bytes:
    """Sizes, 255 at most, of the parts of a set by the low bits of its hashes."""
    return np.minimum(np.bincount((s % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def parities(s: np.ndarray) -> bytes:
    """A bit for each part of a set by the low bits of its hashes, whether its size is odd. There are two to four parts
    a shingle, a power of two."""
    parts = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(parts - 1)).astype(np.int64), minlength=parts).astype(np.uint8) & 1).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """What the parities of two sets show of their difference: its size at most. The finer ones are folded."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sorted, and counts) of shingles in several of a sample of docs(text)."""
    every = max(1, min(docs.count() // SAMPLE, PART))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bytes, int] = {}
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"s": np.concatenate([shingles(t, seen) for t in pdf["text"]]).view(np.int64)})

    sample = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).mapInPandas(run, "s long")
    found = sample.groupBy("s").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "s").limit(COMMON).toPandas()
    s, n = found["s"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(s)
    return s[order], n[order]


def with_sets(rows: DataFrame) -> DataFrame:
    """rows, without their text, with __set (hash of the set of shingles), __n (its size), __sketch, __parities, __fp
    (fingerprint) and __keys."""
    shared = rows.sparkSession.sparkContext.broadcast(common_shingles(rows))  # COMMON at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common, counts = shared.value
        seen: dict[bytes, int] = {}
        for pdf in batches:
            ids, sizes, parts, odd, prints, keys = [], [], [], [], [], []
            for text in pdf["text"]:
                s = shingles(text, seen)
                ids.append(xxhash.xxh64_intdigest(s.tobytes(), 7))
                sizes.append(len(s))
                parts.append(sketch(s))
                odd.append(parities(s))
                prints.append(majority(s.astype(">u8").tobytes()))
                p = len(s) // 5 + 1
                if len(common) and len(s):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    s = s[np.argsort(np.where(common[at] == s, counts[at], 0), kind="stable")]
                keys.append(s[:p].view(np.int64))
            out = pdf.drop(columns="text")
            out["__set"], out["__n"], out["__sketch"], out["__parities"], out["__keys"] = np.array(ids, np.uint64).view(np.int64), sizes, parts, odd, keys
            out["__fp"] = np.array(prints, np.uint64).view(np.int64)
            yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInPandas(run, fields + ", __set long, __n long, __sketch binary, __parities binary, __keys array<long>, __fp long")


def _meet(batches: Iterator[pd.DataFrame], listed: int) -> Iterator[pd.DataFrame]:
    """Within one partition, which holds all rows of its keys: pairs of sets with a hub (FIRST), the other pairs of those
    under a key (LATER), and for crowded keys instead of the latter key, set and size (CROWD)."""
    parts = [(p["key"].to_numpy(), p["id"].to_numpy(), p["n"].to_numpy()) for p in batches]
    if not parts:
        return
    key, ids, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    order = np.lexsort((ids, n, key))
    key, ids, n = key[order], ids[order], n[order]
    first = np.ones(len(key), bool)  # rows of equal sets meet once
    first[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
    key, ids, n = key[first], ids[first], n[first]
    starts = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0]
    sizes = np.diff(np.r_[starts, len(key)])

    def out(kind, left, right):
        if not left:
            return
        a, b = np.concatenate(left), np.concatenate(right)
        good = (ids[a] != ids[b]) & (5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b]))
        a, b = ids[a[good]], ids[b[good]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        for i in range(0, len(pairs), 100_000):
            yield pd.DataFrame({"kind": kind, "a": pairs[i : i + 100_000, 0], "b": pairs[i : i + 100_000, 1], "n": 0})

    hub, member, left, right = [], [], [], []
    for size in np.unique(sizes[(sizes > 1) & (sizes <= listed)]):
        at = starts[sizes == size, None] + np.arange(size)
        hub.append(np.repeat(at[:, size // 2], size))
        member.append(at.ravel())
        if size > 2:
            i, j = np.triu_indices(size, 1)
            i, j = i[(i != size // 2) & (j != size // 2)], j[(i != size // 2) & (j != size // 2)]
            left.append(at[:, i].ravel())
            right.append(at[:, j].ravel())
    for start, size in zip(starts[sizes > listed].tolist(), sizes[sizes > listed].tolist(), strict=True):
        for k in range(HUBS):
            hub.append(np.full(size, start + size * (2 * k + 1) // (2 * HUBS)))
            member.append(np.arange(start, start + size))
    yield from out(FIRST, hub, member)
    yield from out(LATER, left, right)
    at = np.nonzero(np.repeat(sizes > listed, sizes))[0]
    for i in range(0, len(at), 100_000):
        k = at[i : i + 100_000]
        yield pd.DataFrame({"kind": CROWD, "a": key[k], "b": ids[k], "n": n[k]})


def _crossing(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs (u, v) of sets in different components, one from each of the two blocks of a cell or both from its only
    one, that sizes and sketches allow to be similar. Values cut at a level differ by no more than the whole ones, so
    a matrix product over levels finds all of them; the whole sketches decide."""
    ids, n, root, own = (pdf[c].to_numpy() for c in ("id", "n", "root", "own"))
    x = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(-1, BUCKETS)
    top = min(int(x.max()), 16)
    levels = np.concatenate([x >= k for k in range(1, top + 1)], axis=1).astype(np.float32) if top else np.zeros((len(x), 1), np.float32)
    total = levels.sum(1)
    both = pdf["lo"].iloc[0] == pdf["hi"].iloc[0]
    left, right = (np.arange(len(x)),) * 2 if both else (np.nonzero(own == pdf["lo"].iloc[0])[0], np.nonzero(own == pdf["hi"].iloc[0])[0])
    us, vs = [], []
    for i in range(0, len(left), 256):
        a = left[i : i + 256]
        apart = total[a, None] + total[right] - 2 * (levels[a] @ levels[right].T)
        good = (9 * apart <= n[a, None] + n[right]) & (root[a, None] != root[right])
        good &= 5 * np.minimum(n[a, None], n[right]) >= 4 * np.maximum(n[a, None], n[right])
        if both:
            good &= ids[a, None] < ids[right]
        p, q = np.nonzero(good)
        for k in range(0, len(p), 50_000):
            b, c = a[p[k : k + 50_000]], right[q[k : k + 50_000]]
            sure = 9 * np.abs(x[b].astype(np.int16) - x[c]).sum(1) <= n[b] + n[c]
            us.append(ids[b[sure]])
            vs.append(ids[c[sure]])
    u, v = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (us, vs))
    return pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)})


def crossing(hot: DataFrame, blocks: DataFrame, sketches: DataFrame) -> DataFrame:
    """(u, v): pairs under a key of hot(key, id, n, root) between components that sketches(id, sketch) allow. Each key
    is dealt out in its blocks(key, blocks), two of them a cell; other pairs of a key are compared but never written."""
    dealt = hot.join(small(blocks), "key").join(sketches, "id")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "n", "root", "sketch")
    return dealt.groupBy("key", "lo", "hi").applyInPandas(_crossing, "u long, v long")


def small(df: DataFrame) -> DataFrame:
    """df, staged, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= FEW_IDS else df


def _verified(pairs: DataFrame, rows: DataFrame, sig: DataFrame, repeated: bool) -> DataFrame:
    """(u, v), staged, of the pairs(u, v) of sets that are similar; sig has a row of rows(__row, text) for every set.
    repeated: whether a __row may stand for several rows."""
    few = staged(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "few")
    one = sig.join(small(few), F.col("__set") == F.col("id"), "left_semi").groupBy(F.col("__set").alias("id")).agg(F.min_by(F.struct("__n", "__sketch", "__row"), "__row").alias("r"))
    one = staged(one.select("id", "r.*"), "sketches")

    def allowed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, y = (np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(-1, BUCKETS).astype(np.int16) for c in "xy")
                n, m = pdf["n"].to_numpy(), pdf["m"].to_numpy()
                good = 9 * np.abs(x - y).sum(1) <= n + m  # similarity 4/5: a ninth differs
                yield pdf.loc[good & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)), ["u", "v", "n", "m"]]

    both = pairs.join(one.select(F.col("id").alias("u"), F.col("__n").alias("n"), F.col("__sketch").alias("x")), "u")
    both = both.join(one.select(F.col("id").alias("v"), F.col("__n").alias("m"), F.col("__sketch").alias("y")), "v")
    sized = staged(both.mapInPandas(allowed, "u long, v long, n long, m long"), "sized")
    ends = staged(sized.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "ends")
    odd = sig.select(F.col("__set").alias("id"), F.col("__parities").alias("p")).join(small(ends), "id", "left_semi")
    odd = staged(odd.dropDuplicates(["id"]), "parities")

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = [9 * apart(p, q) <= n + m for p, q, n, m in zip(pdf["p"], pdf["q"], pdf["n"], pdf["m"], strict=True)]
            yield pdf.loc[np.array(good, bool), ["u", "v"]]

    both = sized.join(odd.withColumnRenamed("id", "u"), "u").join(odd.select(F.col("id").alias("v"), F.col("p").alias("q")), "v")
    likely = staged(both.mapInPandas(close, "u long, v long"), "likely")
    # Sets go to the cells of two blocks that hold their pairs, once each; blocks gather sets with a common neighbour.
    both = likely.unionByName(likely.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
    near = staged(both.join(least, "v").groupBy(F.col("u").alias("id")).agg(F.min("m").alias("m")), "labels")
    parts = near.groupBy("m").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    home = staged(near.join(parts, "m").select("id", F.xxhash64("m", F.pmod(F.xxhash64("id"), "parts")).alias("block")), "blocks")
    cells = likely.join(home.select(F.col("id").alias("u"), F.col("block").alias("a")), "u").join(home.select(F.col("id").alias("v"), F.col("block").alias("b")), "v")
    cells = staged(cells.select("u", "v", F.xxhash64(F.least("a", "b"), F.greatest("a", "b")).alias("cell")), "cells")
    needed = cells.select("cell", F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.collect_set("cell").alias("cells"))
    named = staged(one.join(needed, "id").select("id", "__row", "cells"), "named")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bytes, int] = {}
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "cells": pdf["cells"], "s": [shingles(t, seen).tobytes() for t in pdf["text"]]})

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, {}
        for pdf in batches:
            good = []
            for cell, u, v, s in zip(pdf["cell"].tolist(), pdf["u"].tolist(), pdf["v"].tolist(), pdf["s"], strict=True):
                if cell != at:
                    at, held = cell, {}
                if s is not None:
                    held[u] = np.frombuffer(s, np.uint64)
                good.append(s is None and similar(held[u], held[v]))
            yield pdf.loc[np.array(good, bool), ["u", "v"]]

    found = rows.select("__row", "text").join(small(named), "__row").mapInPandas(sets, "id long, cells array<long>, s binary")
    found = (found.dropDuplicates(["id"]) if repeated else found).select(F.explode("cells").alias("cell"), F.col("id").alias("u"), F.lit(0).cast("long").alias("v"), "s")
    dealt = found.unionByName(cells.select("cell", "u", "v", F.lit(None).cast("binary").alias("s"))).repartition("cell").sortWithinPartitions("cell", F.col("s").isNull())
    out = staged(dealt.mapInPandas(check, "u long, v long"), "similar")
    unstage(few, one, sized, ends, odd, likely, near, home, cells, named)
    return out


def _pairs_by_print(sig: DataFrame) -> DataFrame:
    """(u, v): pairs of sets whose fingerprints are equal or linked in the SimHash index."""
    prints = staged(sig.groupBy("__fp").agg(F.min("__set").alias("top")), "prints")
    same = sig.join(prints, "__fp").where("__set <> top").select(F.col("__set").alias("u"), F.col("top").alias("v"))
    near = near_links(prints.select(F.col("__fp").alias("fp")))
    near = near.join(prints.select(F.col("__fp").alias("u"), F.col("top").alias("a")), "u").join(prints.select(F.col("__fp").alias("v"), F.col("top").alias("b")), "v")
    return same.unionByName(near.select(F.col("a").alias("u"), F.col("b").alias("v")))


def near_copies(docs: DataFrame, listed: int = LISTED, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): docs with __row (a digest of all columns), and of each row all but the text, with __row, __set and __root.

    Rows of equal __root are connected by near copies, equal sets included. All word-free and null texts have the empty
    set. Rows that are equal in every column share their __row. An empty table gives empty ones.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.withColumn("__row", F.md5(F.to_json(F.struct(*docs.columns)).cast("binary")))
    sig = staged(with_sets(rows), "near")
    reps = sig.groupBy("__set", "__row").agg(F.count("*").alias("n")).groupBy("__set").agg(F.min("__row").alias("__row"), (F.max("n") > 1).alias("repeated"))
    reps = staged(reps, "reps")  # copies probe once
    repeated = not reps.where("repeated").isEmpty()
    keyed = sig.join(small(reps), ["__set", "__row"], "left_semi").select(F.col("__set").alias("id"), F.col("__n").alias("n"), F.explode("__keys").alias("key")).repartition("key")
    met = staged(keyed.mapInPandas(lambda batches: _meet(batches, listed), "kind int, a long, b long, n long"), "met")
    ends = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    first = met.where(F.col("kind") == FIRST).select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(_pairs_by_print(sig).select(*ends))
    first = staged(first.distinct(), "pairs")
    links = _verified(first, rows, sig, repeated)
    roots = staged(connected_components(links), "roots")

    def rooted(df: DataFrame, id_: str, out: str) -> DataFrame:
        return df.join(roots.select(F.col("node").alias(id_), F.col("root").alias(out)), id_, "left").withColumn(out, F.coalesce(out, id_))

    later = met.where(F.col("kind") == LATER).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
    later = rooted(rooted(later, "u", "ru"), "v", "rv").where("ru <> rv").select("u", "v")
    hot = rooted(met.where(F.col("kind") == CROWD).select(F.col("a").alias("key"), F.col("b").alias("id"), "n"), "id", "root")
    # Only keys that still hold several components; in a group of near copies that the hubs reach there are none.
    split = hot.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    hot = staged(hot.join(split, "key", "left_semi"), "split")
    blocks = staged(hot.groupBy("key").agg(F.ceil(F.count("*") / cell).alias("blocks")), "blocks")
    ids = staged(hot.select("id").distinct(), "ids")
    sketches = sig.select(F.col("__set").alias("id"), F.col("__sketch").alias("sketch")).join(small(ids), "id", "left_semi")
    sketches = staged(sketches.dropDuplicates(["id"]), "crowded")
    crowd = crossing(hot, blocks, sketches)
    more = later.unionByName(crowd).distinct().join(first, ["u", "v"], "left_anti")
    more = staged(more, "pairs")
    if not more.isEmpty():
        roots = connected_components(links.unionByName(_verified(more, rows, sig, repeated)))
    unstage(reps, met, first, hot, blocks, ids, sketches, more)
    out = sig.drop("__n", "__sketch", "__parities", "__keys", "__fp").join(roots, F.col("__set") == F.col("node"), "left")
    return rows, out.withColumn("__root", F.coalesce("root", "__set")).drop("node", "root")
