"""Line dedup by a segment-partition edit join.

Distinct lines join at an edit distance of one for each EACH characters of the shorter one, up to `most`; lines of fewer
than EACH characters, which so few edits could rewrite, join by equality only, and blank lines take no part and always
stay. A line with threshold t is split into t + 1 even segments, each indexed under (length, segment number, segment);
by the pigeonhole principle a line within reach agrees with one of them, shifted only as far as the remaining edits
allow, so each line probes the few substrings that qualify for its own and the shorter lengths. Pairs that meet under a
key are verified with banded bit-parallel edit distance. Where many lines meet under one key, their pairs are formed
block by block in the verifying task, and only true links leave it; keys that a sample of lines shows to be common are
spread over many tasks from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, read_table, staged, unstage

MOST, EACH = 2, 8
#: Lines whose keys show which are common, how many of them must share a key for that, and tasks that it is spread over.
SAMPLE, OFTEN, SPREAD = 20_000, 20, 64
#: Lines under one key whose pairs are listed; larger groups are paired where they are verified, BLOCK by BLOCK.
LISTED, BLOCK = 40, 1500
#: Ids that may be broadcast to fetch texts; more are joined.
FEW_IDS = 1_000_000
#: Characters of all pairs that are compared at once.
CELLS = 4_000_000
#: Classes with more than one line in LARGE are broadcast.
LARGE = 1000


def threshold(length, most: int):
    """Edits that lines may differ in, the shorter one having that many characters (a number or an array)."""
    return np.minimum(most, length // EACH)


def within_edits(a: list[str], b: list[str], most: int, relative: bool = False) -> np.ndarray:
    """Whether each pair is at edit distance `most` or less, by banded bit-parallel columns over all pairs at once.
    relative: within the threshold of the shorter line instead."""
    n = len(a)
    la, lb = np.fromiter(map(len, a), np.int64, n), np.fromiter(map(len, b), np.int64, n)
    swap = la < lb
    la, lb = np.where(swap, lb, la), np.where(swap, la, lb)
    good = np.zeros(n, bool)
    live = np.nonzero(la - lb <= most)[0]
    live = live[np.argsort(lb[live], kind="stable")]
    i = 0
    while i < len(live):
        step = min(len(live) - i, 20_000)
        while step > 1 and step * (lb[live[i + step - 1]] + 4 * most) > CELLS:
            step //= 2
        part, i = live[i : i + step], i + step
        dist = _band([b[k] if swap[k] else a[k] for k in part], [a[k] if swap[k] else b[k] for k in part], la[part], lb[part], most)
        good[part] = dist <= (threshold(lb[part], most) if relative else most)
    return good


def _codes(texts: list[str], lengths: np.ndarray, width: int, before: int, fill: int) -> np.ndarray:
    out = np.full((len(texts), width), fill, np.int32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int32)
    rows = np.repeat(np.arange(len(texts)), lengths)
    cols = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, cols + before] = flat
    return np.ascontiguousarray(out.T)


def _band(long: list[str], short: list[str], la: np.ndarray, lb: np.ndarray, most: int) -> np.ndarray:
    """Edit distances of the pairs, right up to `most`."""
    n, steps = len(long), int(lb.max(initial=0))
    x = _codes(long, la, steps + 2 * most + int((la - lb).max(initial=0)) + 1, most, -1)
    y = _codes(short, lb, max(steps, 1), 0, -2)
    one = np.uint64(1)
    vp = np.full(n, np.uint64((~0 << (63 - most)) & (2**64 - 1)))
    vn = np.zeros(n, np.uint64)
    dist = np.full(n, most, np.int64)
    across = np.full(n, np.uint64(1 << 62))
    for i in range(steps):
        pm = np.zeros(n, np.uint64)
        for k in range(2 * most + 1):  # bit 63 - k stands for place i + most - k of the longer line
            pm |= (x[i + 2 * most - k] == y[i]).astype(np.uint64) << np.uint64(63 - k)
        d0 = (((pm & vp) + vp) ^ vp) | pm | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        on, down = i < lb, i < la - most
        dist += on & down & ((d0 >> np.uint64(63)) == 0)
        side = on & ~down
        dist += side & ((hp & across) != 0)
        dist -= side & ((hn & across) != 0)
        across = np.where(side, across >> one, across)
        vp, vn = hn | ~((d0 >> one) | hp), (d0 >> one) & hp
    return dist


def _places(length: int, most: int) -> list[tuple[int, int, int, int, bool]]:
    """(indexed length, segment, start, end, index) of the keys of a line of that length; index false: only probed."""
    out = []
    for less in range(most + 1):
        of, start = length - less, 0
        edits = int(threshold(of, most))
        if edits < max(1, less):
            continue
        for i in range(edits + 1):  # segment i, after which edits - i edits may still come
            size = (of + i) // (edits + 1)
            for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                at = start + shift
                if at >= 0 and at + size <= length:
                    out.append((of, i, at, at + size, less == 0 and shift == 0))
            start += size
    return out


def keys_of(most: int, common=None):
    """mapInPandas function from (id, line) to (key, id, index, part): part deals a key's rows to one task, or those of
    a key in the broadcast array `common` to many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, digest = {}, xxhash.xxh64_intdigest
        often = common.value if common else np.zeros(0, np.int64)
        for pdf in batches:
            for lo in range(0, len(pdf), 5000):
                keys, ids, index = [], [], []
                for id_, line in zip(pdf["id"].to_numpy()[lo : lo + 5000].tolist(), pdf["line"].iloc[lo : lo + 5000], strict=True):
                    n = len(line)
                    if n not in places:
                        if len(places) > 20_000:
                            places.clear()
                        found = _places(n, most)
                        places[n] = [(of * 64 + i, x, y) for of, i, x, y, _ in found], [f[4] for f in found]
                    where, own = places[n]
                    keys += [digest(line[x:y].encode(), seed) for seed, x, y in where]
                    ids += [id_] * len(where)
                    index += own
                key, id_ = np.array(keys, np.uint64).astype(np.int64), np.array(ids, np.int64)
                part = np.where(np.isin(key, often), key + id_ % SPREAD, key) if len(often) else key
                yield pd.DataFrame({"key": key, "id": id_, "index": np.array(index, bool), "part": part})

    return run


def common_keys(lines: DataFrame, most: int) -> np.ndarray:
    """Sorted keys that at least OFTEN of about SAMPLE lines(id, line) share."""
    every = max(1, lines.count() // SAMPLE)
    some = lines.where(F.pmod(F.xxhash64("line"), F.lit(every)) == 0).mapInPandas(keys_of(most), "key long, id long, index boolean, part long")
    found = some.groupBy("key").agg(F.count_distinct("id").alias("n")).where(F.col("n") >= OFTEN).select("key").toPandas()
    return np.sort(found["key"].to_numpy(np.int64))


def _meet(batches: Iterator[pd.DataFrame], common=None) -> Iterator[pd.DataFrame]:
    """Within one partition, which holds all rows of its keys: pairs of ids (hot false), or key and id of crowded keys.
    Keys in the broadcast array `common`, whose rows lie in several partitions, count as crowded."""
    parts = [(p["key"].to_numpy(), p["id"].to_numpy(), p["index"].to_numpy(dtype=bool)) for p in batches]
    if not parts:
        return
    key, ids, index = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    order = np.lexsort((~index, ids, key))
    key, ids, index = key[order], ids[order], index[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
    key, ids, index = key[first], ids[first], index[first]
    starts = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0]
    sizes = np.diff(np.r_[starts, len(key)])
    crowded, found = sizes > LISTED, []
    if common is not None and len(common.value):
        crowded |= np.isin(key[starts], common.value)
    for size in np.unique(sizes[(sizes > 1) & ~crowded]):
        at = starts[(sizes == size) & ~crowded, None] + np.arange(size)
        i, j = np.triu_indices(size, 1)
        a, b = at[:, i].ravel(), at[:, j].ravel()
        some = index[a] | index[b]
        found.append(np.stack([ids[a[some]], ids[b[some]]], 1))
    if found:
        pairs = np.unique(np.concatenate(found), axis=0)
        for i in range(0, len(pairs), 100_000):
            yield pd.DataFrame({"hot": False, "a": pairs[i : i + 100_000, 0], "b": pairs[i : i + 100_000, 1]})
    crowd = np.repeat(crowded, sizes)
    at = np.nonzero(crowd)[0]
    for i in range(0, len(at), 100_000):
        yield pd.DataFrame({"hot": True, "a": key[at[i : i + 100_000]], "b": ids[at[i : i + 100_000]]})


def _likely(x: list[str], y: list[str], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) whose lengths and character counts allow `most` edits."""
    spread = [np.array([np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32) % 32, minlength=32) for t in z], np.int16) for z in (x, y)]
    out = []
    for i, row in enumerate(spread[0]):
        j = np.nonzero(np.abs(spread[1] - row).sum(1) <= 2 * most)[0]
        out.append(np.stack([np.full(len(j), i), j]))
    both = np.concatenate(out, axis=1)
    return both[0], both[1]


def edit_links(lines: DataFrame, most: int = MOST) -> DataFrame:
    """(u, v), u < v: all pairs of lines(id, line), distinct lines, within the threshold of the shorter one."""
    bounded_batches(lines.sparkSession)
    lines = lines.where(F.char_length("line") >= EACH).select("id", "line")
    common = lines.sparkSession.sparkContext.broadcast(common_keys(lines, most))  # SAMPLE * keys of a line / OFTEN at most
    keyed = lines.mapInPandas(keys_of(most, common), "key long, id long, index boolean, part long").repartition("part").drop("part")
    met = staged(keyed.mapInPandas(lambda batches: _meet(batches, common), "hot boolean, a long, b long"), "met")
    pairs = met.where("not hot").select("a", "b").distinct()
    ids = staged(met.select(F.explode(F.when(F.col("hot"), F.array("b")).otherwise(F.array("a", "b"))).alias("id")).distinct(), "ids")
    texts = staged(lines.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, "id", "left_semi"), "texts")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = within_edits(pdf["x"].tolist(), pdf["y"].tolist(), most, True)
            yield pdf.loc[good, ["u", "v"]]

    sides = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    cold = sides.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "x", "y").mapInPandas(verify, "u long, v long")
    hot = met.where("hot").select(F.col("a").alias("key"), F.col("b").alias("id"))
    blocks = hot.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    span = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array_except(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), F.array("block")))
    cells = hot.join(blocks, "key").withColumn("block", block).withColumn("other", F.explode(span))
    cells = cells.select("key", "id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).join(texts, "id")

    def crowd(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        ids, text, found = pdf["id"].to_numpy(), pdf["line"].tolist(), []
        for lo in range(0, len(text), 500):
            i, j = _likely(text[lo : lo + 500], text, most)
            i, j = i[j > i + lo] + lo, j[j > i + lo]
            good = within_edits([text[k] for k in i], [text[k] for k in j], most, True) if len(i) else np.zeros(0, bool)
            found.append(np.stack([ids[i[good]], ids[j[good]]], 1))
        found = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"u": found[:, 0], "v": found[:, 1]})

    out = staged(cold.unionByName(cells.groupBy("key", "i", "j").applyInPandas(crowd, "u long, v long")).distinct(), "links")
    unstage(met, ids, texts)
    return out


def split_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, digest) of the lines of docs(doc_id, text) that aren't blank; null texts have none."""
    out = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return out.where(F.col("line").rlike(r"[^\s]")).withColumn("digest", F.unhex(F.md5(F.col("line").cast("binary"))))


def line_classes(docs: DataFrame, most: int = MOST) -> DataFrame:
    """A row per line that isn't blank: doc_id, line_no, class_doc_id, class_line_no, n_links, kept.

    A class is a connected group of equal or linked lines, named by its first occurrence in the order of doc_id (null
    first) and line_no, which alone is kept. n_links counts the different lines within reach. Rows that repeat a
    doc_id and line_no are treated alike. An empty table gives an empty one.
    """
    lines = split_lines(docs)
    distinct = lines.where(F.char_length("line") >= EACH).groupBy("line", "digest").agg(F.lit(1).alias("one")).drop("one")
    distinct = staged(distinct.select(F.monotonically_increasing_id().alias("id"), "digest", "line"), "lines")
    links = edit_links(distinct.select("id", "line"), most)
    degree = links.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    roots = connected_components(links).join(degree, F.col("node") == F.col("id")).select("node", "root", "n_links")
    named = distinct.select("id", "digest")
    near = named.join(roots, F.col("id") == F.col("node")).select("digest", "root", "n_links")
    tops = named.join(roots.select("root").distinct(), F.col("id") == F.col("root")).select("root", F.col("digest").alias("top"))
    near = staged(near.join(tops, "root").select("digest", "top", "n_links"), "near")
    unstage(links, distinct)
    rows = lines.select("doc_id", "line_no", "digest").join(near, "digest", "left")
    rows = staged(rows.select("doc_id", "line_no", F.coalesce("top", "digest").alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "classes")
    first = staged(rows.groupBy("class").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n")), "firsts")
    bar = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // LARGE
    large = first.where(F.col("n") > bar).select("class", F.col("first").alias("large"))  # at most LARGE rows
    out = rows.join(F.broadcast(large), "class", "left")
    light = out.where("large is null").drop("large").join(first.where(F.col("n") <= bar).select("class", "first"), "class")
    out = light.unionByName(out.where("large is not null").withColumnRenamed("large", "first"))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no"))
    return out.select("doc_id", "line_no", F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").alias("class_line_no"), "n_links", kept.alias("kept"))


def drop_repeated_lines(docs: DataFrame, most: int = MOST) -> DataFrame:
    """docs without the lines that aren't kept. Documents of which no line stays, having had some, go; n_chars follows."""
    gone = line_classes(docs.select("doc_id", "text"), most).where("not kept")
    gone = gone.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("line_no").alias("__gone"))  # a document's own lines
    rows = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    stay = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    rows = rows.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(stay))
    rows = rows.where(F.col("__gone").isNull() | F.col("text").rlike(r"[^\s]"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return rows.select(*docs.columns)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents with their class."""
    return line_classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
