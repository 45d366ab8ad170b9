"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to. A flow network routes token capacity from patterns to
source quotas; a pattern's first pass costs nothing, each repetition costs more than the one before (convex), so that
every pattern is used once before any is repeated. What the flow sends is then drawn document by document in seeded
order. Only the pattern and source totals reach the driver, never documents.
"""

from __future__ import annotations

import heapq
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, staged, unstage, word_count

#: Patterns and sources that the driver solves over; more raise an error.
MAX_PATTERNS = 100_000
#: A pattern's gap counts as closed at this part of what it was to send.
NEAR = 2000


def capped_targets(sizes: dict, weights: dict, repeats: int) -> dict:
    """Shares of all sizes by weight; a share above repeats * size stops there and its excess is shared again."""
    total, out, open_ = float(sum(sizes.values())), {}, [s for s in sizes if sizes[s] > 0]
    out = {s: 0.0 for s in sizes}
    left = total
    while open_:
        weight = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / weight > repeats * sizes[s]]
        if not over:
            for s in open_:
                out[s] = left * weights[s] / weight
            break
        for s in over:
            out[s] = float(repeats * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in set(over)]
    return out


def min_cost_flow(supply: dict, member: dict, quota: dict, repeats: int) -> dict:
    """(pattern, source) -> tokens. supply: pattern -> tokens; member: pattern -> its sources; quota: source -> tokens.

    Successive shortest paths with potentials from patterns to sources over integers. A pattern offers `repeats`
    layers of its own size at cost 0, 1, 2, ... so the total is the cheapest of all largest flows.
    """
    layer = [(p, r) for p in supply for r in range(repeats) if supply[p] > 0]
    nodes = {n: i for i, n in enumerate(["s", "t", *(("p", p) for p in supply), *(("q", q) for q in quota)])}
    head, cap, cost, out = [], [], [], [[] for _ in nodes]

    def arc(a, b, c, w):
        for x, y, cc, ww in ((a, b, c, w), (b, a, 0, -w)):
            out[nodes[x]].append(len(head))
            head.append(nodes[y])
            cap.append(cc)
            cost.append(ww)
        return len(head) - 2

    for p, r in layer:
        arc("s", ("p", p), supply[p], r)
    through = {(p, q): arc(("p", p), ("q", q), repeats * supply[p], 0) for p in supply for q in member[p] if q in quota}
    for q, c in quota.items():
        arc(("q", q), "t", c, 0)
    potential = [0] * len(nodes)
    while True:
        dist, via, heap, tick = {0: 0}, {}, [(0, 0, 0)], count(1)
        done = set()
        while heap:
            d, _, x = heapq.heappop(heap)
            if x in done:
                continue
            done.add(x)
            for a in out[x]:
                if cap[a] > 0 and (nd := d + cost[a] + potential[x] - potential[head[a]]) < dist.get(head[a], 1 << 60):
                    dist[head[a]], via[head[a]] = nd, a
                    heapq.heappush(heap, (nd, next(tick), head[a]))
        if 1 not in dist:
            break
        for x, d in dist.items():
            potential[x] += d
        path, x = [], 1
        while x:
            path.append(via[x])
            x = head[via[x] ^ 1]
        push = min(cap[a] for a in path)
        for a in path:
            cap[a] -= push
            cap[a ^ 1] += push
    return {k: cap[a ^ 1] for k, a in through.items() if cap[a ^ 1] > 0}


def mix_sources(docs: DataFrame, sources: Column, size: Column, weights, repeats: int = 3, seed: int = 17, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs with `size`, `source_size`, `target` (both of the document's sources, summed) and `copies`, `taken`.

    sources: array of the document's sources (null inside the array is a source of its own; repeats are ignored).
    size: tokens, null counts as 0. weights: list of weights dealt to the sources in code-point order, null last, and
    repeated, or a function of that list of sources. Documents of size 0 or of no source are taken 0 times. Rows
    equal in all keys are drawn together. Reruns agree. Output columns replace
    input columns of the same name. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    new = ("size", "source_size", "target", "copies", "taken")
    keep = [c for c in docs.columns if c not in new]
    marked = F.array_sort(F.array_distinct(F.transform(sources, lambda s: F.when(s.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), s)))))
    pattern = F.coalesce(F.to_json(marked), F.lit("[]"))
    draw = F.xxhash64(*[F.col(k).cast("string") for k in keys], F.lit(seed))
    tokens = F.coalesce(size, F.lit(0)).cast("long")
    # What is drawn together, without the documents' other columns: texts are read here and for the result only.
    units = docs.select(pattern.alias("__p"), draw.alias("__h"), marked.alias("__m"), tokens.alias("size"))
    units = staged(units.groupBy("__p", "__h").agg(F.sum("size").alias("size"), F.first("__m").alias("__m")), "units")
    totals = units.groupBy("__p").agg(F.sum("size").alias("b"), F.first(F.coalesce("__m", F.array().cast("array<string>"))).alias("m")).limit(MAX_PATTERNS + 1).collect()
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    supply = {r["__p"]: r["b"] for r in totals}
    member = {r["__p"]: list(r["m"]) for r in totals}
    sizes: dict[str, int] = {}
    for p, ms in member.items():
        for s in ms:
            sizes[s] = sizes.get(s, 0) + supply[p]
    ordered = sorted(sizes, key=lambda s: (s[0], s))  # "0..." in code-point order, then "1", the null
    dealt = weights(ordered) if callable(weights) else [weights[i % len(weights)] for i in range(len(ordered))]
    grand = sum(supply[p] for p in supply if member[p])
    scale = grand / max(sum(sizes.values()), 1)
    target = capped_targets(sizes, dict(zip(ordered, dealt, strict=True)), repeats)
    quota = {s: round(t * scale) for s, t in target.items()}
    flow = min_cost_flow(supply, member, quota, repeats)
    sent: dict[str, int] = {}
    for (p, _), f in flow.items():
        sent[p] = sent.get(p, 0) + f
    plan = spark.createDataFrame(
        pd.DataFrame(
            {
                "__p": list(supply),
                "source_size": [sum(sizes[s] for s in member[p]) for p in supply],
                "target": [float(sum(target[s] for s in member[p])) for p in supply],
                "__whole": [sent.get(p, 0) // supply[p] if supply[p] else 0 for p in supply],
                "__rest": [sent.get(p, 0) % supply[p] if supply[p] else 0 for p in supply],
            }
        ),
        "__p string, source_size long, target double, __whole long, __rest long",
    )
    # At most MAX_PATTERNS rows are broadcast.
    light = units.join(F.broadcast(plan.where("__rest > 0").select("__p", "__rest")), "__p").where("size > 0").select("__p", "__h", "size", "__rest")
    chosen = F.broadcast(plan.join(_cuts(light), "__p", "left"))
    once = F.coalesce(_taken(), F.lit(False)).cast("long")
    base = docs.select(*keep, tokens.alias("size"), pattern.alias("__p"), draw.alias("__h"))
    out = base.join(chosen, "__p").withColumn("copies", F.when(F.col("size") > 0, F.col("__whole") + once).otherwise(F.lit(0)))
    return out.select(*keep, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _taken() -> Column:
    """Whether a unit is taken once more than its whole pattern."""
    return ((F.col("__h") <= F.col("__cut")) & ~F.array_contains("__drops", F.col("__h"))) | F.array_contains("__adds", F.col("__h"))


def _cuts(light: DataFrame) -> DataFrame:
    """(__p, __cut, __adds, __drops): a pattern's units up to hash __cut come to at most __rest tokens. The gap that
    stays is closed by single changes, each a unit to add, to drop or to swap for another, as long as one brings the
    sum nearer and the gap is over 1/NEAR of __rest."""
    upto = Window.partitionBy("__p").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    inside, at = light.withColumn("__from", F.lit(0).cast("long")), None
    for shift in (52, 40):  # 2^12 buckets in the order of the hash, then as many of the one that holds the cut
        inside = inside.withColumn("__b", F.shiftright("__h", shift))
        buckets = inside.groupBy("__p", "__rest", "__from", "__b").agg(F.sum("size").alias("__t"))
        buckets = buckets.withColumn("__from", F.col("__from") + F.coalesce(F.sum("__t").over(upto), F.lit(0)))
        at = buckets.where("__from <= __rest and __from + __t > __rest").groupBy("__p").agg(F.min("__b").alias("__b"), F.min_by("__from", "__b").alias("__from"))
        inside = inside.drop("__from").join(F.broadcast(at), ["__p", "__b"])  # a row a pattern
    so_far = F.col("__from") + F.sum("size").over(Window.partitionBy("__p").orderBy("__h").rangeBetween(Window.unboundedPreceding, 0))
    fits = inside.withColumn("__sum", so_far).where("__sum <= __rest").groupBy("__p").agg(F.max("__h").alias("__cut"), F.max("__sum").alias("__sum"))
    edge = F.shiftleft(F.col("__b"), 40) - 1  # below the bucket, where nothing in it fits
    none = F.array().cast("array<long>")
    cuts = at.join(fits, "__p", "left").join(light.groupBy("__p").agg(F.first("__rest").alias("__rest")), "__p")
    cuts = staged(cuts.select("__p", "__rest", F.coalesce("__cut", edge).alias("__cut"), F.coalesce("__sum", "__from").alias("__sum"), none.alias("__adds"), none.alias("__drops")), "cuts")
    while True:
        open_ = cuts.withColumn("__gap", F.col("__rest") - F.col("__sum")).where(F.abs("__gap") * NEAR > F.col("__rest"))
        near = light.drop("__rest").join(F.broadcast(open_), "__p").withColumn("__in", _taken())
        change = staged(best_changes(near.groupBy("__p", "__gap", "__in", "size").agg(F.count("*").alias("n"))), "changes")
        if change.isEmpty():
            break
        of = near.join(F.broadcast(change), "__p").where((~F.col("__in") & (F.col("size") == F.col("add"))) | (F.col("__in") & (F.col("size") == F.col("drop"))))
        which = of.groupBy("__p").agg(F.min(F.when(~F.col("__in"), F.col("__h"))).alias("a"), F.max(F.when(F.col("__in"), F.col("__h"))).alias("d"), F.first("add").alias("add"), F.first("drop").alias("drop"))
        both = cuts.join(which, "__p", "left")
        new = lambda x, y: F.array_compact(F.array(F.when(~F.array_contains(y, F.col(x)), F.col(x))))
        adds, drops = F.filter("__adds", lambda h: ~h.eqNullSafe(F.col("d"))), F.filter("__drops", lambda h: ~h.eqNullSafe(F.col("a")))
        adds, drops = F.concat(adds, new("a", "__drops")), F.concat(drops, new("d", "__adds"))
        after = F.col("__sum") + F.coalesce("add", F.lit(0)) - F.coalesce("drop", F.lit(0))
        grown = staged(both.select("__p", "__rest", "__cut", after.alias("__sum"), adds.alias("__adds"), drops.alias("__drops")), "cuts")
        unstage(cuts, change)
        cuts = grown
    return cuts.select("__p", "__cut", "__adds", "__drops")


def best_changes(sizes: DataFrame) -> DataFrame:
    """(__p, add, drop): for each pattern the size to add, and the size to drop for it (0: none), that leave least of __gap.

    sizes(__p, __gap, __in, size): a pattern's different sizes, taken (__in) or not, of which there are at most
    sqrt(2 * tokens). A negative gap is an excess; nothing may be added (0) if something is dropped. Of equally good
    changes the one with the smaller size to drop, then to add. Patterns that no change brings nearer have no row.
    """
    zero = sizes.select("__p", "__gap", F.lit(0).cast("long").alias("size")).distinct()
    drops = sizes.where("__in").select("__p", "__gap", "size").unionByName(zero)
    offers = sizes.where("not __in").select("__p", "__gap", "size").unionByName(zero)
    wants = drops.select("__p", "__gap", (F.col("__gap") + F.col("size")).alias("v"), F.col("size").alias("drop"), F.lit(None).cast("long").alias("a"))
    rows = wants.unionByName(offers.select("__p", "__gap", F.col("size").alias("v"), F.lit(None).cast("long").alias("drop"), F.col("size").alias("a")))
    under = F.last("a", True).over(Window.partitionBy("__p").orderBy("v", F.col("a").isNull()))
    over = F.last("a", True).over(Window.partitionBy("__p").orderBy(F.desc("v"), F.col("a").isNull()))
    rows = rows.withColumns({"under": under, "over": over}).where("drop is not null")
    rows = rows.select("__p", "__gap", "v", "drop", F.explode(F.array_compact(F.array("under", "over"))).alias("add"))
    best = rows.groupBy("__p", "__gap").agg(F.min(F.struct(F.abs(F.col("v") - F.col("add")).alias("miss"), "drop", "add")).alias("b"))
    return best.where("b.miss < abs(__gap)").select("__p", "b.add", "b.drop")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 1, 2, 3, at most three passes; null doc_ids and repeated rows are ordinary rows."""
    docs = staged(read_table(spark, sf_dir, "documents").select("doc_id", word_count(F.col("text")).alias("n"), "source"), "sizes")
    out = mix_sources(docs, F.array("source"), F.col("n"), [1, 2, 3])
    return out.select("doc_id", "size", "source_size", "target", "taken")
