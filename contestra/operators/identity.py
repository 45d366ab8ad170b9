"""Identity resolution: overlays in order of trust, unique names, birth dates as tie-break, backfill and audits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_overlay(layers: list[tuple[str, str, float]]) -> list[Column]:
    """[resolved_id, method, confidence] of the first layer (column, method, confidence) that isn't null."""
    hit = F.coalesce(*[F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("id"), F.lit(m).alias("method"), F.lit(p).alias("confidence"))) for c, m, p in layers])
    return [hit["id"].alias("resolved_id"), hit["method"].alias("method"), hit["confidence"].alias("confidence")]


def link_by_name(left: DataFrame, right: DataFrame, left_id: str, right_id: str, name: str, born: str) -> DataFrame:
    """(left_id, right_id, method, confidence) between two tables with columns name and born.

    A name with one right row links at 0.95, 0.995 if the births agree, and not at all if they differ. Among several
    right rows of a name the births decide if exactly one agrees (0.98). Empty names link nothing. Candidates are never
    paired: right rows are counted per name and per name and birth before they are joined.
    """
    r = right.where(F.length(name) > 0)
    by_name = r.groupBy(name).agg(F.count("*").alias("__n"), F.min(right_id).alias("__one"), F.min(born).alias("__born"))
    by_both = r.where(F.col(born).isNotNull()).groupBy(name, born).agg(F.count("*").alias("__m"), F.min(right_id).alias("__same"))
    agree, single = F.coalesce(F.col("__m"), F.lit(0)) == 1, F.col("__n") == 1
    differ = F.col(born).isNotNull() & F.col("__born").isNotNull() & ~agree
    found = F.when(single & agree, F.struct(F.col("__one").alias("id"), F.lit("name_birth").alias("m"), F.lit(0.995).alias("p"))).when(single & ~differ, F.struct(F.col("__one").alias("id"), F.lit("unique_name").alias("m"), F.lit(0.95).alias("p"))).when(~single & agree, F.struct(F.col("__same").alias("id"), F.lit("birth_tiebreak").alias("m"), F.lit(0.98).alias("p")))
    rows = left.join(by_name, name).join(by_both, [name, born], "left").select(left_id, found.alias("f")).where("f is not null")
    return rows.select(left_id, F.col("f.id").alias(right_id), F.col("f.m").alias("method"), F.col("f.p").alias("confidence"))


def without_collisions(links: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Links whose right row is claimed by no other left row."""
    claimed = links.groupBy(right_id).agg(F.count_distinct(left_id).alias("__c")).where("__c = 1").select(right_id)
    return links.join(claimed, right_id, "left_semi")


def backfill(rows: DataFrame, links: DataFrame, key: str, target: str) -> DataFrame:
    """rows whose null `target` is taken from links(key, target), which has one row a key at most."""
    return rows.join(links.select(key, F.col(target).alias("__to")), key, "left").withColumn(target, F.coalesce(target, "__to")).drop("__to")


def history_audit(source: DataFrame, kept: DataFrame, key: str, date: str, as_of: str) -> DataFrame:
    """(key, expected, found, coverage, freshness) (I10): none, gap or complete; fresh to 14 days, recent to 60, else stale."""
    want, have = source.groupBy(key).agg(F.count("*").alias("expected"), F.max(date).alias("__last")), kept.groupBy(key).agg(F.count("*").alias("found"))
    age = F.datediff(F.lit(as_of).cast("date"), F.col("__last"))
    return want.join(have, key, "left").select(
        key, "expected", F.coalesce("found", F.lit(0)).alias("found"),
        F.when(F.coalesce("found", F.lit(0)) == 0, "none").when(F.col("found") < F.col("expected"), "gap").otherwise("complete").alias("coverage"),
        F.when(age <= 14, "fresh").when(age <= 60, "recent").otherwise("stale").alias("freshness"),
    )


def scored_once(rows: DataFrame, key: str, rank: list[Column]) -> DataFrame:
    """The first row of each key, and whether it stood alone."""
    w = Window.partitionBy(key)
    return rows.withColumns({"__r": F.row_number().over(w.orderBy(*rank)), "alone": F.count("*").over(w) == 1}).where("__r = 1").drop("__r")


def _within(values: np.ndarray, at: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Per element of at the first and the end index of the sorted distinct values v with abs(at - v) <= most, as doubles
    are subtracted."""
    lo, hi = np.searchsorted(values, at - most), np.searchsorted(values, at + most, "right")
    wide = np.r_[-np.inf, values, np.inf]  # value i stands at i + 1
    while (move := at - wide[lo] <= most).any():
        lo = lo - move
    while (move := at - wide[lo + 1] > most).any():
        lo = lo + move
    while (move := wide[hi + 1] - at <= most).any():
        hi = hi + move
    while (move := wide[hi] - at > most).any():
        hi = hi - move
    return lo, np.maximum(lo, hi)


def sole_best(left: DataFrame, right: DataFrame, left_id: str, right_id: str, block: str, place: str, amount: str, near: float, far: float) -> DataFrame:
    """(left_id, right_id, points) where of the right rows of the same block exactly one has the most points: 3 for the
    same place, 2 for an amount within `near`, else 1 within `far` (both included).

    Pairs are never listed: right rows are counted per block, place and amount, and in bands of the amount the sorted
    amounts are searched. The best class that isn't empty holds all of its points, so its count decides.
    """

    def known(df: DataFrame) -> DataFrame:
        return df.withColumn(amount, F.col(amount).cast("double")).withColumn(amount, F.when(F.abs(amount) < float("inf"), F.col(amount)))

    def band(x: Column) -> Column:
        return F.floor(F.least(F.greatest(x, F.lit(-1e15)), F.lit(1e15)) / far).cast("long")

    rows = known(left).where(F.col(block).isNotNull()).groupBy(left_id, block, place, amount).agg(F.count("*").alias("copies"))
    values = known(right).where(F.col(block).isNotNull()).groupBy(block, place, amount).agg(F.count("*").alias("n"), F.min(right_id).alias("one"))
    everyone = values.groupBy(block).agg(F.sum("n").alias("n_all"), F.min("one").alias("id_all"))
    placed = values.where(F.col(place).isNotNull()).groupBy(block, place).agg(F.sum("n").alias("n_placed"), F.min("one").alias("id_placed"))
    kinds = ("placed_near", "placed_far", "near", "far")
    keys = [left_id, block, place, amount]

    def count(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = l[[left_id, block, place, amount]].copy()
        for k in kinds:
            out[f"n_{k}"], out[f"id_{k}"] = 0, None
        if not len(l) or not len(r):
            return out.astype({f"id_{k}": "Int64" for k in kinds})
        got = {k: (np.zeros(len(l), np.int64), np.zeros(len(l), np.int64)) for k in kinds}

        def tally(of: pd.DataFrame, rows: np.ndarray, names: tuple[str, str]) -> None:
            of = of.sort_values(amount)
            a, n, one = of[amount].to_numpy(), of["n"].to_numpy(np.int64), of["one"].to_numpy(np.int64)
            each, first = np.unique(a, return_index=True)
            at = np.r_[first, len(a)]
            total, ids = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(one)]  # a difference of ids names a row that is alone
            for name, most in zip(names, (near, far), strict=True):
                lo, hi = _within(each, l[amount].to_numpy()[rows], most)
                got[name][0][rows], got[name][1][rows] = total[at[hi]] - total[at[lo]], ids[at[hi]] - ids[at[lo]]

        tally(r, np.arange(len(l)), ("near", "far"))
        of_place = dict(list(r.groupby(place)))
        for p, rows in l.groupby(place).indices.items():
            if p in of_place:
                tally(of_place[p], rows, ("placed_near", "placed_far"))
        for k, (n, ids) in got.items():
            out[f"n_{k}"], out[f"id_{k}"] = n, pd.array(ids, "Int64")
            out.loc[n != 1, f"id_{k}"] = pd.NA
        return out

    edge = far * 1.001 + F.abs(amount) * 1e-12
    asked = rows.where(F.col(amount).isNotNull()).withColumn("__band", F.explode(F.sequence(band(F.col(amount) - edge), band(F.col(amount) + edge))))
    held = values.where(F.col(amount).isNotNull()).withColumn("__band", band(F.col(amount)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "copies")
    found = asked.groupBy(block, "__band").cogroup(held.groupBy(block, "__band")).applyInPandas(count, fields + "".join(f", n_{k} long, id_{k} long" for k in kinds))
    found = found.groupBy(*keys).agg(*[F.sum(f"n_{k}").alias(f"n_{k}") for k in kinds], *[F.max(f"id_{k}").alias(f"id_{k}") for k in kinds])
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    rows = rows.alias("l").join(found.alias("f"), same[0] & same[1] & same[2] & same[3], "left").select("l.*", *[f"f.n_{k}" for k in kinds], *[f"f.id_{k}" for k in kinds])
    rows = rows.join(everyone, block).join(placed, [block, place], "left")
    best = F.coalesce(*[F.when(F.col(f"n_{k}") > 0, F.struct(F.lit(p).cast("long").alias("points"), F.col(f"n_{k}").alias("n"), F.col(f"id_{k}").alias("id"))) for k, p in (("placed_near", 5), ("placed_far", 4), ("placed", 3), ("near", 2), ("far", 1), ("all", 0))])
    rows = rows.select(left_id, "copies", best.alias("b")).groupBy(left_id, "b.points").agg(F.sum(F.col("copies") * F.col("b.n")).alias("n"), F.max("b.id").alias("id"))
    top = rows.groupBy(left_id).agg(F.max(F.struct("points", "n", "id")).alias("t")).where("t.n = 1")
    return top.select(left_id, F.col("t.id").alias(right_id), F.col("t.points").alias("points"))
