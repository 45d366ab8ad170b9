"""Who a participant without an id is: by biography (I04), and by what resolved rows of that name had.

Participants are rows (fight, side, name, id or null, and the dimensions below); a fight has two sides. Names, texts and
numbers may be null; a dimension counts only where both have it. Several rows of one (fight, side) are candidates alike
and get one answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Points of agreeing dimensions; tolerances with their points; differences that rule a candidate out; tiers.
EQUAL = {"dob": 12, "gym": 5, "nationality": 3, "stance": 1}
NEAR = {"height": ((1.5, 4), (4.0, 2)), "reach": ((2.0, 4), (5.0, 2))}
VETO = {"height": 12.0, "reach": 15.0}
BIOGRAPHY = {"least": 7, "margin": 3, "tiers": (0.995, 0.99, 0.975, 0.95)}
HISTORY = {"least": 8, "margin": 4, "tiers": (0.995, 0.99, 0.98, 0.96)}
DIMENSIONS = (*EQUAL, *NEAR)
KEY = ["fight", "side"]


def _plain(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def _agrees(name: str, u: Column, f: Column) -> Column:
    found = _plain(u) == _plain(f) if name in EQUAL else F.abs(u - f) <= NEAR[name][0][0]
    return F.coalesce(found, F.lit(False)).cast("int")


def _rules_out(name: str, u: Column, f: Column) -> Column:
    found = _plain(u) != _plain(f) if name == "dob" else F.abs(u - f) > VETO[name]
    return F.coalesce(found, F.lit(False)).cast("int")


def _points(name: str, u: Column, f: Column) -> Column:
    if name in EQUAL:
        return _agrees(name, u, f) * EQUAL[name]
    gap, ((close, most), (wide, some)) = F.abs(u - f), NEAR[name]
    return F.when(gap <= close, most).when(gap <= wide, some).otherwise(0)


def _unresolved(rows: DataFrame, accepted: DataFrame | None) -> DataFrame:
    """Rows without an id, with the id of the other side where that is known or accepted."""
    known = rows.where("id is not null").select("fight", "side", "id")
    known = (known if accepted is None else known.unionByName(accepted.select("fight", "side", "id"))).groupBy(F.col("fight").alias("__f"), F.col("side").alias("__s")).agg(F.min("id").alias("opponent_id"))
    open_ = rows.where("id is null").drop("id")
    open_ = open_ if accepted is None else open_.join(accepted.select(*KEY), KEY, "left_anti")
    return open_.join(known, (F.col("fight") == F.col("__f")) & (F.col("side") != F.col("__s")), "left").drop("__f", "__s")


def _accepted(scored: DataFrame, least: int, margin: int, tiers: tuple[float, ...]) -> DataFrame:
    """The best candidate of each side: enough points, by birth or two dimensions, and well before the next."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("score"), "id")
    lead = F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0))
    rows = scored.withColumns({"__n": F.row_number().over(w), "margin": lead, "alone": F.lead("id").over(w).isNull()})
    rows = rows.where((F.col("__n") == 1) & (F.col("score") >= least) & ((F.col("dob") == 1) | (F.col("dimensions") >= 2)) & (F.col("alone") | (F.col("margin") >= margin)))
    sure = F.when((F.col("dob") == 1) & (F.col("score") >= 16), tiers[0]).when(F.col("score") >= 14, tiers[1]).when(F.col("score") >= 10, tiers[2]).otherwise(tiers[3])
    return rows.select(*KEY, "id", F.col("score").cast("long").alias("score"), F.col("margin").cast("long").alias("margin"), sure.alias("confidence"))


def by_biography(rows: DataFrame, people: DataFrame) -> DataFrame:
    """(fight, side, id, score, margin, confidence) of rows that one of people(id, name, dimensions) of that name fits."""
    u, f = _unresolved(rows, None).alias("u"), people.alias("f")
    pairs = u.join(f, F.col("u.name") == F.col("f.name")).where("opponent_id is null or f.id <> opponent_id")
    of = {d: (F.col(f"u.{d}"), F.col(f"f.{d}")) for d in DIMENSIONS}
    pairs = pairs.where(sum((_rules_out(d, *of[d]) for d in ("dob", *VETO)), F.lit(0)) == 0)
    score, count = (sum((g(d, *of[d]) for d in DIMENSIONS), F.lit(0)) for g in (_points, _agrees))
    scored = pairs.select("u.fight", "u.side", F.col("f.id").alias("id"), score.alias("score"), count.alias("dimensions"), _agrees("dob", *of["dob"]).alias("dob"))
    return _accepted(scored.groupBy(*KEY, "id").agg(F.max("score").alias("score"), F.max("dimensions").alias("dimensions"), F.max("dob").alias("dob")), **BIOGRAPHY)


def _cut(df: DataFrame) -> DataFrame:
    """Ends the lineage by a checkpoint in the folder that spark.checkpoint.dir names; one is set here only for a driver
    that is its own only executor."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(found or "file:///tmp/checkpoints/contestra")
    return df.checkpoint()


def by_history(rows: DataFrame, accepted: DataFrame, passes: int = 4) -> DataFrame:
    """accepted, and rows that agree with what accepted rows of that name had, in at most so many passes; a pass that adds
    nothing is the last. Facts are distinct and matches are combined before they meet, so a name with many rows sends one
    row a candidate."""
    accepted = _cut(accepted.withColumn("pass", F.lit(0)))
    for k in range(1, passes + 1):
        facts = rows.join(accepted.select(*KEY, F.col("id").alias("__id")), KEY).where(" or ".join(f"{d} is not null" for d in DIMENSIONS)).select("name", F.col("__id").alias("id"), *DIMENSIONS).distinct()
        u, f = _unresolved(rows, accepted).alias("u"), facts.alias("f")
        pairs = u.join(f, F.col("u.name") == F.col("f.name")).where("opponent_id is null or f.id <> opponent_id")
        of = {d: (F.col(f"u.{d}"), F.col(f"f.{d}")) for d in DIMENSIONS}
        marks = [F.max(_agrees(d, *of[d])).alias(d) for d in DIMENSIONS] + [F.max(_rules_out(d, *of[d])).alias(f"no_{d}") for d in ("dob", *VETO)]
        found = pairs.groupBy(F.col("u.fight").alias("fight"), F.col("u.side").alias("side"), F.col("f.id").alias("id")).agg(*marks).where("no_dob + no_height + no_reach = 0")
        score = sum((F.col(d) * (EQUAL[d] if d in EQUAL else NEAR[d][0][1]) for d in DIMENSIONS), F.lit(0))
        scored = found.select(*KEY, "id", score.alias("score"), sum((F.col(d) for d in DIMENSIONS), F.lit(0)).alias("dimensions"), "dob")
        new = _cut(_accepted(scored, **HISTORY).withColumn("pass", F.lit(k)))
        if new.isEmpty():
            break
        accepted = accepted.unionByName(new)  # of checkpointed parts, one a pass
    return accepted
