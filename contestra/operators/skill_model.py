"""The skill model over all dimensions: retention after a change of division, leave-one-out evidence, standardising within
divisions, shrinking by exposure, composite, recent form and the blend with a prior.

Every step is an aggregate or a join on small tables; nothing is folded in order except ratings that a caller brings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import calibrated, clamp, ranking_reliability, sample_reliability, shrink

DIMENSIONS = ("offence", "defence", "second_offence", "second_defence", "grappling", "pace", "finishing", "schedule", "resume")


# Fixed values of the model.
@dataclass(frozen=True)
class SkillParams:
    prior_minutes: float = 45.0
    half_life: float = 3.5
    eps: float = 0.25
    transfer_years: int = 2
    weights: tuple[float, ...] = (0.30, 0.22, 0.16, 0.16, 0.08, 0.04, 0.04)
    base: tuple[float, float, float, float] = (0.56, 0.24, 0.10, 0.10)


def as_of_rows(obs: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(career, evidence): what lies before as_of, and of that what has an outcome (M02). Careers see the rest as well:
    division, last date and number of contests come from all of it."""
    cut = obs.where(F.col("event_date") < F.lit(as_of).cast("date"))
    return cut, cut.where("won is not null")


def scope(career: DataFrame, years: int) -> DataFrame:
    """(entity_id, division, previous, debut, cutoff): the current stint, the one before it, and how far back that counts."""
    w = Window.partitionBy("entity_id").orderBy("event_date", "seq")
    opens = career.select("entity_id", "event_date", "seq", "division", F.lag("division").over(w).alias("p")).where("p is null or p <> division")
    last = opens.groupBy("entity_id").agg(F.max_by(F.struct("division", F.col("p").alias("previous"), F.col("event_date").alias("debut")), F.struct("event_date", "seq")).alias("l"))
    return last.select("entity_id", "l.*").withColumn("cutoff", F.add_months("debut", -12 * years))


def retained(evidence: DataFrame, scoped: DataFrame) -> DataFrame:
    """evidence of the current division, and of the one before it from the cutoff to the debut (M05), as `division`; the
    division it came from is `fought`."""
    s = scoped.select("entity_id", F.col("division").alias("now"), "previous", "debut", "cutoff")
    rows = evidence.withColumnRenamed("division", "fought").join(s, "entity_id")
    own = F.col("fought") == F.col("now")
    moved = (F.col("fought") == F.col("previous")) & (F.col("event_date") >= F.col("cutoff")) & (F.col("event_date") < F.col("debut"))
    return rows.where(own | F.coalesce(moved, F.lit(False))).withColumnRenamed("now", "division").drop("previous", "debut", "cutoff")


def dimension_evidence(rows: DataFrame, evidence: DataFrame, as_of: str, strength: DataFrame, p: SkillParams = SkillParams()) -> DataFrame:
    """rows with a column for each dimension's raw value and their `weight`.

    strength(opponent_id, opponent_rating) is what is known of opponents. An opponent's totals leave the row's own
    contest out; the division's rates are the prior.
    """
    c = F.col
    totals = evidence.groupBy(c("entity_id").alias("opponent_id"), c("division").alias("fought")).agg(*[F.sum(x).alias(f"t_{x}") for x in ("qty", "ret", "opp_qty", "opp_ret", "lines")])
    prior = evidence.groupBy(c("division").alias("fought")).agg((F.sum("qty") / F.greatest(F.lit(1), F.sum("lines"))).alias("rate"), (15.0 * F.sum("ret") / F.greatest(F.lit(1), F.sum("lines"))).alias("rate15"))
    out = rows.join(totals, ["opponent_id", "fought"]).join(F.broadcast(prior), "fought").join(strength, "opponent_id")
    minutes = F.greatest(F.lit(0), c("t_lines") - c("lines")) + p.prior_minutes

    def expected(total: str, own: str, rate: str, per: float) -> Column:
        return per * (c(total) - c(own) + c(rate) / per * p.prior_minutes) / minutes

    def ratio(a: Column, b: Column) -> Column:
        return F.log((a + p.eps) / (b + p.eps))

    rate, rate15 = c("qty") / c("lines"), 15.0 * c("ret") / c("lines")
    years = F.datediff(F.lit(as_of).cast("date"), "event_date") / 365.25
    weight = F.exp(-years / p.half_life) * clamp(F.sqrt(c("lines") / 15), 0.35, 1.4) * clamp(0.75 + (c("opponent_rating") - 1300) / 800, 0.65, 1.35)
    return out.withColumns({
        "offence": ratio(rate, expected("t_opp_qty", "qty", "rate", 1.0)), "defence": -ratio(c("opp_qty") / c("lines"), expected("t_qty", "opp_qty", "rate", 1.0)),
        "second_offence": ratio(rate15, expected("t_opp_ret", "ret", "rate15", 15.0)), "second_defence": -ratio(15.0 * c("opp_ret") / c("lines"), expected("t_ret", "opp_ret", "rate15", 15.0)),
        "grappling": c("ret") / c("lines"), "pace": (c("qty") + c("opp_qty")) / c("lines"), "finishing": F.when((c("won") == 1) & c("finish"), 1.0).otherwise(0.0),
        "schedule": c("opponent_rating"), "resume": F.when(c("won") == 1, c("opponent_rating") - 1300).when(c("won") == 0, c("opponent_rating") - 1700).otherwise(c("opponent_rating") - 1500), "weight": weight,
    })


def dimension_means(rows: DataFrame) -> DataFrame:
    """(entity_id, division, bouts, minutes, a raw mean for each dimension): weighted over an entity's rows."""
    means = [F.coalesce(F.try_divide(F.sum(F.col(x) * F.col("weight")), F.sum("weight")), F.lit(0.0)).alias(x) for x in DIMENSIONS]
    return rows.groupBy("entity_id", "division").agg(F.count("*").alias("bouts"), F.sum("lines").alias("minutes"), *means)


def dimension_scores(means: DataFrame) -> DataFrame:
    """means with every dimension as clamp(50 + 15 z, 5, 99) within its division, shrunk (M10, M11). One aggregate of a
    division's means and spreads, which is joined; a spread of zero or of one entity counts as 1."""
    c = F.col
    stats = means.groupBy("division").agg(*[F.avg(x).alias(f"m_{x}") for x in DIMENSIONS], *[F.coalesce(F.nullif(F.stddev_samp(x), F.lit(0.0)), F.lit(1.0)).alias(f"s_{x}") for x in DIMENSIONS])
    technical = sample_reliability(c("minutes"), c("bouts"))
    record = clamp(0.25 + 0.75 * (1 - F.exp(-c("bouts") / 9.0)), 0.25, 0.99)
    scores = {x: shrink(clamp(50 + 15 * (c(x) - c(f"m_{x}")) / c(f"s_{x}"), 5.0, 99.0), record if x in ("schedule", "resume") else technical) for x in DIMENSIONS}
    return means.join(F.broadcast(stats), "division").select("entity_id", "division", "bouts", "minutes", *[v.alias(k) for k, v in scores.items()])


def recent_form(evidence: DataFrame, strength: DataFrame, last: int = 5, decay: float = 0.35) -> DataFrame:
    """(entity_id, form): the last results against the strength met, the newest weighing most, shrunk by their number."""
    rn = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("event_date"), F.desc("seq")))
    rows = evidence.withColumn("__r", rn).where(F.col("__r") <= last).join(strength, "opponent_id")
    x, w = (F.col("won") - 0.5) * (0.85 + (F.col("opponent_rating") - 1300) / 700), 1 / (1 + decay * (F.col("__r") - 1))
    mean = F.sum(x * w) / F.sum(w)
    return rows.groupBy("entity_id").agg(shrink(clamp(50 + 38 * mean, 5.0, 95.0), clamp(F.count("*") / 5.0, 0.2, 1.0)).alias("form"))


def composite(scores: DataFrame, form: DataFrame, p: SkillParams = SkillParams()) -> DataFrame:
    """scores with `skill`, `form`, `rating`, `reliability` and `provisional`."""
    c = F.col
    skill = sum((w * c(x) for w, x in zip(p.weights, DIMENSIONS, strict=False)), F.lit(0.0))
    rel = ranking_reliability(c("minutes"), c("bouts"))
    out = scores.join(form, "entity_id", "left").withColumns({"skill": skill, "form": F.coalesce("form", F.lit(50.0)), "reliability": rel})
    base = p.base[0] * c("skill") + p.base[1] * c("resume") + p.base[2] * c("schedule") + p.base[3] * c("form")
    rating = clamp(shrink(calibrated(base), 0.25 + 0.75 * c("reliability")) - (3 * (1 - c("reliability")) + 3 * F.greatest(F.lit(0.0), 5 - c("bouts")) / 5), 5.0, 99.0)
    return out.withColumns({"rating": rating, "provisional": (c("bouts") < 5) | (c("reliability") < 0.55)})


#: How much of a prior's weight each score takes.
BLENDED = {"rating": 1.0, "resume": 0.75, "schedule": 0.65, "form": 0.45}


def blended(rated: DataFrame, prior: DataFrame, most: float = 0.65) -> DataFrame:
    """rated mixed with prior(entity_id, prior_rating, prior_reliability) (M14): the fewer contests, the more of the prior.

    Who has a prior only starts from neutral scores; who has none stays as rated.
    """
    both = rated.join(prior, "entity_id", "full")
    weight = clamp(F.col("prior_reliability") * F.exp(-F.coalesce("bouts", F.lit(0)) / 4.0), 0.0, most)
    both = both.withColumn("prior_weight", F.coalesce(weight, F.lit(0.0)))
    out = {k: F.coalesce(k, F.lit(50.0)) for k in BLENDED}
    return both.withColumns({k: v + (F.coalesce("prior_rating", F.lit(50.0)) - v) * F.col("prior_weight") * BLENDED[k] for k, v in out.items()})


def components() -> Column:
    """What a rating is made of, as JSON."""
    return F.to_json(F.struct(*[F.round(x, 1).alias(x) for x in DIMENSIONS], F.round("form", 1).alias("form")))


def snapshot_key(rows: DataFrame, columns: list[str], sources: list[str]) -> DataFrame:
    """(key): sha256 of the sources and of all rows, whatever their order (M19). Rows are hashed where they are; only
    sums of their hashes meet."""
    h = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return rows.agg(F.sha2(F.concat_ws("|", *map(F.lit, sorted(sources)), F.count("*").cast("string"), *parts), 256).alias("key"))
