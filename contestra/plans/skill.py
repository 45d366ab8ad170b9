"""Named queries over the skill model, forecasts from it, and their judging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import sigmoid
from ..operators import skill_model as M
from ..sources.contests import observations
from .catalog import query

CUT = "2001-02-01"
D = M.DIMENSIONS
CTE = f"""cut as (select * from obs where event_date < date '{CUT}'), ev as (select * from cut where won is not null),
st as (select entity_id as opponent_id, 1300 + 400 * avg(won) as opponent_rating from ev group by 1),
lg as (select *, lag(division) over (partition by entity_id order by event_date, seq) as p from cut), op as (select *, row_number() over (partition by entity_id order by event_date desc, seq desc) as rn from lg where p is null or p <> division),
sc as (select entity_id, division as now, p as previous, event_date as debut, cast(event_date - interval 2 year as date) as cutoff from op where rn = 1),
rt as (select e.seq, e.entity_id, e.opponent_id, e.event_date, e.division as fought, sc.now as division, e.won, e.finish, e.qty, e.lines, e.ret, e.opp_qty, e.opp_ret from ev e join sc using (entity_id) where e.division = now or (e.division = previous and e.event_date >= cutoff and e.event_date < debut)),
tt as (select entity_id as opponent_id, division as fought, sum(qty) as t_qty, sum(ret) as t_ret, sum(opp_qty) as t_opp_qty, sum(opp_ret) as t_opp_ret, sum(lines) as t_lines from ev group by 1, 2),
pr as (select division as fought, sum(qty) / greatest(1, sum(lines)) as rate, 15.0 * sum(ret) / greatest(1, sum(lines)) as rate15 from ev group by 1),
x as (select rt.*, opponent_rating, greatest(0, t_lines - lines) + 45 as m, t_qty, t_ret, t_opp_qty, t_opp_ret, rate, rate15 from rt join tt using (opponent_id, fought) join pr using (fought) join st using (opponent_id)),
e as (select *, ln((qty / lines + 0.25) / ((t_opp_qty - qty + rate * 45) / m + 0.25)) as offence, -ln((opp_qty / lines + 0.25) / ((t_qty - opp_qty + rate * 45) / m + 0.25)) as defence,
  ln((15.0 * ret / lines + 0.25) / (15 * (t_opp_ret - ret + rate15 / 15 * 45) / m + 0.25)) as second_offence, -ln((15.0 * opp_ret / lines + 0.25) / (15 * (t_ret - opp_ret + rate15 / 15 * 45) / m + 0.25)) as second_defence,
  ret / lines as grappling, (qty + opp_qty) / lines as pace, case when won = 1 and finish then 1.0 else 0.0 end as finishing, opponent_rating as schedule,
  case when won = 1 then opponent_rating - 1300 when won = 0 then opponent_rating - 1700 else opponent_rating - 1500 end as resume,
  exp(-((date '{CUT}' - event_date) / 365.25) / 3.5) * least(greatest(sqrt(lines / 15.0), 0.35), 1.4) * least(greatest(0.75 + (opponent_rating - 1300) / 800, 0.65), 1.35) as weight from x),
mn as (select entity_id, division, count(*) as bouts, sum(lines) as minutes, {", ".join(f"coalesce(sum({d} * weight) / nullif(sum(weight), 0), 0) as {d}" for d in D)} from e group by 1, 2),
ds as (select division, {", ".join(f"avg({d}) as m_{d}, coalesce(nullif(stddev_samp({d}), 0), 1) as s_{d}" for d in D)} from mn group by 1),
sr as (select *, least(greatest(0.62 * (1 - exp(-minutes / 55.0)) + 0.38 * (1 - exp(-bouts / 6.0)), 0.08), 0.985) as technical, least(greatest(0.25 + 0.75 * (1 - exp(-bouts / 9.0)), 0.25), 0.99) as record from mn join ds using (division)),
sco as (select entity_id, division, bouts, minutes, {", ".join(f"50 + (least(greatest(50 + 15 * ({d} - m_{d}) / s_{d}, 5), 99) - 50) * {'record' if d in ('schedule', 'resume') else 'technical'} as {d}" for d in D)} from sr),
l5 as (select *, row_number() over (partition by entity_id order by event_date desc, seq desc) as r from ev),
fm as (select entity_id, 50 + (least(greatest(50 + 38 * sum((won - 0.5) * (0.85 + (opponent_rating - 1300) / 700) / (1 + 0.35 * (r - 1))) / sum(1 / (1 + 0.35 * (r - 1))), 5), 95) - 50) * least(greatest(count(*) / 5.0, 0.2), 1) as form from l5 join st using (opponent_id) where r <= 5 group by 1),
co as (select sco.*, coalesce(form, 50) as form, {" + ".join(f"{w} * {d}" for w, d in zip(M.SkillParams().weights, D, strict=False))} as skill, least(greatest(0.42 * (1 - exp(-minutes / 45.0)) + 0.58 * (1 - exp(-bouts / 5.0)), 0.08), 0.99) as reliability from sco left join fm using (entity_id)),
ra as (select *, least(greatest(50 + (least(greatest(50 + 1.45 * (0.56 * skill + 0.24 * resume + 0.10 * schedule + 0.10 * form - 50), 5), 99) - 50) * (0.25 + 0.75 * reliability) - (3 * (1 - reliability) + 3 * greatest(0, 5 - bouts) / 5.0), 5), 99) as rating, bouts < 5 or reliability < 0.55 as provisional from co)
"""


def strength(evidence: DataFrame) -> DataFrame:
    """(opponent_id, opponent_rating) from win rates, for models whose evidence isn't weighed by an ordered fold."""
    return evidence.groupBy(F.col("entity_id").alias("opponent_id")).agg((1300 + 400 * F.avg("won")).alias("opponent_rating"))


def evidence_of(spark: SparkSession, d: str, as_of: str = CUT) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    career, evidence = M.as_of_rows(observations(spark, d), as_of)
    known = strength(evidence)
    rows = M.dimension_evidence(M.retained(evidence, M.scope(career, 2)), evidence, as_of, known)
    return career, evidence, known, rows


def rated(spark: SparkSession, d: str, as_of: str = CUT) -> DataFrame:
    _, evidence, known, rows = evidence_of(spark, d, as_of)
    return M.composite(M.dimension_scores(M.dimension_means(rows)), M.recent_form(evidence, known))


def three(names) -> list:
    """Columns rounded to 3 places; a negative zero is zero."""
    return [F.when(F.round(n, 3) == 0, 0.0).otherwise(F.round(n, 3)).alias(n) for n in names]


def r3(names) -> str:
    return ", ".join(f"case when round({n}, 3) = 0 then 0 else round({n}, 3) end as {n}" for n in names)


@query("m02_career_and_evidence", CTE + " select entity_id, count(*)::bigint as bouts, max(event_date) as last_date, count(won)::bigint as evidence from cut group by 1", dates=("last_date",))
def m02(spark, d):
    career, evidence = M.as_of_rows(observations(spark, d), CUT)
    counts = evidence.groupBy("entity_id").agg(F.count("*").alias("evidence"))
    return career.groupBy("entity_id").agg(F.count("*").alias("bouts"), F.max("event_date").alias("last_date")).join(counts, "entity_id", "left").withColumn("evidence", F.coalesce("evidence", F.lit(0)).cast("long"))


@query("m05_retained", CTE + " select seq, entity_id, fought, division from rt")
def m05(spark, d):
    career, evidence = M.as_of_rows(observations(spark, d), CUT)
    return M.retained(evidence, M.scope(career, 2)).select("seq", "entity_id", "fought", "division")


@query("m08_dimension_evidence", CTE + f" select seq, entity_id, {r3([*D, 'weight'])} from e")
def m08(spark, d):
    return evidence_of(spark, d)[3].select("seq", "entity_id", *three([*D, "weight"]))


@query("m09_dimension_means", CTE + f" select entity_id, division, bouts::bigint as bouts, {r3(D)} from mn")
def m09(spark, d):
    return M.dimension_means(evidence_of(spark, d)[3]).select("entity_id", "division", "bouts", *three(D))


@query("m11_dimension_scores", CTE + f" select entity_id, division, {r3(D)} from sco")
def m11(spark, d):
    return M.dimension_scores(M.dimension_means(evidence_of(spark, d)[3])).select("entity_id", "division", *three(D))


@query("m12_composite", CTE + f" select entity_id, division, provisional, {r3(['skill', 'rating', 'reliability'])} from ra")
def m12(spark, d):
    return rated(spark, d).select("entity_id", "division", "provisional", *three(["skill", "rating", "reliability"]))


@query("m13_recent_form", CTE + " select entity_id, round(form, 3) as form from fm")
def m13(spark, d):
    _, evidence = M.as_of_rows(observations(spark, d), CUT)
    return M.recent_form(evidence, strength(evidence)).select("entity_id", F.round("form", 3).alias("form"))


PRIOR = ", pw as (select s_suppkey as entity_id, least(greatest(s_acctbal / 100, 5), 95) as pr, 0.2 + 0.6 * (s_suppkey % 10) / 10 as rel from supplier where s_suppkey % 4 > 0), bl as (select entity_id, coalesce(pr, 50) as pr, coalesce(least(greatest(rel * exp(-coalesce(bouts, 0) / 4.0), 0), 0.65), 0) as w, coalesce(rating, 50) as rating, coalesce(resume, 50) as resume, coalesce(schedule, 50) as schedule, coalesce(form, 50) as form from ra full join pw using (entity_id))"


@query("m14_prior_blend", CTE + PRIOR + " select entity_id, round(rating + (pr - rating) * w, 3) as rating, round(resume + (pr - resume) * w * 0.75, 3) as resume, round(schedule + (pr - schedule) * w * 0.65, 3) as schedule, round(form + (pr - form) * w * 0.45, 3) as form from bl")
def m14(spark, d):
    s = F.col("s_suppkey")
    prior = spark.read.parquet(f"{d}/supplier.parquet").where(s % 4 > 0).select(s.alias("entity_id"), F.least(F.greatest(F.col("s_acctbal") / 100, F.lit(5.0)), F.lit(95.0)).alias("prior_rating"), (0.2 + 0.6 * (s % 10) / 10).alias("prior_reliability"))
    return M.blended(rated(spark, d), prior).select("entity_id", *three(M.BLENDED))


@query("m15_components", CTE + " select entity_id, to_json({" + ", ".join(f"{x}: round({x}, 1)" for x in [*D, "form"]) + "})::varchar as components from ra")
def m15(spark, d):
    return rated(spark, d).select("entity_id", M.components().alias("components"))


@query("q22_top_prospects", CTE + ", a as (select *, row_number() over (partition by division order by rating desc, entity_id) as rn from ra where not provisional) select division, entity_id, round(rating, 3) as rating, rn::bigint as place from a where rn <= 5")
def q22(spark, d, most: int = 5):
    place = F.row_number().over(Window.partitionBy("division").orderBy(F.desc("rating"), "entity_id"))
    return rated(spark, d).where("not provisional").select("division", "entity_id", F.round("rating", 3).alias("rating"), place.cast("long").alias("place")).where(F.col("place") <= most)


@query("q02_dossier", CTE + """, k as (select entity_id, count(*)::bigint as bouts, sum(won)::double as wins, round(sum(qty) / nullif(sum(qty) + sum(opp_qty), 0), 4) as share from obs group by 1),
t as (select entity_id, string_agg(seq::varchar, ',' order by event_date desc, seq desc) as recent from (select *, row_number() over (partition by entity_id order by event_date desc, seq desc) as rn from obs) where rn <= 10 group by 1)
select k.*, t.recent, round(ra.rating, 3) as rating, (1 + (select count(*) from ra q where round(q.rating, 6) > round(ra.rating, 6)))::bigint as place from k join t using (entity_id) left join ra using (entity_id)""")
def q02(spark, d):
    """Career, last ten contests, rating and place of every entity; the place of unrated ones counts nobody before them."""
    o = observations(spark, d)
    k = o.groupBy("entity_id").agg(F.count("*").alias("bouts"), F.sum("won").alias("wins"), F.round(F.try_divide(F.sum("qty"), F.sum("qty") + F.sum("opp_qty")), 4).alias("share"))
    rn = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("event_date"), F.desc("seq")))
    last = o.select("entity_id", "seq", rn.alias("rn")).where("rn <= 10").groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("rn", "seq"))).alias("l"))
    last = last.select("entity_id", F.array_join(F.transform("l", lambda x: x["seq"].cast("string")), ",").alias("recent"))
    r = rated(spark, d).select("entity_id", F.round("rating", 3).alias("rating"), F.rank().over(Window.orderBy(F.desc(F.round("rating", 6)))).cast("long").alias("place"))
    return k.join(last, "entity_id").join(r, "entity_id", "left").withColumn("place", F.coalesce("place", F.lit(1).cast("long")))


# Forecasts from the ratings. What stands for what isn't known.
NEUTRAL = {"rating": 50.0, "skill": 50.0, "form": 50.0, "schedule": 50.0, "resume": 50.0, "pace": 50.0, "finishing": 50.0}
EDGES = (("offence", "defence"), ("second_offence", "second_defence"), ("grappling", "second_defence"), ("finishing", "defence"))
COEFFICIENTS = tuple(round(0.04 - 0.003 * i, 4) for i in range(len(NEUTRAL) + len(EDGES) + 2))


def forecast_features(sides: DataFrame, ratings: DataFrame) -> DataFrame:
    """(seq, x): antisymmetric features of contests(seq, a_id, b_id): differences of imputed scores (X01), of the logs of
    contests and minutes, and edges of one side's attack over the other's answer against the reverse (X02)."""
    wide = sorted({*NEUTRAL, *(n for e in EDGES for n in e)})
    known = lambda s: ratings.select(F.col("entity_id").alias(f"{s}_id"), *[F.col(n).alias(f"{s}_{n}") for n in [*wide, "bouts", "minutes"]])
    rows = sides.join(known("a"), "a_id", "left").join(known("b"), "b_id", "left")
    v = lambda s, n: F.coalesce(F.col(f"{s}_{n}"), F.lit(NEUTRAL.get(n, 50.0)))
    diff = [v("a", n) - v("b", n) for n in NEUTRAL] + [F.log1p(F.coalesce(f"a_{n}", F.lit(0))) - F.log1p(F.coalesce(f"b_{n}", F.lit(0))) for n in ("bouts", "minutes")]
    edge = [(v("a", x) - v("b", y)) - (v("b", x) - v("a", y)) for x, y in EDGES]
    return rows.withColumn("x", F.array(*diff, *edge))


def scored(features: DataFrame, coefficients=COEFFICIENTS) -> DataFrame:
    """features with `p`: the sigmoid of the frozen coefficients' sum."""
    dot = F.aggregate(F.zip_with("x", F.array(*map(F.lit, coefficients)), lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)
    return features.withColumn("p", sigmoid(dot))


def _sql_features() -> str:
    v = lambda s, n: f"coalesce({s}.{n}, {NEUTRAL.get(n, 50.0)})"
    parts = [f"({v('a', n)} - {v('b', n)})" for n in NEUTRAL] + [f"(ln(1 + coalesce(a.{n}, 0)) - ln(1 + coalesce(b.{n}, 0)))" for n in ("bouts", "minutes")]
    parts += [f"(({v('a', x)} - {v('b', y)}) - ({v('b', x)} - {v('a', y)}))" for x, y in EDGES]
    return " + ".join(f"{c} * {x}" for c, x in zip(COEFFICIENTS, parts, strict=True))


FORECAST = CTE + f", f as (select c.seq, c.event_date, won_a as y, a.bouts is not null and b.bouts is not null as both_, 1 / (1 + exp(-least(greatest({_sql_features()}, -30), 30))) as p from contests c left join ra a on a.entity_id = a_id left join ra b on b.entity_id = b_id where c.event_date >= date '{CUT}')"


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.contests import contests

    c = contests(spark, d).where(F.col("event_date") >= F.lit(CUT).cast("date")).select("seq", "event_date", "a_id", "b_id", F.col("won_a").alias("y"))
    return scored(forecast_features(c, rated(spark, d))).withColumn("both_", F.col("a_bouts").isNotNull() & F.col("b_bouts").isNotNull())


@query("x04_frozen_forecast", FORECAST + " select seq, round(p, 4) as p from f")
def x04(spark, d):
    """Contests after the cut, forecast from ratings before it."""
    return forecasts(spark, d).select("seq", F.round("p", 4).alias("p"))


@query("x15_common_holdout", FORECAST + " select year(event_date)::bigint as year, count(*)::bigint as n, round(avg(case when (p >= 0.5) = (y = 1) then 1.0 else 0.0 end), 4) as accuracy, round(avg((p - y) * (p - y)), 4) as brier from f where both_ and y <> 0.5 group by 1")
def x15(spark, d):
    """Judged only where both sides had a rating; here p of one half counts for side a (the other tie rule, A22)."""
    hit = F.when((F.col("p") >= 0.5) == (F.col("y") == 1), 1.0).otherwise(0.0)
    return forecasts(spark, d).where("both_ and y <> 0.5").groupBy(F.year("event_date").cast("long").alias("year")).agg(F.count("*").alias("n"), F.round(F.avg(hit), 4).alias("accuracy"), F.round(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))), 4).alias("brier"))


GRID = tuple((w, m) for w in (0.0, 0.3, 0.65) for m in (2.0, 4.0))


@query("x12_prior_grid", CTE + PRIOR.replace(", bl as", ", gr as (select unnest([" + ", ".join(f"{{w: {w}, m: {m}}}" for w, m in GRID) + "]) as g), bl as").split(", bl as")[0] + """, bl as (select g.w as most, g.m as life, entity_id, coalesce(rating, 50) as r, coalesce(pr, 50) as pr, coalesce(least(greatest(rel * exp(-coalesce(bouts, 0) / g.m), 0), g.w), 0) as w from gr cross join (ra full join pw using (entity_id)))
select most::double as most, life::double as life, round(avg(r + (pr - r) * w), 4) as mean, round(avg(w), 4) as weight from bl group by 1, 2""")
def x12(spark, d):
    """Prior parameters crossed with all ratings: the few combinations are broadcast."""
    s = F.col("s_suppkey")
    prior = spark.read.parquet(f"{d}/supplier.parquet").where(s % 4 > 0).select(s.alias("entity_id"), F.least(F.greatest(F.col("s_acctbal") / 100, F.lit(5.0)), F.lit(95.0)).alias("pr"), (0.2 + 0.6 * (s % 10) / 10).alias("rel"))
    grid = spark.createDataFrame(list(GRID), "most double, life double")
    both = rated(spark, d).select("entity_id", "rating", "bouts").join(prior, "entity_id", "full").crossJoin(F.broadcast(grid))
    w = F.coalesce(F.least(F.greatest(F.col("rel") * F.exp(-F.coalesce("bouts", F.lit(0)) / F.col("life")), F.lit(0.0)), F.col("most")), F.lit(0.0))
    r = F.coalesce("rating", F.lit(50.0))
    return both.groupBy("most", "life").agg(F.round(F.avg(r + (F.coalesce("pr", F.lit(50.0)) - r) * w), 4).alias("mean"), F.round(F.avg(w), 4).alias("weight"))


@query("x10_walk_forward", """w as (select seq, event_date, entity_id, side, won, exp((event_date - date '1995-01-01') / 1278.375) as g, qty / lines as pace from obs),
s as (select *, sum(g * pace) over (partition by entity_id order by event_date range between unbounded preceding and interval 1 days preceding) as t, sum(g) over (partition by entity_id order by event_date range between unbounded preceding and interval 1 days preceding) as n from w)
select seq, side, round(t / n, 4) as pace_before from s""")
def x10(spark, d):
    """A time-decayed mean strictly before each date, for every contest at once: as the decay is exponential its factor
    cancels, so running sums of e^(t / life) give what a rebuild at each date would."""
    o = observations(spark, d)
    g = F.exp(F.datediff("event_date", F.lit("1995-01-01").cast("date")) / 1278.375)
    w = Window.partitionBy("entity_id").orderBy(F.unix_date("event_date")).rangeBetween(Window.unboundedPreceding, -1)
    return o.select("seq", "side", F.round(F.sum(g * F.col("qty") / F.col("lines")).over(w) / F.sum(g).over(w), 4).alias("pace_before"))


@query("x03_prior_summary", f"""h as (select entity_id, count(*) as n, sum(won) as w, count(*) filter (finish and won = 1) as f, max(event_date) as last, count(distinct opponent_id) as o from obs where event_date < date '{CUT}' group by 1)
select c.seq, round(a.w / a.n - b.w / b.n, 4) as rate, round(ln(1 + a.n) - ln(1 + b.n), 4) as exposure, round(a.f::double / a.n - b.f::double / b.n, 4) as finishes, (b.last - a.last)::bigint as rest, (a.o - b.o)::bigint as opponents from contests c join h a on a.entity_id = a_id join h b on b.entity_id = b_id where c.event_date >= date '{CUT}'""")
def x03(spark, d):
    """Differences of what each side's record before the cut says."""
    from ..sources.contests import contests

    o = observations(spark, d).where(F.col("event_date") < F.lit(CUT).cast("date"))
    h = o.groupBy("entity_id").agg(F.count("*").alias("n"), F.sum("won").alias("w"), F.count_if(F.col("finish") & (F.col("won") == 1)).cast("double").alias("f"), F.max("event_date").alias("last"), F.count_distinct("opponent_id").alias("o"))
    side = lambda s: h.select(F.col("entity_id").alias(f"{s}_id"), *[F.col(x).alias(f"{s}_{x}") for x in ("n", "w", "f", "last", "o")])
    c = contests(spark, d).where(F.col("event_date") >= F.lit(CUT).cast("date")).select("seq", "a_id", "b_id").join(side("a"), "a_id").join(side("b"), "b_id")
    x = F.col
    return c.select("seq", F.round(x("a_w") / x("a_n") - x("b_w") / x("b_n"), 4).alias("rate"), F.round(F.log1p("a_n") - F.log1p("b_n"), 4).alias("exposure"), F.round(x("a_f") / x("a_n") - x("b_f") / x("b_n"), 4).alias("finishes"), F.datediff("b_last", "a_last").cast("long").alias("rest"), (x("a_o") - x("b_o")).alias("opponents"))
