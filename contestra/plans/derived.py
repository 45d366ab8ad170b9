"""More named queries: scalar functions, ratings, predictions, identity, paths, change detection and product views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.fold import elo_fold
from ..operators.rating import best_match, fit_slope, shortest_paths, skill_evidence, skill_rating
from ..operators.relational import latest_per_key
from ..sources.contests import contests, observations, read
from ..streaming.results import changed_rows
from .catalog import AS_OF, EDGES, edges, query, r4


def orders_text(spark: SparkSession, d: str, text: F.Column) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", text.alias("t"))


@query("f01_parse_pair", "select o_orderkey, coalesce(try_cast(regexp_extract(t, '(\\d+)\\s+of\\s+(\\d+)', 1) as bigint), 0) as landed, coalesce(try_cast(regexp_extract(t, '(\\d+)\\s+of\\s+(\\d+)', 2) as bigint), 0) as attempted from (select o_orderkey, case when o_orderstatus = 'F' then '---' else (o_orderkey % 7)::varchar || ' of ' || o_custkey::varchar end as t from orders)", pre=False)
def f01(spark, d):
    rows = orders_text(spark, d, F.when(F.col("o_orderstatus") == "F", "---").otherwise(F.concat((F.col("o_orderkey") % 7).cast("string"), F.lit(" of "), F.col("o_custkey").cast("string"))))
    landed, attempted = S.parse_pair(F.col("t"))
    return rows.select("o_orderkey", landed.alias("landed"), attempted.alias("attempted"))


@query("f02_parse_clock", "select o_orderkey, (case when o_orderstatus = 'F' then 0 else (o_orderkey % 10) * 60 + o_custkey % 60 end)::bigint as seconds from orders", pre=False)
def f02(spark, d):
    rows = orders_text(spark, d, F.when(F.col("o_orderstatus") == "F", "-").otherwise(F.concat((F.col("o_orderkey") % 10).cast("string"), F.lit(":"), F.lpad((F.col("o_custkey") % 60).cast("string"), 2, "0"))))
    return rows.select("o_orderkey", S.parse_clock(F.col("t")).alias("seconds"))


@query("f03_parse_day", "select o_orderkey, case when o_orderkey % 3 < 2 then cast(cast(o_orderdate as date) as varchar) end as day from orders", pre=False)
def f03(spark, d):
    k, day = F.col("o_orderkey") % 3, F.col("o_orderdate")
    rows = orders_text(spark, d, F.when(k == 0, F.date_format(day, "dd/MM/yyyy")).when(k == 1, F.date_format(day, "yyyy-MM-dd")).otherwise("soon"))
    return rows.select("o_orderkey", S.parse_day(F.col("t")).cast("string").alias("day"))


@query("f04_height_cm", "select p_partkey, round(((p_size % 4 + 4) * 12 + p_size % 12) * 2.54, 4)::double as cm from part", pre=False)
def f04(spark, d):
    text = F.concat((F.col("p_size") % 4 + 4).cast("string"), F.lit("' "), (F.col("p_size") % 12).cast("string"), F.lit('"'))
    return read(spark, d, "part").select("p_partkey", r4(S.height_cm(text)).alias("cm"))


FOLD = "lower(strip_accents(p_name || ' Ém' || p_partkey::varchar || ' ñ!'))"


@query("f05_slug_and_name", f"select p_partkey, trim(regexp_replace({FOLD}, '[^a-z0-9]+', '-', 'g'), '-') as slug, trim(regexp_replace({FOLD}, '[^a-z0-9]+', ' ', 'g')) as name from part", pre=False)
def f05(spark, d):
    text = F.concat("p_name", F.lit(" Ém"), F.col("p_partkey").cast("string"), F.lit(" ñ!"))
    return read(spark, d, "part").select("p_partkey", S.slugify(text).alias("slug"), S.normalize_name(text).alias("name"))


@query("f13_reliability", """t as (select entity_id, sum(lines) as m, count(*) as n from obs group by 1),
r as (select entity_id, least(greatest(0.62 * (1 - exp(-m / 55.0)) + 0.38 * (1 - exp(-n / 6.0)), 0.08), 0.985) as s, least(greatest(0.42 * (1 - exp(-m / 45.0)) + 0.58 * (1 - exp(-n / 5.0)), 0.08), 0.99) as k from t)
select entity_id, round(s, 4) as sample, round(k, 4) as ranking, round(50 + 20 * s, 4) as shrunk, round(least(greatest(50 + 1.45 * 20 * s, 5), 99), 4) as shown from r""")
def f13(spark, d):
    t = observations(spark, d).groupBy("entity_id").agg(F.sum("lines").alias("m"), F.count("*").alias("n"))
    s = S.shrink(F.lit(70.0), S.sample_reliability(F.col("m"), F.col("n")))
    return t.select("entity_id", r4(S.sample_reliability(F.col("m"), F.col("n"))).alias("sample"), r4(S.ranking_reliability(F.col("m"), F.col("n"))).alias("ranking"), r4(s).alias("shrunk"), r4(S.calibrated(s)).alias("shown"))


@query("f23_age_and_status", "select entity_id, floor((date '2001-08-01' - min(event_date)) / 365.2425)::bigint as years, case when date '2001-08-01' - max(event_date) <= 548 then 'active' else 'inactive' end as status from obs group by 1")
def f23(spark, d):
    on = F.lit(AS_OF).cast("date")
    return observations(spark, d).groupBy("entity_id").agg(S.age_years(F.min("event_date"), on).alias("years"), S.roster_status(F.max("event_date"), on).alias("status"))


@query("f35_fingerprint", "select n_nationkey, sha256(n_nationkey::varchar || '|' || n_name || '|' || n_regionkey::varchar) as print from nation", pre=False)
def f35(spark, d):
    return read(spark, d, "nation").select("n_nationkey", F.sha2(F.concat_ws("|", "n_nationkey", "n_name", "n_regionkey"), 256).alias("print"))


@query("f44_rounds_and_points", """select seq, greatest(0, least(5, 3, case when finish then a_lines - 1 else 3 end))::bigint as rounds,
case when won_a = 1 then 50 + 50 + seq % 51 when won_a = 0 then -(seq % 51) else 0 end::bigint as points from contests""")
def f44(spark, d):
    won = F.when(F.col("won_a") != 0.5, F.col("won_a") == 1)
    return contests(spark, d).select("seq", S.scorable_rounds(F.col("finish"), F.col("a_lines"), F.lit(3)).cast("long").alias("rounds"), S.pick_points(won, 50 + F.col("seq") % 51).cast("long").alias("points"))


SKILL = """rows_ as (select * from obs where event_date < date '2001-08-01'),
al as (select entity_id as opponent_id, division, sum(opp_qty) as t_allowed, sum(opp_lines) as t_faced from rows_ group by 1, 2),
pr as (select division, sum(qty) / greatest(1, sum(lines)) as rate from rows_ group by 1),
ev as (select o.*, ln((qty / lines + 0.25) / ((t_allowed - qty + rate * 45) / (greatest(0, t_faced - lines) + 45) + 0.25)) as offence,
  exp(-((date '2001-08-01' - event_date) / 365.25) / 3.5) * least(greatest(sqrt(lines / 15.0), 0.35), 1.4) as weight
  from rows_ o join al using (opponent_id, division) join pr using (division))"""


@query("m06_skill_evidence", SKILL + " select seq, entity_id, round(offence, 4) as offence, round(weight, 4) as weight from ev")
def m06(spark, d):
    return skill_evidence(observations(spark, d), AS_OF).select("seq", "entity_id", r4("offence").alias("offence"), r4("weight").alias("weight"))


@query("m10_skill_rating", SKILL + """, s as (select entity_id, division, count(*) as bouts, sum(lines) as m, sum(offence * weight) / sum(weight) as raw from ev group by 1, 2),
g as (select division, avg(raw) as mean, coalesce(nullif(stddev_samp(raw), 0), 1) as sd from s group by 1)
select entity_id, division, bouts::bigint as bouts, round(50 + (least(greatest(50 + 15 * (raw - mean) / sd, 5), 99) - 50) * least(greatest(0.62 * (1 - exp(-m / 55.0)) + 0.38 * (1 - exp(-bouts / 6.0)), 0.08), 0.985), 3) as skill from s join g using (division)""")
def m10(spark, d):
    return skill_rating(skill_evidence(observations(spark, d), AS_OF)).withColumn("skill", F.round("skill", 3))


@query("m07_elo_weighted_skill")
def m07(spark, d):
    """As m10, with each row weighed by the opponent's rating before the contest (an ordered fold: no SQL)."""
    elo = elo_fold(contests(spark, d)).select("seq", "entity_id", "opponent_before")
    return skill_rating(skill_evidence(observations(spark, d).join(elo, ["seq", "entity_id"]), AS_OF, F.col("opponent_before"))).withColumn("skill", F.round("skill", 3))


BEFORE = """h as (select seq, side, entity_id, coalesce(sum(won) over w, 0)::double as wins, (count(*) over w)::double as n from obs window w as (partition by entity_id order by event_date, seq rows between unbounded preceding and 1 preceding)),
f as (select a.seq, (a.wins + 1) / (a.n + 2) - (b.wins + 1) / (b.n + 2) as rate_diff, ln(1 + a.n) - ln(1 + b.n) as exp_diff, least(a.n, b.n) as strength from h a join h b on a.seq = b.seq and a.side = 'a' and b.side = 'b')"""


def features(spark: SparkSession, d: str) -> DataFrame:
    """Antisymmetric differences of what each side had done before; one grouping per contest, no self-join."""
    w = Window.partitionBy("entity_id").orderBy("event_date", "seq").rowsBetween(Window.unboundedPreceding, -1)
    h = observations(spark, d).select("seq", "side", "won", F.coalesce(F.sum("won").over(w), F.lit(0.0)).alias("wins"), F.count("*").over(w).cast("double").alias("n"))
    side = lambda s, c: F.max(F.when(F.col("side") == s, c))
    rate, exposure = (F.col("wins") + 1) / (F.col("n") + 2), F.log(1 + F.col("n"))
    return h.groupBy("seq").agg((side("a", rate) - side("b", rate)).alias("rate_diff"), (side("a", exposure) - side("b", exposure)).alias("exp_diff"), F.min("n").alias("strength"), side("a", F.col("won")).alias("y"))


@query("x02_features", BEFORE + " select seq, rate_diff, round(exp_diff, 4) as exp_diff, strength from f")
def x02(spark, d):
    return features(spark, d).select("seq", "rate_diff", r4("exp_diff").alias("exp_diff"), "strength")


@query("x07_forecast", BEFORE + """, p as (select seq, strength, 1 / (1 + exp(-least(greatest(2.5 * rate_diff + 0.1 * exp_diff, -30), 30))) as p from f)
select seq, round(p, 4) as p, case when abs(p - 0.5) < 1e-10 then null when p > 0.5 then 'a' else 'b' end as pick, strength < 5 as limited from p""")
def x07(spark, d):
    p = features(spark, d).select("seq", "strength", S.sigmoid(2.5 * F.col("rate_diff") + 0.1 * F.col("exp_diff")).alias("p"))
    return p.select("seq", r4("p").alias("p"), F.when(F.abs(F.col("p") - 0.5) < 1e-10, None).when(F.col("p") > 0.5, "a").otherwise("b").alias("pick"), (F.col("strength") < 5).alias("limited"))


@query("x09_fitted_slope")
def x09(spark, d):
    """The slope of the win-rate difference that fits best; found by aggregates on grids, so SQL has no short form."""
    slope = fit_slope(features(spark, d).where("y <> 0.5"), "rate_diff", "y", hi=20.0)
    return spark.createDataFrame([(round(slope, 4),)], "slope double")


@query("x17_similarity", """t as (select entity_id, avg(qty) as q, avg(lines) as l, 100 * avg(won) as w from obs group by 1)
select b.entity_id, round(100 - (abs(a.q - b.q) + abs(a.l - b.l) + abs(a.w - b.w)) / 3, 3) as similarity from t a, t b where a.entity_id = 1 and b.entity_id <> 1""")
def x17(spark, d, target: int = 1):
    """Similarity of every entity to one; the target's single row is broadcast."""
    t = observations(spark, d).groupBy("entity_id").agg(F.avg("qty").alias("q"), F.avg("lines").alias("l"), (100 * F.avg("won")).alias("w"))
    a = t.where(F.col("entity_id") == target).select(*[F.col(c).alias(f"t_{c}") for c in "qlw"])
    far = sum((F.abs(F.col(c) - F.col(f"t_{c}")) for c in "qlw"), F.lit(0.0)) / 3
    return t.where(F.col("entity_id") != target).join(F.broadcast(a)).select("entity_id", F.round(100 - far, 3).alias("similarity"))


@query("i01_unique_name", "select c_custkey, case when count(*) over (partition by c_nationkey, c_mktsegment, c_custkey % 5) = 1 then c_custkey end as id from customer", pre=False)
def i01(spark, d):
    n = F.count("*").over(Window.partitionBy("c_nationkey", "c_mktsegment", F.col("c_custkey") % 5))
    return read(spark, d, "customer").select("c_custkey", F.when(n == 1, F.col("c_custkey")).alias("id"))


@query("i04_scored_match", """p as (select s_suppkey, c_custkey, (case when s_nationkey = c_nationkey then 12 else 0 end + case when abs(s_acctbal - c_acctbal) <= 500 then 4 when abs(s_acctbal - c_acctbal) <= 2000 then 2 else 0 end)::bigint as score from supplier join customer on s_suppkey % 50 = c_custkey % 50),
x as (select *, row_number() over w as rn, score - coalesce(lead(score) over w, 0) as margin from p window w as (partition by s_suppkey order by score desc, c_custkey))
select s_suppkey, c_custkey, score, margin::bigint as margin from x where rn = 1 and score >= 7 and margin >= 3""".replace("p as", "with p as", 1), pre=False)
def i04(spark, d):
    s, c = read(spark, d, "supplier"), read(spark, d, "customer")
    pairs = s.join(c, F.col("s_suppkey") % 50 == F.col("c_custkey") % 50)
    gap = F.abs(F.col("s_acctbal") - F.col("c_acctbal"))
    score = (F.when(F.col("s_nationkey") == F.col("c_nationkey"), 12).otherwise(0) + F.when(gap <= 500, 4).when(gap <= 2000, 2).otherwise(0)).cast("long")
    return best_match(pairs, "s_suppkey", "c_custkey", score, 7, 3).withColumn("margin", F.col("margin").cast("long"))


PATHS = EDGES + """, d0 as (select 1::bigint as node, 0 as depth, '1' as path),
d1 as (select opponent_id as node, 1 as depth, min(path || '>' || opponent_id::varchar) as path from d0 join edges on node = entity_id where opponent_id not in (select node from d0) group by 1),
s1 as (select * from d0 union all select * from d1),
d2 as (select opponent_id as node, 2 as depth, min(path || '>' || opponent_id::varchar) as path from d1 join edges on node = entity_id where opponent_id not in (select node from s1) group by 1),
s2 as (select * from s1 union all select * from d2),
d3 as (select opponent_id as node, 3 as depth, min(path || '>' || opponent_id::varchar) as path from d2 join edges on node = entity_id where opponent_id not in (select node from s2) group by 1)
select node, depth, path from s2 union all select * from d3"""


@query("g01_paths", PATHS)
def g01(spark, d):
    return shortest_paths(edges(spark, d).select("entity_id", "opponent_id"), 1, 3)


@query("z03_changed_rows", "select o_orderkey, o_orderstatus, o_totalprice, case when o_orderkey % 5 > 0 then case when o_orderkey % 3 = 0 then 'X' else o_orderstatus end end as old_o_orderstatus, case when o_orderkey % 5 > 0 then o_totalprice end as old_o_totalprice from orders where o_orderkey % 5 = 0 or o_orderkey % 3 = 0", pre=False)
def z03(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    state = o.where("o_orderkey % 5 > 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus")))
    return changed_rows(state, o, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("q05_forecast_ledger", BEFORE + """, p as (select f.seq, c.won_a, 1 / (1 + exp(-least(greatest(2.5 * rate_diff, -30), 30))) as p from f join contests c using (seq))
select seq, round(p, 4) as p, case when won_a = 0.5 then 'void' when abs(p - 0.5) < 1e-10 then 'no pick' when (p > 0.5) = (won_a = 1) then 'correct' else 'incorrect' end as grade from p""")
def q05(spark, d):
    p = features(spark, d).select("seq", "y", S.sigmoid(2.5 * F.col("rate_diff")).alias("p"))
    grade = F.when(F.col("y") == 0.5, "void").when(F.abs(F.col("p") - 0.5) < 1e-10, "no pick").when((F.col("p") > 0.5) == (F.col("y") == 1), "correct").otherwise("incorrect")
    return p.select("seq", r4("p").alias("p"), grade.alias("grade"))


@query("q10_season_board", """select a_id as voter, sum(case when won_a = 1 then 100 + seq % 51 when won_a = 0 then -(seq % 51) else 0 end)::bigint as points, count(*) filter (won_a = 1)::bigint as correct, count(*)::bigint as picks
from contests group by 1 order by points desc, voter limit 50""")
def q10(spark, d):
    points = S.pick_points(F.when(F.col("won_a") != 0.5, F.col("won_a") == 1), 50 + F.col("seq") % 51)
    return contests(spark, d).groupBy(F.col("a_id").alias("voter")).agg(F.sum(points).alias("points"), F.count_if(F.col("won_a") == 1).alias("correct"), F.count("*").alias("picks")).orderBy(F.desc("points"), "voter").limit(50)


@query("q17_division_splits", "select entity_id, division, count(*)::bigint as bouts, sum(won)::double as wins, max(event_date) as last_date, (row_number() over (partition by entity_id order by count(*) desc, division))::bigint as rn from obs group by 1, 2", dates=("last_date",))
def q17(spark, d):
    t = observations(spark, d).groupBy("entity_id", "division").agg(F.count("*").alias("bouts"), F.sum("won").alias("wins"), F.max("event_date").alias("last_date"))
    return t.withColumn("rn", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("bouts"), "division")).cast("long"))


@query("q20_watchlist_changes", """x as (select *, row_number() over (partition by entity_id order by event_date desc, seq desc) as rn from obs),
was as (select entity_id, division from (select *, row_number() over (partition by entity_id order by event_date desc, seq desc) as k from obs where event_date < date '2001-01-01') where k = 1)
select x.entity_id, x.division, was.division as seen, x.division is distinct from was.division as changed from x left join was using (entity_id) where rn = 1""")
def q20(spark, d):
    o, order = observations(spark, d), [F.desc("event_date"), F.desc("seq")]
    now = latest_per_key(o, ["entity_id"], order).select("entity_id", "division")
    was = latest_per_key(o.where("event_date < date'2001-01-01'"), ["entity_id"], order).select("entity_id", F.col("division").alias("seen"))
    return now.join(was, "entity_id", "left").withColumn("changed", ~F.col("division").eqNullSafe(F.col("seen")))


@query("q28_event_directory", "select event_date, count(*)::bigint as contests, count(distinct division)::bigint as divisions, count(*) filter (finish)::bigint as finishes from contests group by 1", dates=("event_date",))
def q28(spark, d):
    return contests(spark, d).groupBy("event_date").agg(F.count("*").alias("contests"), F.count_distinct("division").alias("divisions"), F.count_if("finish").alias("finishes"))


@query("q31_sitemap", "select '/entity/' || s_suppkey::varchar as loc from supplier union select '/division/' || lower(o_orderpriority) from orders union select '/day/' || cast(cast(o_orderdate as date) as varchar) from orders", pre=False)
def q31(spark, d):
    o = read(spark, d, "orders")
    days = o.select(F.concat(F.lit("/day/"), F.col("o_orderdate").cast("date").cast("string")).alias("loc"))
    divisions = o.select(F.concat(F.lit("/division/"), F.lower("o_orderpriority")).alias("loc"))
    return read(spark, d, "supplier").select(F.concat(F.lit("/entity/"), F.col("s_suppkey").cast("string")).alias("loc")).union(divisions).union(days).distinct()
