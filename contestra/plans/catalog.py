"""Named queries over the contest model and the driver tables, each with the SQL it must agree with.

Every function takes (spark, sf_dir). Dates are relative to a fixed day, never to the clock. Doubles are rounded to 4 places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.fold import elo_fold
from ..operators.relational import change_events, current_stint, decayed_last, greatest_or_null, latest_per_key, nearest_date_join, running_before, unique_match, validate
from ..sources.contests import CONTESTS_SQL, contests, observations, read

AS_OF = "2001-08-01"
QUERIES, ORACLES = {}, {}
PRE = "with " + CONTESTS_SQL


def query(name: str, sql: str | None = None, pre: bool = True, dates: tuple[str, ...] = ()):
    """Registers a function, and its SQL after the contest model's common table expressions if pre. Columns named in
    dates are returned as ISO text by both."""

    def put(f):
        def run(spark, sf_dir):
            df = f(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("string") for c in dates}) if dates else df

        QUERIES[name] = run
        if sql:
            first = sql.lstrip().split("\n")[0]
            text = (PRE + (", " if not first.startswith("select") else " ") if pre else "") + sql
            ORACLES[name] = f"select * replace ({', '.join(f'cast({c} as varchar) as {c}' for c in dates)}) from ({text})" if dates else text
        return f

    return put


def r4(c) -> F.Column:
    return F.round(c, 4)


@query("m01_observations", "select seq, event_date, division, side, entity_id, opponent_id, won, finish, qty, lines, ret, opp_qty, opp_lines, opp_ret from obs", dates=("event_date",))
def m01(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d)


TOTALS_SQL = """x as (select *, row_number() over (partition by entity_id order by event_date desc, seq) as rn from obs)
select entity_id, count(*)::bigint as bouts, sum(won)::double as wins, sum(qty)::double as qty, sum(opp_qty)::double as opp_qty, sum(lines)::bigint as lines,
  max(event_date) as last_date, max(case when rn = 1 then division end) as division from x group by entity_id"""


@query("a01_career_totals", TOTALS_SQL, dates=("last_date",))
def career_totals(spark, d):
    o = observations(spark, d)
    latest = F.max_by("division", F.struct("event_date", -F.col("seq")))
    return o.groupBy("entity_id").agg(F.count("*").alias("bouts"), F.sum("won").alias("wins"), F.sum("qty").alias("qty"), F.sum("opp_qty").alias("opp_qty"), F.sum("lines").alias("lines"), F.max("event_date").alias("last_date"), latest.alias("division"))


@query("a02_division_totals", "select entity_id, division, count(*)::bigint as bouts, sum(won)::double as wins, sum(qty)::double as qty from obs group by 1, 2")
def a02(spark, d):
    return observations(spark, d).groupBy("entity_id", "division").agg(F.count("*").alias("bouts"), F.sum("won").alias("wins"), F.sum("qty").alias("qty"))


@query("a03_division_priors", "select division, round(sum(qty) / greatest(1, sum(lines)), 4) as per_line, round(15.0 * sum(ret) / greatest(1, sum(lines)), 4) as ret_per_15 from obs group by 1")
def a03(spark, d):
    n = F.greatest(F.lit(1), F.sum("lines"))
    return observations(spark, d).groupBy("division").agg(r4(F.sum("qty") / n).alias("per_line"), r4(15.0 * F.sum("ret") / n).alias("ret_per_15"))


@query("a04_career_rates", "select entity_id, round(sum(qty) / nullif(sum(qty) + sum(opp_qty), 0), 4) as share, round(sum(ret)::double / nullif(sum(lines), 0), 4) as ret_rate, round(sum(case when finish and won = 1 then 1.0 else 0 end) / nullif(sum(won), 0), 4) as finish_rate from obs group by 1")
def a04(spark, d):
    fin = F.count_if(F.col("finish") & (F.col("won") == 1)).cast("double")
    return observations(spark, d).groupBy("entity_id").agg(r4(F.try_divide(F.sum("qty"), F.sum("qty") + F.sum("opp_qty"))).alias("share"), r4(F.try_divide(F.sum("ret").cast("double"), F.sum("lines"))).alias("ret_rate"), r4(F.try_divide(fin, F.sum("won"))).alias("finish_rate"))


@query("a05_weighted_mean", "select entity_id, round(coalesce(sum(case when lines > 1 then qty * (lines - 1) end) / nullif(sum(case when lines > 1 then lines - 1 end), 0), 0), 4) as mean from obs group by 1")
def a05(spark, d):
    w = F.when(F.col("lines") > 1, F.col("lines") - 1)
    return observations(spark, d).groupBy("entity_id").agg(r4(F.coalesce(F.try_divide(F.sum(F.col("qty") * w), F.sum(w)), F.lit(0.0))).alias("mean"))


@query("a06_distribution", "select division, round(avg(qty), 4) as mean, round(coalesce(nullif(stddev_samp(qty), 0), 1), 4) as sd, round(stddev_pop(qty), 4) as sd_pop, round(greatest(sqrt(avg(qty * qty)), 1e-6), 4) as rms from obs group by 1")
def a06(spark, d):
    return observations(spark, d).groupBy("division").agg(r4(F.avg("qty")).alias("mean"), r4(F.coalesce(F.nullif(F.stddev_samp("qty"), F.lit(0.0)), F.lit(1.0))).alias("sd"), r4(F.stddev_pop("qty")).alias("sd_pop"), r4(F.greatest(F.sqrt(F.avg(F.col("qty") * F.col("qty"))), F.lit(1e-6))).alias("rms"))


@query("a09_conditional_counts", "select entity_id, count(*) filter (won = 1)::bigint as w, count(*) filter (won = 0)::bigint as l, count(*) filter (won = 0.5)::bigint as d, count(*) filter (finish and won = 1)::bigint as fin, count(*) filter (event_date >= date '2001-08-01' - 730)::bigint as recent from obs group by 1")
def a09(spark, d):
    won = F.col("won")
    return observations(spark, d).groupBy("entity_id").agg(F.count_if(won == 1).alias("w"), F.count_if(won == 0).alias("l"), F.count_if(won == 0.5).alias("d"), F.count_if(F.col("finish") & (won == 1)).alias("fin"), F.count_if(F.col("event_date") >= F.date_sub(F.lit(AS_OF).cast("date"), 730)).alias("recent"))


EDGES = """edges as (select entity_id, opponent_id, count(*)::bigint as fights, count(*) filter (won = 1)::bigint as wins, count(*) filter (won = 0)::bigint as losses, min(event_date) as first_date, max(event_date) as last_date from obs group by 1, 2)"""


@query("a10_edges", EDGES + " select * from edges", dates=("first_date", "last_date"))
def edges(spark, d):
    return observations(spark, d).groupBy("entity_id", "opponent_id").agg(F.count("*").alias("fights"), F.count_if(F.col("won") == 1).alias("wins"), F.count_if(F.col("won") == 0).alias("losses"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"))


@query("a11_edge_summary", EDGES + " select entity_id, count(*)::bigint as opponents, sum(fights)::bigint as fights, string_agg(case when wins > losses then opponent_id::varchar end, ' | ' order by opponent_id::varchar) as beaten from edges group by 1")
def a11(spark, d):
    names = F.array_sort(F.collect_list(F.when(F.col("wins") > F.col("losses"), F.col("opponent_id").cast("string"))))
    return edges(spark, d).groupBy("entity_id").agg(F.count("*").alias("opponents"), F.sum("fights").alias("fights"), F.nullif(F.array_join(names, " | "), F.lit("")).alias("beaten"))


QUALITY = """, idx as (select entity_id, count(*) as bouts, sum(won) as wins from obs group by 1)
select e.entity_id, round(avg(100 * (0.65 * i.wins / i.bouts + 0.25 * least(i.bouts, 20) / 20.0 + 0.10)), 4) as quality, count(*)::bigint as opponents from edges e join idx i on i.entity_id = e.opponent_id group by 1 having count(*) >= 3"""


@query("g04_opponent_quality", EDGES + QUALITY)
def g04(spark, d):
    idx = observations(spark, d).groupBy(F.col("entity_id").alias("opponent_id")).agg(F.count("*").alias("bouts"), F.sum("won").alias("w"))
    q = 100 * (0.65 * F.col("w") / F.col("bouts") + 0.25 * F.least(F.col("bouts"), F.lit(20)) / 20.0 + 0.10)
    return edges(spark, d).join(idx, "opponent_id").groupBy("entity_id").agg(r4(F.avg(q)).alias("quality"), F.count("*").alias("opponents")).where("opponents >= 3")


@query("g05_wins_before_debut", "deb as (select entity_id, division, min(event_date) as debut from obs where division = '1-URGENT' group by all)\nselect o.entity_id, count(*)::bigint as wins from obs o join deb on deb.entity_id = o.opponent_id and o.event_date < deb.debut where o.won = 1 group by 1")
def g05(spark, d):
    o = observations(spark, d)
    debut = o.where("division = '1-URGENT'").groupBy(F.col("entity_id").alias("opponent_id")).agg(F.min("event_date").alias("debut"))
    return o.where("won = 1").join(debut, "opponent_id").where("event_date < debut").groupBy("entity_id").agg(F.count("*").alias("wins"))


@query("a12_distinct_nonempty", "select n_regionkey, count(distinct nullif(c_mktsegment, 'BUILDING'))::bigint as segments from customer join nation on n_nationkey = c_nationkey group by 1", pre=False)
def a12(spark, d):
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return c.groupBy("n_regionkey").agg(F.count_distinct(F.nullif("c_mktsegment", F.lit("BUILDING"))).alias("segments"))


@query("a13_concat_distinct", "select c_nationkey, string_agg(distinct c_mktsegment, ',' order by c_mktsegment) as segments from customer group by 1", pre=False)
def a13(spark, d):
    return read(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"))


@query("a14_directory_with_zeros", "select n_name, count(s_suppkey)::bigint as roster, round(avg(s_acctbal), 1) as mean, max(s_acctbal) as top from nation left join supplier on s_nationkey = n_nationkey and s_acctbal > 5000 group by 1", pre=False)
def a14(spark, d):
    s = read(spark, d, "supplier").where("s_acctbal > 5000")
    return read(spark, d, "nation").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("s_suppkey").alias("roster"), F.round(F.avg("s_acctbal"), 1).alias("mean"), F.max("s_acctbal").alias("top"))


@query("a18_ranked_evidence_pivot", "x as (select user_id, event_type, value, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events where user_id is not null)\nselect user_id, max(case when event_type = 'click' then value end) as click, max(case when event_type = 'view' then value end) as view, max(case when event_type = 'purchase' then value end) as purchase from x where rn = 1 group by 1".replace("x as", "with x as", 1), pre=False)
def a18(spark, d):
    last = latest_per_key(read(spark, d, "events").where("user_id is not null"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return last.groupBy("user_id").agg(*[F.max(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in ("click", "view", "purchase")])


@query("a20_json_field_rollup", "select event_type, (props::json->>'k')::bigint as k, count(*)::bigint as n, round(sum(value), 2) as total from events group by 1, 2", pre=False)
def a20(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, d, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


PRED = "p as (select event_date, won_a as y, least(greatest(a_qty / (a_qty + b_qty), 0.001), 0.999) as p from contests where won_a <> 0.5)"


def predictions(spark, d):
    p = F.least(F.greatest(F.col("a_qty") / (F.col("a_qty") + F.col("b_qty")), F.lit(0.001)), F.lit(0.999))
    return contests(spark, d).where("won_a <> 0.5").select("event_date", F.col("won_a").alias("y"), p.alias("p"))


@query("a21_calibration", PRED + " select least(floor(p * 10), 9)::bigint as bucket, count(*)::bigint as n, round(avg(p), 4) as mean_p, round(avg(y), 4) as rate from p group by 1")
def a21(spark, d):
    return predictions(spark, d).groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("long").alias("bucket")).agg(F.count("*").alias("n"), r4(F.avg("p")).alias("mean_p"), r4(F.avg("y")).alias("rate"))


def metrics(tie: float = 0.5):
    p, y = F.col("p"), F.col("y")
    hit = F.when(p == 0.5, tie).when((p > 0.5) == (y == 1), 1.0).otherwise(0.0)
    return [F.count("*").alias("n"), r4(F.avg(hit)).alias("accuracy"), r4(F.avg((p - y) * (p - y))).alias("brier"), r4(-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss")]


METRICS = "count(*)::bigint as n, round(avg(case when p = 0.5 then 0.5 when (p > 0.5) = (y = 1) then 1.0 else 0.0 end), 4) as accuracy, round(avg((p - y) * (p - y)), 4) as brier, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 4) as log_loss"


@query("a22_metrics", PRED + f" select {METRICS} from p")
def a22(spark, d):
    return predictions(spark, d).agg(*metrics())


@query("a23_metrics_by_year", PRED + f" select year(event_date)::bigint as year, {METRICS} from p group by 1")
def a23(spark, d):
    return predictions(spark, d).groupBy(F.year("event_date").cast("long").alias("year")).agg(*metrics())


@query("a24_bands", "x as (select entity_id, count(*) as n from obs group by 1)\nselect case when n < 50 then 'few' when n < 150 then 'some' else 'many' end as band, count(*)::bigint as entities from x group by 1")
def a24(spark, d):
    n = observations(spark, d).groupBy("entity_id").count()
    return n.groupBy(F.when(F.col("count") < 50, "few").when(F.col("count") < 150, "some").otherwise("many").alias("band")).agg(F.count("*").alias("entities"))


@query("a28_duplicate_keys", "select l_orderkey, l_linenumber, count(*)::bigint as n from lineitem group by 1, 2 having count(*) > 1", pre=False)
def a28(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("a32_last_five", "x as (select *, row_number() over (partition by entity_id order by event_date desc, seq desc) as rn from obs)\nselect entity_id, count(*) filter (won = 1)::bigint as w, count(*) filter (won = 0)::bigint as l from x where rn <= 5 group by 1")
def a32(spark, d):
    rn = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("event_date"), F.desc("seq")))
    return observations(spark, d).withColumn("rn", rn).where("rn <= 5").groupBy("entity_id").agg(F.count_if(F.col("won") == 1).alias("w"), F.count_if(F.col("won") == 0).alias("l"))


@query("f33_null_propagating_max", "select c_custkey, case when c_acctbal < 0 then null else greatest(c_acctbal, 1000.0) end as v from customer", pre=False)
def f33(spark, d):
    return read(spark, d, "customer").select("c_custkey", greatest_or_null(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), F.lit(1000.0)).alias("v"))


@query("j05_opposite_side", "select a.seq, a.entity_id, b.entity_id as other from obs a join obs b on a.seq = b.seq and a.side <> b.side")
def j05(spark, d):
    o = observations(spark, d).select("seq", "side", "entity_id")
    b = o.select(F.col("seq").alias("s2"), F.col("side").alias("side2"), F.col("entity_id").alias("other"))
    return o.join(b, (F.col("seq") == F.col("s2")) & (F.col("side") != F.col("side2"))).select("seq", "entity_id", "other")


@query("j07_asof_totals", "select seq, entity_id, coalesce(sum(won) over w, 0)::double as wins_before, coalesce(sum(qty) over w, 0)::double as qty_before, (count(*) over w)::bigint as bouts_before from obs window w as (partition by entity_id order by event_date, seq rows between unbounded preceding and 1 preceding)")
def j07(spark, d):
    out = running_before(observations(spark, d), ["entity_id"], ["event_date", "seq"], {"wins_before": F.col("won"), "qty_before": F.col("qty"), "bouts_before": F.lit(1).cast("long")})
    return out.select("seq", "entity_id", F.col("wins_before").cast("double").alias("wins_before"), F.col("qty_before").cast("double").alias("qty_before"), "bouts_before")


NEAR = """l as (select seq, least(a_id, b_id) as p, greatest(a_id, b_id) as q, event_date from contests where seq % 2 = 0), r as (select seq as r_seq, least(a_id, b_id) as p, greatest(a_id, b_id) as q, event_date as r_date from contests where seq % 2 = 1),
m as (select l.seq, l.p, l.q, l.event_date, r_date, r_seq, row_number() over (partition by seq order by r_seq is null, case r_date - l.event_date when 0 then 0 when -1 then 1 when 1 then 2 when -2 then 3 else 4 end, r_seq) as rn from l left join r on l.p = r.p and l.q = r.q and r_date between l.event_date - 2 and l.event_date + 2)
select seq, p, q, event_date, r_date, r_seq from m where rn = 1"""


@query("j08_nearby_date_join", NEAR, dates=("event_date", "r_date"))
def j08(spark, d):
    c = contests(spark, d).select("seq", F.least("a_id", "b_id").alias("p"), F.greatest("a_id", "b_id").alias("q"), "event_date")
    return nearest_date_join(c.where("seq % 2 = 0"), c.where("seq % 2 = 1").withColumnRenamed("seq", "r_seq"), ["p", "q"], "event_date")


@query("j11_semi", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')", pre=False)
def j11(spark, d):
    o = read(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return read(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("j12_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)", pre=False)
def j12(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("j16_unique_match", "select n_nationkey, (case when (select count(distinct s_suppkey) from supplier where s_nationkey = n_nationkey) = 1 then (select min(s_suppkey) from supplier where s_nationkey = n_nationkey) end) as s from nation", pre=False)
def j16(spark, d):
    return unique_match(read(spark, d, "nation").select("n_nationkey"), read(spark, d, "supplier"), F.col("n_nationkey"), F.col("s_nationkey"), "s_suppkey", "s")


BOARD = """x as (select *, row_number() over (partition by entity_id order by event_date desc, seq) as rn from obs),
t as (select entity_id, count(*) as bouts, round(100 * sum(won) / count(*), 4) as score, max(case when rn = 1 then division end) as division from x group by 1),
r as (select *, row_number() over (order by score desc, bouts desc, entity_id) as rank from t)
select r.rank::bigint as rank, r.entity_id, s_name as name, r.division, r.score, r.bouts::bigint as bouts, (count(*) over ())::bigint as total from r join supplier on s_suppkey = entity_id where position('1' in lower(s_name)) > 0 order by rank limit 25"""


@query("q03_leaderboard", BOARD)
def leaderboard(spark, d, search: str = "1", page: int = 25, skip: int = 0):
    """Ranks all entities first, then searches by literal substring and pages; total counts what the search found."""
    t = career_totals(spark, d).select("entity_id", "bouts", r4(100 * F.col("wins") / F.col("bouts")).alias("score"), "division")
    ranked = t.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("bouts"), "entity_id")).cast("long"))
    names = read(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"))
    found = ranked.join(names, "entity_id").where(F.instr(F.lower("name"), search.lower()) > 0)
    found = found.withColumn("total", F.count("*").over(Window.partitionBy(F.lit(1))))
    return found.orderBy("rank").offset(skip).limit(page).select("rank", "entity_id", "name", "division", "score", "bouts", "total")


@query("q04_division_counts", "x as (select *, row_number() over (partition by entity_id order by event_date desc, seq) as rn from obs)\nselect division, count(*)::bigint as entities from x where rn = 1 group by 1")
def q04(spark, d):
    return career_totals(spark, d).groupBy("division").agg(F.count("*").alias("entities"))


SCORE = "t as (select entity_id, division, count(*) as n, round(100 * sum(won) / count(*), 4) as score from obs group by 1, 2)"


@query("w05_percent_rank", SCORE + " select entity_id, division, score, round(100 * percent_rank() over (order by score), 1) as pct, (rank() over (order by score desc))::bigint as rank, (rank() over (partition by division order by score desc))::bigint as division_rank from t")
def w05(spark, d):
    t = observations(spark, d).groupBy("entity_id", "division").agg(r4(100 * F.sum("won") / F.count("*")).alias("score"))
    return t.select("entity_id", "division", "score", F.round(100 * F.percent_rank().over(Window.orderBy("score")), 1).alias("pct"), F.rank().over(Window.orderBy(F.desc("score"))).cast("long").alias("rank"), F.rank().over(Window.partitionBy("division").orderBy(F.desc("score"))).cast("long").alias("division_rank"))


@query("w07_change_events", "x as (select seq, entity_id, event_date, division, lag(division) over (partition by entity_id order by event_date, seq) as previous from obs)\nselect * from x where previous <> division", dates=("event_date",))
def w07(spark, d):
    return change_events(observations(spark, d).select("seq", "entity_id", "event_date", "division"), "entity_id", ["event_date", "seq"], "division")


@query("w08_runner_up_margin", SCORE + " select division, entity_id, score, round(score - lead(score) over w, 4) as margin, (count(*) over (partition by division))::bigint as candidates from t window w as (partition by division order by score desc, entity_id) qualify row_number() over w = 1")
def w08(spark, d):
    t = observations(spark, d).groupBy("entity_id", "division").agg(r4(100 * F.sum("won") / F.count("*")).alias("score"))
    w = Window.partitionBy("division").orderBy(F.desc("score"), "entity_id")
    out = t.select("division", "entity_id", "score", r4(F.col("score") - F.lead("score").over(w)).alias("margin"), F.count("*").over(Window.partitionBy("division")).alias("candidates"), F.row_number().over(w).alias("rn"))
    return out.where("rn = 1").drop("rn")


@query("w11_trailing_two_years", "select seq, entity_id, (count(*) over (partition by entity_id order by event_date range between interval 730 days preceding and interval 1 days preceding))::bigint as recent from obs")
def w11(spark, d):
    w = Window.partitionBy("entity_id").orderBy(F.unix_date("event_date")).rangeBetween(-730, -1)
    return observations(spark, d).select("seq", "entity_id", F.count("*").over(w).alias("recent"))


@query("w12_decayed_form", "x as (select *, row_number() over (partition by entity_id order by event_date desc, seq desc) as rn from obs)\nselect entity_id, round(sum((won - 0.5) / (1 + 0.35 * (rn - 1))) / sum(1 / (1 + 0.35 * (rn - 1))), 4) as form from x where rn <= 5 group by 1")
def w12(spark, d):
    return decayed_last(observations(spark, d), "entity_id", [F.desc("event_date"), F.desc("seq")], F.col("won") - 0.5, 5, 0.35, "form").select("entity_id", r4("form").alias("form"))


@query("w15_current_stint", "x as (select *, case when lag(division) over w <> division then 1 else 0 end as c from obs window w as (partition by entity_id order by event_date, seq)), y as (select *, sum(c) over (partition by entity_id order by event_date, seq) as run from x), z as (select *, max(run) over (partition by entity_id) as last from y)\nselect entity_id, division, count(*)::bigint as bouts, min(event_date) as since from z where run = last group by 1, 2", dates=("since",))
def w15(spark, d):
    return current_stint(observations(spark, d), "entity_id", ["event_date", "seq"], "division").groupBy("entity_id", "division").agg(F.count("*").alias("bouts"), F.min("event_date").alias("since"))


@query("t07_merged_feeds", "select * from (select 'order' as kind, o_orderkey as id, o_orderdate as moment from orders union all select event_type, event_id, ts from events) order by moment desc, kind, id limit 75", pre=False, dates=())
def t07(spark, d):
    a = read(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("moment"))
    b = read(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("moment"))
    return a.unionByName(b).orderBy(F.desc("moment"), "kind", "id").limit(75)


@query("u09_drop_all_duplicates", "select l_orderkey, l_linenumber, min(l_partkey) as l_partkey from lineitem group by 1, 2 having count(*) = 1", pre=False)
def u09(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.count("*").alias("n")).where("n = 1").drop("n")


@query("d01_contest_checks", "x as (select seq, 'finish needs a winner' as rule from contests where finish and won_a = 0.5 union all select seq, 'two lines a side' from contests where not (a_lines >= 2 and b_lines >= 2))\nselect rule, count(*)::bigint as n from x group by 1")
def d01(spark, d):
    rules = {"sides differ": F.col("a_id") != F.col("b_id"), "finish needs a winner": ~F.col("finish") | (F.col("won_a") != 0.5), "two lines a side": (F.col("a_lines") >= 2) & (F.col("b_lines") >= 2)}
    return validate(contests(spark, d), rules, "seq")[1].groupBy("rule").agg(F.count("*").alias("n"))


@query("m03_elo")
def m03(spark, d):
    return elo_fold(contests(spark, d)).select("seq", "entity_id", "opponent_id", r4("before").alias("before"), r4("opponent_before").alias("opponent_before"), r4("after").alias("after"))
