"""Named queries over a directory of people: customers as people, their nation as promotion and country, their orders as contests.

A person's rating is the account balance, a win an order of status F, a finish one above 300,000, a title one above 450,000.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.facets import checked, faceted, intelligence_gaps, status_of, visible, whole_location
from ..operators.relational import latest_per_key
from ..sources.contests import read
from .catalog import AS_OF, query

PEOPLE = """with o as (select o_custkey as id, count(*) as bouts, count(*) filter (o_orderstatus = 'F') as wins, count(*) filter (o_orderstatus = 'F' and o_totalprice > 300000) as finishes,
  count(*) filter (o_totalprice > 450000) as titles, max(cast(o_orderdate as date)) as last_date from orders group by 1),
people as (select c_custkey as id, c_name as name, c_mktsegment as division, n_name as promotion, n_name as country, r_name as region, 18 + c_custkey % 25 as age, c_acctbal as rating,
  coalesce(bouts, 0)::bigint as bouts, coalesce(wins, 0)::bigint as wins, coalesce(finishes, 0)::bigint as finishes, coalesce(titles, 0)::bigint as titles, last_date,
  100 * (1 - exp(-coalesce(bouts, 0) / 7.0)) as evidence, case c_custkey % 4 when 0 then 'managed' when 1 then 'free' else 'unknown' end as management,
  case when c_custkey % 6 = 0 then 'signed' when c_custkey % 3 = 0 then 'expiring' else 'unknown' end as contract, case when c_custkey % 5 = 0 then 'open' else 'unknown' end as opportunity
  from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey left join o on o.id = c_custkey)
"""


def people(spark: SparkSession, d: str) -> DataFrame:
    """One row a person; statuses that nothing states are unknown, never inferred."""
    o = read(spark, d, "orders")
    won = F.col("o_orderstatus") == "F"
    o = o.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("bouts"), F.count_if(won).alias("wins"), F.count_if(won & (F.col("o_totalprice") > 300000)).alias("finishes"), F.count_if(F.col("o_totalprice") > 450000).alias("titles"), F.max(F.col("o_orderdate").cast("date")).alias("last_date"))
    k = F.col("c_custkey")
    c = read(spark, d, "customer").withColumns({"explicit": F.when(k % 4 == 0, "managed"), "seen": F.when(k % 4 == 1, " free "), "deal": F.when(k % 6 == 0, "signed").when(k % 3 == 0, "expiring"), "offer": F.when(k % 5 == 0, "open")})
    places = read(spark, d, "nation").join(F.broadcast(read(spark, d, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    c = c.join(F.broadcast(places), F.col("n_nationkey") == F.col("c_nationkey")).join(o, k == F.col("id"), "left").drop("id")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    return c.select(
        k.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("division"), F.col("n_name").alias("promotion"), F.col("n_name").alias("country"), F.col("r_name").alias("region"),
        (18 + k % 25).alias("age"), F.col("c_acctbal").alias("rating"), zero("bouts"), zero("wins"), zero("finishes"), zero("titles"), "last_date",
        (100 * (1 - F.exp(-F.coalesce("bouts", F.lit(0)) / 7.0))).alias("evidence"), status_of("explicit", "seen").alias("management"), status_of("deal").alias("contract"), status_of("offer").alias("opportunity"),
    )


FACETS = {"q": "customer#0000", "division": "BUILDING", "management": "unknown", "age_min": 20, "age_max": 40, "rating_min": 0.0, "evidence_min": 50.0, "wins_min": 1, "active_months": 240, "finish_rate_min": 0.05, "title": False}


@query("p03_facets", PEOPLE + """select id, name, rating, wins from people where instr(lower(name || ' ' || promotion || ' ' || country), 'customer#0000') > 0 and division = 'BUILDING' and management = 'unknown' and age between 20 and 40 and rating >= 0
and evidence >= 50 and wins >= 1 and last_date >= date '2001-08-01' - interval 240 month and finishes::double / nullif(wins, 0) >= 0.05 and not titles > 0""", pre=False)
def p03(spark, d):
    return faceted(people(spark, d), AS_OF, **FACETS).select("id", "name", "rating", "wins")


@query("q12_talent_search", PEOPLE + """select id, name, region, age, rating, (count(*) over ())::bigint as total from people where region = 'ASIA' and contract = 'unknown' and age <= 35 order by last_date desc nulls last, id limit 30 offset 5""", pre=False)
def q12(spark, d, metric: str = "activity", page: int = 30, skip: int = 5):
    """Faceted search: the narrow order key is ranked and cut first, what is shown is joined to the page."""
    column, page, skip = checked(metric, page, skip)
    found = faceted(people(spark, d), AS_OF, region="ASIA", contract="unknown", age_max=35).select("id", column)
    found = found.withColumn("total", F.count("*").over(Window.partitionBy(F.lit(1))))
    cut = found.orderBy(F.desc_nulls_last(column), "id").offset(skip).limit(page).select("id", "total")
    return people(spark, d).join(F.broadcast(cut), "id").select("id", "name", "region", "age", "rating", "total")


OPENINGS = [(1, "BUILDING", 30, 3, "unknown"), (2, None, 25, None, "managed"), (3, "MACHINERY", None, 8, None)]


@query("q19_opening_candidates", PEOPLE + """, w as (select * from (values (1, 'BUILDING', 30, 3, 'unknown'), (2, null, 25, null, 'managed'), (3, 'MACHINERY', null, 8, null)) t(opening, division, max_age, min_wins, management)),
m as (select w.opening, p.id, p.rating, p.wins, row_number() over (partition by w.opening order by p.rating desc, p.id) as place from w join people p
  on (w.division is null or p.division = w.division) and (w.max_age is null or p.age <= w.max_age) and (w.min_wins is null or p.wins >= w.min_wins) and (w.management is null or p.management = w.management))
select opening::bigint as opening, id, rating, wins, place::bigint as place from m where place <= 20""", pre=False)
def q19(spark, d, most: int = 20):
    """The best people for each saved opening (P04); the few openings are broadcast against all people."""
    w = spark.createDataFrame(OPENINGS, "opening long, w_division string, max_age int, min_wins int, w_management string")
    c = F.col
    fits = (c("w_division").isNull() | (c("division") == c("w_division"))) & (c("max_age").isNull() | (c("age") <= c("max_age"))) & (c("min_wins").isNull() | (c("wins") >= c("min_wins"))) & (c("w_management").isNull() | (c("management") == c("w_management")))
    place = F.row_number().over(Window.partitionBy("opening").orderBy(F.desc("rating"), "id"))
    return people(spark, d).join(F.broadcast(w), fits).select("opening", "id", "rating", "wins", place.cast("long").alias("place")).where(c("place") <= most)


PROSPECTS = PEOPLE + """, s as (select id, division, promotion, age, 0.6 * rating / 100 + 25.0 * wins / nullif(bouts, 0) + 15 * least(bouts, 20) / 20.0 - case when greatest(age, 26) is null then null else greatest(age, 26) - 26 end as raw from people where bouts > 0 and age <= 32),
r as (select *, round(100 * percent_rank() over (order by raw), 1) as score, rank() over (order by raw desc) as place, rank() over (partition by division order by raw desc) as division_place from s)
select id, division, round(raw, 4) as raw, score, place::bigint as place, division_place::bigint as division_place from r where promotion <> 'NATION_0' and score >= 40"""


@query("q13_prospect_board", PROSPECTS, pre=False)
def q13(spark, d, max_age: int = 32, least: float = 40.0, top: str = "NATION_0"):
    """Derived scores ranked over all who qualify; then those outside the top promotion with score enough."""
    # Multiplied before divided, and rounded as the SQL rounds: scores that tie there must tie here.
    rounded = lambda c, n: F.round(c * 10.0**n) / 10.0**n
    raw = 0.6 * F.col("rating") / 100 + F.try_divide(25.0 * F.col("wins"), F.col("bouts")) + 15 * F.least("bouts", F.lit(20)) / 20.0 - (F.greatest("age", F.lit(26)) - 26)
    s = people(spark, d).where((F.col("bouts") > 0) & (F.col("age") <= max_age)).withColumn("raw", raw)
    s = s.select("id", "division", "promotion", "raw", rounded(100 * F.percent_rank().over(Window.orderBy("raw")), 1).alias("score"), F.rank().over(Window.orderBy(F.desc("raw"))).cast("long").alias("place"), F.rank().over(Window.partitionBy("division").orderBy(F.desc("raw"))).cast("long").alias("division_place"))
    return s.where((F.col("promotion") != top) & (F.col("score") >= least)).select("id", "division", rounded(F.col("raw"), 4).alias("raw"), "score", "place", "division_place")


LOCATIONS = """with x as (select c_custkey as id, case when c_custkey % 3 = 0 then 'Town' || c_custkey % 9 end as o_city, null as o_region, case when c_custkey % 4 = 0 then 'Land' || c_custkey % 5 end as o_country, 'City' || c_custkey % 7 as l_city, n_name as l_region from customer join nation on n_nationkey = c_nationkey)
select id, case when coalesce(o_city, o_country) is not null then o_city else l_city end as city, case when coalesce(o_city, o_country) is not null then null else l_region end as region, case when coalesce(o_city, o_country) is not null then o_country end as country from x"""


@query("p06_whole_location", LOCATIONS, pre=False)
def p06(spark, d):
    k, text = F.col("c_custkey"), lambda p, m: F.concat(F.lit(p), (F.col("c_custkey") % m).cast("string"))
    rows = read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    none = F.lit(None).cast("string")
    rows = rows.select(k.alias("id"), F.when(k % 3 == 0, text("Town", 9)).alias("o_city"), none.alias("o_region"), F.when(k % 4 == 0, text("Land", 5)).alias("o_country"), text("City", 7).alias("l_city"), F.col("n_name").alias("l_region"), none.alias("l_country"))
    return rows.select("id", *whole_location("o", "l"))


@query("p08_visible", "select c_custkey from customer where c_custkey not in (select s_suppkey from supplier where s_acctbal < 3000)", pre=False)
def p08(spark, d):
    controls = read(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.when(F.col("s_acctbal") < 3000, "removed").when(F.col("s_acctbal") < 6000, "public").alias("status"))
    return visible(read(spark, d, "customer").select("c_custkey"), controls, "c_custkey")


@query("p07_completed", "select o_orderkey from orders where o_orderstatus <> 'O' and cast(o_orderdate as date) <= date '1998-06-01'", pre=False)
def p07(spark, d, as_of: str = "1998-06-01"):
    return read(spark, d, "orders").where((F.col("o_orderstatus") != "O") & (F.col("o_orderdate") < F.date_add(F.lit(as_of).cast("date"), 1).cast("timestamp"))).select("o_orderkey")


@query("p11_usable_calendar", "select o_orderkey from orders where cast(o_orderdate as date) between date '1998-06-01' - 3 and date '1998-06-01' + 540 and nullif(o_orderpriority, '5-LOW') is not null", pre=False)
def p11(spark, d, as_of: str = "1998-06-01"):
    day, on = F.col("o_orderdate").cast("date"), F.lit(as_of).cast("date")
    return read(spark, d, "orders").where(day.between(F.date_sub(on, 3), F.date_add(on, 540)) & F.nullif("o_orderpriority", F.lit("5-LOW")).isNotNull()).select("o_orderkey")


@query("f39_intelligence_gaps", PEOPLE + """select id, array_to_string(list_sort(list_filter([case when last_date is null then 'activity missing' when date '2001-08-01' - last_date > 120 then 'activity stale' end,
 case when id % 7 = 0 then 'contract missing' when date '2001-08-01' - (date '2001-01-01' + (id % 200)::integer) > 90 then 'contract stale' end], lambda x: x is not null)), '; ') as gaps from people""", pre=False)
def f39(spark, d):
    contract = F.when(F.col("id") % 7 != 0, F.date_add(F.lit("2001-01-01").cast("date"), (F.col("id") % 200).cast("int")))
    gaps = intelligence_gaps(F.lit(AS_OF).cast("date"), activity=(F.col("last_date"), 120), contract=(contract, 90))
    return people(spark, d).select("id", F.array_join(gaps, "; ").alias("gaps"))


@query("f40_named_promotions", "select n_nationkey from nation where lower(n_name) not in ('nation_1', 'unknown', 'nation_12') and trim(n_name) <> ''", pre=False)
def f40(spark, d, generic: tuple[str, ...] = ("nation_1", "unknown", "nation_12")):
    return read(spark, d, "nation").where(~F.lower(F.trim("n_name")).isin(*generic) & (F.trim("n_name") != "")).select("n_nationkey")


@query("f41_q16_continents", """select r_name as continent, count(*)::bigint as people, count(distinct n_nationkey)::bigint as countries, round(avg(c_acctbal), 2) as mean, round(max(c_acctbal), 2) as top from region left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by 1""", pre=False)
def f41(spark, d):
    """A directory by continent; the map of countries is broadcast."""
    places = F.broadcast(read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "right"))
    rows = places.join(read(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy(F.col("r_name").alias("continent")).agg(F.count("*").alias("people"), F.count_distinct("n_nationkey").alias("countries"), F.round(F.avg("c_acctbal"), 2).alias("mean"), F.round(F.max("c_acctbal"), 2).alias("top"))


@query("f43_profile_facts", PEOPLE + "select id, round(100.0 * finishes / nullif(wins, 0), 2) as finish_rate, round(100.0 * wins / nullif(bouts, 0), 2) as win_rate, titles > 0 as titled from people", pre=False)
def f43(spark, d):
    rate = lambda a, b: F.round(100.0 * F.try_divide(F.col(a).cast("double"), F.col(b)), 2)
    return people(spark, d).select("id", rate("finishes", "wins").alias("finish_rate"), rate("wins", "bouts").alias("win_rate"), (F.col("titles") > 0).alias("titled"))


@query("a27_q14_agency_rosters", PEOPLE + """select promotion as agency, count(*)::bigint as roster, count(*) filter (last_date >= date '2001-08-01' - 365)::bigint as active, count(*) filter (age < 26)::bigint as young, round(avg(rating), 1) as mean, max(rating) as top,
 count(distinct nullif(management, 'unknown'))::bigint as kinds, max(last_date) as latest, string_agg(distinct division, ', ' order by division) as divisions from people group by 1""", pre=False, dates=("latest",))
def a27(spark, d):
    return people(spark, d).groupBy(F.col("promotion").alias("agency")).agg(
        F.count("*").alias("roster"), F.count_if(F.col("last_date") >= F.date_sub(F.lit(AS_OF).cast("date"), 365)).alias("active"), F.count_if(F.col("age") < 26).alias("young"), F.round(F.avg("rating"), 1).alias("mean"), F.max("rating").alias("top"),
        F.count_distinct(F.nullif("management", F.lit("unknown"))).alias("kinds"), F.max("last_date").alias("latest"), F.array_join(F.array_sort(F.collect_set("division")), ", ").alias("divisions"),
    )


@query("q15_promotion_directory", PEOPLE + """, x as (select promotion, id, name, rating, row_number() over (partition by promotion order by rating desc, id) as rn from people)
select promotion, count(*)::bigint as roster, max(case when rn = 1 then name end) as leader, string_agg(case when rn <= 3 then name end, ' | ' order by rn) as leaders from x group by 1""", pre=False)
def q15(spark, d):
    x = people(spark, d).select("promotion", "name", F.row_number().over(Window.partitionBy("promotion").orderBy(F.desc("rating"), "id")).alias("rn"))
    best = F.array_sort(F.collect_list(F.when(F.col("rn") <= 3, F.struct("rn", "name"))))
    return x.groupBy("promotion").agg(F.count("*").alias("roster"), F.max(F.when(F.col("rn") == 1, F.col("name"))).alias("leader"), F.array_join(F.transform(best, lambda b: b["name"]), " | ").alias("leaders"))


@query("a31_q18_field_coverage", PEOPLE + """, f as (select id, division, (bouts > 0)::int + (last_date is not null)::int + (management <> 'unknown')::int + (contract <> 'unknown')::int + (opportunity <> 'unknown')::int + (titles > 0)::int + (finishes > 0)::int + (rating > 0)::int + (age is not null)::int + (name is not null)::int + (promotion is not null)::int + (country is not null)::int + (region is not null)::int + (division is not null)::int + (wins > 0)::int + (evidence > 50)::int + (bouts >= 5)::int as n from people)
select id, round(100.0 * n / 17, 1) as coverage, (17 - n)::bigint as missing from f order by n, id limit 300""", pre=False)
def a31(spark, d, most: int = 300):
    """Share of 17 fields that are known; the least known first."""
    known = [F.col(c) > 0 for c in ("bouts", "titles", "finishes", "rating", "wins")] + [F.col(c) != "unknown" for c in ("management", "contract", "opportunity")]
    known += [F.col(c).isNotNull() for c in ("last_date", "age", "name", "promotion", "country", "region", "division")] + [F.col("evidence") > 50, F.col("bouts") >= 5]
    n = sum((F.coalesce(k, F.lit(False)).cast("int") for k in known), F.lit(0))
    rows = people(spark, d).select("id", n.alias("n"))
    return rows.orderBy("n", "id").limit(most).select("id", F.round(100.0 * F.col("n") / len(known), 1).alias("coverage"), (len(known) - F.col("n")).cast("long").alias("missing"))


@query("t02_status_order", "select o_orderkey, o_orderstatus, (row_number() over (order by case o_orderstatus when 'P' then 0 when 'O' then 1 else 2 end, o_totalprice desc, o_orderkey))::bigint as place from orders order by place limit 40", pre=False)
def t02(spark, d, most: int = 40):
    order = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    top = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", order.alias("s")).orderBy("s", F.desc("o_totalprice"), "o_orderkey").limit(most)
    return top.select("o_orderkey", "o_orderstatus", F.row_number().over(Window.orderBy("s", F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("place"))


@query("t06_filter_after_limit", PEOPLE + "select id, rating from (select * from people order by rating desc, id limit 200) where age < 30 order by rating desc, id limit 20", pre=False)
def t06(spark, d):
    """The age filter sees the 200 best only, so it may find fewer than there are."""
    return people(spark, d).orderBy(F.desc("rating"), "id").limit(200).where("age < 30").orderBy(F.desc("rating"), "id").limit(20).select("id", "rating")


@query("w04_j14_best_evidence", """with e as (select user_id, event_id, case event_type when 'purchase' then 'A' when 'click' then 'B' else 'C' end as confidence, ts from events),
x as (select *, row_number() over (partition by user_id order by confidence, ts desc, event_id desc) as rn from e)
select c_custkey, event_id, confidence from customer left join x on user_id = c_custkey and rn = 1""", pre=False)
def w04(spark, d):
    """Each person's best evidence: confidence first, then the newest."""
    kind = F.when(F.col("event_type") == "purchase", "A").when(F.col("event_type") == "click", "B").otherwise("C")
    best = latest_per_key(read(spark, d, "events").select(F.col("user_id").alias("c_custkey"), "event_id", kind.alias("confidence"), "ts"), ["c_custkey"], [F.asc("confidence"), F.desc("ts"), F.desc("event_id")])
    return read(spark, d, "customer").select("c_custkey").join(best.select("c_custkey", "event_id", "confidence"), "c_custkey", "left")


@query("j21_q23_evidence_history", """with x as (select o_custkey, o_orderkey, cast(o_orderdate as date) as day, o_orderstatus = 'O' as current from orders),
l as (select l_orderkey, string_agg(l_returnflag || ':' || l_linenumber || ':' || l_suppkey, ',' order by l_returnflag, l_linenumber, l_suppkey) as evidence, count(*) as n from lineitem group by 1)
select o_custkey, o_orderkey, day, current, coalesce(evidence, '') as evidence, coalesce(n, 0)::bigint as n, (row_number() over (partition by o_custkey order by current desc, day desc, o_orderkey))::bigint as place from x left join l on l_orderkey = o_orderkey""", pre=False, dates=("day",))
def j21(spark, d):
    """Dated entries with their evidence as one array each, current ones first."""
    e = F.array_sort(F.collect_list(F.struct("l_returnflag", "l_linenumber", "l_suppkey")))
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(e, lambda x: F.concat_ws(":", x["l_returnflag"], x["l_linenumber"].cast("string"), x["l_suppkey"].cast("string"))), ",").alias("evidence"), F.count("*").alias("n"))
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderstatus") == "O").alias("current"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("current"), F.desc("day"), "o_orderkey"))
    return o.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_custkey", "o_orderkey", "day", "current", F.coalesce("evidence", F.lit("")).alias("evidence"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), place.cast("long").alias("place"))


FEEDS = """select 'order' as kind, o_orderkey as id, cast(o_orderdate as timestamp) as moment, o_totalprice as amount from orders union all select 'return', l_orderkey * 100 + l_linenumber, l_shipdate, l_extendedprice from lineitem where l_returnflag = 'R'
union all select event_type, event_id, ts, value from events"""


@query("q21_u02_activity_wire", f"with w as ({FEEDS}) select kind, id, moment, amount from w order by moment desc, kind, id, amount limit 75", pre=False)
def q21(spark, d, most: int = 75):
    """Feeds tagged by kind; each is cut to the newest before they meet, so that the merge sorts little."""
    o = read(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("moment"), F.col("o_totalprice").alias("amount"))
    r = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.lit("return").alias("kind"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("moment"), F.col("l_extendedprice").alias("amount"))
    e = read(spark, d, "events")
    feeds = [o, r] + [e.where(F.col("event_type") == k).select(F.lit(k).alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("moment"), F.col("value").alias("amount")) for k in ("click", "view", "purchase", "error", "signup", "login", "logout", "search")]
    order = [F.desc("moment"), F.asc("kind"), F.asc("id"), F.asc("amount")]
    out = feeds[0].orderBy(*order).limit(most)
    for f in feeds[1:]:
        out = out.unionByName(f.orderBy(*order).limit(most))
    return out.orderBy(*order).limit(most)


@query("q37_threads", """with r as (select turn, conv_id, count(*) filter (role = 'user') as users from conversations group by 1, 2),
p as (select conv_id, turn, role, length(text) as size from conversations)
select p.conv_id, p.turn, p.role, p.size::bigint as size, coalesce(r.users, 0)::bigint as reactions, p.conv_id % 3 = 0 as mine from p left join r on r.conv_id = p.conv_id and r.turn = p.turn + 1 where p.conv_id not in (select user_id from events where event_type = 'error' and user_id % 4 = 0)""", pre=False)
def q37(spark, d):
    """Posts with the number of reactions to each, without those of blocked authors."""
    c = read(spark, d, "conversations")
    r = c.groupBy("conv_id", (F.col("turn") - 1).alias("turn")).agg(F.count_if(F.col("role") == "user").alias("reactions"))
    blocked = read(spark, d, "events").where("event_type = 'error' and user_id % 4 = 0").select(F.col("user_id").alias("conv_id")).distinct()
    out = c.join(blocked, "conv_id", "left_anti").join(r, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", F.char_length("text").cast("long").alias("size"), F.coalesce("reactions", F.lit(0)).cast("long").alias("reactions"), (F.col("conv_id") % 3 == 0).alias("mine"))


@query("q36_notes", "select o_orderkey, o_custkey, o_custkey % 7 = 0 as pinned, (row_number() over (partition by o_orderpriority order by o_custkey % 7 = 0 desc, o_orderdate desc, o_orderkey))::bigint as place from orders", pre=False)
def q36(spark, d):
    pinned = F.col("o_custkey") % 7 == 0
    return read(spark, d, "orders").select("o_orderkey", "o_custkey", pinned.alias("pinned"), F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc(pinned), F.desc("o_orderdate"), "o_orderkey")).cast("long").alias("place"))


@query("j19_coverage_matrix", "with k as (select unnest(['click', 'view', 'purchase', 'error', 'refund']) as kind), u as (select distinct user_id from events) select u.user_id, kind from u cross join k where not exists (select 1 from events e where e.user_id = u.user_id and e.event_type = kind)", pre=False)
def j19(spark, d, kinds: tuple[str, ...] = ("click", "view", "purchase", "error", "refund")):
    """What each person lacks of a fixed list (U03, J19): the list is a few rows."""
    e = read(spark, d, "events").select("user_id", F.col("event_type").alias("kind")).distinct()
    every = e.select("user_id").distinct().select("user_id", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    return every.join(e, ["user_id", "kind"], "left_anti")


@query("j18_alias_winner", "with a as (select n_nationkey, 'place ' || n_nationkey % 8 as alias, n_name as target from nation) select c_custkey, min(target) as target from customer left join a on alias = 'place ' || c_custkey % 12 group by 1", pre=False)
def j18(spark, d):
    """Aliases may name several targets; the first of them counts. The alias table is grouped first and broadcast."""
    a = read(spark, d, "nation").groupBy(F.concat(F.lit("place "), (F.col("n_nationkey") % 8).cast("string")).alias("alias")).agg(F.min("n_name").alias("target"))
    return read(spark, d, "customer").select("c_custkey", F.concat(F.lit("place "), (F.col("c_custkey") % 12).cast("string")).alias("alias")).join(F.broadcast(a), "alias", "left").select("c_custkey", "target")


@query("j01_star", "select l_orderkey, l_linenumber, l_suppkey, l_partkey, c_name, n.n_name, r_name, p_brand, sn.n_name as supplier_nation from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation n on n.n_nationkey = c_nationkey join region on r_regionkey = n.n_regionkey join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join nation sn on sn.n_nationkey = s_nationkey where l_quantity > 45", pre=False)
def j01(spark, d):
    """Facts filtered first, dimensions chosen for broadcast by size; nation is joined in two roles."""
    n = read(spark, d, "nation")
    l = read(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    out = l.join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey")).join(read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    out = out.join(n.select("n_nationkey", "n_name", "n_regionkey"), F.col("n_nationkey") == F.col("c_nationkey")).join(read(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    out = out.join(read(spark, d, "part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey")).join(read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    other = n.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("supplier_nation"))
    return out.join(other, F.col("k2") == F.col("s_nationkey")).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "c_name", "n_name", "r_name", "p_brand", "supplier_nation")


@query("u05_richest", "with x as (select *, row_number() over (partition by c_nationkey, c_mktsegment order by c_acctbal desc, c_custkey) as rn from customer) select c_custkey, c_nationkey, c_mktsegment from x where rn = 1", pre=False)
def u05(spark, d):
    return read(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("c_custkey"))


@query("u01_linked_history", "select o_orderkey, o_custkey as person, 'id' as via from orders where o_orderkey % 3 > 0 union all select o_orderkey, k.c, 'name' from orders join (select n_name as name, min(c_custkey) as c from nation join customer on c_nationkey = n_nationkey where c_custkey < 60 group by 1 having count(*) = 1) k on k.name = 'NATION_' || o_orderkey % 30 where o_orderkey % 3 = 0", pre=False)
def u01(spark, d):
    """History linked by id, and where that is missing by a name that only one person has."""
    o = read(spark, d, "orders")
    alone = read(spark, d, "nation").join(read(spark, d, "customer").where("c_custkey < 60"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("name")).agg(F.min("c_custkey").alias("person"), F.count("*").alias("n")).where("n = 1")
    named = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.concat(F.lit("NATION_"), (F.col("o_orderkey") % 30).cast("string")).alias("name")).join(F.broadcast(alone), "name")
    return o.where("o_orderkey % 3 > 0").select("o_orderkey", F.col("o_custkey").alias("person"), F.lit("id").alias("via")).unionByName(named.select("o_orderkey", "person", F.lit("name").alias("via")))


@query("a17_agreed_identity", "select o_custkey % 50 as name, min(o_custkey) as id from orders where o_custkey < 80 group by 1 having count(distinct o_custkey) = 1", pre=False)
def a17(spark, d):
    rows = read(spark, d, "orders").where("o_custkey < 80").groupBy((F.col("o_custkey") % 50).alias("name")).agg(F.min("o_custkey").alias("id"), F.max("o_custkey").alias("top"))
    return rows.where("id = top").select("name", "id")


@query("a25_backlog", "with n as (select n_nationkey, count(c_custkey) as n from nation left join customer on c_nationkey = n_nationkey and c_acctbal > 9500 group by 1) select case when n = 0 then 'none' when n = 1 then 'one' else 'several' end as category, count(*)::bigint as names from n group by 1", pre=False)
def a25(spark, d):
    c = read(spark, d, "customer").where("c_acctbal > 9500").select("c_nationkey", "c_custkey")
    n = read(spark, d, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg(F.count("c_custkey").alias("n"))
    return n.groupBy(F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "one").otherwise("several").alias("category")).agg(F.count("*").alias("names"))


@query("a29_middle", "select c_nationkey, list_sort(list(c_acctbal))[(count(*) // 2 + 1)::integer] as middle from customer group by 1", pre=False)
def a29(spark, d):
    """The upper of the two middle values, as an index into the sorted list gives it."""
    w = Window.partitionBy("c_nationkey")
    rows = read(spark, d, "customer").select("c_nationkey", "c_acctbal", F.row_number().over(w.orderBy("c_acctbal")).alias("rn"), F.count("*").over(w).alias("n"))
    return rows.where("rn = floor(n / 2) + 1").select("c_nationkey", F.col("c_acctbal").alias("middle"))


@query("a30_completeness", PEOPLE + "select id, round(30 + 45.0 * wins / nullif(bouts, 0) + 25 * (bouts >= 5)::int, 2) as by_share, round(least(55 + 7.5 * least(bouts, 6), 100), 2) as by_count from people", pre=False)
def a30(spark, d):
    """The two definitions side by side: by the share of known contests, and by their number."""
    share = 30 + 45.0 * F.try_divide(F.col("wins").cast("double"), F.col("bouts")) + 25 * (F.col("bouts") >= 5).cast("int")
    return people(spark, d).select("id", F.round(share, 2).alias("by_share"), F.round(F.least(55 + 7.5 * F.least("bouts", F.lit(6)), F.lit(100.0)), 2).alias("by_count"))


@query("w13_ranks_by_metric", PEOPLE + "select id, (1 + (select count(*) from people q where q.rating > p.rating))::bigint as rating_rank, (1 + (select count(*) from people q where q.wins > p.wins))::bigint as wins_rank, (1 + (select count(*) from people q where q.finishes > p.finishes))::bigint as finishes_rank from people p", pre=False)
def w13(spark, d):
    """Ranks in which ties share a place, for several metrics: values are counted and ranked, not the people."""
    out = people(spark, d).select("id", "rating", "wins", "finishes")
    for m in ("rating", "wins", "finishes"):
        above = Window.orderBy(F.desc(m)).rowsBetween(Window.unboundedPreceding, -1)
        ranks = out.groupBy(m).agg(F.count("*").alias("n")).select(m, (1 + F.coalesce(F.sum("n").over(above), F.lit(0))).cast("long").alias(f"{m}_rank"))
        out = out.join(ranks, m)
    return out.select("id", "rating_rank", "wins_rank", "finishes_rank")


@query("f28_text_search", "select p_partkey, p_name from part where p_name like '%\\_%' escape '\\' or lower(substr(p_brand, 1, 7)) = 'brand#1' and instr(p_type, 'ECO') > 0 and nullif(trim(p_name), '') is not null", pre=False)
def f28(spark, d):
    """An escaped pattern, a prefix without regard to case, and a literal substring."""
    c = F.col
    return read(spark, d, "part").where(c("p_name").like("%\\_%") | ((F.lower(F.substring("p_brand", 1, 7)) == "brand#1") & (F.instr("p_type", "ECO") > 0) & F.nullif(F.trim("p_name"), F.lit("")).isNotNull())).select("p_partkey", "p_name")


@query("f30_date_guard", "select o_orderkey, regexp_matches(t, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') as dated from (select o_orderkey, case when o_orderkey % 4 = 0 then 'soon' else cast(o_orderdate as varchar) end as t from orders)", pre=False)
def f30(spark, d):
    text = F.when(F.col("o_orderkey") % 4 == 0, "soon").otherwise(F.col("o_orderdate").cast("string"))
    return read(spark, d, "orders").select("o_orderkey", text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}").alias("dated"))


@query("f32_formatted", "select p_partkey, printf('%.1f cm', p_size / 7.0) as t from part", pre=False)
def f32(spark, d):
    return read(spark, d, "part").select("p_partkey", F.format_string("%.1f cm", F.col("p_size") / 7.0).alias("t"))


@query("f31_json", "select event_id, json_type(props, '$.k') is not null as has, json_valid(props) as valid, (json_extract(props, '$.k'))::bigint as k, length(to_json({k: (json_extract(props, '$.k'))::bigint, t: event_type}))::bigint as size from events", pre=False)
def f31(spark, d):
    k = F.get_json_object("props", "$.k")
    both = F.to_json(F.struct(k.cast("long").alias("k"), F.col("event_type").alias("t")))
    return read(spark, d, "events").select("event_id", k.isNotNull().alias("has"), F.try_parse_json("props").isNotNull().alias("valid"), k.cast("long").alias("k"), F.char_length(both).cast("long").alias("size"))
