"""Named queries over the global rating, identity links, text events, forecast judging and further product views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import division_name
from ..operators import fitting, global_rating, identity, publishing, text_events
from ..operators.relational import latest_per_key
from ..sources.contests import contests, observations, read
from ..sources.texts import EMAIL, newer_rows, public_emails, versus_pairs
from ..streaming.results import membership_changes
from .catalog import AS_OF, predictions, query

SPLIT = "1999-01-01"


# The global rating: a fold over all contests, tested against a plain loop.
@query("r02_career_history", dates=("event_date",))
def r02(spark: SparkSession, d: str) -> DataFrame:
    return global_rating.career_history(contests(spark, d))


@query("r05_mirrored_differences", dates=("event_date",))
def r05(spark, d):
    return global_rating.mirrored_differences(r02(spark, d))


def fitted(history: DataFrame) -> dict[str, float]:
    return global_rating.fit_weights(global_rating.mirrored_differences(history), SPLIT)


@query("r06_fitted_weights")
def r06(spark, d):
    weights = fitted(r02(spark, d))
    return spark.createDataFrame(list(weights.items()), "measure string, weight double")


@query("r09_global_rating")
def r09(spark, d):
    """Ratings by weights fitted before SPLIT. The fold is kept, since the fit and four aggregates read it."""
    history = r02(spark, d).persist()
    return global_rating.rated(global_rating.current_measures(history), fitted(history))


R10 = """x as (select *, row_number() over (partition by entity_id order by event_date desc, seq desc) as rn from obs)
select entity_id, count(*)::bigint as bouts, (count(*) filter (won = 1 and finish))::bigint as finishes, (count(*) filter (won = 0 and finish))::bigint as finished,
  (count(*) filter (event_date >= date '2001-08-01' - 730))::bigint as recent, count(distinct division)::bigint as divisions,
  max(case when rn = 1 and event_date >= date '2001-08-01' - 730 then division end) as current_division from x group by 1"""


@query("r10_profiles", R10)
def r10(spark, d):
    recent = F.col("event_date") >= F.date_sub(F.lit(AS_OF).cast("date"), 730)
    last = F.max_by(F.struct("division", recent.alias("recent")), F.struct("event_date", "seq"))
    return observations(spark, d).groupBy("entity_id").agg(
        F.count("*").alias("bouts"), F.count_if((F.col("won") == 1) & F.col("finish")).alias("finishes"), F.count_if((F.col("won") == 0) & F.col("finish")).alias("finished"),
        F.count_if(recent).alias("recent"), F.count_distinct("division").alias("divisions"), F.when(last["recent"], last["division"]).alias("current_division"),
    )


@query("r11_unique_slugs", "select p_partkey, case when count(*) over (partition by p_size) > 1 then 'size-' || p_size || '-' || p_partkey else 'size-' || p_size end as slug from part", pre=False)
def r11(spark, d):
    parts = read(spark, d, "part").select("p_partkey", F.concat(F.lit("size-"), F.col("p_size").cast("string")).alias("s"))
    shared = parts.groupBy("s").agg((F.count("*") > 1).alias("shared"))
    return parts.join(shared, "s").select("p_partkey", F.when(F.col("shared"), F.concat_ws("-", "s", F.col("p_partkey").cast("string"))).otherwise(F.col("s")).alias("slug"))


M04 = """c as (select entity_id, event_date, seq, division, case when lag(division) over w <> division then 1 else 0 end as ch from obs window w as (partition by entity_id order by event_date, seq)),
s as (select *, sum(ch) over (partition by entity_id order by event_date, seq) as stint from c),
g as (select entity_id, stint, division, min(event_date) as debut from s group by all),
r as (select *, lag(division) over (partition by entity_id order by stint) as previous, row_number() over (partition by entity_id order by stint desc) as rn from g)
select entity_id, division, previous, debut, cast(debut - interval 2 year as date) as cutoff from r where rn = 1"""


@query("m04_transfer_scope", M04, dates=("debut", "cutoff"))
def m04(spark, d):
    w = Window.partitionBy("entity_id").orderBy("event_date", "seq")
    rows = observations(spark, d).select("entity_id", "event_date", "seq", "division")
    # Only rows that open a stint go on; the last two of an entity say it all.
    opens = rows.withColumn("p", F.lag("division").over(w)).where("p is null or p <> division")
    last = opens.groupBy("entity_id").agg(F.max_by(F.struct("division", F.col("p").alias("previous"), F.col("event_date").alias("debut")), F.struct("event_date", "seq")).alias("l"))
    return last.select("entity_id", "l.*").withColumn("cutoff", F.add_months("debut", -24))


# Identity.
@query("i02_overlays", """select c_custkey, case when c_custkey % 5 = 0 then c_custkey * 10 when c_custkey % 3 = 0 then c_custkey * 20 when c_custkey % 2 = 0 then c_custkey * 30 end as resolved_id,
  case when c_custkey % 5 = 0 then 'reviewed' when c_custkey % 3 = 0 then 'history' when c_custkey % 2 = 0 then 'name' end as method,
  case when c_custkey % 5 = 0 then 1.0 when c_custkey % 3 = 0 then 0.97 when c_custkey % 2 = 0 then 0.9 end::double as confidence from customer""", pre=False)
def i02(spark, d):
    k = F.col("c_custkey")
    rows = read(spark, d, "customer").select(k, *[F.when(k % m == 0, k * by).alias(c) for c, m, by in (("reviewed", 5, 10), ("history", 3, 20), ("name", 2, 30))])
    return rows.select("c_custkey", *identity.first_overlay([("reviewed", "reviewed", 1.0), ("history", "history", 0.97), ("name", "name", 0.9)]))


LINKS = """l as (select s_suppkey, s_suppkey % 40 as name, case when s_suppkey % 4 > 0 then s_suppkey % 9 end as born from supplier),
r as (select c_custkey, c_custkey % 300 % 60 + case when c_custkey > 40 then 30 else 0 end as name, case when c_custkey % 5 > 0 then c_custkey % 9 end as born from customer),
m as (select l.s_suppkey, count(*) as n, count(*) filter (l.born = r.born) as same, min(r.c_custkey) as one, min(r.c_custkey) filter (l.born = r.born) as other,
  count(*) filter (l.born <> r.born) as differ from l join r on l.name = r.name group by 1)
select s_suppkey, case when n = 1 then one else other end as c_custkey, case when n = 1 and same = 1 then 'name_birth' when n = 1 then 'unique_name' else 'birth_tiebreak' end as method,
  (case when n = 1 and same = 1 then 0.995 when n = 1 then 0.95 else 0.98 end)::double as confidence from m where (n = 1 and differ = 0) or (n > 1 and same = 1)"""


@query("i07_name_and_birth", "with " + LINKS, pre=False)
def i07(spark, d):
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    left = read(spark, d, "supplier").select(s, (s % 40).cast("string").alias("name"), F.when(s % 4 > 0, s % 9).alias("born"))
    right = read(spark, d, "customer").select(c, (c % 300 % 60 + F.when(c > 40, 30).otherwise(0)).cast("string").alias("name"), F.when(c % 5 > 0, c % 9).alias("born"))
    return identity.link_by_name(left, right, "s_suppkey", "c_custkey", "name", "born")


@query("i09_backfill", "select o_orderkey, coalesce(case when o_orderkey % 3 > 0 then o_custkey end, n_nationkey)::bigint as c from orders left join nation on n_nationkey = o_orderkey % 40", pre=False)
def i09(spark, d):
    k = F.col("o_orderkey")
    rows = read(spark, d, "orders").select(k, (k % 40).alias("k"), F.when(k % 3 > 0, F.col("o_custkey")).cast("long").alias("c"))
    return identity.backfill(rows, read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_nationkey").alias("c")), "k", "c").select("o_orderkey", "c")


@query("i10_history_audit", """h as (select o_custkey, count(*) as expected, max(cast(o_orderdate as date)) as last, count(*) filter (o_orderstatus = 'F') as found from orders group by 1)
select o_custkey, expected::bigint as expected, found::bigint as found, case when found = 0 then 'none' when found < expected then 'gap' else 'complete' end as coverage,
  case when date '2001-08-01' - last <= 14 then 'fresh' when date '2001-08-01' - last <= 60 then 'recent' else 'stale' end as freshness from h""".replace("h as", "with h as", 1), pre=False)
def i10(spark, d):
    rows = read(spark, d, "orders").select("o_custkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("day"))
    return identity.history_audit(rows, rows.where("o_orderstatus = 'F'"), "o_custkey", "day", AS_OF)


# Text events. The phrases and the events they must give, by order key.
HURT = [("He pulls out of Saturday's bout", "withdrawal"), ("Not yet medically cleared, he waits", "injury_disclosed"), ("She is cleared to compete again", "cleared_to_compete"), ("Pulls out a win late", None), ("A newcomer steps in on Friday", "replacement_announced"), ("Nothing new", None)]
TESTS = [("tested positive for a substance", "positive_test"), ("Provisionally suspended today", "flagged"), ("suspended until May", "suspended"), ("completed his 6-month suspension", "reinstated"), ("officially cleared for return", "cleared"), ("Sponsorship: suspended for", None)]
COACHES = [("He parts ways with longtime coach Eric Albarracin and moves", "parted_ways", "Eric Albarracin"), ("Her new coach is Ricky Lundell", "hired", "Ricky Lundell"), ("A coach spoke", None, None)]


def case(of: str, values: list) -> str:
    return f"case {of} " + " ".join(f"when {i} then " + ("null" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values)) + " end"


def topic_rows(spark, d, phrases: list[str]) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, phrases)), (F.col("o_orderkey") % len(phrases) + 1).cast("int"))
    return read(spark, d, "orders").select("o_orderkey", text.alias("t"))


def topic_query(name: str, topic: text_events.Topic, table: list[tuple]) -> None:
    sql = f"select * from (select o_orderkey, {case(f'o_orderkey % {len(table)}', [r[1] for r in table])} as event from orders) where event is not null"

    @query(name, sql, pre=False)
    def run(spark, d):
        rows = topic_rows(spark, d, [r[0] for r in table])
        return rows.where(text_events.has_signal(F.col("t"), topic)).select("o_orderkey", text_events.event_type(F.col("t"), topic).alias("event"))


topic_query("e06_injury_events", text_events.INJURY, HURT)
topic_query("e07_doping_events", text_events.DOPING, TESTS)
topic_query("e05_coach_events", text_events.COACH, COACHES)


@query("e05_coach_names", f"select o_orderkey, {case('o_orderkey % 3', [r[2] for r in COACHES])} as coach from orders", pre=False)
def e05(spark, d):
    return topic_rows(spark, d, [r[0] for r in COACHES]).select("o_orderkey", text_events.coach_name(F.col("t")).alias("coach"))


E08 = """with n as (select c_custkey as id, 'client no ' || c_custkey % 700 as name from customer), k as (select name, count(*) as c, min(id) as id from n group by 1),
t as (select o_orderkey, unnest([o_custkey % 700, o_orderkey % 900]) as v from orders)
select distinct o_orderkey, k.name, k.c > 1 as ambiguous, k.c::bigint as profiles from t join k on k.name = 'client no ' || v"""


@query("e08_mentions", E08, pre=False)
def e08(spark, d):
    names = read(spark, d, "customer").select("c_custkey", F.concat(F.lit("Client No. "), (F.col("c_custkey") % 700).cast("string")).alias("n"))
    text = F.concat(F.lit("Deal: Client No. "), (F.col("o_custkey") % 700).cast("string"), F.lit(" met (client no "), (F.col("o_orderkey") % 900).cast("string"), F.lit(")!"))
    found = text_events.mentions(read(spark, d, "orders").select("o_orderkey", text.alias("t")), names, "o_orderkey", "t", "c_custkey", "n")
    return found.select("o_orderkey", "name", "ambiguous", F.size("name_ids").cast("long").alias("profiles"))


@query("e10_candidates", """with x as (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as rn from events)
select sha256('u' || user_id || '|' || event_type || '|' || event_type) as key, event_type as event, event_id::varchar as summary, case when user_id % 2 = 0 then 'needs_identity' else 'pending' end as status from x where rn = 1""", pre=False)
def e10(spark, d):
    rows = read(spark, d, "events").select("event_id", "ts", "event_type", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("event_id").cast("string").alias("s"), (F.col("user_id") % 2 == 0).alias("amb"))
    return text_events.candidates(rows, "url", "event_type", "event_type", "s", "amb", [F.asc("ts"), F.asc("event_id")]).select("key", "event", "summary", "status")


@query("e12_record_basis", "select * from (select o_orderkey, case when o_orderkey % 4 = 0 or o_custkey % 5 = 0 then 'needs_identity' when o_orderkey % 3 = o_custkey % 3 then 'pending' end as status from orders) where status is not null", pre=False)
def e12(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return read(spark, d, "orders").select(k, text_events.record_basis(F.when(k % 4 > 0, k % 3), F.when(c % 5 > 0, c % 3)).alias("status")).where("status is not null")


# Forecasts.
@query("x05_drivers", """x as (select seq, list_transform(list_slice(list_sort(list_filter([{k: -abs(a_qty - b_qty), name: 'volume', v: a_qty - b_qty}, {k: -abs(b_ret - a_ret) * 5.0, name: 'returns', v: (b_ret - a_ret) * 5.0}, {k: -abs(a_lines - b_lines) * 3.0, name: 'length', v: (a_lines - b_lines) * 3.0}, {k: -abs(a_qty - b_qty) / 2, name: 'pace', v: (b_qty - a_qty) / 2}], lambda z: z.k < 0)), 1, 3), lambda z: z.name || ' ' || round(z.v, 1)::double) as l from contests)
select seq, array_to_string(l, ', ') as drivers from x""")
def x05(spark, d):
    def gap(m: str, a: str = "a", b: str = "b"):
        return (F.col(f"{a}_{m}") - F.col(f"{b}_{m}")).cast("double")

    rows = contests(spark, d).select("seq", fitting.drivers({"volume": gap("qty"), "returns": gap("ret", "b", "a") * 5, "length": gap("lines") * 3, "pace": gap("qty", "b", "a") / 2}).alias("l"))
    return rows.select("seq", F.array_join(F.transform("l", lambda x: F.concat_ws(" ", x["name"], F.round(x["value"], 1).cast("string"))), ", ").alias("drivers"))


@query("x13_paired_bootstrap")
def x13(spark, d):
    low, high = fitting.paired_bootstrap(predictions(spark, d).withColumn("half", F.lit(0.5)), "event_date", "p", "half", "y")
    return spark.createDataFrame([(low, high)], "low double, high double")


# Names of classes and addresses in pages.
TITLES = [("Light Heavyweight Bout", "Light Heavyweight"), ("UFC Interim Heavyweight Title Bout", "Heavyweight"), ("Womens Flyweight Bout", "Women's Flyweight"), ("Catch Weight Bout", "Catch Weight"), ("Road to UFC 2 Superfight", "Superfight"), ("", "Unknown")]


@query("f09_division_names", f"select o_orderkey, {case('o_orderkey % 6', [r[1] for r in TITLES])} as division from orders", pre=False)
def f09(spark, d):
    return topic_rows(spark, d, [r[0] for r in TITLES]).select("o_orderkey", division_name(F.col("t")).alias("division"))


@query("s16_public_emails", f"select page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(coalesce(html, '')), '{EMAIL}'))), ' ') as emails from pages", pre=False)
def s16(spark, d):
    return read(spark, d, "pages").select("page_id", F.array_join(public_emails(F.col("html")), " ").alias("emails"))


@query("s14_versus_pairs", "with x as (select o_orderkey, o_custkey % 10 as a, o_orderkey % 7 as b from orders) select o_orderkey, 'Side ' || a as a, 'Side ' || b as b from x where a <> b", pre=False)
def s14(spark, d):
    title = F.concat(F.lit("Side "), (F.col("o_custkey") % 10).cast("string"), F.lit(" vs. Side "), (F.col("o_orderkey") % 7).cast("string"))
    return versus_pairs(read(spark, d, "orders").select("o_orderkey", title.alias("t")), "o_orderkey", "t")


@query("k15_current_takeover", "select event_id, user_id, (event_type = 'purchase' and row_number() over (partition by user_id, event_type = 'purchase' order by ts desc, event_id desc) = 1) as current from events", pre=False)
def k15(spark, d):
    rows = read(spark, d, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "purchase").alias("current"))
    return publishing.current_takeover(rows, "user_id", "current", [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("k17_matched_load", "with k as (select c_nationkey as n, count(*) as c, min(c_custkey) as t from customer where c_custkey <= 20 group by 1) select s_suppkey, case when c = 1 then t end as c_custkey, case when c = 1 then 'matched' when c > 1 then 'ambiguous' else 'unmatched' end as outcome from supplier left join k on n = s_nationkey", pre=False)
def k17(spark, d):
    known = read(spark, d, "customer").where("c_custkey <= 20").select(F.col("c_nationkey").alias("n"), "c_custkey")
    return publishing.matched_load(read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n")), known, "n", "c_custkey").drop("n")


@query("s18_newer_rows", "select o_orderkey, cast(o_orderdate as date) as day from orders where o_orderkey % 2 = 0 or cast(o_orderdate as date) > (select max(cast(o_orderdate as date)) from orders where o_orderkey % 2 = 0)", pre=False, dates=("day",))
def s18(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return newer_rows(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 2 = 1"), "day")


# Product views.
@query("q01_entity_search", "select c_custkey, c_name, c_acctbal from customer where lower(c_name) like '%12%' order by c_acctbal desc, c_custkey limit 20", pre=False)
def q01(spark, d, text: str = "12", most: int = 20):
    rows = read(spark, d, "customer").where(F.contains(F.lower("c_name"), F.lit(text.lower())))
    return rows.select("c_custkey", "c_name", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(most)


@query("q12_facets", "select c_mktsegment, case when c_acctbal < 0 then 'owing' when c_acctbal < 5000 then 'some' else 'much' end as band, count(*)::bigint as n from customer where exists (select 1 from orders where o_custkey = c_custkey) group by 1, 2", pre=False)
def q12(spark, d):
    band = F.when(F.col("c_acctbal") < 0, "owing").when(F.col("c_acctbal") < 5000, "some").otherwise("much").alias("band")
    held = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").join(held, "c_custkey", "left_semi").groupBy("c_mktsegment", band).agg(F.count("*").alias("n"))


@query("q18_coverage", """select user_id, count(distinct event_type)::bigint as kinds, (4 - least(4, count(distinct event_type)))::bigint as missing, cast(max(ts) as date) as last_day from events group by 1
order by missing desc, last_day, user_id limit 300""", pre=False, dates=("last_day",))
def q18(spark, d, kinds: int = 4, most: int = 300):
    rows = read(spark, d, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds"), F.max("ts").cast("date").alias("last_day"))
    return rows.withColumn("missing", (kinds - F.least(F.lit(kinds), "kinds")).cast("long")).orderBy(F.desc("missing"), "last_day", "user_id").limit(most)


@query("q26_entity_index", """x as (select *, row_number() over (partition by entity_id order by event_date desc, seq desc) as rn from obs)
select entity_id, count(*)::bigint as bouts, sum(won)::double as wins, max(case when rn = 1 then division end) as division, max(case when rn = 1 then opponent_id end) as last_opponent, max(case when rn = 1 then won end)::double as last_won from x group by 1""")
def q26(spark, d):
    last = F.max_by(F.struct("division", "opponent_id", "won"), F.struct("event_date", "seq"))
    rows = observations(spark, d).groupBy("entity_id").agg(F.count("*").alias("bouts"), F.sum("won").alias("wins"), last.alias("l"))
    return rows.select("entity_id", "bouts", "wins", F.col("l.division").alias("division"), F.col("l.opponent_id").alias("last_opponent"), F.col("l.won").alias("last_won"))


@query("q27_next_contest", """x as (select *, row_number() over (partition by entity_id order by event_date, seq) as rn from obs where event_date >= date '1998-01-01')
select entity_id, seq, opponent_id, event_date from x where rn = 1""", dates=("event_date",))
def q27(spark, d, today: str = "1998-01-01"):
    rows = observations(spark, d).where(F.col("event_date") >= F.lit(today).cast("date"))
    return latest_per_key(rows, ["entity_id"], [F.asc("event_date"), F.asc("seq")]).select("entity_id", "seq", "opponent_id", "event_date")


@query("q29_threads", "select user_id, count(*)::bigint as posts, (count(*) filter (event_type = 'purchase'))::bigint as replies, round(sum(value), 2) as total from events group by 1 order by posts desc, user_id limit 50", pre=False)
def q29(spark, d):
    rows = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("posts"), F.count_if(F.col("event_type") == "purchase").alias("replies"), F.round(F.sum("value"), 2).alias("total"))
    return rows.orderBy(F.desc("posts"), "user_id").limit(50)


@query("q30_report_rollup", "select user_id, count(*)::bigint as reports, string_agg(distinct event_type, ',' order by event_type) as reasons from events group by 1 having count(distinct event_type) > 1", pre=False)
def q30(spark, d):
    rows = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("reports"), F.array_sort(F.collect_set("event_type")).alias("r"))
    return rows.where(F.size("r") > 1).select("user_id", "reports", F.array_join("r", ",").alias("reasons"))


@query("q33_review_queue", "select o_orderstatus as status, count(*)::bigint as n, (count(*) filter (o_totalprice > 200000))::bigint as urgent, min(cast(o_orderdate as date)) as oldest from orders group by 1", pre=False, dates=("oldest",))
def q33(spark, d):
    return read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("urgent"), F.min(F.col("o_orderdate").cast("date")).alias("oldest"))


@query("q38_recent_events", "select o_orderkey, o_orderpriority, cast(o_orderdate as date) as day from orders where o_orderpriority = '1-URGENT' and cast(o_orderdate as date) >= date '1998-06-01' - 45 order by day, o_orderkey", pre=False, dates=("day",))
def q38(spark, d, division: str = "1-URGENT", today: str = "1998-06-01"):
    rows = read(spark, d, "orders").where((F.col("o_orderpriority") == division) & (F.col("o_orderdate") >= F.date_sub(F.lit(today).cast("date"), 45).cast("timestamp")))
    return rows.select("o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("day")).orderBy("day", "o_orderkey")


@query("z06_scoring_window", """g as (select event_date, max(seq) as last_seq, count(*)::bigint as n from contests group by 1)
select event_date, n, last_seq, cast(event_date + interval 48 hour as date) as closes, event_date + interval 48 hour > timestamp '1998-06-01' as open from g""", dates=("event_date", "closes"))
def z06(spark, d, now: str = "1998-06-01"):
    rows = contests(spark, d).groupBy("event_date").agg(F.max("seq").alias("last_seq"), F.count("*").alias("n"))
    return rows.withColumns({"closes": F.date_add("event_date", 2), "open": F.date_add("event_date", 2).cast("timestamp") > F.lit(now).cast("timestamp")})


@query("z07_membership_changes", """with b as (select distinct user_id, event_type from events where event_id % 3 = 0), a as (select distinct user_id, event_type from events where event_id % 5 = 0)
select *, 'added' as change from (select * from a except select * from b) union all select *, 'removed' from (select * from b except select * from a)""", pre=False)
def z07(spark, d):
    rows = read(spark, d, "events")
    return membership_changes(rows.where("event_id % 3 = 0"), rows.where("event_id % 5 = 0"), ["user_id", "event_type"])
